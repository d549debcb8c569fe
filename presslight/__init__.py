"""presslight: media-coverage analytics as PySpark DataFrame operators."""
