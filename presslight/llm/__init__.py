"""Operators for training-data pipelines; nothing else in presslight imports this subpackage."""
