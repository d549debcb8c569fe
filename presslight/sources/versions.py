"""Tables whose versions are never changed, and a pointer that moves to the next version at once (SK-06, SS-05, ST-12).

Below the path of a set of tables, `data` holds a folder for each written table and `manifests` one small file for each version, which
names the folders of all tables of that version. A version is there when its manifest is: the file is written under another
name and renamed, which fails where a manifest of that number is there already. So several tables change together or not at
all, a failed write leaves no trace but folders that no manifest names, and a reader sees one version only, whatever is written meanwhile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has published the version first."""


class VersionedTables:
    """A set of tables at a path of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        """Numbers of the versions that are kept, ascending."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json") and n[0] != "_")

    def manifest(self, version: int | None = None) -> dict:
        """version, epoch and tables (name -> folder and schema) of a version, the newest by default; version 0 has none."""
        found = self.versions()
        version = (found[-1] if found else 0) if version is None else version
        if version == 0:
            return {"version": 0, "epoch": None, "tables": {}}
        if version not in found:
            raise LookupError(f"no version {version}")
        stream = self._fs.open(self._path(f"{self.path}/manifests/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version. Only the files of that version are listed and read."""
        return self._table(self.manifest(version), name)

    def _table(self, manifest: dict, name: str) -> DataFrame:
        from pyspark.sql.types import StructType

        found = manifest["tables"][name]
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(f"{self.path}/{found['folder']}")

    def publish(self, make: Callable[[Callable[[str], DataFrame | None]], dict[str, DataFrame]], epoch: int | None = None) -> int:
        """Publishes what `make` returns as the next version's tables; the others stay as they are. Returns the version.

        `make` gets a function from a table's name to the table (None where there is none yet), all of one version. An
        epoch that is not above the last published one has been delivered before: nothing is written then.
        """
        last = self.manifest()
        if epoch is not None and last["epoch"] is not None and epoch <= last["epoch"]:
            return last["version"]
        tables = dict(last["tables"])
        for name, df in make(lambda name: self._table(last, name) if name in last["tables"] else None).items():
            folder = f"data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            tables[name] = {"folder": folder, "schema": json.loads(df.schema.json())}
        version = last["version"] + 1
        self._point(version, {"version": version, "epoch": last["epoch"] if epoch is None else epoch, "tables": tables})
        return version

    def _point(self, version: int, manifest: dict) -> None:
        new, final = (self._path(f"{self.path}/manifests/{n}") for n in (f"_{uuid.uuid4().hex}", f"{version:012d}.json"))
        out = self._fs.create(new, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        # local file systems replace on rename, so the target is looked for first; others refuse
        if self._fs.exists(final) or not self._fs.rename(new, final):
            self._fs.delete(new, False)
            raise Conflict(f"version {version} of {self.path} is there already")

    def expire(self, keep: int = 2) -> list[str]:
        """Deletes all but the last `keep` versions, and folders that none of these names; returns what was deleted.

        Readers of older versions must be done, and no writer may be at work: its folders have no name yet.
        """
        found = self.versions()
        old, kept = found[: max(0, len(found) - max(1, keep))], found[-max(1, keep) :]
        named = {t["folder"] for v in kept for t in self.manifest(v)["tables"].values()}
        gone = [f"manifests/{v:012d}.json" for v in old] + [f"data/{n}" for n in self._names("data") if f"data/{n}" not in named]
        for name in gone:  # manifests first, so that no version is named whose data are gone
            self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return gone
