"""Tables replaced as a whole, several at once, by switching one version marker.

Parquet has no transactions: a change of related tables (an import that touches
teams, participants and memberships, or a snapshot of all outputs) is written
beside the old rows, into a folder of its own, and counts only once a marker
file of the next version number names that folder. Creating the marker is the
only step that readers notice, and the file system lets one writer create it,
so a failed or beaten writer leaves the old version as it was.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class VersionConflict(RuntimeError):
    """Another writer committed the same version first."""


class VersionedTables:
    """Named parquet tables under ``path`` that change together."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        """Committed versions, oldest first; a marker without content is a commit under way."""
        fs, p = self._at("_versions")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getLen() > 0)

    def _folder(self, version: int) -> str:
        fs, p = self._at("_versions", f"{version:012d}")
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def read(self, name: str, version: int | None = None) -> DataFrame | None:
        """Table ``name`` of a version (the current one by default); None if it was never written."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        path = f"{self.path}/{self._folder(version)}/{name}"
        fs, p = self._at(self._folder(version), name)
        return self.spark.read.parquet(path) if fs.exists(p) else None

    def commit(self, frames: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None) -> int:
        """Write all ``frames`` and make them the next version; readers see all of them or none."""
        known = self.versions()
        version = (known[-1] if known else 0) + 1
        folder = f"data/{version:012d}-{uuid.uuid4().hex}"
        for name, df in frames.items():
            out = df.write.option("compression", "zstd")
            if partition_by and partition_by.get(name):
                out = out.partitionBy(*partition_by[name])
            out.parquet(f"{self.path}/{folder}/{name}")
        fs, p = self._at("_versions", f"{version:012d}")
        try:
            stream = fs.create(p, False)
        except Exception as e:  # the marker exists: somebody else made this version
            raise VersionConflict(f"version {version} of {self.path} was committed by another writer") from e
        stream.write(bytearray(folder.encode()))
        stream.close()
        return version
