"""Tables that are replaced whole: every write is a folder of its own, and one small file says which folder counts.

A write goes to a fresh folder first. Only when all of it is there is the pointer file written beside the old one and
renamed over it, which readers see as one step. A write that dies half-way leaves the pointer, and so the table, as it
was; its folder is swept up by a later ``remove_old``. Readers that have resolved the pointer go on with their folder
while a newer one is being put in its place.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of a row group in a table laid out for lookups.
LOOKUP_GROUP_BYTES = 1 << 20
POINTER = "_current"
VERSIONS = "versions"


class _Files:
    """The file system that holds a table, whatever it is."""

    def __init__(self, spark: SparkSession, table: str) -> None:
        self.sc = spark.sparkContext
        self.fs = self.path(table).getFileSystem(self.sc._jsc.hadoopConfiguration())

    def path(self, path: str):
        return self.sc._jvm.org.apache.hadoop.fs.Path(path)

    def read(self, path: str) -> str | None:
        if not self.fs.exists(self.path(path)):
            return None
        stream = self.fs.open(self.path(path))
        try:
            return bytes(stream.readNBytes(4096)).decode()
        finally:
            stream.close()

    def replace(self, path: str, said: str) -> None:
        """Write ``said`` to a new file and rename that over ``path``."""
        fresh = self.path(f"{path}.{uuid.uuid4().hex}")
        stream = self.fs.create(fresh, True)
        stream.write(bytearray(said.encode()))
        stream.close()
        hadoop = self.sc._jvm.org.apache.hadoop.fs
        how = self.sc._gateway.new_array(hadoop.Options.Rename, 1)
        how[0] = hadoop.Options.Rename.OVERWRITE
        context = hadoop.FileContext.getFileContext(self.fs.getUri(), self.sc._jsc.hadoopConfiguration())
        context.rename(self.fs.makeQualified(fresh), self.fs.makeQualified(self.path(path)), how)

    def folders(self, path: str) -> list[str]:
        if not self.fs.exists(self.path(path)):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(path)) if s.isDirectory())

    def delete(self, path: str) -> None:
        self.fs.delete(self.path(path), True)


def current_version(spark: SparkSession, table: str) -> str | None:
    """Name of the folder that counts, None before the first finished write."""
    return _Files(spark, table).read(f"{table}/{POINTER}")


def write_snapshot(df: DataFrame, table: str, lookup: str | None = None) -> str:
    """Replace the table by ``df``; returns the new version. ``df`` may read the table itself.

    With ``lookup`` rows are laid out for reading a single value of that column: sorted over all files, so that their
    row groups' bounds tell which may hold it, in small row groups with a bloom filter each.
    """
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = df.write
    if lookup:
        laid = df.repartitionByRange(F.col(lookup)).sortWithinPartitions(lookup)
        filters = {f"parquet.bloom.filter.enabled#{lookup}": "true", "parquet.block.size": str(LOOKUP_GROUP_BYTES)}
        writer = laid.write.options(**filters)
    writer.parquet(f"{table}/{VERSIONS}/{version}")
    _Files(df.sparkSession, table).replace(f"{table}/{POINTER}", version)
    return version


def read_snapshot(spark: SparkSession, table: str, version: str | None = None) -> DataFrame:
    """The table as it is now, or as it was at ``version``."""
    version = version or current_version(spark, table)
    if version is None:
        raise FileNotFoundError(f"no finished write of {table}")
    return spark.read.parquet(f"{table}/{VERSIONS}/{version}")


def remove_old(spark: SparkSession, table: str, keep: int = 1) -> list[str]:
    """Delete versions that don't count, but for the ``keep`` last ones before the current one; returns their names.

    Versions after the current one are writes under way or dead, and go only once a later write has been finished.
    """
    files, current = _Files(spark, table), current_version(spark, table)
    before = [v for v in files.folders(f"{table}/{VERSIONS}") if current is not None and v < current]
    gone = before[: len(before) - keep] if keep else before
    for version in gone:
        files.delete(f"{table}/{VERSIONS}/{version}")
    return gone
