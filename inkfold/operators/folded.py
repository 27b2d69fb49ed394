"""A table that is replaced as a whole: small results that batches are folded into.

Each version is a folder of its own.  A version counts once it is written to the end, so a
reader sees the old one or the new one, and a job that dies leaves the old one.  The version
before stays for readers that have begun; older ones are deleted.  One writer at a time.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_MARK = "version="


class FoldedTable:
    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root = spark, root
        self.schema = StructType.fromDDL(schema)
        context = spark.sparkContext
        self._path = context._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(root).getFileSystem(context._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """The whole versions, at most two and one that is being written."""
        folder = self._path(self.root)
        if not self._files.exists(folder):
            return []
        found = [s.getPath().getName() for s in self._files.listStatus(folder)]
        numbers = sorted(int(name.removeprefix(_MARK)) for name in found if name.startswith(_MARK))
        return [n for n in numbers if self._files.exists(self._path(os.path.join(self._folder(n), "_SUCCESS")))]

    def _folder(self, version: int) -> str:
        return os.path.join(self.root, f"{_MARK}{version}")

    def read(self) -> DataFrame:
        """The newest whole version; no rows before the first."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(known[-1]))

    def replace(self, rows: DataFrame) -> DataFrame:
        """Make these rows, which may be made from the present version, the newest one."""
        known = self.versions()
        rows.select(*self.schema.names).write.mode("overwrite").parquet(self._folder(known[-1] + 1 if known else 0))
        for old in known[:-1]:
            self._files.delete(self._path(self._folder(old)), True)
        return self.read()
