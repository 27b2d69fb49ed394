"""Intermediate tables in the shared folder: they cut the lineage and survive executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from inkfold.session import shared_dir


class Landing:
    """Writes tables, reads them back, and deletes those that are not needed any more."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose = spark, purpose
        self.paths: dict[int, str] = {}

    def land(self, df: DataFrame) -> DataFrame:
        path = shared_dir(self.spark, self.purpose)
        df.write.parquet(path)
        # Spark deletes the shuffle files of a plan once the driver has let go of it.
        self.spark.sparkContext._jvm.System.gc()
        # The schema is known: no job to find it out, also for a table without rows.
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = path
        table._landed_path = path
        return table

    def land_bucketed(self, df: DataFrame, buckets: int, column: str) -> DataFrame:
        """The same with the rows of a column's value in one bucket: joins and aggregates on it
        need no shuffle.  Without a shuffle before it, each task writes a file a bucket it has."""
        path, name = shared_dir(self.spark, self.purpose), f"bucketed_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").saveAsTable(name)
        self.spark.sparkContext._jvm.System.gc()
        table = self.spark.table(name)
        # The plan holds files and buckets; the catalog, which others may share, need not.
        self.spark.sql(f"DROP TABLE {name}")
        table._landed_path = path
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete landed tables that no later result reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._landed_path)
            path.getFileSystem(conf).delete(path, True)
