"""Tables written to the cluster's shared folder, so that a lost executor costs a re-read and no recomputation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tokenloom.cluster import shared_folder


class Scratch:
    """One operator run's tables below the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/tokenloom-{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: dict[int, tuple[DataFrame, str]] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
        """Writes ``df`` once, by ``tasks`` tasks at most, and returns a scan of what was written."""
        path = self.path(name)
        if tasks is not None:
            df = df.coalesce(tasks)
        df.write.mode("overwrite").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._saved[id(table)] = (table, path)
        return table

    def delete(self, *tables: DataFrame) -> None:
        """Removes tables that ``save`` returned and that no later plan reads."""
        fs = self.spark._jvm.org.apache.hadoop.fs
        for table in tables:
            _, name = self._saved.pop(id(table))
            path = fs.Path(name)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
