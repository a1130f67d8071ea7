"""Keyed stores of rows under one shared folder: the last write of a key wins, deletes are writes too.

A write is a sub-folder that counts once its marker is there, so a lost job leaves nothing half done; the number of a write
orders it. Reading is one scan and one aggregation by key.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacre.sources.tables import written


class Store:
    """Rows by a key column."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: str) -> None:
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _writes(self) -> list[str]:
        """Names of finished writes, in order."""
        root = self._path(f"{self.folder}/finished")
        return sorted(str(s.getPath().getName()) for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def put(self, rows: DataFrame, gone: bool = False) -> None:
        """Adds rows; of rows with one key in one write any may stay."""
        name = f"{len(self._writes()):08d}-{uuid.uuid4().hex}"
        rows.withColumns({"_gone": F.lit(gone), "_write": F.lit(name)}).write.parquet(f"{self.folder}/rows/{name}")
        self._fs.mkdirs(self._path(f"{self.folder}/finished/{name}"))

    def delete(self, keys: DataFrame) -> DataFrame:
        """Removes keys; returns (key, present): whether each was there."""
        k = keys.select(self.key).distinct()
        there = k.join(self.all().select(self.key, F.lit(True).alias("present")), self.key, "left").withColumn("present", F.coalesce("present", F.lit(False)))
        there = written(there, "deleted")  # as it was before the write
        self.put(k, gone=True)
        return there

    def all(self) -> DataFrame:
        """The rows that are there now."""
        names = self._writes()
        kind = f"{self.schema}, _gone boolean, _write string"
        if not names:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(kind).parquet(*(f"{self.folder}/rows/{n}" for n in names))
        columns = [c for c in rows.columns if c not in (self.key, "_write")]
        last = rows.groupBy(self.key).agg(F.max_by(F.struct(*columns), "_write").alias("_r")).where("not _r._gone")
        return last.select(self.key, *(F.col(f"_r.{c}").alias(c) for c in columns if c != "_gone"))

    def get(self, key: str) -> DataFrame:
        return self.all().where(F.col(self.key) == key)
