"""Folders written once per micro-batch, so that a replayed batch changes nothing."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from clicktrail.sources.storage import Storage

_BATCH = re.compile(r"batch_id=(\d+)")


class BatchFolders:
    """Folders ``batch_id=N`` under a root, each of which appears whole and at once.

    A batch is written aside and its folder renamed into place. The rename is the commit: what
    is in place is complete and never written again, so readers, streams too, see all of a
    batch or nothing, and a replayed batch finds it there. What a lost driver left aside is
    overwritten. Renaming a folder has to be one step, as it is on HDFS and local disks; it is
    not on plain object stores.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
        self.columns = schema.fieldNames()
        self.storage = Storage(spark)
        self.storage.make(self.root)

    def path(self, batch_id: int) -> str:
        return f"{self.root}/batch_id={batch_id}"

    def has(self, batch_id: int) -> bool:
        return self.storage.exists(self.path(batch_id))

    def complete(self) -> list[int]:
        found = (_BATCH.fullmatch(name) for name in self.storage.names(self.root))
        return sorted(int(m.group(1)) for m in found if m)

    def publish(self, df: DataFrame, batch_id: int) -> None:
        """Write a batch unless it is there already."""
        if self.has(batch_id):
            return
        aside = f"{self.root}/_aside/batch_id={batch_id}"
        df.select(*self.columns).write.mode("overwrite").parquet(aside)
        self.storage.move(aside, self.path(batch_id))

    def publish_rows(self, df: DataFrame, batch_id: int) -> None:
        """As :meth:`publish`, but without rows there is no folder either."""
        if self.has(batch_id):
            return
        df = df.persist()       # looked at and written, computed once
        try:
            if not df.isEmpty():
                # few rows are few files under adaptive execution
                self.publish(df.hint("rebalance"), batch_id)
        finally:
            df.unpersist()

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those below ``before``, with their ``batch_id``."""
        rows = self.spark.read.schema(self.schema).parquet(self.root)
        return rows if before is None else rows.where(rows["batch_id"] < before)

    def batch(self, batch_id: int) -> DataFrame:
        """Rows of one batch; none if there is no such folder."""
        if not self.has(batch_id):
            return self.spark.createDataFrame([], self.schema).select(*self.columns)
        rows = self.spark.read.schema(self.schema).option("basePath", self.root).parquet(self.path(batch_id))
        return rows.select(*self.columns)

    def remove(self, batch_id: int) -> None:
        self.storage.remove(self.path(batch_id))
