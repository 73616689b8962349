"""Folders that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from clicktrail.sources.storage import Storage


def shared_root(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names, or the warehouse where it is unset.

    On a cluster the warehouse has to lie on storage that all nodes reach; one on the driver's
    own disk is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
        if root.startswith("file:") and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes reach")
    return root.rstrip("/")


def _mark(spark: SparkSession) -> str:
    return f"clicktrail-{spark.sparkContext.applicationId}-"


def work_folder(spark: SparkSession, name: str = "work") -> str:
    """A new folder name under :func:`shared_root`, marked with the application's id."""
    return f"{shared_root(spark)}/{_mark(spark)}{name}-{uuid.uuid4().hex}"


def remove_work(spark: SparkSession) -> int:
    """Remove the folders that this application made under :func:`shared_root`; returns how many.

    Frames that read them can no longer be computed.
    """
    storage, root = Storage(spark), shared_root(spark)
    names = [name for name in storage.names(root) if name.startswith(_mark(spark))]
    for name in names:
        storage.remove(f"{root}/{name}")
    return len(names)


def stash(df: DataFrame, name: str = "stash") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: what follows survives lost executors without running what came
    before again, and two readers see the same rows.
    """
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
