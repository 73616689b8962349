"""Batch sinks. Writing is left to Spark's own writers, one connection per task."""

from __future__ import annotations

from pyspark.sql import DataFrame


def overwrite_table(
    df: DataFrame, name: str, database: str | None = None, fmt: str = "parquet",
    buckets: int | None = None, by: str | None = None,
) -> None:
    """Replace a catalog table by ``df``.

    With ``buckets``, rows are dealt by the column ``by`` and sorted by it. Tables of as many
    buckets are joined by that column without moving a row. All rows of a key lie in one
    bucket then, so a log in which one key has most of the rows is better left as it is.
    """
    writer = df.write.format(fmt).mode("overwrite")
    if buckets:
        writer = writer.bucketBy(buckets, by).sortBy(by)
    writer.saveAsTable(f"{database}.{name}" if database else name)


def append_sink(df: DataFrame, fmt: str = "jdbc", path: str | None = None, **options) -> None:
    """Append ``df`` to a JDBC table (options ``url``, ``dbtable``, ``user``, ``password``)
    or, with another format and a path, to files."""
    df.write.format(fmt).mode("append").options(**options).save(path)


def replace_parts(df: DataFrame, path: str, *parts: str, fmt: str = "parquet") -> None:
    """Write ``df`` to files, replacing the partitions it has rows of and no others.

    An append that may be tried again: with the task's or the batch's number among ``parts``,
    writing twice leaves one copy, and what others wrote stays.
    """
    df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).save(path)
