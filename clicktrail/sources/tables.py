"""Batch sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clicktrail.schemas import INPUT_TABLES, conform


def read_table(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    """A catalog table; the clickstream tables are checked against their schema."""
    df = spark.table(f"{database}.{name}" if database else name)
    return conform(df, INPUT_TABLES[name], name) if name in INPUT_TABLES else df


def read_files(spark: SparkSession, name: str, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """One of the clickstream tables, read from files."""
    return conform(spark.read.format(fmt).options(**options).load(path), INPUT_TABLES[name], name)
