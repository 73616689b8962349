"""Streaming sources of ad log lines; each gives one column ``value`` of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Fixed value: the topic of the ad log.
TOPIC = "ads_log"


def topic_lines(
    spark: SparkSession, servers: str, topic: str = TOPIC, group_id: str | None = None,
    starting: str = "latest", **options,
) -> DataFrame:
    """Record values of a Kafka topic. Offsets are kept in the query's checkpoint.

    Needs the Kafka connector on the class path. ``maxOffsetsPerTrigger`` bounds a batch.
    Without ``group_id`` Spark makes one per query; queries that share one would each see
    a part of the topic only.
    """
    if group_id is not None:
        options["kafka.group.id"] = group_id
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .options(**options)
        .load()
        .selectExpr("CAST(value AS STRING) AS value")
    )


def file_lines(spark: SparkSession, path: str, **options) -> DataFrame:
    """Lines of the text files that appear under ``path``."""
    return spark.readStream.format("text").options(**options).load(path).select("value")
