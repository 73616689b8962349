"""Session settings the operators rely on."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Day, hour and minute labels depend on the session time zone, so it is pinned.
TIME_ZONE = "UTC"

BATCH_CONF = {
    "spark.sql.session.timeZone": TIME_ZONE,
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

STREAM_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a restarted query opens the state's files; it does not put every key ever written again
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "false",
    # otherwise each key is looked up once more to be counted
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}


def configure(spark: SparkSession, time_zone: str = TIME_ZONE, streaming: bool = False) -> SparkSession:
    """Set the runtime options on an existing session and return it.

    Partition counts are left to the cluster: set
    ``spark.sql.adaptive.coalescePartitions.initialPartitionNum`` to several times the
    core count there and let adaptive execution merge small partitions.
    """
    conf = {**BATCH_CONF, **(STREAM_CONF if streaming else {})}
    conf["spark.sql.session.timeZone"] = time_zone
    for key, value in conf.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def adaptive(spark: SparkSession) -> Iterator[None]:
    """Adaptive execution for the frames computed within.

    A stateful stream's session has it off, since the number of its state's partitions is fixed.
    What is computed from a micro-batch that is there already is not bound by that.
    """
    key = "spark.sql.adaptive.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
