"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution joins skewed partitions in pieces; forcing it keeps that true where a
# later aggregation reuses the join's partitioning.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

STATE_PARTITIONS = "waymark.state.partitions"
ROCKSDB_PROVIDER = (
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
)


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "waymark", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def streaming_session(spark: SparkSession) -> SparkSession:
    """A sibling session for stateful streams; the caller's settings stay untouched.

    State partitions are fixed for the life of a checkpoint. ``waymark.state.partitions``
    sets their number; choose it for the largest cluster the stream shall grow to. Without
    the setting they follow the core count of the first start. RocksDB keeps state on disk
    instead of the executor heap.
    """
    sibling = spark.newSession()
    for key, value in SQL_SETTINGS.items():
        sibling.conf.set(key, value)
    partitions = spark.conf.get(STATE_PARTITIONS, None) or spark.sparkContext.defaultParallelism
    sibling.conf.set("spark.sql.shuffle.partitions", str(max(1, int(partitions))))
    sibling.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    return sibling
