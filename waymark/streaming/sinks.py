"""Starting streams and reading what they wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from waymark.operators.flags import flags_for_users

# How often changed counters are saved, and how often predictions and specs
# are refreshed.
SNAPSHOT_INTERVAL = "60 seconds"
REFRESH_INTERVAL = "15 seconds"


def write_append(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    return (stream.writeStream.outputMode("append").format("parquet")
            .option("path", path).option("checkpointLocation", checkpoint))


def write_batches(stream: DataFrame, path: str, checkpoint: str,
                  mode: str = "append") -> DataStreamWriter:
    """Each micro-batch overwrites its own folder, so a repeated batch leaves one copy."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (stream.writeStream.outputMode(mode).foreachBatch(write)
            .option("checkpointLocation", checkpoint))


def read_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(with_batch).parquet(path)


def run_available(writer: DataStreamWriter) -> None:
    """Process everything that has arrived, then stop."""
    query: StreamingQuery = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def run_every(writer: DataStreamWriter, interval: str) -> StreamingQuery:
    """Keep running, one micro-batch per interval."""
    return writer.trigger(processingTime=interval).start()


def forward_events(events: DataFrame) -> DataFrame:
    """Every event, first or not, as the three texts other systems receive."""
    return events.select("namespace", F.col("event_name").alias("name"),
                         F.col("user_id").alias("key"))


class FlagStream:
    """Flags for a stream of users; the specs are read anew for every micro-batch."""

    def __init__(self, read_specs: Callable[[SparkSession], DataFrame], path: str,
                 now: Column, rand: Column, key: str) -> None:
        self.read_specs, self.path, self.now, self.rand = read_specs, path, now, rand
        self.key = key

    def __call__(self, users: DataFrame, batch_id: int) -> None:
        specs = self.read_specs(users.sparkSession)
        flags_for_users(users, specs, self.now, self.rand, self.key).write.mode(
            "overwrite").parquet(f"{self.path}/batch_id={batch_id}")
