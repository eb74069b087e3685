"""Registered queries: streams over the given tables, read back as batch results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from waymark.functions.names import tags_text
from waymark.operators import counters
from waymark.plans.event_queries import rounded
from waymark.plans.flag_queries import nation_specs, now, rand, user_object
from waymark.plans.inputs import (EVENTS, WEEKLY_RULES, goal_table, log_columns,
                                  streamed_events, table)
from waymark.schemas import COUNTER_KEY
from waymark.session import streaming_session
from waymark.storage import new_path
from waymark.streaming import (FlagStream, IncrementalFacts, IncrementalPredictions,
                               changed_counters, forward_events, latest_snapshot, read_batches, run_available,
                               stream_first_writes, unique_user_counts, weekly_user_counts,
                               write_append, write_batches)
from waymark.streaming.first_writes import STREAM_FACTS


ARRIVALS = 3


def _typed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_columns(streamed_events(spark, sf_dir), F.col("event_type"))


def _facts_text(facts: DataFrame) -> DataFrame:
    return facts.select(*COUNTER_KEY, "user_id", "seq", rounded("value"), "is_goal",
                        tags_text("tags").alias("tags"))


def _arrivals(spark: SparkSession, sf_dir: str,
              step: Callable[[DataFrame], None]) -> None:
    """The events arrive in ``ARRIVALS`` parts; after each one ``step`` gets the stream over
    all that has arrived, and continues from its checkpoint."""
    session = streaming_session(spark)
    events = table(session, sf_dir, "events")
    base = new_path(spark, "arrivals")
    shares = [k / ARRIVALS for k in range(1, ARRIVALS)]
    cuts = events.agg(F.percentile_approx("event_id", shares)).first()[0] or []
    part = sum((F.when(F.col("event_id") > cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    for number in range(ARRIVALS):
        events.filter(part == number).write.mode("append").parquet(base)
        step(session.readStream.schema(EVENTS).parquet(base))


def _snapshot(spark: SparkSession, sf_dir: str, label: str,
              counts: Callable[[DataFrame], DataFrame], *keys: str) -> DataFrame:
    """Counts in update mode over several micro-batches; the latest row of every key."""
    base = new_path(spark, label)
    schemas = []

    def step(events: DataFrame) -> None:
        stream = counts(events)
        schemas.append(stream.schema)
        run_available(write_batches(stream, f"{base}/out", f"{base}/state", mode="update"))

    _arrivals(spark, sf_dir, step)
    return latest_snapshot(read_batches(spark, f"{base}/out", schemas[0]), *keys)


def _typed(events: DataFrame) -> DataFrame:
    return log_columns(events, F.col("event_type"))


def stream_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = streaming_session(spark)
    facts = stream_first_writes(_typed_stream(session, sf_dir), goal_table(session),
                                WEEKLY_RULES)
    base = new_path(spark, "stream-facts")
    run_available(write_append(facts, f"{base}/out", f"{base}/state"))
    return _facts_text(spark.read.schema(STREAM_FACTS).parquet(f"{base}/out"))


def stream_unique_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, "stream-users", lambda e: unique_user_counts(_typed(e)),
                     "namespace", "event_name")


def stream_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshot(spark, sf_dir, "stream-weeks", lambda e: weekly_user_counts(_typed(e)),
                     "namespace", "event_name", "iso_year", "iso_week")


def stream_late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates moved back by up to 99 days: they arrive in no order, and late by batches."""
    days = F.get_json_object("props", "$.k").cast("int")
    late = F.col("ts") - F.make_dt_interval(days)
    return _snapshot(
        spark, sf_dir, "stream-late",
        lambda e: weekly_user_counts(log_columns(e, F.col("event_type"), ts=late)),
        "namespace", "event_name", "iso_year", "iso_week")


def stream_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as a stream; after each part the counters that changed are written, and the last
    row of each is kept."""
    base = new_path(spark, "stream-snapshot")
    schemas = []

    def step(events: DataFrame) -> None:
        session = events.sparkSession
        facts = stream_first_writes(_typed(events), goal_table(session), WEEKLY_RULES)
        run_available(write_append(facts, f"{base}/facts", f"{base}/facts-state"))
        changed = changed_counters(
            session.readStream.schema(STREAM_FACTS).parquet(f"{base}/facts"))
        schemas.append(changed.schema)
        run_available(write_batches(changed, f"{base}/out", f"{base}/state", mode="update"))

    _arrivals(spark, sf_dir, step)
    latest = latest_snapshot(read_batches(spark, f"{base}/out", schemas[0]), *COUNTER_KEY)
    return latest.select(*COUNTER_KEY, "count", rounded("value_sum"))


def stream_restart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first half of the events, a stop, then the rest from the saved state."""
    session = streaming_session(spark)
    events = table(session, sf_dir, "events")
    base = new_path(spark, "stream-restart")
    middle = events.agg(F.expr("percentile_approx(event_id, 0.5)").alias("m")).first()["m"]
    for part in (F.col("event_id") <= middle, F.col("event_id") > middle):
        events.filter(part).write.mode("append").parquet(f"{base}/in")
        log = log_columns(session.readStream.schema(EVENTS).parquet(f"{base}/in"),
                          F.col("event_type"))
        facts = stream_first_writes(log, goal_table(session), WEEKLY_RULES)
        run_available(write_append(facts, f"{base}/out", f"{base}/state"))
    return _facts_text(spark.read.schema(STREAM_FACTS).parquet(f"{base}/out"))


def _incremental(spark: SparkSession, sf_dir: str, handler: IncrementalFacts,
                 base: str) -> None:
    _arrivals(spark, sf_dir, lambda events: run_available(
        _typed(events).drop("ts").writeStream.foreachBatch(handler)
        .option("checkpointLocation", f"{base}/state")))


def stream_goal_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Goals announced in the stream take effect at once, for all users."""
    base = new_path(spark, "stream-goals")
    handler = IncrementalFacts(f"{base}/tables", WEEKLY_RULES)
    _incremental(spark, sf_dir, handler, base)
    facts = handler.facts(spark).filter("is_goal")
    singles = counters.single_tag_counts(handler.prior(spark))
    totals = facts.groupBy(*COUNTER_KEY).agg(F.count("*").alias("goal_users"))
    return (totals.alias("t").join(singles.alias("s"), counters.same_counter("t", "s"), "left")
            .select("t.*", "s.tag", F.coalesce("s.count", F.lit(0)).alias("count")))


def stream_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "stream-forward")
    forwarded = forward_events(_typed_stream(streaming_session(spark), sf_dir))
    run_available(write_append(forwarded, f"{base}/out", f"{base}/state"))
    return (spark.read.schema(forwarded.schema).parquet(f"{base}/out")
            .groupBy("namespace", "name", "key").agg(F.count("*").alias("events")))


def stream_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions brought up to date after every batch, from its new facts."""
    base = new_path(spark, "stream-predictions")
    kept = IncrementalPredictions(f"{base}/tables")
    handler = IncrementalFacts(f"{base}/tables", initial_goals=goal_table(spark), after=kept)
    _incremental(spark, sf_dir, handler, base)
    return kept.predictions(spark).read().select(
        "namespace", "goal", "event_name", rounded("bayes"))


def stream_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "stream-flags")
    session = streaming_session(spark)
    schema = table(session, sf_dir, "customer").schema
    users = (session.readStream.schema(schema).option("pathGlobFilter", "customer.parquet")
             .parquet(sf_dir).withColumn("user", user_object()))
    handler = FlagStream(lambda s: nation_specs(s, sf_dir), f"{base}/out", now(), rand(),
                         "c_custkey")
    run_available(users.writeStream.foreachBatch(handler)
                  .option("checkpointLocation", f"{base}/state"))
    written = T.StructType([schema["c_custkey"], T.StructField("name", T.StringType()),
                            T.StructField("enabled", T.BooleanType())])
    return read_batches(spark, f"{base}/out", written).select("c_custkey", "name", "enabled")


QUERIES = {
    "stream_first_writes": stream_facts,
    "stream_unique_users": stream_unique_users,
    "stream_weekly": stream_weekly,
    "stream_late_events": stream_late_events,
    "stream_snapshot": stream_snapshot,
    "stream_restart": stream_restart,
    "stream_goal_activation": stream_goal_activation,
    "stream_forward": stream_forward,
    "stream_predictions": stream_predictions,
    "stream_flags": stream_flags,
}
