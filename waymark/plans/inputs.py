"""The given tables seen as events, users, requests and specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from waymark.functions.dates import iso_week, iso_year
from waymark.functions.names import normalize_user_id
from waymark.operators.cohorts import CohortRule
from waymark.schemas import WEEKLY

WEEKLY_RULES = (CohortRule("purchase|signup", date_cohort=WEEKLY), CohortRule(".*"))

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_k() -> Column:
    """The ``k`` (0-99) every event carries in its properties."""
    return F.get_json_object("props", "$.k").cast("int")


def namespace_of(k: Column) -> Column:
    return F.when(k < 50, F.lit("default")).otherwise(F.lit("beta"))


def log_columns(events: DataFrame, event_name: Column, ts: Column | None = None) -> DataFrame:
    """Rows of ``events`` (batch or stream) as an event log.

    Events with ``k`` from 40 to 59 carry no value; a purchase above 100 announces itself
    as a goal.
    """
    k = event_k()
    ts = F.col("ts") if ts is None else ts
    return events.select(
        F.col("event_id").alias("seq"),
        namespace_of(k).alias("namespace"),
        event_name.alias("event_name"),
        normalize_user_id(F.col("user_id")).alias("user_id"),
        F.when(~k.between(40, 59), F.col("value")).alias("value"),
        ((F.col("event_type") == "purchase") & (F.col("value") > 100)).alias("ensure_goal"),
        iso_year(ts).alias("iso_year"),
        iso_week(ts).alias("iso_week"),
        ts.alias("ts"))


def typed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five event types as event names."""
    return log_columns(table(spark, sf_dir, "events"), F.col("event_type"))


def step_name() -> Column:
    """Goals keep their name, other types are told apart by the tens of ``k``."""
    step = F.concat(F.col("event_type"), F.lit(" "), F.floor(event_k() / 10).cast("string"))
    return F.when(F.col("event_type").isin("purchase", "signup"),
                  F.col("event_type")).otherwise(step)


def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A finer vocabulary, in which users have done some events and not others."""
    return log_columns(table(spark, sf_dir, "events"), step_name())


def goal_table(spark: SparkSession) -> DataFrame:
    """Goals that were registered before the first event.

    Inline values have a size Catalyst knows, unlike a frame made from Python objects.
    """
    return spark.sql("""
        SELECT * FROM VALUES ('default', 'purchase', 0L), ('default', 'signup', 0L),
                             ('beta', 'purchase', 0L) AS g(namespace, goal_name, active_from_seq)
    """)


def streamed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet")
            .parquet(sf_dir))
