"""Column layouts shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

DEFAULT_NAMESPACE = "default"
GLOBAL_COUNTER = "global_counter"

INTERNAL = "internal"
NAMED = "named"
WEEKLY = "weekly"

# Identity of a counter. Only weekly counters carry a year and a week.
COUNTER_KEY = ["namespace", "event_name", "counter_type", "iso_year", "iso_week"]

EVENT_LOG = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("namespace", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("ensure_goal", T.BooleanType()),
    T.StructField("iso_year", T.IntegerType()),
    T.StructField("iso_week", T.IntegerType()),
])

GOALS = T.StructType([
    T.StructField("namespace", T.StringType()),
    T.StructField("goal_name", T.StringType()),
    T.StructField("active_from_seq", T.LongType()),
])

FIRST_WRITES = T.StructType([
    T.StructField("namespace", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("counter_type", T.StringType()),
    T.StructField("iso_year", T.IntegerType()),
    T.StructField("iso_week", T.IntegerType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

COUNTERS = T.StructType([
    T.StructField("namespace", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("counter_type", T.StringType()),
    T.StructField("iso_year", T.IntegerType()),
    T.StructField("iso_week", T.IntegerType()),
    T.StructField("count", T.LongType()),
    T.StructField("value_sum", T.DoubleType()),
])

FLAG_CONDITION = T.StructType([
    T.StructField("property", T.StringType()),
    T.StructField("comparator", T.StringType()),
    T.StructField("value", T.VariantType()),
])

FLAG_SPECS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("boolean", T.BooleanType()),
    T.StructField("rollout_start", T.LongType()),
    T.StructField("rollout_end", T.LongType()),
    T.StructField("user", T.ArrayType(FLAG_CONDITION)),
])
