"""Counters and predictions as metric rows: name, labels, value."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from waymark.schemas import WEEKLY

COUNTER, COUNTER_WEEKLY, PREDICTION = (
    "event_counter", "event_counter_weekly", "goal_prediction")


def counter_metrics(totals: DataFrame) -> DataFrame:
    weekly = F.col("counter_type") == WEEKLY
    plain = F.create_map(F.lit("namespace"), F.col("namespace"),
                         F.lit("name"), F.col("event_name"))
    dated = F.map_concat(plain, F.create_map(
        F.lit("year"), F.col("iso_year").cast("string"),
        F.lit("week"), F.col("iso_week").cast("string")))
    return totals.select(
        F.when(weekly, F.lit(COUNTER_WEEKLY)).otherwise(F.lit(COUNTER)).alias("metric"),
        F.when(weekly, dated).otherwise(plain).alias("labels"),
        F.col("count").cast("double").alias("value"))


def prediction_metrics(predictions: DataFrame) -> DataFrame:
    return predictions.select(
        F.lit(PREDICTION).alias("metric"),
        F.create_map(F.lit("namespace"), F.col("namespace"), F.lit("goal"), F.col("goal"),
                     F.lit("event"), F.col("event_name")).alias("labels"),
        F.col("bayes").alias("value"))
