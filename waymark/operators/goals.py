"""Goals: which events record what their users did before, and since when."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from waymark.schemas import INTERNAL


def upsert_goals(registrations: DataFrame) -> DataFrame:
    """Registering a goal again changes nothing: the earliest registration stands."""
    return (registrations.groupBy("namespace", "goal_name")
            .agg(F.min("active_from_seq").alias("active_from_seq")))


def goals_from_log(log: DataFrame) -> DataFrame:
    """Goals announced inside the event stream; the announcing event already counts."""
    return (log.filter("ensure_goal")
            .groupBy("namespace", F.col("event_name").alias("goal_name"))
            .agg(F.min("seq").alias("active_from_seq")))


def list_goals(goals: DataFrame, namespace: str | None = None) -> DataFrame:
    chosen = goals if namespace is None else goals.filter(F.col("namespace") == namespace)
    by_name = Window.partitionBy("namespace").orderBy("goal_name")
    return chosen.select("namespace", "goal_name", F.row_number().over(by_name).alias("rank"))


def mark_goals(facts: DataFrame, goals: DataFrame) -> DataFrame:
    """Adds ``is_goal``: the first write came while its event was a goal.

    A user whose first write came before the registration stays a non-goal user for good.
    No broadcast is forced: a goal table small enough by its file or local size is
    broadcast by Catalyst, a larger one is joined by shuffle with skew splitting.
    """
    registered = goals.select("namespace", F.col("goal_name").alias("event_name"),
                              "active_from_seq")
    active = F.coalesce(F.col("seq") >= F.col("active_from_seq"), F.lit(False))
    return (facts.join(registered, ["namespace", "event_name"], "left")
            .withColumn("is_goal", active & (F.col("counter_type") != INTERNAL))
            .select(*facts.columns, "is_goal"))
