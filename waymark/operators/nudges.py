"""Nudges: which event, not done yet, makes a goal most likely."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from waymark.schemas import INTERNAL, NAMED


def nudges_for_requests(requests: DataFrame, predictions: DataFrame,
                        facts: DataFrame) -> DataFrame:
    """Ranked nudges for asked pairs of ``namespace, user_id, goal``.

    An unknown goal gives no rows, an unknown user every event of the goal. Asking twice
    gives the same rows once. Events stay rows throughout: those done are removed by an anti
    join on the user and event, and the rest is ranked per user and goal.
    """
    done = facts.filter(F.col("counter_type") == NAMED).select(
        "namespace", "user_id", "event_name")
    open_events = (requests.select("namespace", "user_id", "goal").distinct()
                   .join(predictions, ["namespace", "goal"])
                   .join(done, ["namespace", "user_id", "event_name"], "left_anti"))
    best_first = (Window.partitionBy("namespace", "user_id", "goal")
                  .orderBy(F.desc("bayes"), "event_name"))
    return open_events.select(
        "namespace", "user_id", "goal", "event_name", F.col("bayes").alias("prediction"),
        F.row_number().over(best_first).alias("rank"))


def nudges_for_all_users(facts: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ranked nudges for every user and every goal of the user's namespace."""
    goals = predictions.select("namespace", "goal").distinct()
    users = facts.filter(F.col("counter_type") == INTERNAL).select("namespace", "user_id")
    return nudges_for_requests(users.join(goals, "namespace"), predictions, facts)
