"""Registered queries: predictions, nudges, funnels, churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from waymark.functions.names import normalize_user_id, tags_text
from waymark.functions.probability import bayes_from_counts
from waymark.operators import churn, counters, facts as fact_ops, funnels, goals as goal_ops
from waymark.operators import models, nudges, predictions
from waymark.plans.event_queries import marked_facts, order_events, rounded
from waymark.plans.inputs import (event_k, goal_table, log_columns, namespace_of, step_log,
                                  table, typed_log)

from waymark.storage import materialize

CHURN_DAY = "2024-02-26"
AFTER_THE_LOG = 1 << 62
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
EXTERNAL_MODELS = ["value", "volume"]


def named_facts(log: DataFrame, goals: DataFrame) -> DataFrame:
    """Facts of a log without weekly rules, marked and written once."""
    return materialize(goal_ops.mark_goals(fact_ops.first_writes(log), goals), "facts")


def counts_of(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals, single tag counts) of marked facts."""
    return (counters.counter_totals(facts),
            counters.single_tag_counts(fact_ops.prior_events(facts)))


def _typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_facts(typed_log(spark, sf_dir), goal_table(spark))


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_facts(step_log(spark, sf_dir), goal_table(spark))


def _evidence(facts: DataFrame) -> predictions.Evidence:
    """Written, because several joins read each part of it."""
    totals, singles = (materialize(counts, "counts") for counts in counts_of(facts))
    found = predictions.evidence_of(totals, singles)
    return predictions.Evidence(*(materialize(part, "evidence") for part in (
        found.events, found.goals, found.pairs)))


def _predictions(facts: DataFrame) -> DataFrame:
    return materialize(predictions.bayes_predictions(*counts_of(facts)), "predictions")


def bayes_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The formula on each customer nation's order counts."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    everyone = joined.groupBy("c_nationkey").agg(
        F.count("*").alias("everyone"),
        F.count_if(F.col("o_orderstatus") == "F").alias("goal"),
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("tag"),
        F.count_if((F.col("o_orderstatus") == "F")
                   & (F.col("o_orderpriority") == "1-URGENT")).alias("goal_tag"))
    return (everyone.withColumn("bayes", bayes_from_counts(
        F.col("goal_tag"), F.col("goal"), F.col("tag"), F.col("everyone")))
        .select("c_nationkey", rounded("bayes")))


def goals_with_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.goals_with_evidence(*counts_of(_typed(spark, sf_dir)))


def bayes_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predictions.bayes_predictions(*counts_of(_typed(spark, sf_dir)))
    return found.select("namespace", "goal", "event_name", rounded("bayes"))


def bayes_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P(order status | priority or segment) over orders as users."""
    log = materialize(order_events(spark, sf_dir), "order-events")
    goals = materialize(goal_ops.goals_from_log(log), "goals")
    found = predictions.bayes_predictions(*counts_of(named_facts(log, goals)))
    return found.select("namespace", "goal", "event_name", rounded("bayes"))


def bayes_predictions_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = predictions.bayes_predictions_weekly(*counts_of(marked_facts(spark, sf_dir)))
    return found.select("namespace", "goal", "iso_year", "iso_week", "event_name",
                        rounded("bayes"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event sets asked about: the events of one hour in a namespace, repeats included.

    Events with ``k`` 99 ask for a name nobody has recorded.
    """
    k = event_k()
    asked = F.when(k == 99, F.lit("never seen")).otherwise(F.col("event_type"))
    return (table(spark, sf_dir, "events")
            .groupBy(F.floor(F.col("event_id") / 4).cast("long").alias("request_id"),
                     namespace_of(k).alias("namespace"))
            .agg(F.collect_list(asked).alias("events")))


def naive_bayes_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(_typed(spark, sf_dir))
    found = predictions.naive_bayes_events(_requests(spark, sf_dir), evidence)
    return found.select("request_id", "namespace", "goal", rounded("yes"), rounded("no"),
                        rounded("likelihood"), "note")


def naive_bayes_goal_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which requests contain the goal they would be predicted for."""
    evidence = _evidence(_typed(spark, sf_dir))
    found = predictions.naive_bayes_events(_requests(spark, sf_dir), evidence)
    return (found.filter(F.col("note") == predictions.GOAL_NOTE)
            .select("request_id", "namespace", "goal", "note"))


def unknown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = counters.counter_totals(fact_ops.named_first_writes(typed_log(spark, sf_dir)))
    return predictions.unknown_events(_requests(spark, sf_dir), totals).select(
        "request_id", "namespace", "event_name")


def naive_bayes_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _steps(spark, sf_dir)
    found = predictions.naive_bayes_users(facts, _evidence(facts))
    return found.select("namespace", "user_id", "goal", rounded("yes"), rounded("no"),
                        rounded("likelihood"), "note")


def prediction_request_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers asking by id, with an event, or with both."""
    nation = F.col("c_nationkey")
    requests = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"), F.lit("default").alias("namespace"),
        F.when(nation != 0, normalize_user_id(F.col("c_custkey"))).alias("user_id"),
        F.when(nation < 2, F.array(F.lit("click"))).alias("events"))
    facts = fact_ops.first_writes(typed_log(spark, sf_dir))
    return predictions.request_status(requests, facts).select("request_id", "status")


def merge_external_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Naive Bayes for view and click, merged with two outside models."""
    log = typed_log(spark, sf_dir)
    evidence = _evidence(_typed(spark, sf_dir))
    request = log.groupBy("namespace").agg(F.lit(1).cast("long").alias("request_id"))
    asked = request.withColumn("events", F.array(F.lit("view"), F.lit("click")))
    internal = predictions.naive_bayes_events(asked, evidence).select(
        "namespace", "goal", "yes", "no", "likelihood")
    per_type = log.groupBy("namespace", F.col("event_name").alias("goal"))
    by_value = per_type.agg((F.avg("value") / 1000).alias("yes")).select(
        "namespace", "goal", F.lit("value").alias("model"), "yes",
        (1 - F.col("yes")).alias("no"))
    by_volume = (per_type.agg(F.count("*").alias("n")).filter("namespace = 'beta'")
                 .select("namespace", "goal", F.lit("volume").alias("model"),
                         (F.col("n") / (F.col("n") + 1000)).alias("yes"),
                         (1000 / (F.col("n") + 1000)).alias("no")))
    merged = predictions.merge_external(internal, by_value.unionByName(by_volume),
                                        EXTERNAL_MODELS)
    numbers = [c for c in merged.columns if c not in ("namespace", "goal")]
    return merged.select("namespace", "goal", *[rounded(c) for c in numbers])


def prediction_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.prediction_documents(bayes_predictions(spark, sf_dir))


def nudges_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer asks for a way to a purchase; many are unknown as event users."""
    facts = _steps(spark, sf_dir)
    requests = table(spark, sf_dir, "customer").select(
        F.lit("default").alias("namespace"), F.lit("purchase").alias("goal"),
        normalize_user_id(F.col("c_custkey")).alias("user_id"))
    # Every request twice, and written: constants would turn the join into a nested loop.
    requests = materialize(requests.unionByName(requests), "requests")
    found = nudges.nudges_for_requests(requests, _predictions(facts), facts)
    return found.select("namespace", "user_id", "goal", "event_name",
                        rounded("prediction"), "rank")


def nudges_all_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _steps(spark, sf_dir)
    found = nudges.nudges_for_all_users(facts, _predictions(facts))
    return found.select("namespace", "user_id", "goal", "event_name",
                        rounded("prediction"), "rank")


def _goal_users(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(totals of goal facts, what their users had done before)"""
    return counters.counter_totals(facts.filter("is_goal")), fact_ops.prior_events(facts)


def combination_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = funnels.split_combinations(*_goal_users(_typed(spark, sf_dir)),
                                       include=["view", "click"], exclude=["error"])
    return split.select("namespace", "event_name", "bucket", "count")


def events_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = counters.counter_totals(fact_ops.first_writes(step_log(spark, sf_dir)))
    return counters.ranked_events(totals).select("namespace", "event_name", "counter_type",
                                                 "count", "rank")


def probability_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions.probability_matrix(bayes_predictions(spark, sf_dir), EVENT_TYPES)


def funnel_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnels.funnel_depth(*_goal_users(_steps(spark, sf_dir))).select(
        "namespace", "event_name", "depth", "users")


def goal_event_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = funnels.goal_event_share(*counts_of(_steps(spark, sf_dir)))
    return share.select("namespace", "goal", "tag", rounded("share"))


def _churned(log: DataFrame) -> DataFrame:
    return churn.churn_events(log, F.lit(CHURN_DAY).cast("date"),
                              F.lit(AFTER_THE_LOG).cast("long"))


def churn_last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _churned(typed_log(spark, sf_dir)).select("namespace", "event_name", "user_id",
                                                     "ensure_goal")


def _churn_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = step_log(spark, sf_dir)
    churned = materialize(_churned(log), "churned")
    base = log.withColumn("ensure_goal", F.lit(False)).select(*churned.columns)
    return named_facts(base.unionByName(churned), goal_ops.goals_from_log(churned))


def churn_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What exactly each of the users who stay away had done."""
    prior = materialize(fact_ops.prior_events(_churn_facts(spark, sf_dir)), "prior")
    return counters.tag_combinations(prior).select(
        "namespace", "event_name", tags_text("tags").alias("tags"), "count")


def churn_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which events the users who stay away have in common."""
    found = predictions.bayes_predictions(*counts_of(_churn_facts(spark, sf_dir)))
    return found.select("namespace", "goal", "event_name", rounded("bayes"))


def goal_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "purchase", F.lit("paid: purchase")).otherwise(
        F.col("event_type"))
    scores = models.goal_model_scores(log_columns(table(spark, sf_dir, "events"), name))
    names = Window.partitionBy("namespace")  # a row per event name
    goal, score = F.col("label") == 1, F.col("goal_probability")
    return scores.select(
        "namespace", "event_name", "label", score.between(0, 1).alias("is_probability"),
        F.when(goal, score > F.max(F.when(~goal, score)).over(names))
        .otherwise(score < F.min(F.when(goal, score)).over(names)).alias("told_apart"))


QUERIES = {
    "bayes_scalar": bayes_scalar,
    "goals_with_evidence": goals_with_evidence,
    "bayes_predictions": bayes_predictions,
    "bayes_predictions_orders": bayes_orders,
    "bayes_predictions_weekly": bayes_predictions_weekly,
    "naive_bayes_events": naive_bayes_events,
    "naive_bayes_goal_note": naive_bayes_goal_note,
    "unknown_events": unknown_events,
    "naive_bayes_users": naive_bayes_users,
    "prediction_request_status": prediction_request_status,
    "merge_external_predictions": merge_external_predictions,
    "prediction_json": prediction_json,
    "nudges_user": nudges_user,
    "nudges_all_users": nudges_all_users,
    "combination_split": combination_split,
    "events_ranked": events_ranked,
    "probability_matrix": probability_matrix,
    "funnel_depth": funnel_depth,
    "goal_event_share": goal_event_share,
    "churn_last_seen": churn_last_seen,
    "churn_combinations": churn_combinations,
    "churn_predictions": churn_predictions,
    "goal_model_scores": goal_model_scores,
}
