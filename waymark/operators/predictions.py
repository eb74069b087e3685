"""Goal predictions: Bayes for single events, naive Bayes for event sets and users."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions.probability import bayes_from_counts, likelihood, yes_ratio
from waymark.operators.counters import part_of
from waymark.schemas import INTERNAL, NAMED, WEEKLY

# Fixed value: text shown instead of numbers where the goal itself is among the events.
GOAL_NOTE = "Submitted events included this goal, no prediction made"

# Outcome of a prediction request.
BOTH_GIVEN = "user_id and event cannot both be specified"
NO_EVENTS = "No events found for user"
UNKNOWN_EVENT = "Event is not known in this namespace"


def _named(totals: DataFrame, name: str, count: str) -> DataFrame:
    return (totals.filter(F.col("counter_type") == NAMED)
            .select("namespace", F.col("event_name").alias(name), F.col("count").alias(count)))


def goals_with_evidence(totals: DataFrame, singles: DataFrame) -> DataFrame:
    """Named goals some user reached after another event: the goals predicted at all."""
    evidence = singles.filter(F.col("counter_type") == NAMED).select(
        "namespace", F.col("event_name").alias("goal"))
    return _named(totals, "goal", "goal_count").join(evidence, ["namespace", "goal"],
                                                     "left_semi")


def _bayes(goal_tags: DataFrame, totals: DataFrame) -> DataFrame:
    everyone = totals.filter(F.col("counter_type") == INTERNAL).select(
        "namespace", F.col("count").alias("global_count"))
    return (goal_tags
            .join(_named(totals, "event_name", "event_count"), ["namespace", "event_name"])
            .join(everyone, "namespace")
            .withColumn("bayes", bayes_from_counts(
                F.col("goal_event_count"), F.col("goal_count"), F.col("event_count"),
                F.col("global_count"))))


def bayes_predictions(totals: DataFrame, singles: DataFrame) -> DataFrame:
    """P(goal | event) for every named goal and every event seen before it."""
    goal_tags = (singles.filter(F.col("counter_type") == NAMED)
                 .select("namespace", F.col("event_name").alias("goal"),
                         F.col("tag").alias("event_name"),
                         F.col("count").alias("goal_event_count"))
                 .join(_named(totals, "goal", "goal_count"), ["namespace", "goal"]))
    return _bayes(goal_tags, totals).select("namespace", "goal", "event_name", "bayes")


def bayes_predictions_weekly(totals: DataFrame, singles: DataFrame) -> DataFrame:
    """The same per weekly cohort of the goal."""
    key = ["namespace", "goal", "iso_year", "iso_week"]
    cohorts = (totals.filter(F.col("counter_type") == WEEKLY)
               .select("namespace", F.col("event_name").alias("goal"), "iso_year", "iso_week",
                       F.col("count").alias("goal_count")))
    goal_tags = (singles.filter(F.col("counter_type") == WEEKLY)
                 .select("namespace", F.col("event_name").alias("goal"), "iso_year",
                         "iso_week", F.col("tag").alias("event_name"),
                         F.col("count").alias("goal_event_count"))
                 .join(cohorts, key))
    return _bayes(goal_tags, totals).select(*key, "event_name", "bayes")


@dataclass(frozen=True)
class Evidence:
    """What naive Bayes needs, without a table of all goals and all events.

    ``events``: count of every known event. ``goals``: count of every goal with evidence.
    ``pairs``: factors of the goals and events that were seen together. Of any other pair
    the factors follow from the two counts: yes is 0, no is the quotient of the counts.
    """

    events: DataFrame
    goals: DataFrame
    pairs: DataFrame


def evidence_of(totals: DataFrame, singles: DataFrame) -> Evidence:
    events = _named(totals, "event_name", "event_count")
    goals = goals_with_evidence(totals, singles)
    seen = (singles.filter(F.col("counter_type") == NAMED)
            .select("namespace", F.col("event_name").alias("goal"),
                    F.col("tag").alias("event_name"), F.col("count").alias("hits")))
    hits = F.col("hits")
    pairs = (seen.join(goals, ["namespace", "goal"]).join(events, ["namespace", "event_name"])
             .select("namespace", "goal", "event_name",
                     yes_ratio(hits, F.col("goal_count")).alias("yes_ratio"),
                     # what remains of the quotient of counts in the no factor
                     F.try_divide(F.col("event_count") - hits, F.col("event_count"))
                     .alias("no_share")))
    return Evidence(events, goals, pairs)


def _combined(asked: DataFrame, key: list[str], evidence: Evidence) -> DataFrame:
    """Products of the factors of all asked ``(key, namespace, event_name)`` per goal, with
    ``_yes, _no, _included, _unknown``.

    Asked events meet known events and seen pairs by name, so neither goals nor the names of
    a hot user gather in one place; sums and products are combined before they move. Keys
    and goals of a namespace are paired last, one row for each of the results.
    """
    named = ["namespace", "event_name"]
    known = asked.join(evidence.events, named, "left")
    whole = known.groupBy(*key).agg(
        F.count("*").alias("_asked"), F.sum(F.log("event_count")).alias("_log_counts"),
        F.bool_or(F.col("event_count").isNull()).alias("_unknown"))
    seen = (asked.join(evidence.pairs, named).groupBy(*key, "goal").agg(
        F.count("*").alias("_seen"), F.product("yes_ratio").alias("_yes_seen"),
        F.product("no_share").alias("_share")))
    goal_names = evidence.goals.select("namespace", "goal", F.col("goal").alias("event_name"))
    included = (asked.join(goal_names, named).select(*key, "goal").distinct()
                .withColumn("_is_included", F.lit(True)))
    every = whole.join(evidence.goals, "namespace")
    paired = every.join(seen, [*key, "goal"], "left").join(included, [*key, "goal"], "left")
    quotients = F.exp(F.col("_log_counts") - F.col("_asked") * F.log("goal_count"))
    return paired.select(
        *key, "goal", "_unknown", F.coalesce("_is_included", F.lit(False)).alias("_included"),
        F.when(F.col("_seen") == F.col("_asked"), F.col("_yes_seen")).otherwise(0.0)
        .alias("_yes"),
        (quotients * F.coalesce("_share", F.lit(1.0))).alias("_no"))


def _numbers_or_note(combined: DataFrame, *keys: str) -> DataFrame:
    def unless_included(value: Column) -> Column:
        return F.when(~F.col("_included"), value)

    return combined.select(
        *keys,
        unless_included(F.col("_yes")).alias("yes"),
        unless_included(F.col("_no")).alias("no"),
        unless_included(likelihood(F.col("_yes"), F.col("_no"))).alias("likelihood"),
        F.when(F.col("_included"), F.lit(GOAL_NOTE)).alias("note"))


def unknown_events(requests: DataFrame, totals: DataFrame) -> DataFrame:
    """Requested events (``request_id, namespace, events``) no counter is known for."""
    asked = requests.select("request_id", "namespace", F.explode("events").alias("event_name"))
    return asked.join(_named(totals, "event_name", "_n"), ["namespace", "event_name"],
                      "left_anti")


def naive_bayes_events(requests: DataFrame, evidence: Evidence) -> DataFrame:
    """yes / no / likelihood of every goal for each request's events.

    An event listed twice multiplies twice; an empty list gives no rows. A request fails
    as a whole if it names an unknown event and any goal had to be evaluated for it: then
    all its rows carry the error as ``note``.
    """
    key = ["request_id", "namespace"]
    asked = requests.select(*key, F.explode("events").alias("event_name"))
    combined = _combined(asked, key, evidence)
    evaluated = F.col("_unknown") & ~F.col("_included")
    failed = F.bool_or(evaluated).over(Window.partitionBy(*key))
    rows = _numbers_or_note(combined.withColumn("_failed", failed), *key, "goal", "_failed")
    return rows.select(
        *key, "goal",
        *[F.when(~F.col("_failed"), F.col(c)).alias(c) for c in ("yes", "no", "likelihood")],
        F.when(F.col("_failed"), F.lit(UNKNOWN_EVENT)).otherwise(F.col("note")).alias("note"))


def naive_bayes_users(facts: DataFrame, evidence: Evidence) -> DataFrame:
    """Naive Bayes of every goal for every user, from all events the user has done."""
    done = facts.filter(F.col("counter_type") == NAMED).select(
        "namespace", "user_id", "event_name")
    return _numbers_or_note(_combined(done, ["namespace", "user_id"], evidence),
                            "namespace", "user_id", "goal")


def request_status(requests: DataFrame, facts: DataFrame) -> DataFrame:
    """Checks ``request_id, namespace, user_id, events`` before any prediction is made."""
    users = (facts.filter(F.col("counter_type") == INTERNAL)
             .select("namespace", "user_id", F.lit(True).alias("_seen")))
    has_user = F.col("user_id").isNotNull()
    has_events = F.coalesce(F.size("events") > 0, F.lit(False))
    return (requests.join(users, ["namespace", "user_id"], "left")
            .withColumn("status",
                        F.when(has_user & has_events, F.lit(BOTH_GIVEN))
                        .when(has_user & F.col("_seen").isNull(), F.lit(NO_EVENTS))
                        .otherwise(F.lit("ok")))
            .drop("_seen"))


def merge_external(internal: DataFrame, external: DataFrame,
                   models: list[str]) -> DataFrame:
    """Internal ``namespace, goal, yes, no, likelihood`` with external model scores.

    ``external`` is long: ``namespace, goal, model, yes, no``. Goals only one side knows
    stay. Every configured model gives the columns ``<model>_yes`` and ``<model>_no``.
    """
    aggregates = []
    for model in models:
        for side in ("yes", "no"):
            aggregates.append(F.max(F.when(F.col("model") == model, F.col(side)))
                              .alias(f"{model}_{side}"))
    wide = external.groupBy("namespace", "goal").agg(*aggregates)
    return internal.join(wide, ["namespace", "goal"], "full_outer")


def prediction_documents(predictions: DataFrame) -> DataFrame:
    """Per namespace and goal, the predictions as ``{"events":{name:{"bayes":p}}}``.

    The events of every goal are dealt to a fixed number of parts, one document each.
    """
    dealt = predictions.withColumn("part", part_of(F.col("event_name")))
    entry = F.struct("event_name", F.struct("bayes").alias("p"))
    events = F.map_from_entries(F.array_sort(F.collect_list(entry)))
    return (dealt.groupBy("namespace", "goal", "part").agg(events.alias("events"))
            .select("namespace", "goal", "part", F.to_json(F.struct("events")).alias("document")))


def probability_matrix(predictions: DataFrame, events: list[str]) -> DataFrame:
    """Goal rows, one column per named event."""
    return (predictions.groupBy("namespace", "goal").pivot("event_name", events)
            .agg(F.first("bayes")))
