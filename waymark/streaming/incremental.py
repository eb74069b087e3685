"""Micro-batches against a facts table, for goals that are announced inside the stream.

A goal announced by one user changes what a later event of another user records, even in
the same micro-batch. Keyed state cannot see that, so each batch runs the batch operators:
goals first, then the facts that are new, then what the new goal users had done before.

Goals, facts and prior events are :class:`waymark.streaming.runs.Runs`. A batch looks up the
facts of its own users only, so its cost follows the batch and the history of these users.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from waymark.operators.cohorts import CohortRule
from waymark.operators.counters import counter_totals, same_counter, single_tag_counts
from waymark.operators.facts import first_writes, prior_events
from waymark.operators.goals import goals_from_log, mark_goals, upsert_goals
from waymark.operators.predictions import bayes_predictions
from waymark.schemas import (COUNTER_KEY, COUNTERS, FIRST_WRITES, GLOBAL_COUNTER, GOALS,
                             INTERNAL, NAMED)
from waymark.storage import materialize
from waymark.streaming.runs import Runs, latest, summed

MARKED = T.StructType([*FIRST_WRITES.fields, T.StructField("is_goal", T.BooleanType())])
PRIOR = T.StructType([f for f in FIRST_WRITES.fields if f.name in COUNTER_KEY]
                     + [T.StructField("user_id", T.StringType()),
                        T.StructField("goal_seq", T.LongType()),
                        T.StructField("tag", T.StringType())])
SINGLES = T.StructType([*PRIOR.fields[:len(COUNTER_KEY)], T.StructField("tag", T.StringType()),
                        T.StructField("count", T.LongType())])
PREDICTIONS = T.StructType([T.StructField("namespace", T.StringType()),
                            T.StructField("goal", T.StringType()),
                            T.StructField("event_name", T.StringType()),
                            T.StructField("bayes", T.DoubleType())])
USER = ["namespace", "user_id"]


class IncrementalFacts:
    """A ``foreachBatch`` handler that keeps goals, facts and prior events as tables.

    A batch that is repeated after a failure replaces its own output. ``after`` runs at the
    end of each batch and gets the handler, the session, the batch's number, its new facts
    and its new prior events, for instance to bring predictions up to date.
    """

    def __init__(self, path: str, rules: Sequence[CohortRule] = (),
                 initial_goals: DataFrame | None = None,
                 after: Callable[[IncrementalFacts, SparkSession, int, DataFrame, DataFrame],
                                 None] | None = None) -> None:
        self.path, self.rules, self.initial_goals = path, tuple(rules), initial_goals
        self.after = after

    def _runs(self, spark: SparkSession, table: str, schema: T.StructType,
              key: Sequence[str]) -> Runs:
        return Runs(spark, f"{self.path}/{table}", schema, key)

    def fact_runs(self, spark: SparkSession) -> Runs:
        return self._runs(spark, "facts", MARKED, USER)

    def prior_runs(self, spark: SparkSession) -> Runs:
        return self._runs(spark, "prior", PRIOR, USER)

    def goal_runs(self, spark: SparkSession) -> Runs:
        return self._runs(spark, "goals", GOALS, ["namespace", "goal_name"])

    def facts(self, spark: SparkSession, up_to: int | None = None) -> DataFrame:
        return self.fact_runs(spark).read(up_to)

    def prior(self, spark: SparkSession, up_to: int | None = None) -> DataFrame:
        return self.prior_runs(spark).read(up_to)

    def goals(self, spark: SparkSession, up_to: int | None = None) -> DataFrame:
        return upsert_goals(self.goal_runs(spark).read(up_to))

    def __call__(self, log: DataFrame, batch_id: int) -> None:
        log = log.persist()
        try:
            self._step(log, batch_id)
        finally:
            log.unpersist()

    def _step(self, log: DataFrame, batch_id: int) -> None:
        spark = log.sparkSession
        announced = goals_from_log(log)
        if batch_id == 0 and self.initial_goals is not None:
            announced = announced.unionByName(self.initial_goals)
        self.goal_runs(spark).append(announced, batch_id)

        stored = self.fact_runs(spark)
        seen = stored.lookup(log.select(*USER), batch_id - 1)
        new = (first_writes(log, self.rules).alias("n")
               .join(seen.alias("s"), same_counter("n", "s", [*COUNTER_KEY, "user_id"]),
                     "left_anti"))
        marked = materialize(mark_goals(new, self.goals(spark, batch_id)), "batch-facts")
        stored.append(marked, batch_id)

        # Only new goal writes gain prior events; their history is that of the same users.
        users = marked.where("is_goal").select(*USER)
        history = stored.lookup(users, batch_id - 1).withColumn("is_goal", F.lit(False))
        own = marked.join(users.distinct(), USER, "left_semi").select(*history.columns)
        prior = materialize(prior_events(history.unionByName(own)), "batch-prior")
        self.prior_runs(spark).append(prior, batch_id)
        if self.after:
            self.after(self, spark, batch_id, marked, prior)


class IncrementalPredictions:
    """Bayes predictions brought up to date by what a batch has added.

    Totals and single-event counts are sums of deltas. A prediction changes if the count of
    its goal, of its event or of both together does (the number of all users cancels out), so
    those of the touched names are computed anew and the others stay. Use as ``after``.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def totals(self, spark: SparkSession) -> Runs:
        return Runs(spark, f"{self.path}/totals", COUNTERS, ["namespace", "event_name"],
                    summed(COUNTER_KEY, "count", "value_sum"))

    def _singles(self, spark: SparkSession, name: str, key: str) -> Runs:
        return Runs(spark, f"{self.path}/{name}", SINGLES, ["namespace", key],
                    summed([*COUNTER_KEY, "tag"], "count"))

    def predictions(self, spark: SparkSession) -> Runs:
        key = ["namespace", "goal", "event_name"]
        return Runs(spark, f"{self.path}/predictions", PREDICTIONS, key, latest(key, "bayes"))

    def __call__(self, tables: IncrementalFacts, spark: SparkSession, batch_id: int,
                 facts: DataFrame, prior: DataFrame) -> None:
        totals = self.totals(spark)
        by_goal = self._singles(spark, "singles-by-goal", "event_name")
        by_tag = self._singles(spark, "singles-by-tag", "tag")
        total_delta = materialize(counter_totals(facts), "total-delta")
        single_delta = materialize(single_tag_counts(prior), "single-delta")
        totals.append(total_delta, batch_id)
        by_goal.append(single_delta, batch_id)
        by_tag.append(single_delta, batch_id)

        names = ["namespace", "event_name"]
        touched = total_delta.where(F.col("counter_type") == NAMED).select(*names).union(
            single_delta.select(*names)).distinct()
        as_tags = touched.withColumnRenamed("event_name", "tag")
        pairs = by_goal.lookup(touched, batch_id).union(by_tag.lookup(as_tags, batch_id))
        pairs = materialize(pairs.where(F.col("counter_type") == NAMED).distinct(), "pairs")
        asked = (pairs.select(*names).union(pairs.select("namespace", "tag"))
                 .union(pairs.select("namespace", F.lit(GLOBAL_COUNTER))).distinct())
        counts = totals.lookup(asked, batch_id).where(
            F.col("counter_type").isin(NAMED, INTERNAL))
        self.predictions(spark).append(bayes_predictions(counts, pairs), batch_id)
