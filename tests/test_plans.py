"""Shapes of the plans that decide how the jobs scale."""

import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import goals_of
from waymark.operators import flags, nudges, predictions
from waymark.operators.counters import counter_totals, single_tag_counts
from waymark.operators.facts import first_writes, prior_events
from waymark.operators.goals import mark_goals
from waymark.plans import event_queries, flag_queries
from waymark.plans.inputs import WEEKLY_RULES, goal_table, typed_log
from waymark.storage import materialize, new_path, shared_dir

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_facts_scan_the_log_once_and_shuffle_it_after_combining(spark):
    text = plan(first_writes(typed_log(spark, SF_DIR), WEEKLY_RULES))
    assert text.count("FileScan") == 1
    assert text.count("Exchange") == 2
    assert "SortAggregate" not in text and "Window" not in text
    # The scan feeds a partial aggregation before the first exchange.
    first_exchange = text.rindex("Exchange")
    assert "partial_min" in text[first_exchange:]


def test_small_goal_tables_do_not_shuffle_the_facts(spark):
    facts = materialize(first_writes(typed_log(spark, SF_DIR)), "facts")
    text = plan(mark_goals(facts, goal_table(spark)))
    assert "BroadcastHashJoin" in text and "Exchange hash" not in text


def test_only_needed_columns_are_read(spark):
    text = plan(event_queries.unique_users_global(spark, SF_DIR))
    assert re.search(r"ReadSchema: struct<user_id:bigint,props:string>", text)


def test_tag_join_reads_facts_with_filters(spark):
    facts = materialize(mark_goals(first_writes(typed_log(spark, SF_DIR)), goal_table(spark)),
                        "facts")
    text = plan(prior_events(facts))
    assert text.count("FileScan") == 2 and "Union" not in text
    assert "EqualTo(is_goal,true)" in text and "EqualTo(counter_type,named)" in text


def without_broadcast(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    session.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    return session


def test_nothing_forces_a_broadcast(spark):
    """With broadcasts switched off every join still has another way."""
    session = without_broadcast(spark)
    facts = materialize(mark_goals(first_writes(typed_log(session, SF_DIR)),
                                   goal_table(session)), "facts")
    predicted = session.createDataFrame(
        [("default", "purchase", "view", .5)],
        "namespace string, goal string, event_name string, bayes double")
    evidence = predictions.evidence_of(counter_totals(facts),
                                       single_tag_counts(prior_events(facts)))
    for df in (prior_events(facts), mark_goals(facts.drop("is_goal"), goal_table(session)),
               predictions.naive_bayes_users(facts, evidence),
               nudges.nudges_for_all_users(facts, predicted)):
        text = plan(df)
        assert "Broadcast" not in text and "Cartesian" not in text
        assert "SortMergeJoin" in text or "ShuffledHashJoin" in text


def test_user_predictions_meet_only_events_seen_together(spark):
    """No pair of goal and event is made that nobody has done; products are combined first."""
    facts = materialize(mark_goals(first_writes(typed_log(spark, SF_DIR)), goal_table(spark)),
                        "facts")
    totals, singles = counter_totals(facts), single_tag_counts(prior_events(facts))
    evidence = predictions.evidence_of(totals, singles)
    assert evidence.pairs.count() == singles.filter("counter_type = 'named'").count()
    assert "partial_product" in plan(predictions.naive_bayes_users(facts, evidence))


def test_a_user_with_a_large_vocabulary(spark):
    """One user with 100,000 names: the names are spread, the result is one row."""
    names = spark.range(100_000).select(
        F.lit("n").alias("namespace"), F.concat(F.lit("e"), "id").alias("event_name"),
        F.lit("named").alias("counter_type"), F.lit(1).cast("long").alias("count"))
    goal = spark.createDataFrame([("n", "g", "named", 2)], names.schema)
    pairs = spark.createDataFrame([("n", "g", "named", "e7", 1)],
                                  "namespace string, event_name string, counter_type string, "
                                  "tag string, count long")
    facts = names.withColumn("user_id", F.lit("u"))
    row = predictions.naive_bayes_users(facts, predictions.evidence_of(
        names.union(goal), pairs)).collect()
    assert [(r["goal"], r["yes"], r["no"]) for r in row] == [("g", 0.0, 0.0)]


def test_flag_conditions_are_joined_by_value(spark):
    users = flag_queries.customers(spark, SF_DIR)
    specs = flag_queries.nation_specs(spark, SF_DIR)
    text = plan(flags.flags_for_users(users, specs, flag_queries.now(), flag_queries.rand(),
                                      "c_custkey"))
    assert "ScalarSubquery" not in text and "collect_list" not in text
    assert re.search(r"HashJoin \[[^\]]*property[^\]]*value", text)


def test_requests_are_parsed_once(spark):
    text = plan(event_queries.ingest_json_single(spark, SF_DIR))
    assert len(re.findall("parseJson|parse_json", text)) == 1
    assert "Exchange" not in text


def test_the_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert shared_dir(spark) == configured
    assert new_path(spark, "x").startswith(configured)


@pytest.mark.parametrize("hot_share", [0.34])
def test_a_hot_user_is_reduced_before_the_shuffle(spark, hot_share):
    """A third of all events by one user: the second stage sees one row per event name."""
    log = spark.range(200_000).select(
        F.col("id").alias("seq"), F.lit("default").alias("namespace"),
        F.concat(F.lit("e"), (F.col("id") % 20).cast("string")).alias("event_name"),
        F.when(F.rand(7) < hot_share, F.lit("hot")).otherwise(
            F.concat(F.lit("u"), (F.col("id") % 5000).cast("string"))).alias("user_id"),
        F.lit(1.0).alias("value"), F.lit(False).alias("ensure_goal"),
        F.lit(2024).alias("iso_year"), F.lit(1).alias("iso_week"))
    facts = materialize(mark_goals(first_writes(log), goals_of(spark, ("default", "e7"))),
                        "hot")
    hot = facts.filter("user_id = 'hot'")
    assert hot.count() == 21
    tags = prior_events(facts).filter("user_id = 'hot'").count()
    first_e7 = hot.filter("event_name = 'e7'").first()["seq"]
    earlier = hot.filter(f"counter_type = 'named' and seq < {first_e7}").count()
    assert tags == earlier
