"""Known counter results."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import goals_of, log_of
from waymark.operators import counters, funnels, membership, sketches
from waymark.operators.cohorts import CohortRule, setting_rejects, with_counter_settings
from waymark.operators.facts import first_writes, merge_first_writes, prior_events
from waymark.operators.goals import list_goals, mark_goals, upsert_goals
from waymark.schemas import EVENT_LOG


def results(spark, events, goals=(("default", "goal"),), rules=()):
    """(totals, combinations, singles) by event name, of the named counters."""
    marked = mark_goals(first_writes(log_of(spark, events), rules), goals_of(spark, *goals))
    prior = prior_events(marked)
    totals = counters.counter_totals(marked)
    combos = counters.tag_counts(totals, prior)
    named = lambda df: df.filter("counter_type = 'named'").collect()
    return ({r["event_name"]: (r["count"], r["value_sum"]) for r in named(totals)},
            {(r["event_name"], tuple(r["tags"])): r["count"] for r in named(combos)},
            {(r["event_name"], r["tag"]): r["count"] for r in
             named(counters.single_tag_counts(prior))})


@pytest.mark.parametrize("events, count, value", [
    ([("u", "x")], 1, None),
    ([("u", "x"), ("u", "x")], 1, None),
    ([("u1", "x"), ("u2", "x")], 2, None),
    ([("u", "x", 1)], 1, 1.0),
    ([("u", "x", 2), ("u", "x", 3)], 1, 2.0),
    ([("42", "x", 3), ("42", "x", 3)], 1, 3.0),
    ([("u", "x"), ("u", "x", 5)], 1, None),
    ([("u1", "x", 1.5), ("u2", "x", 2)], 2, 3.5),
])
def test_a_user_counts_once_with_the_first_value(spark, events, count, value):
    totals, combos, singles = results(spark, events)
    assert totals["x"] == (count, value)
    assert combos == {("x", ()): count}
    assert singles == {}


@pytest.mark.parametrize("events, combos, singles", [
    ([("u", "foo"), ("u", "goal")], {("foo",): 1}, {"foo": 1}),
    ([("1", "foo"), ("2", "foo"), ("1", "goal"), ("2", "goal")], {("foo",): 2}, {"foo": 2}),
    ([("u", "foo"), ("u", "goal"), ("u", "bar"), ("u", "goal")], {("foo",): 1}, {"foo": 1}),
    ([("1", "foo"), ("1", "bar"), ("2", "bar"), ("2", "foo"), ("1", "goal"), ("2", "goal")],
     {("bar", "foo"): 2}, {"bar": 2, "foo": 2}),
    ([("u", "A"), ("u", "B"), ("u", "C"), ("u", "goal")],
     {("A", "B", "C"): 1}, {"A": 1, "B": 1, "C": 1}),
    ([("u", "goal")], {(): 1}, {}),
    ([("1", "goal"), ("2", "foo"), ("2", "goal")], {(): 1, ("foo",): 1}, {"foo": 1}),
])
def test_goals_record_what_was_done_before(spark, events, combos, singles):
    _, all_combos, all_singles = results(spark, events)
    assert {k[1]: v for k, v in all_combos.items() if k[0] == "goal"} == combos
    assert {k[1]: v for k, v in all_singles.items()} == singles


def test_goals_of_another_namespace_record_nothing(spark):
    _, combos, singles = results(spark, [("u", "foo"), ("u", "goal")],
                                 goals=(("elsewhere", "goal"),))
    assert singles == {}
    assert combos[("goal", ())] == 1


def test_a_late_registration_leaves_earlier_users_alone(spark):
    events = [("1", "foo"), ("1", "goal"), ("2", "foo"), ("2", "goal"), ("1", "goal")]
    _, combos, singles = results(spark, events, goals=(("default", "goal", 3),))
    assert combos[("goal", ())] == 1 and combos[("goal", ("foo",))] == 1
    assert singles == {("goal", "foo"): 1}


def test_the_same_event_in_two_namespaces_is_two_counters(spark):
    log = log_of(spark, [("u", "x", None, "a"), ("u", "x", None, "b")])
    rows = counters.counter_totals(first_writes(log)).collect()
    assert len(rows) == 4 and all(r["count"] == 1 for r in rows)


def test_display_names_are_not_padded(spark):
    frame = spark.createDataFrame(
        [("default", "feature", "weekly", 2020, 1, 1), ("default", "x", "named", None, None, 1)],
        "namespace string, event_name string, counter_type string, iso_year int, iso_week int,"
        "count long")
    names = [r["name"] for r in counters.with_display_name(frame).collect()]
    assert names == ["feature 20201", "x"]


def test_goals_are_upserted_and_listed_by_namespace(spark):
    goals = upsert_goals(goals_of(spark, ("a", "g", 5), ("a", "g", 2), ("b", "h", 1)))
    assert {tuple(r) for r in goals.collect()} == {("a", "g", 2), ("b", "h", 1)}
    assert [r["goal_name"] for r in list_goals(goals, "a").collect()] == ["g"]


def test_dropped_counters_are_gone(spark):
    totals = counters.counter_totals(first_writes(log_of(spark, [("u", "x"), ("u", "y")])))
    removed = totals.filter("event_name = 'x'")
    left = counters.drop_counters(totals, removed)
    assert {r["event_name"] for r in left.collect()} == {"y", "global_counter"}


def test_events_of_a_user_are_the_named_ones_of_the_namespace(spark):
    facts = first_writes(log_of(spark, [("u", "y"), ("u", "x"), ("u", "z", None, "other"),
                                        ("v", "w")]))
    found = counters.events_of_user(facts, "default", "u")
    assert [r["event_name"] for r in found.collect()] == ["x", "y"]
    assert counters.events_of_user(facts, "default", "nobody").count() == 0


def test_first_matching_rule_applies_anywhere_in_the_name(spark):
    rules = (CohortRule("foo", kind="bloom_fixed_size", size=100, error_probability=None),
             CohortRule(".*", size=5))
    names = spark.createDataFrame([("a foo b",), ("bar",)], "event_name string")
    found = {r["event_name"]: (r["rule"], r["kind"], r["size"])
             for r in with_counter_settings(names, rules).collect()}
    assert found == {"a foo b": (1, "bloom_fixed_size", 100), "bar": (2, "bloom_scalable", 5)}
    other = with_counter_settings(names, (CohortRule("nothing like it"),)).collect()
    assert {(r["rule"], r["size"], r["error_probability"]) for r in other} == {
        (0, 100_000, 0.001)}


def test_unusable_settings_are_named(spark):
    frame = spark.createDataFrame([
        ("a", None, None, None, None), ("b", "fixed", 10, 0.1, None),
        ("c", "bloom_scalable", 10, 0.1, "monthly"), ("d", "bloom_fixed_size", 10, None, "weekly"),
        ("e", "bloom_scalable", 10, None, None), ("f", "bloom_fixed_size", 0, None, None)],
        "pattern string, kind string, size long, error_probability double, date_cohort string")
    assert {r["pattern"] for r in setting_rejects(frame).collect()} == set("abcef")


def test_entries_are_dealt_to_parts(spark):
    key = "namespace string, event_name string, counter_type string, iso_year int, iso_week int,"
    totals = spark.createDataFrame(
        [("n", "g", "named", None, None, 500, 1.0), ("n", "x", "named", None, None, 3, None)],
        key + "count long, value_sum double")
    tags = spark.createDataFrame(
        [("n", "g", "named", None, None, [f"t{i}"], 1) for i in range(500)]
        + [("n", "x", "named", None, None, [], 3)], key + "tags array<string>, count long")
    singles = spark.createDataFrame(
        [("n", "g", "named", None, None, f"t{i}", 1) for i in range(500)],
        key + "tag string, count long")
    rows = counters.nested_counts(totals, tags, singles).collect()
    big = [r for r in rows if r["event_name"] == "g"]
    assert len(big) == counters.PARTS
    assert {tuple(e["events"]) for r in big for e in r["event_counts"]} == {
        (f"t{i}",) for i in range(500)}
    assert sum(len(r["single_event_counts"]) for r in big) == 500
    assert len([r for r in rows if r["event_name"] == "x"]) == 1


def test_parts_of_a_log_merge(spark):
    events = [("u", "x", 1), ("v", "x", 2), ("u", "x", 3), ("u", "y", 4), ("v", "y", 5)]
    log = log_of(spark, events)
    early, late = log.filter("seq < 2"), log.filter("seq >= 2")
    whole = sorted(map(str, first_writes(log).collect()))
    for first, second in ((early, late), (late, early)):
        merged = merge_first_writes(first_writes(first), first_writes(second))
        assert sorted(map(str, merged.collect())) == whole


def _filters(spark, kind, size, error, users=20_000):
    everyone = spark.range(2 * users).select(F.col("id").cast("string").alias("user_id"))
    inside = F.col("user_id").cast("int") < users
    facts = everyone.filter(inside).select(
        F.lit("n").alias("namespace"), F.lit("e").alias("event_name"),
        F.lit("named").alias("counter_type"), "user_id")
    probes = everyone.select(F.lit("n").alias("namespace"), F.lit("e").alias("event_name"),
                             "user_id")
    plans = membership.filter_plans(spark.createDataFrame(
        [("n", "e", kind, size, error, users)], "namespace string, event_name string, "
        "kind string, size long, error_probability double, count long"))
    halves = [membership.build_filters(facts.filter(f"cast(user_id as int) % 2 = {i}"), plans)
              for i in (0, 1)]
    answers = membership.probably_done(probes, membership.merge_filters(*halves), plans)
    return answers.agg(F.count_if(inside & F.col("member")).alias("hits"),
                       F.count_if(~inside & F.col("member")).alias("errors")).first()


def test_filters_grow_to_their_users(spark):
    """Twenty times the capacity: no user is missed, and errors stay within the target."""
    found = _filters(spark, "bloom_scalable", 1_000, 0.01)
    assert found["hits"] == 20_000
    assert found["errors"] < 0.015 * 20_000


def test_a_filter_of_fixed_size_saturates(spark):
    found = _filters(spark, "bloom_fixed_size", 1_000, 0.01)
    assert found["hits"] == 20_000
    assert found["errors"] > 19_000


def test_a_counter_without_users_has_no_members(spark):
    probes = spark.createDataFrame([("n", "e", "u")],
                                   "namespace string, event_name string, user_id string")
    plans = spark.createDataFrame(
        [], "namespace string, event_name string, slices long, bits long, hashes int")
    filters = spark.createDataFrame(
        [], "namespace string, event_name string, slice long, word long, bits long")
    assert [r["member"] for r in membership.probably_done(probes, filters, plans).collect()
            ] == [False]


def test_sketches_merge(spark):
    log = spark.range(30_000).select(
        (F.col("id") % 10_000).cast("string").alias("user_id"), (F.col("id") % 7).alias("day"),
        F.lit("e").alias("event_name"))
    merged = sketches.merge_sketches(
        sketches.user_sketches(log, "event_name", "day"), "event_name")
    estimate = sketches.sketch_estimates(merged).first()["estimate"]
    assert abs(estimate - 10_000) < 300


def test_combinations_split_by_excluded_then_included(spark):
    histories = {"1": ["a", "x"], "2": ["a"], "3": ["a"], "4": ["b"], "5": [], "6": ["b", "a"]}
    events = [(user, name) for user, names in histories.items() for name in [*names, "goal"]]
    marked = mark_goals(first_writes(log_of(spark, events)),
                        goals_of(spark, ("default", "goal")))
    totals, prior = counters.counter_totals(marked.filter("is_goal")), prior_events(marked)
    split = funnels.split_combinations(totals, prior, include=["a"], exclude=["x"])
    assert {r["bucket"]: r["count"] for r in split.collect()} == {
        "excluded": 1, "included": 3, "ignored": 2}
    nothing = funnels.split_combinations(totals, prior)
    assert {r["bucket"]: r["count"] for r in nothing.collect()} == {"ignored": 6}
    depth = {r["depth"]: r["users"] for r in funnels.funnel_depth(totals, prior).collect()}
    assert depth == {0: 1, 1: 3, 2: 2}


def test_long_combinations_keep_all_their_events(spark):
    long = 10_500
    events = [(u, f"e{i}") for u in ("1", "2") for i in range(long)] + [
        ("3", "e0"), ("1", "goal"), ("2", "goal"), ("3", "goal")]
    marked = mark_goals(first_writes(log_of(spark, events)),
                        goals_of(spark, ("default", "goal")))
    prior = prior_events(marked)
    found = {(r["size"], r["count"]): r["tags"]
             for r in counters.tag_combinations(prior).collect()}
    assert found == {(long, 2): sorted(f"e{i}" for i in range(long)), (1, 1): ["e0"]}
    rows = counters.combination_events(counters.combination_counts(prior), prior).collect()
    assert {r["tag"] for r in rows if r["size"] == long} == {f"e{i}" for i in range(long)}
    assert len(rows) == long + 1


def test_users_with_the_same_order_number_keep_their_own_combinations(spark):
    prior = spark.createDataFrame(
        [("n", "gone", "named", None, None, user, 7, tag) for user, tags in
         {"u": "ab", "v": "bc", "w": "abc", "x": "ab"}.items() for tag in tags],
        "namespace string, event_name string, counter_type string, iso_year int, iso_week int, "
        "user_id string, goal_seq long, tag string")
    found = {tuple(r["tags"]): r["count"] for r in counters.tag_combinations(prior).collect()}
    assert found == {("a", "b"): 2, ("b", "c"): 1, ("a", "b", "c"): 1}


def test_sketches_refuse_an_error_they_cannot_reach():
    assert sketches.sketch_size(0.01) == 14
    with pytest.raises(ValueError):
        sketches.sketch_size(1e-4)


def test_an_empty_log_gives_empty_results(spark):
    log = spark.createDataFrame([], EVENT_LOG)
    marked = mark_goals(first_writes(log), goals_of(spark, ("default", "g")))
    assert counters.counter_totals(marked).count() == 0
    assert prior_events(marked).count() == 0
