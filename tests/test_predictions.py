"""Known prediction and nudge results."""

import pytest
from pyspark.sql import functions as F

from tests.helpers import goals_of, log_of
from waymark.operators import nudges, predictions
from waymark.operators.counters import counter_totals, single_tag_counts
from waymark.operators.facts import first_writes, prior_events
from waymark.operators.goals import mark_goals

TOTAL_TYPE = ("namespace string, event_name string, counter_type string, iso_year int,"
              "iso_week int, count long, value_sum double")
SINGLE_TYPE = ("namespace string, event_name string, counter_type string, iso_year int,"
               "iso_week int, tag string, count long")
REQUEST_TYPE = "request_id long, namespace string, events array<string>"


def counts(spark, named, singles, everyone, namespace="default"):
    totals = [(namespace, n, "named", None, None, c, None) for n, c in named.items()]
    totals.append((namespace, "global_counter", "internal", None, None, everyone, None))
    tags = [(namespace, goal, "named", None, None, tag, c) for (goal, tag), c in singles.items()]
    return spark.createDataFrame(totals, TOTAL_TYPE), spark.createDataFrame(tags, SINGLE_TYPE)


def ask(spark, totals, singles, *event_lists, namespace="default"):
    requests = spark.createDataFrame(
        [(i, namespace, list(events)) for i, events in enumerate(event_lists)], REQUEST_TYPE)
    rows = predictions.naive_bayes_events(
        requests, predictions.evidence_of(totals, singles)).collect()
    return {(r["request_id"], r["goal"]): (r["yes"], r["no"], r["likelihood"], r["note"])
            for r in rows}


@pytest.mark.parametrize("namespace", ["default", "elsewhere"])
def test_bayes(spark, namespace):
    both = counts(spark, {"feature": 2, "goal": 4}, {("goal", "feature"): 1}, 6, namespace)
    rows = predictions.bayes_predictions(*both).collect()
    assert [tuple(r) for r in rows] == [(namespace, "goal", "feature", 0.5)]


def test_naive_bayes_of_one_event(spark):
    both = counts(spark, {"feature": 2, "goal": 4}, {("goal", "feature"): 1}, 6)
    assert ask(spark, *both, ["feature"]) == {(0, "goal"): (0.25, 0.25, 1.0, None)}


def test_no_events_give_no_rows(spark):
    both = counts(spark, {"feature": 2, "goal": 4}, {("goal", "feature"): 1}, 6)
    assert ask(spark, *both, []) == {}


def test_a_goal_among_the_events_gets_a_note(spark):
    both = counts(spark, {"feature": 2, "goal": 4}, {("goal", "feature"): 1}, 6)
    found = ask(spark, *both, ["goal"], ["feature", "goal"])
    assert set(found.values()) == {(None, None, None, predictions.GOAL_NOTE)}
    assert len(found) == 2


def test_an_unknown_event_fails_the_request(spark):
    named = {"feature": 2, "goal": 4, "other": 3}
    singles = {("goal", "feature"): 1, ("other", "feature"): 1}
    totals, tags = counts(spark, named, singles, 6)
    found = ask(spark, totals, tags, ["No Match"], ["goal", "No Match"])
    assert {v[3] for v in found.values()} == {predictions.UNKNOWN_EVENT}
    assert len(found) == 4
    one_goal = counts(spark, {"feature": 2, "goal": 4}, {("goal", "feature"): 1}, 6)
    assert ask(spark, *one_goal, ["goal", "No Match"])[(0, "goal")][3] == predictions.GOAL_NOTE


def test_unknown_events_are_listed(spark):
    totals, _ = counts(spark, {"feature": 2}, {("g", "feature"): 1}, 6)
    requests = spark.createDataFrame([(1, "default", ["feature", "x"]), (2, "b", ["feature"])],
                                     REQUEST_TYPE)
    found = predictions.unknown_events(requests, totals).select("request_id", "event_name")
    assert {tuple(r) for r in found.collect()} == {(1, "x"), (2, "feature")}


def test_stolen_cars(spark):
    named = {"red": 5, "yellow": 5, "sports": 6, "suv": 4, "domestic": 5, "imported": 5,
             "was_stolen": 5}
    stolen = {"red": 3, "yellow": 2, "sports": 4, "suv": 1, "domestic": 2, "imported": 3}
    both = counts(spark, named, {("was_stolen", k): v for k, v in stolen.items()}, 10)
    yes, no, ratio, note = ask(spark, *both, ["red", "suv", "domestic"])[(0, "was_stolen")]
    assert (yes, no, ratio) == pytest.approx((0.048, 0.144, 0.048 / 0.144)) and note is None


def test_an_event_listed_twice_multiplies_twice(spark):
    both = counts(spark, {"feature": 2, "goal": 4}, {("goal", "feature"): 1}, 6)
    assert ask(spark, *both, ["feature", "feature"])[(0, "goal")] == (0.0625, 0.0625, 0.625, None)


@pytest.mark.parametrize("yes, no, ratio", [
    (0.016829971181556196, 0.0, 0.16829971181556194),
    (0.0, 0.3510382513661202, 0.0),
    (0.21160073336053775, 0.004485197799318837, 2.1160073336053773),
    (0.09355191256830601, 4.413551912568306, 0.02119651347068146),
])
def test_the_divisor_has_a_floor(spark, yes, no, ratio):
    from waymark.functions.probability import likelihood
    frame = spark.createDataFrame([(yes, no)], "yes double, no double")
    assert frame.select(likelihood(F.col("yes"), F.col("no"))).first()[0] == pytest.approx(ratio)


def test_goals_nobody_reached_after_an_event_are_left_out(spark):
    events = [("1", "a"), ("1", "g"), ("2", "h")]
    marked = mark_goals(first_writes(log_of(spark, events)),
                        goals_of(spark, ("default", "g"), ("default", "h")))
    found = predictions.goals_with_evidence(
        counter_totals(marked), single_tag_counts(prior_events(marked)))
    assert [tuple(r) for r in found.collect()] == [("default", "g", 1)]


def test_user_predictions_equal_asking_for_the_users_events(spark):
    events = [("1", "a"), ("1", "b"), ("1", "g"), ("2", "a"), ("2", "g"), ("3", "a"),
              ("3", "b"), ("4", "b"), ("4", "h"), ("5", "c")]
    facts = mark_goals(first_writes(log_of(spark, events)),
                       goals_of(spark, ("default", "g"), ("default", "h"))).cache()
    totals, singles = counter_totals(facts), single_tag_counts(prior_events(facts))
    evidence = predictions.evidence_of(totals, singles)
    bulk = {(r["user_id"], r["goal"]): tuple(r)[3:] for r in
            predictions.naive_bayes_users(facts, evidence).collect()}
    done = {"1": ["a", "b", "g"], "2": ["a", "g"], "3": ["a", "b"], "4": ["b", "h"], "5": ["c"]}
    users = sorted(done)
    single = ask(spark, totals, singles, *[done[u] for u in users])
    assert bulk == {(users[i], goal): v for (i, goal), v in single.items()}
    facts.unpersist()


PREDICTED = [("default", "g", "feature_2", .5), ("default", "g", "foo_event", .3),
             ("default", "g", "feature_1", .1)]


def test_nudges_leave_out_what_is_done(spark):
    predicted = spark.createDataFrame(
        PREDICTED, "namespace string, goal string, event_name string, bayes double")
    facts = first_writes(log_of(spark, [("u", "foo_event"), ("v", "unrelated")]))
    requests = spark.createDataFrame(
        [("default", "u", "g"), ("default", "new", "g"), ("default", "u", "unknown goal")],
        "namespace string, user_id string, goal string")

    def ranked(rows, user):
        mine = sorted((r["rank"], r["event_name"]) for r in rows if r["user_id"] == user)
        return [name for _, name in mine]

    asked = nudges.nudges_for_requests(requests, predicted, facts).collect()
    assert ranked(asked, "u") == ["feature_2", "feature_1"]
    assert ranked(asked, "new") == ["feature_2", "foo_event", "feature_1"]
    assert {r["goal"] for r in asked} == {"g"}
    everyone = nudges.nudges_for_all_users(facts, predicted).collect()
    assert ranked(everyone, "u") == ["feature_2", "feature_1"]
    assert ranked(everyone, "v") == ["feature_2", "foo_event", "feature_1"]


def test_a_repeated_request_changes_nothing(spark):
    predicted = spark.createDataFrame(
        PREDICTED, "namespace string, goal string, event_name string, bayes double")
    facts = first_writes(log_of(spark, [("u", "foo_event"), ("v", "unrelated")]))
    once = spark.createDataFrame([("default", "u", "g")],
                                 "namespace string, user_id string, goal string")
    rows = lambda asked: sorted(map(str, nudges.nudges_for_requests(
        asked, predicted, facts).collect()))
    assert rows(once.union(once)) == rows(once) and len(rows(once)) == 2


def test_equal_predictions_rank_by_name(spark):
    predicted = spark.createDataFrame(
        [("default", "g", n, .5) for n in ("b", "c", "a")],
        "namespace string, goal string, event_name string, bayes double")
    facts = first_writes(log_of(spark, [("u", "x")]))
    rows = nudges.nudges_for_all_users(facts, predicted).orderBy("rank").collect()
    assert [r["event_name"] for r in rows] == ["a", "b", "c"]


def test_requests_are_checked(spark):
    facts = first_writes(log_of(spark, [("u", "x")]))
    requests = spark.createDataFrame(
        [(1, "default", "u", ["x"]), (2, "default", "nobody", None), (3, "default", "u", []),
         (4, "default", None, ["x"]), (5, "other", "u", None)],
        "request_id int, namespace string, user_id string, events array<string>")
    status = {r["request_id"]: r["status"]
              for r in predictions.request_status(requests, facts).collect()}
    assert status == {1: predictions.BOTH_GIVEN, 2: predictions.NO_EVENTS, 3: "ok", 4: "ok",
                      5: predictions.NO_EVENTS}


def test_external_scores_join_and_add_goals(spark):
    internal = spark.createDataFrame(
        [("default", "goal_1", .1, .2, .5)],
        "namespace string, goal string, yes double, no double, likelihood double")
    external = spark.createDataFrame(
        [("default", "goal_1", "model_name", .5, .25), ("default", "goal_2", "model_name", .6, .1)],
        "namespace string, goal string, model string, yes double, no double")
    rows = {r["goal"]: tuple(r)[2:] for r in predictions.merge_external(
        internal, external, ["model_name"]).collect()}
    assert rows == {"goal_1": (.1, .2, .5, .5, .25), "goal_2": (None, None, None, .6, .1)}


def test_prediction_document(spark):
    predicted = spark.createDataFrame(
        PREDICTED[:2], "namespace string, goal string, event_name string, bayes double")
    rows = predictions.prediction_documents(predicted).collect()
    assert {r["document"] for r in rows} == {
        '{"events":{"feature_2":{"bayes":0.5}}}', '{"events":{"foo_event":{"bayes":0.3}}}'}
    assert len({r["part"] for r in rows}) == 2


def test_known_values_of_the_sample(spark):
    """P(goal | event) of the smallest sample in one namespace."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    log = events.select(F.col("event_id").alias("seq"), F.lit("default").alias("namespace"),
                        F.col("event_type").alias("event_name"),
                        F.col("user_id").cast("string").alias("user_id"), "value",
                        F.lit(False).alias("ensure_goal"), F.lit(2024).alias("iso_year"),
                        F.lit(1).alias("iso_week"))
    facts = mark_goals(first_writes(log), goals_of(spark, ("default", "purchase"),
                                                   ("default", "signup"))).cache()
    totals, singles = counter_totals(facts), single_tag_counts(prior_events(facts))
    found = {(r["goal"], r["event_name"]): round(r["bayes"] * 150)
             for r in predictions.bayes_predictions(totals, singles).collect()}
    assert found == {
        ("purchase", "click"): 79, ("purchase", "error"): 71, ("purchase", "signup"): 69,
        ("purchase", "view"): 77, ("signup", "click"): 83, ("signup", "error"): 82,
        ("signup", "purchase"): 81, ("signup", "view"): 79}
    sums = {r["event_name"]: round(r["value_sum"], 2) for r in
            totals.filter("counter_type = 'named'").collect()}
    assert sums == {"click": 8029.82, "error": 7274.61, "purchase": 7282.29,
                    "signup": 7956.37, "view": 7502.42}
    both = ask(spark, totals, singles, ["view", "click"])
    assert both[(0, "purchase")][:2] == pytest.approx((0.270356, 0.230356), abs=1e-6)
    assert both[(0, "signup")][:2] == pytest.approx((0.291422, 0.211422), abs=1e-6)
    facts.unpersist()
