"""Snapshots, metrics and documents."""

import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import goals_of, log_of
from waymark.operators.cohorts import CohortRule
from waymark.operators.counters import (counter_totals, nested_counts, single_tag_counts,
                                        tag_counts)
from waymark.operators.facts import first_writes, prior_events
from waymark.operators.goals import mark_goals
from waymark.sinks import (analytics_documents, counter_metrics, read_counters, read_goals,
                           read_specs, write_changed_counters, write_counters, write_goals)

EVENTS = [("u", "a: b/c", 2), ("u", "goal"), ("v", "a: b/c"), ("w", "goal", 1)]
RULES = (CohortRule("goal", date_cohort="weekly"),)


def test_counters_come_back_unchanged(spark, tmp_path):
    totals = counter_totals(first_writes(log_of(spark, EVENTS), RULES))
    write_counters(totals, str(tmp_path / "c"))
    back = read_counters(spark, str(tmp_path / "c"))
    assert back.columns == totals.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, totals.collect()))


def test_missing_snapshots_are_empty(spark, tmp_path):
    for read in (read_counters, read_goals, read_specs):
        assert read(spark, str(tmp_path / "absent")).count() == 0


def test_goals_come_back(spark, tmp_path):
    write_goals(goals_of(spark, ("a", "g", 5)), str(tmp_path / "g"))
    assert [tuple(r) for r in read_goals(spark, str(tmp_path / "g")).collect()] == [("a", "g", 5)]


def totals_of(spark, events):
    return counter_totals(first_writes(log_of(spark, events)))


def plain(frame):
    return sorted(map(str, frame.collect()))


def test_a_failed_write_leaves_the_old_snapshot(spark, tmp_path):
    path = str(tmp_path / "c")
    first = totals_of(spark, EVENTS)
    assert write_counters(first, path) == 0
    open_before = read_counters(spark, path)
    broken = totals_of(spark, [*EVENTS, ("x", "new")]).withColumn(
        "count", F.raise_error(F.lit("lost")).cast("long"))
    for write in (write_counters, write_changed_counters):
        with pytest.raises(Exception, match="lost"):
            write(broken, path)
        assert plain(read_counters(spark, path)) == plain(first)
    second = totals_of(spark, [*EVENTS, ("x", "new")])
    assert write_counters(second, path) == 1
    assert plain(read_counters(spark, path)) == plain(second)
    assert plain(open_before) == plain(first)  # a reader keeps to its version
    assert plain(read_counters(spark, path, version=0)) == plain(first)


def test_only_changed_counters_are_written(spark, tmp_path):
    path = str(tmp_path / "c")
    kept = {}
    for number in range(11):  # merged on the way
        changed = totals_of(spark, [(f"u{i}", f"e{number % 4}") for i in range(number + 1)])
        write_changed_counters(changed, path)
        for row in changed.collect():
            kept[row["event_name"]] = str(row)
        assert plain(read_counters(spark, path)) == sorted(kept.values())
    assert len(list(tmp_path.glob("c/data-*"))) <= 8 + 3


def test_old_versions_lose_their_files(spark, tmp_path):
    path = str(tmp_path / "g")
    for number in range(6):
        write_goals(goals_of(spark, ("a", f"g{number}", 5)), path)
    assert [r["goal_name"] for r in read_goals(spark, path).collect()] == ["g5"]
    assert len(list(tmp_path.glob("g/data-*"))) == 3


def test_metrics(spark):
    totals = counter_totals(first_writes(log_of(spark, EVENTS), RULES))
    rows = {(r["metric"], tuple(sorted(r["labels"].items())), r["value"])
            for r in counter_metrics(totals).collect()}
    assert ("event_counter_weekly", (("name", "goal"), ("namespace", "default"), ("week", "1"),
                                     ("year", "2024")), 2.0) in rows
    assert ("event_counter", (("name", "global_counter"), ("namespace", "default")), 3.0) in rows


def test_documents(spark):
    marked = mark_goals(first_writes(log_of(spark, EVENTS)), goals_of(spark, ("default", "goal")))
    prior, totals = prior_events(marked), counter_totals(marked)
    nested = nested_counts(totals, tag_counts(totals, prior),
                           single_tag_counts(prior))
    found = {}
    for row in analytics_documents(nested).collect():  # the parts of a counter put together
        document = json.loads(row["document"])
        whole = found.setdefault(row["name"], document)
        if whole is not document:
            for entries in ("event_counts", "single_event_counts"):
                whole[entries] = sorted(whole[entries] + document[entries], key=str)
    assert found["goal"] == {
        "name": "goal", "type": "named", "count": 2, "value": {"sum": 1.0},
        "event_counts": [{"events": ["a: b/c"], "count": 1}, {"events": [], "count": 1}],
        "single_event_counts": [{"name": "a: b/c", "count": 1}]}
    assert found["a: b/c"]["single_event_counts"] == []
    assert found["global_counter"]["type"] == "internal"
