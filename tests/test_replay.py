"""Batch and stream facts against an event-by-event replay."""

import time

import pytest
from pyspark.sql import functions as F

from tests.helpers import (fact_rows, goals_of, log_of, random_events, replay, tagged_facts,
                           with_tags)
from waymark.operators.cohorts import CohortRule
from waymark.operators.counters import (counter_totals, single_tag_counts,
                                        tag_counts)
from waymark.operators.facts import first_writes, prior_events
from waymark.operators.goals import goals_from_log, mark_goals, upsert_goals
from waymark.schemas import COUNTER_KEY, EVENT_LOG, WEEKLY
from waymark.session import streaming_session
from waymark.storage import new_path
from waymark.streaming import (IncrementalFacts, run_available, run_every,
                               stream_first_writes, write_append)
from waymark.streaming.first_writes import STREAM_FACTS

RULES = (CohortRule("e[0-3]$", date_cohort=WEEKLY), CohortRule(".*"))
PATTERN = "e[0-3]$"
FIXED = [("default", "e3"), ("other", "e1")]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batch_facts_equal_the_replay(spark, seed):
    events = random_events(1500, seed)
    log = log_of(spark, events)
    goals = upsert_goals(goals_of(spark, *FIXED).unionByName(goals_from_log(log)))
    facts = tagged_facts(log, goals, RULES)
    assert fact_rows(facts) == replay(events, FIXED, PATTERN)


def test_without_goals_or_weeks(spark):
    events = random_events(400, 4)
    facts = tagged_facts(log_of(spark, events), goals_of(spark, ("default", "none")))
    expected = {row[:8] + (False, ()) for row in replay(events)
                if not any(e[4] for e in events)} or {
        row[:8] for row in replay(events)}
    assert {row[:8] for row in fact_rows(facts)} == {row[:8] for row in expected}


def test_weekly_goal_can_leave_itself_out(spark):
    events = [("u", "a"), ("u", "e1"), ("u", "e1")]
    goals = goals_of(spark, ("default", "e1"))
    tags = {row[2]: row[9] for row in fact_rows(
        tagged_facts(log_of(spark, events), goals, RULES, include_self=False))
        if row[1] == "e1"}
    assert tags == {"named": ("a",), "weekly": ("a",)}
    with_self = {row[2]: row[9] for row in fact_rows(
        tagged_facts(log_of(spark, events), goals, RULES)) if row[1] == "e1"}
    assert with_self == {"named": ("a",), "weekly": ("a", "e1")}


def _arrive(spark, events, parts):
    """Write the log in ``parts`` consecutive pieces, one file system folder."""
    path = new_path(spark, "arrivals")
    log = log_of(spark, events)
    size = -(-len(events) // parts)
    for part in range(parts):
        yield path, log.filter(F.col("seq").between(part * size, (part + 1) * size - 1))


def test_stream_equals_batch_over_restarts(spark):
    events = random_events(900, 7)
    session = streaming_session(spark)
    goals = goals_of(session, *FIXED)
    base = new_path(spark, "stream")
    for path, piece in _arrive(spark, events, 3):
        piece.write.mode("append").parquet(path)
        stream = session.readStream.schema(EVENT_LOG).parquet(path)
        run_available(write_append(stream_first_writes(stream, goals, RULES),
                                   f"{base}/out", f"{base}/state"))
    streamed = spark.read.schema(STREAM_FACTS).parquet(f"{base}/out")
    quiet = [(*e[:4], False, e[5]) for e in events]
    assert fact_rows(streamed) == replay(quiet, FIXED, PATTERN)


def test_stream_continues_from_batch_facts(spark):
    events = [(*e[:4], False, e[5]) for e in random_events(600, 13)]
    session = streaming_session(spark)
    goals = goals_of(session, *FIXED)
    base = new_path(spark, "bootstrap")
    (early_path, early), (_, late) = list(_arrive(spark, events, 2))
    tagged = tagged_facts(early, goals_of(spark, *FIXED), RULES)
    tagged.write.parquet(f"{base}/stored")
    late.write.parquet(early_path)
    stored = session.read.schema(STREAM_FACTS).parquet(f"{base}/stored")
    stream = session.readStream.schema(EVENT_LOG).parquet(early_path)
    run_available(write_append(
        stream_first_writes(stream, goals, RULES, stored=stored),
        f"{base}/out", f"{base}/state"))
    streamed = fact_rows(spark.read.schema(STREAM_FACTS).parquet(f"{base}/out"))
    before = fact_rows(spark.read.schema(STREAM_FACTS).parquet(f"{base}/stored"))
    assert not streamed & before
    assert streamed | before == replay(events, FIXED, PATTERN)


def test_state_can_expire(spark):
    """With a lifetime the stream still runs and emits first writes."""
    session = streaming_session(spark)
    base = new_path(spark, "lifetime")
    log_of(spark, [("u", "x"), ("u", "x"), ("v", "x")]).write.parquet(f"{base}/in")
    stream = session.readStream.schema(EVENT_LOG).parquet(f"{base}/in")
    facts = stream_first_writes(stream, goals_of(session, *FIXED), ttl_ms=3_600_000)
    query = run_every(write_append(facts, f"{base}/out", f"{base}/state"), "1 second")
    try:
        for _ in range(60):
            if query.lastProgress:
                break
            time.sleep(1)
    finally:
        query.stop()
    assert spark.read.schema(STREAM_FACTS).parquet(f"{base}/out").count() == 4


def test_incremental_batches_see_goals_of_the_same_batch(spark):
    events = random_events(900, 8)
    session = streaming_session(spark)
    base = new_path(spark, "incremental")
    handler = IncrementalFacts(f"{base}/tables", RULES, goals_of(session, *FIXED))
    last = -1
    for path, piece in _arrive(spark, events, 3):
        piece.write.mode("append").parquet(path)
        stream = session.readStream.schema(EVENT_LOG).parquet(path)
        run_available(stream.writeStream.foreachBatch(handler)
                      .option("checkpointLocation", f"{base}/state"))
        last += 1
    facts = with_tags(handler.facts(spark, last), handler.prior(spark, last))
    assert fact_rows(facts) == replay(events, FIXED, PATTERN)


def test_a_repeated_batch_leaves_one_copy(spark):
    events = random_events(300, 9)
    handler = IncrementalFacts(f"{new_path(spark, 'repeat')}/tables", RULES)
    log = log_of(spark, events)
    handler(log, 0)
    once = handler.facts(spark, 0).count()
    handler(log, 0)
    assert handler.facts(spark, 0).count() == once
    handler(log, 1)
    assert handler.facts(spark, 1).count() == once


def test_counts_agree_with_each_other(spark):
    log = log_of(spark, random_events(1500, 11))
    marked = mark_goals(first_writes(log, RULES), goals_of(spark, *FIXED)).cache()
    prior = prior_events(marked)
    totals = counter_totals(marked)
    combos = tag_counts(totals, prior)
    singles = single_tag_counts(prior)
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in COUNTER_KEY]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    per_counter = combos.groupBy(*COUNTER_KEY).agg(F.sum("count").alias("total"))
    assert per_counter.count() == totals.count()
    assert per_counter.alias("a").join(totals.alias("b"), condition).filter(
        "a.total <> b.count").count() == 0
    assert singles.alias("a").join(totals.alias("b"), condition).filter(
        "a.count > b.count").count() == 0
    marked.unpersist()


def test_order_between_different_users_does_not_matter(spark):
    events = [(*e[:4], False, e[5]) for e in random_events(600, 12)]
    by_user = sorted(events, key=lambda e: e[0])  # stable: keeps each user's own order
    goals = goals_of(spark, *FIXED)

    def without_seq(rows):
        return {row[:6] + row[7:] for row in rows}

    first = fact_rows(tagged_facts(log_of(spark, events), goals, RULES))
    second = fact_rows(tagged_facts(log_of(spark, by_user), goals, RULES))
    assert without_seq(first) == without_seq(second)
