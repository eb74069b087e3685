"""Small event logs for tests, and an event-by-event replay to compare with."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta

from pyspark.sql import functions as F

from waymark.operators.counters import same_counter
from waymark.operators.facts import first_writes, prior_events
from waymark.operators.goals import mark_goals
from waymark.schemas import COUNTER_KEY, EVENT_LOG, GOALS


def log_of(spark, events):
    """``(user, event[, value[, namespace[, ensure_goal[, day]]]])`` in arrival order."""
    rows = []
    for seq, event in enumerate(events):
        user, name, value, namespace, ensure, day = (
            list(event) + [None, None, "default", False, date(2024, 1, 1)][len(event) - 1:])
        year, week, _ = day.isocalendar()
        rows.append((seq, namespace, name, user,
                     None if value is None else float(value), ensure, year, week))
    return spark.createDataFrame(rows, EVENT_LOG)


def goals_of(spark, *goals):
    return spark.createDataFrame([(*g, 0) if len(g) == 2 else g for g in goals], GOALS)


def with_tags(marked, prior):
    """Facts with the list of what their users had done before."""
    lists = (prior.groupBy(*COUNTER_KEY, "user_id")
             .agg(F.array_sort(F.collect_list("tag")).alias("tags")))
    condition = same_counter("m", "l", [*COUNTER_KEY, "user_id"])
    return (marked.alias("m").join(lists.alias("l"), condition, "left")
            .select("m.*", F.coalesce("l.tags", F.array().cast("array<string>"))
                    .alias("tags")))


def tagged_facts(log, goals, rules=(), include_self=True):
    marked = mark_goals(first_writes(log, rules), goals)
    return with_tags(marked, prior_events(marked, include_self))


def fact_rows(facts):
    """Facts as a set of plain tuples."""
    rows = facts.select("namespace", "event_name", "counter_type", "iso_year", "iso_week",
                        "user_id", "seq", "value", "is_goal", F.array_sort("tags").alias("t"))
    collected = [tuple(r[:-1]) + (tuple(r["t"]),) for r in rows.collect()]
    assert len(collected) == len(set(collected))
    return set(collected)


def random_events(count, seed, users=40, names=12, namespaces=("default", "other")):
    """Random events: skewed users, dates in no order, some values, some goal flags."""
    pick = random.Random(seed)
    start = date(2020, 12, 20)
    events = []
    for _ in range(count):
        user = "hot" if pick.random() < 0.34 else f"u{pick.randrange(users)}"
        name = f"e{pick.randrange(names)}"
        value = pick.randrange(100) if pick.random() < 0.6 else None
        ensure = name in ("e1", "e2") and pick.random() < 0.1
        events.append((user, name, value, pick.choice(namespaces), ensure,
                       start + timedelta(days=pick.randrange(30))))
    return events


def replay(events, goals=(), weekly_pattern=None):
    """One event at a time over plain dictionaries, following the counting rules."""
    registered = {(ns, name) for ns, name in goals}
    seen, facts = {}, set()
    for seq, (user, name, value, ns, ensure, day) in enumerate(events):
        if ensure:
            registered.add((ns, name))
        year, week, _ = day.isocalendar()
        targets = [("global_counter", "internal", None, None), (name, "named", None, None)]
        if weekly_pattern and re.search(weekly_pattern, name):
            targets.append((name, "weekly", year, week))
        for counter in targets:
            is_goal = counter[1] != "internal" and (ns, name) in registered
            history = sorted({key[1] for key in seen.get((ns, user), ())
                              if key[0] == "named"})
            done = seen.setdefault((ns, user), set())
            key = (counter[1], counter[0], counter[2], counter[3])
            if key in done:
                continue
            done.add(key)
            facts.add((ns, counter[0], counter[1], counter[2], counter[3], user, seq,
                       None if value is None else float(value), is_goal,
                       tuple(history) if is_goal else ()))
    return facts
