"""Continuous first writes: keyed state per user, facts appended as they happen."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waymark.operators.cohorts import CohortRule, is_weekly
from waymark.schemas import FIRST_WRITES, GLOBAL_COUNTER, INTERNAL, NAMED, WEEKLY

# Workers receive this module's code with the job and need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STREAM_FACTS = T.StructType([
    *FIRST_WRITES.fields,
    T.StructField("is_goal", T.BooleanType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
])

_INPUT = T.StructType([
    T.StructField("namespace", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("event_name", T.StringType()),
    T.StructField("iso_year", T.IntegerType()),
    T.StructField("iso_week", T.IntegerType()),
    T.StructField("seq", T.LongType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("active_from_seq", T.LongType()),
])
_KEYS = ["namespace", "user_id", "event_name", "iso_year", "iso_week"]


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per Arrow batch, the first row of each user, event and week.

    Later repeats can never be first writes, so dropping them before the shuffle is exact,
    and a very active user no longer sends every event to one task.
    """
    first = pc.ScalarAggregateOptions(skip_nulls=False)
    others = [f.name for f in _INPUT.fields if f.name not in _KEYS]
    schema = None
    for batch in batches:
        schema = schema or batch.schema
        table = pa.Table.from_batches([batch]).sort_by("seq")
        kept = table.group_by(_KEYS, use_threads=False).aggregate(
            [(name, "first", first) for name in others])
        renamed = kept.rename_columns(
            [n.removesuffix("_first") for n in kept.column_names])
        yield from renamed.select(schema.names).cast(schema).to_batches()


class FirstWriteProcessor(StatefulProcessor):
    """State of one user in one namespace: the first writes so far, as a growing list.

    A write is ``(event, year, week)`` with its order number; the named one has no week.
    One read and one append per user and micro-batch keep the traffic between Python and
    the state store low, and appending never rewrites what is stored. The list holds at
    most one entry per event name and week. ``ttl_ms`` lets entries expire; that bounds
    state but makes a returning user count again, so it is off by default.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.writes = handle.getListState(
            "writes", "event string, iso_year int, iso_week int, seq bigint", self.ttl_ms)

    def handleInitialState(self, key, stored: Row, timer_values) -> None:
        """One fact of an earlier run; called for each before the first micro-batch."""
        self.writes.appendValue(
            (stored.event_name, stored.iso_year, stored.iso_week, stored.seq))

    def handleInputRows(self, key, rows: Iterator[Row], timer_values) -> Iterator[Row]:
        namespace, user = key
        earliest: dict[tuple, Row] = {}
        for row in rows:
            slot = (row.event_name, row.iso_year, row.iso_week)
            if slot not in earliest or row.seq < earliest[slot].seq:
                earliest[slot] = row

        named: dict[str, int] = {}
        weeks: set[tuple] = set()
        for event, year, week, seq in self.writes.get():
            if week is None:
                named[event] = seq
            else:
                weeks.add((event, year, week))
        greeted, added = bool(named), []

        def prior(limit: int, inclusive: bool) -> list[str]:
            return sorted(name for name, seq in named.items()
                          if seq < limit or (inclusive and seq == limit))

        def fact(kind: str, row: Row, goal: bool) -> Row:
            name = GLOBAL_COUNTER if kind == INTERNAL else row.event_name
            year, week = (row.iso_year, row.iso_week) if kind == WEEKLY else (None, None)
            tags = prior(row.seq, kind == WEEKLY) if goal else []
            return Row(namespace=namespace, event_name=name, counter_type=kind,
                       iso_year=year, iso_week=week, user_id=user, seq=row.seq,
                       value=row.value, is_goal=goal, tags=tags)

        for row in sorted(earliest.values(), key=lambda r: r.seq):
            goal = row.active_from_seq is not None and row.seq >= row.active_from_seq
            slot = (row.event_name, row.iso_year, row.iso_week)
            if not greeted:
                yield fact(INTERNAL, row, False)
                greeted = True
            if row.event_name not in named:
                yield fact(NAMED, row, goal)
                named[row.event_name] = row.seq
                added.append((row.event_name, None, None, row.seq))
            if row.iso_week is not None and slot not in weeks:
                yield fact(WEEKLY, row, goal)
                weeks.add(slot)
                added.append((*slot, row.seq))
        if added:
            self.writes.appendList(added)

    def close(self) -> None:
        pass


def stream_first_writes(log: DataFrame, goals: DataFrame,
                        rules: Sequence[CohortRule] = (),
                        ttl_ms: int | None = None,
                        stored: DataFrame | None = None) -> DataFrame:
    """Streaming event log → facts with tags, each emitted once, in append mode.

    ``goals`` is the goal table known when the stream starts; goals announced inside the
    stream need :class:`waymark.streaming.incremental.IncrementalFacts`. Arrival order
    rules: inside a micro-batch rows are taken by ``seq``, and a batch never reopens what
    an earlier one wrote. Old dates are accepted at any time; there is no watermark.

    A lifetime (``ttl_ms``) follows the clock, so such a stream never runs out of work:
    start it with ``run_every``, not ``run_available``.

    ``stored`` are facts written earlier, for instance by a batch job. The first run takes
    them as its state, and they are not emitted again.
    """
    registered = goals.select("namespace", F.col("goal_name").alias("event_name"),
                              "active_from_seq")
    dated = is_weekly(F.col("event_name"), rules)
    rows = (log.join(registered, ["namespace", "event_name"], "left")
            .withColumn("iso_year", F.when(dated, F.col("iso_year")))
            .withColumn("iso_week", F.when(dated, F.col("iso_week")))
            .select(*_INPUT.fieldNames()))
    known = None
    if stored is not None:
        known = (stored.filter(F.col("counter_type").isin(NAMED, WEEKLY))
                 .select("namespace", "user_id", "event_name", "iso_year", "iso_week", "seq")
                 .groupBy("namespace", "user_id"))
    return (rows.mapInArrow(_first_rows, _INPUT)
            .groupBy("namespace", "user_id")
            .transformWithState(FirstWriteProcessor(ttl_ms), STREAM_FACTS,
                                outputMode="Append",
                                timeMode="ProcessingTime" if ttl_ms else "None",
                                initialState=known))
