"""Finding the faults of conversations and their cheapest repair by iterative-deepening A*.

A legal conversation has the role initials ``(s?(ua)+)?``: an optional system turn, then user
and assistant in turn. Edits are Keep, Rerole, Delete and Insert. The search goes depth first,
edits in ASCII order of their initials, under a cost bound that rises to the smallest estimate
it cut off; a table of failed (row, state, budget) entries cuts repeated work. The first path
that is accepted is the cheapest, and the least in ASCII order of these.

A conversation may hold most of the rows. Its rows are numbered by range, cut into segments of
``SEGMENT`` rows, and every segment is searched for itself, once per state it may be entered
and left in. The results of the segments are put together in order, holding only what is not
yet decided. Two things are one value per conversation by definition: the audit and the hash
of the repaired text. The hash is made from a sorted stream of rows, a row at a time.

Defined results: a null in any column reads as one space (a null ``conv_id`` is a conversation
of its own and stays null). Rows of equal turn are ordered by role and text. A role's initial
is its first character; any role but s, u and a must be changed or deleted. Repeated rows are
duplicates. Empty and very long texts are ordinary; an empty table gives an empty result;
other columns do not matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from waymark.llm.common import prefix_scan
from waymark.storage import materialize

SEGMENT = 192
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1  # costs
# States: 0 nothing yet, 1 after a system turn, 2 after a user turn, 3 after an assistant turn.
STEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ADDED = (2, 2, 3, 2)  # the state after a turn that was inserted or given another role
AFTER = {"s": 1, "u": 2, "a": 3}
ROLE = {2: "user", 3: "assistant"}
ACCEPTED = (0, 3)
_VISIBLE = r"[^\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text)``, the id as a string, with faults by the CRC of
    ``conv_id:turn``: of 20 rows one is dropped, one emptied, one loses its sentence ends, one
    is repeated, one gets the role user."""
    blank = F.lit(" ")
    role = F.coalesce(F.col("role").cast("string"), blank)
    text = F.coalesce(F.col("text").cast("string"), blank)
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    once, twice = F.array(F.lit(0)), F.array(F.lit(0), F.lit(1))
    return conversations.where(kind != 0).select(
        F.col("conv_id").cast("string").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, twice).otherwise(once)).alias("repeat")).drop("repeat")


def coded(rows: DataFrame) -> DataFrame:
    """``rows`` with ``position`` in their conversation and ``code``: the initial of the role
    and the first fault (b blank, d duplicate, t truncated, . none)."""
    placed = prefix_scan(rows, ["conv_id"], ["turn", "role", "text"], {}, "position",
                         "turns", dealt_by=["turn", "role"])
    placed = materialize(placed, "placed-turns")
    same = F.struct("role", F.unhex(F.md5("text")).alias("digest"))
    earliest = placed.groupBy(F.col("conv_id").alias("_conv"), same.alias("_same")).agg(
        F.min("position").alias("_earliest"))
    found = placed.join(earliest, F.col("conv_id").eqNullSafe(F.col("_conv"))
                        & (same == F.col("_same")))
    last = F.regexp_extract("text", rf"({_VISIBLE})[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(~F.col("text").rlike(_VISIBLE), "b")
             .when(F.col("position") > F.col("_earliest"), "d")
             .when(~last.isin(".", "!", "?"), "t").otherwise("."))
    initial = F.substring("role", 1, 1)
    return found.select(*placed.columns, F.concat(
        F.when(initial.isin("s", "u", "a"), initial).otherwise("?"), fault).alias("code"))


class Segment:
    """The search over some successive rows, given their codes."""

    def __init__(self, codes: str):
        self.initials, self.faults = codes[::2], codes[1::2]
        self.n = n = len(self.initials)
        # By row: what all rows from here on cost at least, the next row that may stay, and
        # whether a system turn is among those.
        self.forced, self.next_row, self.system = [0] * (n + 1), [n] * (n + 1), [False] * (n + 1)
        for i in range(n - 1, -1, -1):
            gone = self.faults[i] in "bd"
            self.forced[i] = self.forced[i + 1] + (
                DELETE if gone else TRUNCATED if self.faults[i] == "t" else 0)
            self.next_row[i] = self.next_row[i + 1] if gone else i
            self.system[i] = self.system[i + 1] or (not gone and self.initials[i] == "s")

    def breaks(self, goals: tuple[int, ...]) -> list[int]:
        """By row that may stay: illegal neighbours from it on, the end included."""
        found = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            if self.next_row[i] != i:
                continue
            state, after = AFTER.get(self.initials[i]), self.next_row[i + 1]
            legal = state in goals if after == self.n else (
                state is not None and self.initials[after] in STEPS[state])
            found[i] = found[after] + (not legal)
        return found

    def search(self, entry: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
        """Cost and edits of the cheapest way from ``entry`` to one of ``goals``, the least in
        ASCII order; None if there is none."""
        breaks = self.breaks(goals)

        def least(i: int, state: int) -> float:
            # An edit costs 2 or more and mends at most two illegal neighbours.
            at = self.next_row[i]
            if not (2 in goals or 3 in goals):
                if state > 1 or (state == 1 and 1 not in goals) or (
                        state == 0 and 0 not in goals and not self.system[i]):
                    return math.inf
            entered = state in goals if at == self.n else self.initials[at] in STEPS[state]
            return self.forced[i] + 2 * ((breaks[at] + (not entered) + 1) // 2)

        bound = least(0, entry)
        while bound < math.inf:
            path, bound_or_next = self.deepen(entry, goals, bound, least)
            if path is not None:
                return int(bound), path
            bound = bound_or_next
        return None

    def moves(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """Edits in ASCII order with the row and state they lead to and what they cost."""
        if i < self.n:
            yield "D", i + 1, state, DELETE
        yield "I", i, ADDED[state], INSERT
        if i < self.n and self.faults[i] not in "bd":
            extra = TRUNCATED if self.faults[i] == "t" else 0
            kept = STEPS[state].get(self.initials[i])
            if kept is not None:
                yield "K", i + 1, kept, extra
            yield "R", i + 1, ADDED[state], REROLE + extra

    def deepen(self, entry, goals, bound, least) -> tuple[str | None, float]:
        """The first accepted path within ``bound``, else the smallest estimate beyond it."""
        if self.n == 0 and entry in goals:
            return "", bound
        failed: dict[tuple[int, int], float] = {}
        beyond = math.inf
        letters: list[str] = []
        stack = [(0, entry, 0, self.moves(0, entry))]
        while stack:
            i, state, spent, rest = stack[-1]
            for letter, row, reached, cost in rest:
                total = spent + cost
                estimate = total + least(row, reached)
                if estimate > bound:
                    beyond = min(beyond, estimate)
                elif failed.get((row, reached), -1) < bound - total:
                    letters.append(letter)
                    if row == self.n and reached in goals:
                        return "".join(letters), bound
                    stack.append((row, reached, total, self.moves(row, reached)))
                    break
            else:
                stack.pop()
                failed[i, state] = max(failed.get((i, state), -1), bound - spent)
                if letters:
                    letters.pop()
        return None, beyond


def routes(codes: str, first: bool, last: bool) -> list[tuple[int, int, int, str]]:
    """``(entry, exit, cost, audit)`` for every way through a segment; the exit of the last
    one is -1."""
    segment = Segment(codes)
    found = []
    for entry in (0,) if first else range(4):
        for goals in (ACCEPTED,) if last else ((0,), (1,), (2,), (3,)):
            best = segment.search(entry, goals)
            if best is not None:
                found.append((entry, -1 if last else goals[0], *best))
    return found


def searched(segments: DataFrame) -> DataFrame:
    """``segments`` with the ways through each of them."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["routes"] = [
                [dict(zip(("entry", "exit", "cost", "audit"), r))
                 for r in routes(codes, segment == 0, segment == last)]
                for codes, segment, last in zip(batch["codes"], batch["segment"], batch["last"])]
            yield batch

    return segments.select("conv_id", "segment", "last", "codes").mapInPandas(
        run, "conv_id string, segment long, last long, codes string, "
             "routes array<struct<entry int, exit int, cost long, audit string>>")


class Joined:
    """Puts the segments of one conversation together, in order."""

    def __init__(self):
        # By state: cost, edits since the last decided segment, and (entry, edits) by segment.
        self.alive = {0: (0, "", [])}
        self.base = 0
        self.decided: list[str] = []
        self.illegal, self.before = 0, ""

    def add(self, segment: int, codes: str, ways) -> list[tuple[int, int, str]]:
        """Takes the next segment; returns ``(segment, entry, audit)`` of those decided now."""
        initials = self.before + codes[::2]
        self.illegal += sum(a + b not in ("su", "ua", "au")
                            for a, b in zip(initials, initials[1:]))
        self.before = initials[-1:]
        found: dict[int, tuple[int, str, list[tuple[int, str]]]] = {}
        for way in ways:
            if way["entry"] in self.alive:
                cost, edits, parts = self.alive[way["entry"]]
                new = (cost + way["cost"], edits + way["audit"])
                if way["exit"] not in found or new < found[way["exit"]][:2]:
                    found[way["exit"]] = (*new, [*parts, (way["entry"], way["audit"])])
        self.alive = found
        agreed = []
        lists = [parts for _, _, parts in found.values()]
        while lists[0] and all(p and p[0] == lists[0][0] for p in lists):
            entry, audit = lists[0][0]
            agreed.append((segment - len(lists[0]) + 1, entry, audit))
            self.decided.append(audit)
            for parts in lists:
                parts.pop(0)
            self.alive = {s: (c, e[len(audit):], p) for s, (c, e, p) in self.alive.items()}
            lists = [parts for _, _, parts in self.alive.values()]
        return agreed

    def total(self) -> tuple[int, int, str]:
        (cost, _, _), = self.alive.values()
        return self.illegal, cost, "".join(self.decided)


def joined(ways: DataFrame) -> DataFrame:
    """One row per segment with the chosen ``entry`` and ``audit``, and one per conversation,
    with segment -1, that has ``illegal``, ``cost`` and the whole ``audit``."""
    schema = "conv_id string, segment long, entry int, audit string, illegal long, cost long"
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = Joined()
        for batch in batches:
            rows = []
            for conv, segment, last, codes, found in zip(*(batch[c] for c in batch.columns)):
                if segment == 0:
                    state = Joined()
                rows += [(conv, *done, 0, 0) for done in state.add(segment, codes, found)]
                if segment == last:
                    illegal, cost, audit = state.total()
                    rows.append((conv, -1, 0, audit, illegal, cost))
            yield pd.DataFrame(rows, columns=names)

    dealt = ways.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return dealt.mapInPandas(run, schema)


class Rewriter:
    """Hashes the repaired rows of a conversation, a row at a time."""

    def __init__(self):
        self.hash, self.empty = hashlib.sha256(), True

    def enter(self, state: int, audit: str) -> None:
        """Starts a segment; turns inserted before its first row are written."""
        self.state, self.edits = state, iter(audit)
        self.letter = next(self.edits, "")
        self.write_inserted()

    def write(self, role: str, text: str) -> None:
        self.hash.update(("" if self.empty else "\n").encode())
        self.hash.update(f"{role}:{text}".encode("utf-8"))
        self.empty = False

    def write_inserted(self) -> None:
        while self.letter == "I":
            self.state = ADDED[self.state]
            self.write(ROLE[self.state], "")
            self.letter = next(self.edits, "")

    def row(self, role: str, text: str) -> None:
        if self.letter == "K":
            self.state = STEPS[self.state][role[0]]
            self.write(role, text)
        elif self.letter == "R":
            self.state = ADDED[self.state]
            self.write(ROLE[self.state], text)
        self.letter = next(self.edits, "")
        self.write_inserted()


def rewritten(rows: DataFrame, chosen: DataFrame, segment_rows: int) -> DataFrame:
    """``(conv_id, repaired_sha256)`` from all rows and the edits of their segments."""
    parts = chosen.where("segment >= 0").select(
        F.col("conv_id").alias("_conv"), F.col("segment").alias("_segment"), "entry", "audit")
    # Both sides grow with the conversations.
    both = rows.join(parts.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv")) & (
        F.floor(F.col("position") / segment_rows) == F.col("_segment")))
    dealt = (both.select("conv_id", "position", "n_rows", "entry", "audit", "role", "text")
             .repartition("conv_id").sortWithinPartitions("conv_id", "position"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer = Rewriter()
        for batch in batches:
            done = []
            for conv, position, n_rows, entry, audit, role, text in zip(
                    *(batch[c] for c in batch.columns)):
                if position == 0:
                    writer = Rewriter()
                if position % segment_rows == 0:
                    writer.enter(entry, audit)
                writer.row(role, text)
                if position == n_rows - 1:
                    done.append((conv, writer.hash.hexdigest()))
            yield pd.DataFrame(done, columns=["conv_id", "repaired_sha256"])

    return dealt.mapInPandas(run, "conv_id string, repaired_sha256 string")


def repair_report(rows: DataFrame, segment_rows: int = SEGMENT) -> DataFrame:
    """Faults and cheapest repair of every conversation of ``rows`` (as from :func:`damaged`):
    ``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``.
    """
    found = materialize(coded(rows), "coded-turns")

    def faults(letter: str):
        return F.sum((F.substring("code", 2, 1) == letter).cast("long"))

    stats = (found.groupBy("conv_id", "turn")
             .agg(F.count("*").alias("n"), faults("b").alias("b"), faults("d").alias("d"),
                  faults("t").alias("t"))
             .groupBy("conv_id").agg(
                 F.sum("n").alias("n_rows"),
                 F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0))
                 .alias("gaps"),
                 F.sum("b").alias("blank"), F.sum("d").alias("duplicate"),
                 F.sum("t").alias("truncated")))
    stats = materialize(stats, "conversations")
    sized = stats.select(F.col("conv_id").alias("_of"), "n_rows")
    rows = found.join(sized, F.col("conv_id").eqNullSafe(F.col("_of"))).drop("_of")
    segment = F.floor(F.col("position") / segment_rows)
    segments = (rows.groupBy("conv_id", segment.alias("segment"),
                             F.floor((F.col("n_rows") - 1) / segment_rows).alias("last"))
                .agg(F.array_sort(F.collect_list(F.struct("position", "code"))).alias("list"))
                .select("conv_id", "segment", "last",
                        F.array_join(F.col("list.code"), "").alias("codes")))
    chosen = materialize(joined(searched(segments)), "edits")
    whole = chosen.where("segment = -1").select(
        F.col("conv_id").alias("_whole"), "illegal", "cost", "audit")
    hashes = rewritten(rows, chosen, segment_rows).withColumnRenamed("conv_id", "_hashed")
    same = F.col("conv_id").eqNullSafe
    return (stats.join(whole, same(F.col("_whole"))).join(hashes, same(F.col("_hashed")))
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost",
                    "audit", "repaired_sha256"))


def repair_damaged(conversations: DataFrame, segment_rows: int = SEGMENT) -> DataFrame:
    """:func:`repair_report` of the damaged conversations, with a row for every original one;
    a conversation without rows has zeros and the hash of an empty text."""
    found = repair_report(damaged(conversations), segment_rows)
    ids = conversations.groupBy(F.col("conv_id").alias("_original")).agg(F.count("*").alias("_n"))
    zeros = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    same = F.col("_original").cast("string").eqNullSafe(F.col("conv_id"))
    return ids.join(found, same, "left").select(
        F.col("_original").alias("conv_id"),
        *(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in zeros),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest()))
        .alias("repaired_sha256"))
