"""Conversation repair against a plain search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random
import re
import zlib

import pytest

from waymark.llm.conversation_repair import Segment, repair_damaged

NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """``(cost, audit, text)`` by uniform-cost search; ``rows`` are (role, text, fault)."""
    heap, seen = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, audit, "\n".join(made)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        turn, to = ("assistant", 3) if state == 2 else ("user", 2)
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, (*made, f"{turn}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, made))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                if role[:1] in NEXT[state]:
                    heapq.heappush(heap, (cost + extra, audit + "K", i + 1,
                                          NEXT[state][role[:1]], (*made, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + extra, audit + "R", i + 1, to,
                                      (*made, f"{turn}:{text}")))


def expected(table):
    """The report of a list of (conv_id, turn, role, text), row by row."""
    result = {}
    for conv in {row[0] for row in table}:
        rows = []
        for _, turn, role, text in (row for row in table if row[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(name.encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            visible = re.sub("[\x20\x09-\x0d]", "", text)
            fault = ("blank" if not visible else "duplicate" if (role, text) in seen
                     else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [r[0] for r in rows if r[0] is not None]
        initials = [role[:1] for role, _, _ in marked]
        cost, audit, text = cheapest(marked)
        faults = [fault for _, _, fault in marked]
        result[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
            cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return result


def report(spark, table, **options):
    frame = spark.createDataFrame(
        [(*row, "other") for row in table],
        "conv_id long, turn long, role string, text string, code string")
    rows = repair_damaged(frame, **options).collect()
    found = {row["conv_id"]: tuple(row)[1:] for row in rows}
    assert len(found) == len(rows)
    return found


def random_table(pick, conversations, longest):
    table = []
    for conv in [None, *range(conversations)]:
        for turn in range(pick.randrange(longest)):
            role = pick.choice(["user", "assistant", "user", "assistant", "system", "tool", "",
                                None, "Ärzte"])
            text = pick.choice(["Yes.", "No!", "Well", "", None, " \t", "Why? ", "Für é",
                                f"Line {turn}.\nEnd.", f"cut {turn}", "\x1c", "\x85"])
            table.append((conv, pick.choice([turn, turn, turn, None, turn + 3]), role, text))
    return table


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, seed):
    table = random_table(random.Random(seed), 150, 9)
    assert report(spark, table) == expected(table)


def test_segments_of_a_long_conversation(spark):
    pick = random.Random(5)
    table = random_table(pick, 6, 70)
    table += [(99, turn, pick.choice(["user", "assistant", "system"]), f"Turn {turn}.")
              for turn in range(800)]
    wanted = expected(table)
    assert report(spark, table, segment_rows=5) == wanted
    assert report(spark, table) == wanted


def test_system_turns_over_several_segments(spark):
    table = [(1, turn, "system", f"Rule {turn}.") for turn in range(40)]
    table += [(2, turn, "system", "") for turn in range(30)] + [(2, 99, "system", "Last.")]
    assert report(spark, table, segment_rows=4) == expected(table)


def test_repeated_rows_and_ties(spark):
    table = [(3, 1, "user", "Same."), (3, 1, "user", "Same."), (3, 1, "assistant", "Same."),
             (3, 1, "assistant", "Other."), (3, None, "user", "x" * 100_000 + ".")] * 3
    assert report(spark, table) == expected(table)
    assert report(spark, table, segment_rows=2) == expected(table)


def test_conversation_without_rows_after_damage(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert report(spark, [(conv, 0, "user", "Gone.")]) == {
        conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}


def test_empty_table(spark):
    assert report(spark, []) == {}


def test_search_returns_nothing_where_no_way_exists():
    assert Segment("u.a.").search(2, (1,)) is None
    assert Segment("u.s.").search(0, (1,)) == (3, "DK")
    assert Segment("").search(3, (0, 3)) == (0, "")


def test_estimate_never_exceeds_the_cost():
    pick = random.Random(9)
    for _ in range(300):
        codes = "".join(pick.choice("sua?") + pick.choice("bdt...") for _ in range(7))
        rows = [({"s": "s", "u": "u", "a": "a", "?": "x"}[r],
                 "", {"b": "blank", "d": "duplicate", "t": "truncated", ".": ""}[f])
                for r, f in zip(codes[::2], codes[1::2])]
        cost, audit, _ = cheapest(rows)
        assert Segment(codes).search(0, (0, 3)) == (cost, audit)
