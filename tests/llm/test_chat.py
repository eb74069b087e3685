"""Perspective rotation against a plain rendering."""

from __future__ import annotations

import re

from waymark.llm.chat import rotate_perspectives

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def rendered(rows):
    found = set()
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (
            r[1] is not None, r[1] or 0, r[2] or "unknown", r[3] or ""))
        names = [re.sub(r"[^\w-]", "_", r[2] or "unknown") for r in turns]
        for speaker in set(names) - {"system"}:
            at = 0
            for position, (turn, role) in enumerate(zip(turns, names)):
                header = ("assistant" if role == speaker else
                          role if role == "system" else f"user name={role}")
                text = (turn[3] or "").replace("<|", "< |")
                message = f"<|{header}|>\n{text}<|end|>\n"
                found.add((conv, speaker, position, turn[1], role, message, at,
                           at + len(message), role == speaker))
                at += len(message)
    return found


def test_rotation(spark):
    rows = [(1, 0, "system", "Rules", None), (1, 1, "anna", "hi <|end|> é", None),
            (1, 2, "bob b", "", None), (1, 3, "anna", None, None), (2, 0, "system", "only", None),
            (None, None, None, "lost", None), (None, 0, "anna", "x", None),
            (3, 5, "anna", "same", "x"), (3, 5, "anna", "same", "x"), (3, 5, "bob", "tie", "x")]
    rows += [(9, i, "anna" if i % 2 else "bob", f"long {i} 🎉", None) for i in range(500)]
    turns = spark.createDataFrame(rows, SCHEMA)
    result = rotate_perspectives(turns)
    assert result.columns == ["conv_id", "speaker", "position", "turn", "role", "message",
                              "start", "end", "mask"]
    found = [tuple(r) for r in result.collect()]
    assert len(found) == len(set(found))
    assert set(found) == rendered(rows)
    assert rotate_perspectives(turns.limit(0)).collect() == []
