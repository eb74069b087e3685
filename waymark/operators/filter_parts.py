"""The bits of Bloom filters: their parts are set and read here, many users at a time."""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Workers receive this module's code with the job and need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PART_BITS = 32_768  # of a part at most; the bytes of one are united by ``bitmap_or_agg``
AT_ONCE = 16  # parts of one stage that are built, or read, by one call
USERS_AT_ONCE = 65_536  # on average


def _hashes(users: pa.ChunkedArray) -> np.ndarray:
    return users.to_numpy().view(np.uint64)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each user, of a power of two: the first bits of its hash."""
    return ((hashes >> np.uint64(34)) * np.uint64(parts) >> np.uint64(30)).astype(np.int64)


def _drawn(hashes: np.ndarray, number: int) -> np.ndarray:
    """32 bits per user, independent for every number (SplitMix64)."""
    z = hashes + np.uint64(number * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z ^ (z >> np.uint64(31))) >> np.uint64(32)


def _position(drawn: np.ndarray, bits: int) -> np.ndarray:
    return (drawn * np.uint64(bits) >> np.uint64(32)).astype(np.int64)


def built(key: tuple[pa.Scalar, ...], users: pa.Table, plan: pa.Table) -> pa.Table:
    """The parts of a block that have users: ``(namespace, event_name, origin, stage, part,
    words)``. ``key`` begins with the stage and its block."""
    parts, bits, hashes = (plan.column(c)[0].as_py() for c in ("parts", "part_bits", "hashes"))
    user = _hashes(users.column("hash"))
    first = key[4].as_py() * AT_ONCE
    part = _part(user, parts) - first
    filled = np.zeros((min(AT_ONCE, parts - first), -(-bits // 8) * 8), bool)
    for number in range(1, hashes + 1):
        filled[part, _position(_drawn(user, number), bits)] = True
    present = np.unique(part)
    words = np.packbits(filled[present], axis=1, bitorder="little")
    return pa.table({
        **{name: pa.array([value.as_py()] * len(present), value.type) for name, value in zip(
            ("namespace", "event_name", "origin", "stage"), key)},
        "part": pa.array(present + first, pa.int64()),
        "words": pa.array([row.tobytes() for row in words], pa.binary())})


def _stages(parts: pa.Table) -> list[tuple[int, int, int, int, np.ndarray]]:
    """Per stage its number of parts, their bits, its hashes, and the words of its parts from
    a first one on; parts without users are empty."""
    found: dict[tuple, list[dict]] = {}
    for row in parts.to_pylist():
        found.setdefault((row["origin"], row["stage"]), []).append(row)
    laid_out = []
    for rows in found.values():
        first, last = (f(row["part"] for row in rows) for f in (min, max))
        words = np.zeros((last - first + 1, max(len(row["words"]) for row in rows)), np.uint8)
        for row in rows:
            words[row["part"] - first] |= np.frombuffer(row["words"], np.uint8)
        laid_out.append((rows[0]["parts"], rows[0]["part_bits"], rows[0]["hashes"], first, words))
    return laid_out


def looked_up(columns: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Probes with ``member``, given the parts in which they may be."""

    def run(probes: pa.Table, parts: pa.Table) -> pa.Table:
        user = _hashes(probes.column("_hash"))
        member, drawn = np.zeros(len(user), bool), {}
        for count, bits, hashes, first, words in _stages(parts):
            part = _part(user, count) - first
            asked = np.flatnonzero(~member & (part >= 0) & (part < len(words)))
            part = part[asked]
            for number in range(1, hashes + 1):  # few of the others remain after some
                if number not in drawn:
                    drawn[number] = _drawn(user, number)
                at = _position(drawn[number][asked], bits)
                held = (words[part, at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                asked, part = asked[held], part[held]
                if not len(asked):
                    break
            member[asked] = True
        return probes.select(columns).append_column("member", pa.array(member))

    return run
