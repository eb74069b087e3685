"""Wide tables as events: every named column becomes ``prefix:value`` events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from waymark.functions.dates import week_of_arrival
from waymark.functions.names import normalize_user_id
from waymark.schemas import DEFAULT_NAMESPACE


@dataclass(frozen=True)
class Pass:
    """One load pass over the table: a column, its event prefix, and whether it is a goal."""

    column: str
    prefix: str
    goal: bool = False


def wide_to_events(table: DataFrame, user: str, row_order: str,
                   passes: Sequence[Pass]) -> DataFrame:
    """Unpivot in one scan; a later pass arrives after every row of an earlier one.

    ``row_order`` is a non-negative BIGINT. The pass number takes the bits above it, so the
    order needs neither a sort nor a row count.
    """
    order_bits = 56
    entries = F.array(*[
        F.struct(F.lit(number).cast("long").alias("pass"),
                 F.concat(F.lit(p.prefix), F.col(p.column).cast("string")).alias("event_name"),
                 F.lit(p.goal).alias("ensure_goal"))
        for number, p in enumerate(passes)])
    fits = F.col(row_order).between(0, (1 << order_bits) - 1)
    exploded = table.select(
        normalize_user_id(F.col(user)).alias("user_id"),
        F.when(fits, F.col(row_order)).otherwise(
            F.raise_error(F.lit("row order is out of range"))).cast("long").alias("_row"),
        F.explode(entries).alias("e"))
    return exploded.filter(F.col("e.event_name").isNotNull()).select(
        (F.shiftleft(F.col("e.pass"), order_bits) + F.col("_row")).alias("seq"),
        F.lit(DEFAULT_NAMESPACE).alias("namespace"),
        F.col("e.event_name").alias("event_name"),
        "user_id",
        F.lit(None).cast("double").alias("value"),
        F.col("e.ensure_goal").alias("ensure_goal"),
        *week_of_arrival())
