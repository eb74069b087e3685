"""Names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from waymark.schemas import WEEKLY


def normalize_user_id(user_id: Column) -> Column:
    """Integer and text forms of an id are the same user."""
    return user_id.cast("string")


def display_name(name: Column, counter_type: Column, year: Column, week: Column) -> Column:
    """Weekly counters show as ``<name> <year><week>``, without padding."""
    weekly = F.concat(name, F.lit(" "), year.cast("string"), week.cast("string"))
    return F.when(counter_type == WEEKLY, weekly).otherwise(name)


def tags_text(tags: Column) -> Column:
    """A tag combination as one text; the empty combination is the empty text."""
    return F.array_join(F.array_sort(tags), "|")
