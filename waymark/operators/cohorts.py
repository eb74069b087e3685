"""Counter settings: the first rule whose pattern occurs in an event's name applies.

Rules are application settings, a short ordered list. They compile into one CASE
expression over the event name, so applying them costs neither a join nor a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from waymark.schemas import WEEKLY

# Kinds of counter storage, and the settings used where no rule matches.
SCALABLE, FIXED_SIZE = "bloom_scalable", "bloom_fixed_size"
DEFAULT_SIZE, DEFAULT_ERROR = 100_000, 0.001


@dataclass(frozen=True)
class CohortRule:
    pattern: str
    kind: str = SCALABLE
    size: int = DEFAULT_SIZE
    error_probability: float | None = DEFAULT_ERROR
    date_cohort: str | None = None


def _first_match(name: Column, rules: Sequence[CohortRule], value, otherwise) -> Column:
    chain = None
    for rule in rules:
        matched, result = name.rlike(rule.pattern), F.lit(value(rule))
        chain = F.when(matched, result) if chain is None else chain.when(matched, result)
    return F.lit(otherwise) if chain is None else chain.otherwise(F.lit(otherwise))


def is_weekly(name: Column, rules: Sequence[CohortRule]) -> Column:
    return _first_match(name, rules, lambda r: r.date_cohort == WEEKLY, False)


def with_counter_settings(names: DataFrame, rules: Sequence[CohortRule],
                          name: str = "event_name") -> DataFrame:
    """Adds the settings that apply to each name; rule 0 stands for the default."""
    column = F.col(name)
    numbered = {id(rule): number for number, rule in enumerate(rules, start=1)}
    return (names
            .withColumn("rule", _first_match(column, rules, lambda r: numbered[id(r)], 0))
            .withColumn("kind", _first_match(column, rules, lambda r: r.kind, SCALABLE))
            .withColumn("size", _first_match(column, rules, lambda r: r.size,
                                             DEFAULT_SIZE).cast("long"))
            .withColumn("error_probability", _first_match(
                column, rules, lambda r: r.error_probability, DEFAULT_ERROR).cast("double"))
            .withColumn("date_cohort", _first_match(
                column, rules, lambda r: r.date_cohort, None).cast("string")))


def setting_rejects(settings: DataFrame) -> DataFrame:
    """Settings rows that are unusable, with the reason."""
    known = F.col("kind").isin(SCALABLE, FIXED_SIZE)
    missing = (F.col("kind").isNull() | F.col("size").isNull()
               | ((F.col("kind") == SCALABLE) & F.col("error_probability").isNull()))
    unusable = (F.col("size") <= 0) | (F.col("error_probability") <= 0) | (
        F.col("error_probability") >= 1)
    reason = (F.when(F.col("date_cohort").isNotNull() & (F.col("date_cohort") != WEEKLY),
                     F.lit("unknown_date_cohort"))
              .when(missing, F.lit("missing_setting"))
              .when(~known, F.lit("unknown_kind"))
              .when(unusable, F.lit("unusable_size_or_error")))
    return settings.withColumn("reason", reason).filter(F.col("reason").isNotNull())
