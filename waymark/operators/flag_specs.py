"""Flag specification tables: validation, updates, rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.functions.dates import format_rfc3339

# Texts that stand for on and off in stored specs; no text means off.
ON_TEXTS = ["enabled", "true"]
OFF_TEXTS = ["disabled", "false", "undefined"]


def boolean_from_text(text: Column) -> Column:
    """NULL where the text is neither an on nor an off word."""
    return (F.when(text.isNull() | text.isin(*OFF_TEXTS), F.lit(False))
            .when(text.isin(*ON_TEXTS), F.lit(True)))


def bound_from_text(text: Column) -> Column:
    """A stored rollout bound; the word ``undefined`` means none."""
    return F.when(text != "undefined", text.try_cast("bigint"))


def spec_rejects(specs: DataFrame) -> DataFrame:
    """Specs that must not be stored, with the first reason found.

    ``user`` here is the submitted form: a list of terms, each a list of texts.
    """
    start, end = F.col("rollout_start"), F.col("rollout_end")

    def term_reason(term: Column) -> Column:
        comparator = F.try_element_at(term, F.lit(2))
        known = F.coalesce(comparator.isin("=", "in"), F.lit(False))
        return (F.when(F.size(term) != 3, F.lit("condition_needs_three_terms"))
                .when(~known, F.lit("unknown_comparator")))

    bad_terms = F.filter(F.transform("user", term_reason), lambda r: r.isNotNull())
    reason = (F.when(F.size(bad_terms) > 0, bad_terms[0])
              .when(start.isNotNull() & end.isNull(),
                    F.lit("rollout_without_end"))
              .when(start.isNull() & end.isNotNull(), F.lit("rollout_without_start"))
              .when(start > end, F.lit("rollout_ends_before_start")))
    return specs.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def upsert_specs(updates: DataFrame, seq: str = "seq") -> DataFrame:
    """The last submitted spec of each name."""
    fields = [c for c in updates.columns if c not in ("name", seq)]
    last = updates.groupBy("name").agg(
        F.max_by(F.struct(*fields), F.col(seq)).alias("s"), F.max(seq).alias(seq))
    return last.select("name", seq, "s.*")


def render_specs(specs: DataFrame) -> DataFrame:
    """Specs as JSON: bounds as UTC date-times, absent bounds left out."""
    body = F.struct(
        F.col("name"), F.col("boolean"),
        format_rfc3339(F.col("rollout_start")).alias("rollout_start"),
        format_rfc3339(F.col("rollout_end")).alias("rollout_end"),
        F.col("user"))
    return specs.select("name", F.to_json(body).alias("document"))


def list_specs(specs: DataFrame) -> DataFrame:
    """Case-insensitive by name; names that differ in case only, by code point. ``rank`` is
    the place among the names of the same initial, so a long list is ranked in parts."""
    initial = F.lower(F.substring("name", 1, 1))
    order = Window.partitionBy(initial).orderBy(F.lower("name"), "name")
    return specs.withColumn("rank", F.row_number().over(order)).orderBy(F.lower("name"), "name")
