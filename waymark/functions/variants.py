"""Untyped JSON values, kept as VARIANT so that 42 and "42" stay different."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

NUMERIC_TYPE = r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"
BASE64_PATTERN = r"^[A-Za-z0-9+/]*={0,2}$"
LONG_RANGE = 9.2e18


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def json_type(value: Column) -> Column:
    """Spark's name for the JSON type; NULL if the value is absent."""
    return F.schema_of_variant(value)


def is_number(value: Column) -> Column:
    return json_type(value).rlike(NUMERIC_TYPE)


def _fraction_text(number: Column) -> Column:
    """Text of a non-integer type, the same for 42.0, 4.2e1 and their integer 42."""
    whole = (number == F.floor(number)) & (F.abs(number) < LONG_RANGE)
    return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(
        number.cast("string"))


def equality_key(value: Column) -> Column:
    """Equal for equal JSON values: numbers by amount, everything else by type and text."""
    def of(v: Column) -> Column:
        number = let(F.try_variant_get(v, "$", "double"), _fraction_text)
        return (F.when(json_type(v) == "BIGINT", F.concat(F.lit("n"), F.to_json(v)))
                .when(is_number(v), F.concat(F.lit("n"), number))
                .otherwise(F.to_json(v)))
    return let(value, of)


def member_key(value: Column) -> Column:
    """Like :func:`equality_key`, but 42 and 42.0 differ: list membership is exact."""
    return let(value, lambda v: F.when(json_type(v) == "BIGINT", F.to_json(v))
               .otherwise(F.concat(F.lit("x"), equality_key(v))))


def decode_base64_json(text: Column) -> tuple[Column, Column]:
    """(decoded JSON, reason for rejection). An absent parameter decodes to no value."""
    padded = (F.length(text) % 4 == 0) & text.rlike(BASE64_PATTERN)
    decoded = F.when(padded, F.try_to_binary(text, F.lit("base64"))).cast("string")
    value = F.try_parse_json(decoded)
    reason = (F.when(text.isNull(), F.lit(None).cast("string"))
              .when(decoded.isNull(), F.lit("invalid_base64"))
              .when(F.try_variant_get(value, "$", "map<string,variant>").isNull(),
                    F.lit("invalid_json")))
    return value, reason
