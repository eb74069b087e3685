"""Event requests: one JSON body per row, holding one event, an envelope or a bare array.

A body is checked as a whole: one bad event rejects its request. The check works on the
array inside the row, so neither the check nor the split needs a shuffle, and a request is
never spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from waymark.functions.dates import parse_rfc3339, utc_date, week_of_arrival
from waymark.functions.variants import is_number, json_type, let
from waymark.schemas import DEFAULT_NAMESPACE

SINGLE, ENVELOPE, ARRAY = "single", "envelope", "array"

# Arrival order is (request, position in the request), packed into one BIGINT. 24 bits hold
# 16 million events per request, 39 bits 550 billion requests; beyond that the job fails
# instead of misordering.
POSITION_BITS = 24


def packed_seq(request_seq: Column, position: Column,
               position_bits: int = POSITION_BITS) -> Column:
    fits = ((position < (1 << position_bits)) & (request_seq >= 0)
            & (request_seq < (1 << (63 - position_bits))))
    packed = F.shiftleft(request_seq.cast("long"), position_bits) + position.cast("long")
    return F.when(fits, packed).otherwise(
        F.raise_error(F.lit("request number or event position is out of range")))


def _member(event: Column, name: str) -> Column:
    return F.try_variant_get(event, f"$.{name}", "variant")


FIELDS = ["event_name", "user_id", "namespace", "ensure_goal", "value", "datetime"]
TEXT_FIELDS = ["event_name", "user_id", "namespace", "datetime"]


def _event(element: Column) -> Column:
    """A variant element as a struct of typed fields plus the reason it is unusable."""
    members = F.struct(*[_member(element, name).alias(name) for name in FIELDS])
    return let(members, lambda m: _checked(element, m))


def _checked(element: Column, m: Column) -> Column:
    def text(name: str) -> Column:
        return F.try_variant_get(m[name], "$", "string")

    def wrong(name: str, right: Column) -> Column:
        return m[name].isNotNull() & ~right

    bad_type = wrong("ensure_goal", json_type(m["ensure_goal"]) == "BOOLEAN") | wrong(
        "value", is_number(m["value"]))
    for name in TEXT_FIELDS:
        bad_type = bad_type | wrong(name, json_type(m[name]) == "STRING")

    def fields(moment: Column) -> Column:
        # Only an element without the required members can be something else than an object.
        is_object = F.try_variant_get(element, "$", "map<string,variant>").isNotNull()
        lacking = F.when(is_object, F.lit("missing_required_key")).otherwise(
            F.lit("incorrect_type"))
        reason = (F.when(m["event_name"].isNull() | m["user_id"].isNull(), lacking)
                  .when(bad_type, F.lit("incorrect_type"))
                  .when(m["datetime"].isNotNull() & moment.isNull(), F.lit("invalid_date")))
        return F.struct(
            text("event_name").alias("event_name"), text("user_id").alias("user_id"),
            text("namespace").alias("namespace"),
            F.try_variant_get(m["ensure_goal"], "$", "boolean").alias("ensure_goal"),
            F.try_variant_get(m["value"], "$", "double").alias("value"),
            moment.alias("datetime"), reason.alias("reason"))

    return let(parse_rfc3339(text("datetime")), fields)


def _first_reason(events: Column) -> Column:
    bad = F.filter(events, lambda e: e["reason"].isNotNull())
    return F.try_element_at(bad, F.lit(1))["reason"]


def _decide(body: Column) -> Column:
    """Shape, events and reason of a parsed body."""
    as_array = F.try_variant_get(body, "$", "array<variant>")
    enveloped = F.try_variant_get(body, "$.events", "array<variant>")

    def from_parts(p: Column) -> Column:
        single_ok = p["single"]["reason"].isNull()
        list_ok = p["list_reason"].isNull() & p["listed"].isNotNull()
        envelope_ok = ~p["is_array"] & list_ok
        reason = (F.when(body.isNull(), F.lit("invalid_json"))
                  .when(single_ok & envelope_ok, F.lit("matches_more_than_one_shape"))
                  .when(single_ok | list_ok, F.lit(None).cast("string"))
                  .when(p["is_array"] | p["has_events"],
                        F.coalesce(p["list_reason"], F.lit("incorrect_type")))
                  .otherwise(p["single"]["reason"]))
        shape = (F.when(single_ok, F.lit(SINGLE)).when(p["is_array"], F.lit(ARRAY))
                 .otherwise(F.lit(ENVELOPE)))
        events = F.when(single_ok, F.array(p["single"])).otherwise(p["listed"])
        return let(reason, lambda r: F.struct(
            F.when(r.isNull(), shape).alias("shape"),
            F.when(r.isNull(), events).alias("events"),
            r.alias("reason")))

    listed = F.transform(F.coalesce(as_array, enveloped), _event)
    return let(listed, lambda events: let(F.struct(
        events.alias("listed"),
        _first_reason(events).alias("list_reason"),
        _event(body).alias("single"),
        as_array.isNotNull().alias("is_array"),
        _member(body, "events").isNotNull().alias("has_events")), from_parts))


def parse_requests(requests: DataFrame) -> DataFrame:
    """``(request_seq, body, ...)`` → adds ``shape``, ``events`` and ``reason``.

    Exactly one of the three shapes must fit. ``reason`` is NULL for usable requests, whose
    ``shape`` is set and whose ``events`` are all valid. The decision is made in a
    generator: filters on its columns stay above it, so that a body is parsed once.
    """
    decision = let(F.try_parse_json("body"), _decide)
    return requests.select("*", F.inline_outer(F.array(decision)))


def accepted_events(parsed: DataFrame, received_at: str | None = None) -> DataFrame:
    """Usable requests as event log rows, in arrival order and with defaults filled in.

    An event without a date falls into the week it was received in: ``received_at`` names
    the column with that time (an instant, or UTC wall-clock time without a zone); without
    one it is the time of the run.
    """
    if received_at is None:
        arrival_day = utc_date(F.current_timestamp())
    elif isinstance(parsed.schema[received_at].dataType, T.TimestampNTZType):
        arrival_day = F.to_date(received_at)
    else:
        arrival_day = utc_date(F.col(received_at))
    flat = (parsed.filter(F.col("reason").isNull())
            .select("request_seq", "shape", arrival_day.alias("_arrival"),
                    F.posexplode("events").alias("pos", "e")))
    day = F.coalesce(utc_date(F.col("e.datetime")), F.col("_arrival"))
    return flat.select(
        packed_seq(F.col("request_seq"), F.col("pos")).alias("seq"),
        "request_seq", "pos", "shape",
        F.coalesce("e.namespace", F.lit(DEFAULT_NAMESPACE)).alias("namespace"),
        F.col("e.event_name").alias("event_name"),
        F.col("e.user_id").alias("user_id"),
        F.col("e.value").alias("value"),
        F.coalesce("e.ensure_goal", F.lit(False)).alias("ensure_goal"),
        *week_of_arrival(day),
    )


def rejected_requests(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).drop("events", "shape")
