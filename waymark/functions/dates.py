"""Dates: ISO week buckets and RFC 3339 text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# A full date-time with a zone. Spark's own parser alone would also take a bare "2020".
RFC3339_PATTERN = (
    r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
)


def iso_year(ts: Column) -> Column:
    """Year that owns the ISO week of ``ts`` (2021-01-03 belongs to 2020)."""
    return F.extract(F.lit("YEAROFWEEK"), ts).cast("int")


def iso_week(ts: Column) -> Column:
    return F.weekofyear(ts).cast("int")


def parse_rfc3339(text: Column) -> Column:
    """Timestamp of an RFC 3339 text, NULL where the text is not one."""
    return F.when(text.rlike(RFC3339_PATTERN), F.try_to_timestamp(F.upper(text)))


def is_rfc3339(text: Column) -> Column:
    return parse_rfc3339(text).isNotNull()


def utc_date(instant: Column) -> Column:
    """UTC day of an instant, whatever the session's time zone is."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(instant) / 86_400).cast("int"))


def format_rfc3339(epoch_seconds: Column) -> Column:
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    moment = epoch + F.make_dt_interval(secs=epoch_seconds.cast("decimal(18,6)"))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def week_of_arrival(day: Column | None = None) -> list[Column]:
    """``iso_year`` and ``iso_week`` of undated events: the week they are read in."""
    day = utc_date(F.current_timestamp()) if day is None else day
    return [iso_year(day).alias("iso_year"), iso_week(day).alias("iso_week")]
