"""Timestamps without a session time zone and without reading a clock."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from reelscope.functions.numeric import col


def as_timestamp(value) -> Column:
    """A timestamp Column from a Column, a datetime or ISO text (UTC when no zone is given)."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    micros = round((value - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)
    return F.timestamp_micros(F.lit(micros))


def parse_ts(value) -> Column:
    """ISO-8601, ``YYYYMMDD`` and 10- or 13-digit epoch text to a UTC timestamp; anything else is null."""
    s = F.trim(col(value).cast("string"))
    s = F.regexp_replace(s, " UTC$", "Z")
    iso_day = F.when(
        s.rlike("^[0-9]{8}$"),
        F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2)),
    ).when(s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), s)
    zoned = s.rlike("([Zz]|[+-][0-9]{2}:?[0-9]{2})$")
    text = F.when(iso_day.isNotNull(), F.concat(iso_day, F.lit("T00:00:00Z"))).when(
        s.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ]"), F.when(zoned, s).otherwise(F.concat(s, F.lit("Z")))
    )
    epoch = s.rlike("^[0-9]+\\.?[0-9]*$") & F.length(s).isin(10, 13)
    return F.when(epoch, F.timestamp_seconds(F.substring(s, 1, 10).try_cast("double"))).otherwise(
        text.try_cast("timestamp")
    )


def days_since(ts, as_of) -> Column:
    days = (F.unix_micros(as_timestamp(as_of)) - F.unix_micros(col(ts))) / 86_400_000_000.0
    return F.greatest(F.coalesce(days, F.lit(1.0)), F.lit(1.0))


def hours_since(ts, as_of) -> Column:
    """Hours with two decimals, at least 1; null when the timestamp is unknown."""
    hours = (F.unix_micros(as_timestamp(as_of)) - F.unix_micros(col(ts))) / 3_600_000_000.0
    return F.when(hours.isNotNull(), F.round(F.greatest(hours, F.lit(1.0)), 2))


def _epoch_day(ts) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int")


def calendar_parts(ts) -> dict[str, Column]:
    """UTC hour (unknown = 12), weekend flag, month and ISO weekday."""
    t = col(ts)
    day = _epoch_day(t)
    hour = F.pmod(F.floor(F.unix_micros(t) / F.lit(3_600_000_000)), F.lit(24)).cast("int")
    iso_weekday = (F.pmod(day + 3, F.lit(7)) + 1).cast("int")
    return {
        "pub_hour": F.coalesce(hour, F.lit(12)),
        "is_weekend": F.coalesce((iso_weekday >= 6).cast("int"), F.lit(0)),
        "month": F.month(F.date_from_unix_date(day)),
        "iso_weekday": iso_weekday,
    }


def publication_label(value) -> Column:
    """``YYYY-MM-DD HH:MM UTC`` for readable timestamps, the raw text otherwise."""
    ts = parse_ts(value)
    day = F.date_from_unix_date(_epoch_day(ts)).cast("string")
    minute = F.pmod(F.floor(F.unix_micros(ts) / F.lit(60_000_000)), F.lit(1440))
    clock = F.format_string("%02d:%02d", F.floor(minute / 60), F.pmod(minute, F.lit(60)))
    label = F.concat(day, F.lit(" "), clock, F.lit(" UTC"))
    return F.coalesce(label, F.trim(col(value).cast("string")), F.lit(""))


def season(month) -> Column:
    m = col(month)
    return (
        F.when(m.between(3, 5), F.lit("Spring"))
        .when(m.between(6, 8), F.lit("Summer"))
        .when(m.between(9, 11), F.lit("Fall"))
        .otherwise(F.lit("Winter"))
    )
