"""Nanoseconds since the epoch, UTC, as bigint. Timestamps keep microseconds only, so they are never the key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, DAY = 10**9, 86_400


def day_epoch(ts_ns: str = "ts_ns") -> Column:
    """Seconds of the start of the day; division and remainder truncate."""
    return F.expr(f"(({ts_ns}) div {SECOND}) - (({ts_ns}) div {SECOND}) % {DAY}")


def day_text(ts_ns: str = "ts_ns") -> Column:
    """``YYYY-MM-DD`` whatever the session's time zone."""
    return F.expr(f"date_format(date_add(date'1970-01-01', cast(floor(({ts_ns}) / {SECOND * DAY}D) as int)), 'yyyy-MM-dd')")


_RFC3339 = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})[Tt ]([0-9]{2}:[0-9]{2}:[0-9]{2})(\.[0-9]+)?([Zz]|[+-][0-9]{2}:[0-9]{2})$"


def rfc3339_to_ns(c: Column) -> Column:
    """Nanoseconds of an RFC 3339 text, null if it is none; digits beyond the ninth are cut off."""
    def part(i):
        return F.regexp_extract(c, _RFC3339, i)

    zone = F.when(F.upper(part(4)) == "Z", "+00:00").otherwise(part(4))
    at = F.try_to_timestamp(F.concat(part(1), F.lit(" "), part(2), zone), F.lit("yyyy-MM-dd HH:mm:ssXXX"))
    fraction = F.rpad(F.substring(part(3), 2, 9), 9, "0").cast("long")
    return F.when(c.rlike(_RFC3339), F.unix_seconds(at) * SECOND + F.coalesce(fraction, F.lit(0)))
