"""Scans: conjunctive filters that reach Parquet, keyset and offset pages, lookups."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.times import DAY, SECOND
from ..schema import SUMMARY

DEFAULT_EVENTS, DEFAULT_ROWS, MAX_PAGE = 50, 100, 1000


@dataclass(frozen=True)
class EventFilter:
    """All conditions must hold. '' matches rows without the attribute. ``to_ns`` is inclusive, ``status_below`` is not."""

    user_id: str | None = None
    api_key_id: str | None = None
    model: str | None = None
    provider: str | None = None
    source: str | None = None
    user_tag: str | None = None
    session_tag: str | None = None
    tier: str | None = None
    from_ns: int | None = None
    to_ns: int | None = None
    status_from: int | None = None
    status_below: int | None = None

    def condition(self, events: DataFrame) -> Column:
        out = F.lit(True)
        for f in fields(self)[:8]:
            if (value := getattr(self, f.name)) is not None:
                same = F.col(f.name) == value
                out &= same | F.col(f.name).isNull() if value == "" else same
        if self.from_ns is not None:
            out &= F.col("ts_ns") >= self.from_ns
        if self.to_ns is not None:
            out &= F.col("ts_ns") <= self.to_ns
        if "day" in events.columns:  # the same bounds on the partition column
            if self.from_ns is not None:
                out &= F.col("day") >= day_of(self.from_ns)
            if self.to_ns is not None:
                out &= F.col("day") <= day_of(self.to_ns)
        status = F.coalesce("http_status", F.lit(0))
        if self.status_from is not None:
            out &= status >= self.status_from
        if self.status_below is not None:
            out &= status < self.status_below
        return out

    def apply(self, events: DataFrame) -> DataFrame:
        return events.where(self.condition(events))


def day_of(ns: int) -> str:
    from datetime import UTC, datetime, timedelta

    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=ns // SECOND // DAY * DAY)).strftime("%Y-%m-%d")


def older_than(cursor: tuple[int, str | None]) -> Column:
    """After a row in newest-first order; the bare bound on ``ts_ns`` is what the scan can use."""
    ts, id_ = cursor
    if id_ is None:
        return F.col("ts_ns") < ts
    return (F.col("ts_ns") <= ts) & ((F.col("ts_ns") < ts) | ((F.col("ts_ns") == ts) & (F.col("id") < id_)))


def newest(events: DataFrame, which: EventFilter = EventFilter(), limit: int = DEFAULT_EVENTS, cursor: tuple[int, str | None] | None = None) -> DataFrame:
    """The newest rows that match, at most ``limit``: a top-k in each task, then of the tasks'."""
    rows = which.apply(events)
    if cursor:
        rows = rows.where(older_than(cursor))
    return rows.orderBy(F.desc("ts_ns"), F.desc("id")).limit(limit)


def page(events: DataFrame, which: EventFilter = EventFilter(), limit: int = DEFAULT_EVENTS, cursor: tuple[int, str | None] | None = None) -> tuple[list, bool, tuple[int, str] | None]:
    """(rows, whether there are more, cursor of the next page)."""
    limit = max(1, min(limit, MAX_PAGE))
    rows = summary(newest(events, which, limit + 1, cursor)).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    return rows, more, (rows[-1]["ts_ns"], rows[-1]["id"]) if more else None


def offset_page(rows: DataFrame, order: list, limit: int = DEFAULT_ROWS, offset: int = 0) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(max(1, min(limit, MAX_PAGE)))


def by_id(events: DataFrame, id_: str) -> DataFrame:
    return events.where(F.col("id") == id_).limit(1)


def summary(events: DataFrame) -> DataFrame:
    """The narrow listing; only its columns are read."""
    return events.select(*(F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c) for c in SUMMARY))


def export_ndjson(events: DataFrame, which: EventFilter = EventFilter()) -> DataFrame:
    """All matches, newest first, a JSON object a line: one plan, one total order, no paging."""
    rows = which.apply(events).orderBy(F.desc("ts_ns"), F.desc("id"))
    return rows.select(F.to_json(F.struct("*")).alias("value"))


def table_view(events: DataFrame) -> DataFrame:
    """What a terminal shows of events."""
    return events.select("id", "provider", "model", (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.format_string("$%.8f", F.col("cost_nanodollars") / F.lit(1e9)).alias("cost"))
