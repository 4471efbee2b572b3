"""Quota, daily rollup, statistics from the rollup, and sums over archives and tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import histogram
from ..functions.money import sum_saturating, sum_u32
from ..functions.times import DAY, SECOND, day_epoch, day_text
from ..schema import ROLLUP_KEYS, ROLLUP_SUMS, USAGE
from .filters import EventFilter


def quota(events: DataFrame, user_id: str | None = None, api_key_id: str | None = None, from_ns: int | None = None) -> DataFrame:
    """Spend and number of events since ``from_ns``, of a user, a key or both; (0, 0) if there are none."""
    if user_id is None and api_key_id is None:
        raise ValueError("a quota needs a user or a key")
    rows = EventFilter(user_id=user_id, api_key_id=api_key_id, from_ns=from_ns).apply(events)
    return rows.agg(F.coalesce(sum_saturating(F.col("cost_nanodollars")), F.lit(0)).alias("cost_nanodollars"), F.count(F.lit(1)).alias("event_count"))


def quota_from(cube: DataFrame, events: DataFrame, user_id: str | None = None, api_key_id: str | None = None, from_ns: int = 0, to_ns: int | None = None) -> DataFrame:
    """The same from ``from_ns`` to ``to_ns`` (inclusive), whole days from the daily cube and only what is left of a first and a last day from ``events``."""
    if user_id is None and api_key_id is None:
        raise ValueError("a quota needs a user or a key")
    day = DAY * SECOND
    first, last = -(-from_ns // day) * day, None if to_ns is None else (to_ns + 1) // day * day  # whole days from first to before last
    if last is not None and last <= first:
        edges, cells = [(from_ns, to_ns)], None
    else:
        edges = [(from_ns, first - 1)] * (from_ns < first) + ([(last, to_ns)] if to_ns is not None and last <= to_ns else [])
        cells = rollup_rows(cube, first // SECOND, None if last is None else last // SECOND - DAY, user_id, api_key_id)
    parts = [EventFilter(user_id=user_id, api_key_id=api_key_id, from_ns=a, to_ns=b).apply(events).select("cost_nanodollars", F.lit(1).cast("long").alias("event_count")) for a, b in edges]
    parts += [cells.select("cost_nanodollars", "event_count")] if cells is not None else []
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(F.coalesce(sum_saturating(F.col("cost_nanodollars")), F.lit(0)).alias("cost_nanodollars"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"))


def less(cube: DataFrame, taken: DataFrame) -> DataFrame:
    """``cube`` without the events of the cube ``taken``; cells that are empty then go."""
    negative = taken.select(*ROLLUP_KEYS, *((-F.col(c)).alias(c) for c in ROLLUP_SUMS))
    return merged(cube.select(*ROLLUP_KEYS, *ROLLUP_SUMS).unionByName(negative)).where("event_count > 0")


def _sums(count: Column, errors: Column) -> list[Column]:
    plain = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens"]
    return [count.alias("event_count"), errors.alias("error_count"), *(F.sum(c).alias(c) for c in plain), sum_saturating(F.col("cost_nanodollars")).alias("cost_nanodollars")]


def rollup(events: DataFrame) -> DataFrame:
    """The daily cube: an exchange of partial sums, whose size is that of the cube, not of the events."""
    keys = [day_epoch().alias("day"), *(F.coalesce(c, F.lit("")).alias(c) for c in ROLLUP_KEYS[1:])]
    return events.groupBy(*keys).agg(*_sums(F.count(F.lit(1)), F.sum(F.col("is_error").cast("long"))))


def merged(rollups: DataFrame) -> DataFrame:
    """Partial cubes, of tiers or of micro-batches, made one."""
    return rollups.groupBy(*ROLLUP_KEYS).agg(*_sums(F.sum("event_count"), F.sum("error_count")))


def rollup_rows(cube: DataFrame, from_day: int | None = None, to_day: int | None = None, user_id: str | None = None, api_key_id: str | None = None) -> DataFrame:
    """Cells of days in both bounds, inclusive."""
    for c, op, v in (("day", "__ge__", from_day), ("day", "__le__", to_day), ("user_id", "__eq__", user_id), ("api_key_id", "__eq__", api_key_id)):
        if v is not None:
            cube = cube.where(getattr(F.col(c), op)(v))
    return cube


ROLLUP_ORDER = ["day", "user_id", "api_key_id", "model", "provider"]


def stats(cube: DataFrame, provider: str | None = None, by_model: bool = False) -> DataFrame:
    """Sums over cells, by provider and model or in one row; no row over no cells."""
    if provider is not None:
        cube = cube.where(F.col("provider") == provider)
    keys = [F.col(k) if by_model else F.lit("").alias(k) for k in ("provider", "model")]
    return cube.groupBy(*keys).agg(*_sums(F.sum("event_count"), F.sum("error_count")))


STATS_ORDER = ["-cost_nanodollars", "provider", "model"]


def ordered(order: list[str]) -> list[Column]:
    return [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]


def archive_summary(manifests: DataFrame) -> DataFrame:
    return manifests.agg(F.count(F.lit(1)).alias("archives"), F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("compressed_bytes"), F.coalesce(F.min("min_ts_ns"), F.lit(0)).alias("oldest_ts_ns"))


def archive_by_user(manifests: DataFrame) -> DataFrame:
    return manifests.groupBy("user_id").agg(F.sum("event_count").alias("event_count"), F.sum("compressed_bytes").alias("compressed_bytes"))


def archive_groups(events: DataFrame) -> DataFrame:
    """(user, day) groups with the figures of a chunk; events without a user are of ``_none``."""
    user = F.when(F.coalesce("user_id", F.lit("")) == "", "_none").otherwise(F.col("user_id"))
    return events.groupBy(user.alias("user_id"), day_text().alias("day")).agg(F.count(F.lit(1)).alias("event_count"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns"))


def tier_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("tier").agg(F.count(F.lit(1)).alias("event_count"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns"))


def usage_merge(deltas: DataFrame, keys: list[str]) -> DataFrame:
    have = [u for u in USAGE if u in deltas.columns]
    return deltas.groupBy(*keys).agg(*(sum_u32(F.col(u)).alias(u) for u in have))


#: Percentiles in thousandths, so that ranks are compared in whole numbers.
PERCENTILES = {"p50": 500, "p95": 950, "p99": 990, "p999": 999}


def latency_percentiles(events: DataFrame, column: str = "total_ms") -> DataFrame:
    """One row, exact: the smallest number that at least this share of the events does not exceed; nulls are not counted.

    Equal numbers are counted first. A task adds up the counts of one bucket of the log-linear histogram, and one those of the
    buckets, some thousand at most, so none has all numbers.
    """
    values = events.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).withColumn("bucket", histogram.bucket(F.col("value")))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = values.groupBy("bucket").agg(F.sum("n").alias("n"))
    buckets = buckets.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy()).alias("of"))
    along = Window.partitionBy("bucket").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = values.join(buckets, "bucket").withColumn("upto", F.col("start") + F.sum("n").over(along))
    return rows.agg(*(F.min(F.when(F.col("upto") * 1000 >= F.col("of") * q, F.col("value"))).alias(n) for n, q in PERCENTILES.items()))
