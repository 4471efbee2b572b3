"""Log-linear buckets of whole numbers, for distributions that are stored and merged.

A number below ``2 ** (BITS + 1)`` has a bucket of its own; above, each power of two is cut into
``2 ** BITS`` buckets of equal width. A bucket is named by its smallest number, so that counts of buckets
from any days, tiers or tasks can be added up, and a number is less than ``2 ** -BITS`` above its bucket's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 7


def bucket(c: Column, bits: int = BITS) -> Column:
    """Smallest number of the bucket of ``c``; negative numbers count as 0."""
    n = F.greatest(c.cast("long"), F.lit(0).cast("long"))
    cut = F.length(F.bin(n)) - (bits + 1)  # low bits that a bucket does not tell apart
    return F.when(cut > 0, F.call_function("shiftleft", F.call_function("shiftright", n, cut), cut)).otherwise(n)


def counts(rows: DataFrame, keys: list, column: str, bits: int = BITS) -> DataFrame:
    """``keys, bucket, n``, pre-aggregated in each task; nulls are not counted."""
    return rows.where(F.col(column).isNotNull()).groupBy(*keys, bucket(F.col(column), bits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merged(parts: DataFrame, keys: list[str]) -> DataFrame:
    return parts.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def quantiles(histogram: DataFrame, keys: list[str], wanted: dict[str, float]) -> DataFrame:
    """``keys, n`` and a column for each wanted quantile: the bucket of the smallest number that at least this share does not exceed.

    It is at most the number itself and less than ``2 ** -BITS`` of it smaller. A group has some thousand buckets at
    most, whatever it counts.
    """
    along = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    rows = merged(histogram, keys).withColumns({"upto": F.sum("n").over(along), "of": F.sum("n").over(Window.partitionBy(*keys))})
    reached = {name: F.min(F.when(F.col("upto") >= F.ceil(F.lit(q) * F.col("of")), F.col("bucket"))) for name, q in wanted.items()}
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), *(c.alias(name) for name, c in reached.items()))
