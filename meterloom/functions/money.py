"""Nanodollars: int64 that saturates instead of overflowing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

I64_MAX, I64_MIN, U32_MAX, NANOS = 2**63 - 1, -(2**63), 2**32 - 1, 10**9


def clamp_i64(value: Column) -> Column:
    """A decimal or double cut to the range of int64; null stays null, which ``least`` alone would skip."""
    low, high = F.lit(str(I64_MIN)).cast("decimal(38,0)"), F.lit(str(I64_MAX)).cast("decimal(38,0)")
    return F.when(value.isNotNull(), F.greatest(F.least(value.cast("decimal(38,0)"), high), low)).cast("long")


def sum_saturating(value: Column) -> Column:
    return clamp_i64(F.sum(value.cast("decimal(38,0)")))


def sum_u32(value: Column) -> Column:
    """Counters only grow, so cutting the whole sum equals cutting every step."""
    return F.when(F.sum(value) > U32_MAX, F.lit(U32_MAX)).otherwise(F.sum(value)).cast("long")


def dollars_to_nanos(dollars: Column) -> Column:
    """Half away from zero."""
    return clamp_i64(F.round(dollars.cast("double") * F.lit(float(NANOS))))


def nanos_to_dollars(nanos: Column) -> Column:
    """For display only."""
    return nanos.cast("double") / F.lit(float(NANOS))


def cost_display(nanos: Column) -> Column:
    """``$d.dddddddd``, the ninth digit cut off; never through a double."""
    digits = F.abs(nanos.cast("decimal(20,0)"))
    whole = F.floor(digits / F.lit(NANOS).cast("decimal(20,0)")).cast("decimal(20,0)")
    rest = F.floor((digits - whole * F.lit(NANOS).cast("decimal(20,0)")) / F.lit(10)).cast("long")
    return F.concat(F.when(nanos < 0, "-").otherwise(""), F.lit("$"), whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), 8, "0"))


def total_billable_input(provider: Column, usage) -> Column:
    whole = F.least(usage("input_tokens") + usage("cache_creation_input_tokens") + usage("cache_read_input_tokens"), F.lit(U32_MAX))
    return F.when(provider.isin("anthropic", "bedrock"), whole).otherwise(usage("input_tokens")).cast("long")


def total_output(usage) -> Column:
    return F.least(usage("output_tokens") + usage("reasoning_tokens"), F.lit(U32_MAX)).cast("long")
