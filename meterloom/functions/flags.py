"""Flags as one integer: six of the event, four that tell a stored 0 from nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit of each flag.
BITS = {"streaming": 0, "tool_calls": 1, "reasoning": 2, "stream_incomplete": 3, "cache_used": 4, "budget_blocked": 5}
PRESENT = {"ttft_ms": 8, "http_status": 9, "error_json": 10, "time_to_close_ms": 11}


def pack(col=F.col) -> Column:
    given = [F.when(F.coalesce(col(n), F.lit(False)), F.lit(1 << b)).otherwise(0) for n, b in BITS.items()]
    there = [F.when(col(n).isNotNull(), F.lit(1 << b)).otherwise(0) for n, b in PRESENT.items()]
    return reduce(lambda a, b: a.bitwiseOR(b), given + there)


def unpack(bits: Column) -> dict[str, Column]:
    return {n: bits.bitwiseAND(F.lit(1 << b)) != 0 for n, b in BITS.items()}


def present(bits: Column, name: str, value: Column) -> Column:
    """A stored value, null where its bit says that there was none."""
    return F.when(bits.bitwiseAND(F.lit(1 << PRESENT[name])) != 0, value)
