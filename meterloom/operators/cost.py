"""What a call costs, as one Column over usage, rates and options; no UDF."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.money import I64_MAX, clamp_i64

#: Rates of a catalog entry, nanodollars for each unit; all but the first two may be null.
RATES = ["input", "output", "cache_read", "cache_creation", "cache_creation_1h", "cache_creation_above_200k", "cache_read_above_200k", "input_above_200k", "output_above_200k",
         "input_batch", "output_batch", "reasoning", "audio_input", "video_second", "search_query"]
Of = Callable[[str], Column]


def compute_cost(provider: Column, usage: Of, rate: Of, *, is_batch: Column | bool = False, cache_ttl: Column | str = "minutes5",
                 context_bucket: Column | str = "up_to_200k", geo: Column | str = "us", geo_multiplier: Column | None = None) -> Column:
    """Nanodollars, saturating: usage and rates are not negative, so a product or a sum beyond int64 is the largest int64. A missing usage counts 0.

    Anthropic and Bedrock report input without what caches served, all others with it, so the two
    kinds differ in what is billed at the cache rates and in what a missing cache rate falls back to:
    the base rate there, the selected input rate here.
    """
    def col(x):
        return x if isinstance(x, Column) else F.lit(x)

    batch, hour, above = col(is_batch), col(cache_ttl) == "hours1", col(context_bucket) == "above_200k"
    input_rate = F.coalesce(F.when(batch, rate("input_batch")), F.when(above, rate("input_above_200k")), rate("input"))
    output_rate = F.coalesce(F.when(batch, rate("output_batch")), F.when(above, rate("output_above_200k")), rate("output"))
    apart = provider.isin("anthropic", "bedrock")
    read_rate = F.when(apart, F.coalesce(F.when(above, rate("cache_read_above_200k")), rate("cache_read"), rate("input"))).otherwise(F.coalesce(rate("cache_read"), input_rate))
    created = F.coalesce(F.when(above, rate("cache_creation_above_200k")), F.when(hour, rate("cache_creation_1h")), rate("cache_creation"), rate("input"))
    create_rate = F.when(apart, created).otherwise(F.coalesce(rate("cache_creation"), F.lit(0)))
    read = usage("cache_read_input_tokens")
    fresh = F.when(apart, usage("input_tokens")).otherwise(F.greatest(usage("input_tokens") - read, F.lit(0)))
    parts = [
        (fresh, input_rate), (read, read_rate), (usage("cache_creation_input_tokens"), create_rate), (usage("output_tokens"), output_rate),
        (usage("reasoning_tokens"), F.coalesce(rate("reasoning"), output_rate)),
        *((usage(u), F.coalesce(rate(r), F.lit(0))) for u, r in (("audio_input_tokens", "audio_input"), ("video_seconds", "video_second"), ("search_queries", "search_query"))),
    ]
    zero = F.lit(0).cast("long")
    terms = [F.try_multiply(F.coalesce(a.cast("long"), zero), F.coalesce(b.cast("long"), zero)) for a, b in parts]
    # null from here on says that int64 was left; one small method, where a second sum in decimals would keep the compiler out
    cost = F.coalesce(reduce(F.try_add, terms), F.lit(I64_MAX))
    if geo_multiplier is None:
        return cost
    return F.when(geo_multiplier.isNotNull() & (col(geo) == "non_us"), clamp_i64(F.round(cost.cast("double") * geo_multiplier))).otherwise(cost)
