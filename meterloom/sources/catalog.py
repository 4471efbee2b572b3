"""The price catalog: one JSON object of entries, spread to a small table of names and rates, and the lookup join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import dollars_to_nanos
from ..functions.text import ascii_lower, strip_date_suffix
from ..operators.cost import RATES

#: The catalog's field for each rate.
FIELDS = {
    "input": "input_cost_per_token", "output": "output_cost_per_token", "cache_read": "cache_read_input_token_cost",
    "cache_creation": "cache_creation_input_token_cost", "cache_creation_1h": "cache_creation_input_token_cost_above_1hr",
    "cache_creation_above_200k": "cache_creation_input_token_cost_above_200k_tokens", "cache_read_above_200k": "cache_read_input_token_cost_above_200k_tokens",
    "input_above_200k": "input_cost_per_token_above_200k_tokens", "output_above_200k": "output_cost_per_token_above_200k_tokens",
    "input_batch": "input_cost_per_token_batches", "output_batch": "output_cost_per_token_batches", "reasoning": "output_cost_per_reasoning_token",
    "audio_input": "input_cost_per_audio_token", "video_second": "input_cost_per_video_per_second",
}
SEARCH = "search_context_cost_per_query"
#: Names of an entry by how they were made, the first wins where two entries claim a name.
RANKS = ("canonical", "stripped", "unprefixed", "unprefixed_stripped")
#: A catalog has some thousands of entries; only up to this many names is its table broadcast.
BROADCAST_NAMES = 100_000


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``entry`` and ``spec`` (its JSON) of a catalog file."""
    return entries(spark.read.text(path, wholetext=True).select(F.col("value").alias("json")))


def entries(json: DataFrame) -> DataFrame:
    return json.select(F.explode(F.from_json("json", "map<string,string>")).alias("entry", "spec"))


def _number(v: Column, field: str, bad: list[Column]) -> Column:
    at = F.try_variant_get(v, f"$.{field}", "variant")
    kind = F.schema_of_variant(at)
    bad.append(at.isNotNull() & ~kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|VOID)$"))
    return F.try_variant_get(v, f"$.{field}", "double")


def rates(entry: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row for each entry that can be priced: ``canonical``, the rates, limits and descriptions, and the columns ``by`` as they are.

    The example entry, entries with a field of the wrong kind and entries without input and output
    rates are left out.
    """
    v = F.try_parse_json("spec")
    bad: list[Column] = [v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT")]
    dollars = {r: _number(v, f, bad) for r, f in FIELDS.items()}
    flat = F.try_variant_get(v, f"$.{SEARCH}", "double")
    tiers = [F.try_variant_get(v, f"$.{SEARCH}.search_context_size_{t}", "double") for t in ("medium", "high", "low")]
    search = F.when(F.try_variant_get(v, f"$.{SEARCH}", "variant").isNotNull(), F.coalesce(flat, *tiers, F.lit(0.0)))

    def limit(field):
        at = F.try_variant_get(v, f"$.{field}", "variant")
        return F.when(F.schema_of_variant(at) == "BIGINT", F.try_variant_get(v, f"$.{field}", "long"))

    broken = bad[0]
    for b in bad[1:]:
        broken = broken | F.coalesce(b, F.lit(False))
    rows = entry.where((F.col("entry") != "sample_spec") & ~broken & (dollars["input"].isNotNull() | dollars["output"].isNotNull()))
    return rows.select(
        *by, ascii_lower(F.trim("entry")).alias("canonical"),
        *(dollars_to_nanos(F.coalesce(d, F.lit(0.0)) if r in ("input", "output") else d).alias(r) for r, d in dollars.items()),
        dollars_to_nanos(search).alias("search_query"),
        limit("max_input_tokens").alias("max_input_tokens"), limit("max_output_tokens").alias("max_output_tokens"),
        F.coalesce(F.try_variant_get(v, "$.mode", "string"), F.lit("chat")).alias("mode"),
    )


def with_names(priced: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for every name under which an entry is found, ``model``; the smallest entry of the best rank has it, in each group ``by``."""
    c = F.col("canonical")
    short = F.when(c.contains("/"), F.expr("substr(canonical, locate('/', canonical) + 1)"))
    names = [c, F.when(strip_date_suffix(c) != c, strip_date_suffix(c)), short, F.when(strip_date_suffix(short) != short, strip_date_suffix(short))]
    spread = priced.select("*", F.explode(F.array(*(F.struct(n.alias("model"), F.lit(i).alias("rank")) for i, n in enumerate(names)))).alias("name"))
    spread = spread.select("*", "name.model", "name.rank").drop("name").where("model is not null")
    first = Window.partitionBy(*by, "model").orderBy("rank", "canonical", *RATES)
    return spread.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


_HELD: dict[tuple, tuple[DataFrame, bool]] = {}  # a catalog's names and whether they are few enough to be broadcast


def held(spark: SparkSession, entry: DataFrame, version: str) -> DataFrame:
    """The names of a catalog as a local table, built once a session and version; beyond the bound the plan itself."""
    key = (spark.sparkContext.applicationId, version)
    if key not in _HELD:
        named = with_names(rates(entry))
        rows = named.limit(BROADCAST_NAMES + 1).collect()
        _HELD.clear()
        small = len(rows) <= BROADCAST_NAMES
        _HELD[key] = (spark.createDataFrame(rows, named.schema) if small else named, small)
    return _HELD[key][0]


def _is_small(catalog: DataFrame) -> bool:
    """Whether the names fit a broadcast; those of a held catalog are counted already."""
    for names, small in _HELD.values():
        if names is catalog:
            return small
    return catalog.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES


def with_rates(events: DataFrame, catalog: DataFrame, model: str = "model") -> DataFrame:
    """``events`` with a struct ``rates``: the entry of the model's name, else of the name without its date, else null."""
    names = catalog.select(F.col("model").alias("name"), F.struct("canonical", *RATES).alias("found"))
    if _is_small(catalog):
        names = F.broadcast(names)
    key = ascii_lower(F.trim(F.col(model)))
    rows = events.withColumns({"_exact": key, "_bare": strip_date_suffix(key)})
    exact = names.select(F.col("name").alias("_exact"), F.col("found").alias("_exact_found"))
    bare = names.select(F.col("name").alias("_bare"), F.col("found").alias("_bare_found"))
    return chosen(rows.join(exact, "_exact", "left").join(bare, "_bare", "left"))


def chosen(rows: DataFrame) -> DataFrame:
    """The whole entry is chosen first: a rate that the exact entry lacks is never taken from the other."""
    return rows.withColumn("rates", F.when(F.col("_exact_found").isNotNull(), F.col("_exact_found")).otherwise(F.col("_bare_found"))).drop("_exact", "_bare", "_exact_found", "_bare_found")


def rate_of(name: str) -> Column:
    return F.col(f"rates.{name}")


