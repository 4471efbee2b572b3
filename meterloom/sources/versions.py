"""Versions of the price catalog: a log of those that were fetched, and prices as they were at the time of an event.

A version counts from its time until the next. For the join the versions of a name become stretches of time in
which its entry stays the same, so an event meets as many rows as its model has had prices, not as there are
versions, and at most one of them holds its time.

A refresh appends a version only if it can be read and prices something; one that fails leaves a record of why and
the last good version in force. Catalogs are small documents, fetched and checked on the driver.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, strip_date_suffix
from ..functions.times import SECOND
from ..operators.cost import RATES
from .catalog import BROADCAST_NAMES, chosen, entries, held, rates, with_names

#: Seconds that lie between two refreshes at least, and the share of the interval by which one may come earlier or later.
LEAST_S, JITTER = 60, 0.1
END = 2**63 - 1
LOG = "at_ns long, json string, error string"


def stretches(versions: DataFrame) -> DataFrame:
    """``name, from_ns, to_ns, found`` of ``versions`` (``at_ns, json``): an entry in force from a time, inclusive, to another, exclusive."""
    follows = Window.orderBy("at_ns")  # one row a version
    # of two versions of one time the one with the larger text counts
    times = versions.groupBy("at_ns").agg(F.max("json").alias("json")).withColumn("next_ns", F.coalesce(F.lead("at_ns").over(follows), F.lit(END)))
    by = ("at_ns", "next_ns")
    entry = times.select(*by, F.explode(F.from_json("json", "map<string,string>")).alias("entry", "spec"))
    named = with_names(rates(entry, by), by).select(*by, F.col("model").alias("name"), F.struct("canonical", *RATES).alias("found"))
    along = Window.partitionBy("name").orderBy("at_ns")
    same = (F.lag("next_ns").over(along) == F.col("at_ns")) & F.lag("found").over(along).eqNullSafe(F.col("found"))
    parts = named.withColumn("new", (~F.coalesce(same, F.lit(False))).cast("int")).withColumn("nth", F.sum("new").over(along))
    return parts.groupBy("name", "nth", "found").agg(F.min("at_ns").alias("from_ns"), F.max("next_ns").alias("to_ns")).select("name", "from_ns", "to_ns", "found")


def with_rates_as_of(events: DataFrame, versions: DataFrame, model: str = "model", at_ns: str = "ts_ns") -> DataFrame:
    """``events`` with a struct ``rates``: the entry of the model's name in the version of the event's time, else of the name without its date, else null.

    The stretches are broadcast up to ``BROADCAST_NAMES`` rows, counted first; beyond, both sides are shuffled by name,
    where Spark splits models that are hot.
    """
    found = stretches(versions)
    if found.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES:
        found = F.broadcast(found)
    key = ascii_lower(F.trim(F.col(model)))
    rows = events.withColumns({"_exact": key, "_bare": strip_date_suffix(key)})
    for side in ("_exact", "_bare"):
        own = found.select(F.col("name").alias(f"{side}_name"), F.col("from_ns").alias(f"{side}_from"), F.col("to_ns").alias(f"{side}_to"), F.col("found").alias(f"{side}_found"))
        holds = (F.col(at_ns) >= F.col(f"{side}_from")) & (F.col(at_ns) < F.col(f"{side}_to"))
        rows = rows.join(own, (F.col(side) == F.col(f"{side}_name")) & holds, "left").drop(f"{side}_name", f"{side}_from", f"{side}_to")
    return chosen(rows)


@dataclass(frozen=True)
class CatalogLog:
    """The versions below ``root``, and the refreshes that failed."""

    spark: SparkSession
    root: str

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(LOG).parquet(self.root)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], LOG)

    def versions(self) -> DataFrame:
        return self.read().where("json IS NOT NULL").select("at_ns", "json")

    def refresh(self, fetch: Callable[[], str], at_ns: int) -> bool:
        """Fetch a version and append it; what cannot be fetched, read or used is recorded instead. Says whether it went well."""
        text, error = None, None
        try:
            text = fetch()
            if not rates(entries(self.spark.createDataFrame([(text,)], "json string"))).limit(1).count():
                text, error = None, "no entry that can be priced"
        except Exception as e:  # whatever the place of the catalog throws
            text, error = None, f"{type(e).__name__}: {e}"[:1000]
        self.spark.createDataFrame([(at_ns, text, error)], LOG).coalesce(1).write.mode("append").parquet(self.root)
        return text is not None

    def current(self) -> DataFrame:
        """Names and rates of the newest good version, as a stream takes them for each micro-batch."""
        last = self.versions().orderBy(F.desc("at_ns"), F.desc("json")).first()
        if last is None:
            raise LookupError("no catalog has been fetched yet")
        return held(self.spark, entries(self.spark.createDataFrame([(last["json"],)], "json string")), last["json"])

    def status(self, now_ns: int) -> dict[str, int | None]:
        """Refreshes that went well and that failed, and the age of the version in force in seconds."""
        r = self.read().agg(F.count("json").alias("ok"), F.count("error").alias("failed"), F.max(F.when(F.col("json").isNotNull(), F.col("at_ns"))).alias("last")).first()
        return {"ok": r["ok"], "failed": r["failed"], "age_s": None if r["last"] is None else (now_ns - r["last"]) // SECOND}


def next_refresh(at_ns: int, interval_s: float, draw: Callable[[], float] = random.random) -> int:
    """When to refresh next: after the interval give or take a tenth, so that many do not come at once, and a minute at least."""
    return at_ns + int(max(LEAST_S, interval_s * (1 + JITTER * (2 * draw() - 1))) * SECOND)
