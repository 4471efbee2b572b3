"""Streaming ingest: JSON lines by micro-batches into the store and the rollup.

A micro-batch is written to a place of its own number, so one that runs again after a failure replaces
itself. The catalog is read anew for each micro-batch and prices only its events. The rollup is a table
of partial cubes, merged when it is read; late events add to their own day, nothing is dropped. A sink
that is full ends the query; the micro-batch is not committed and comes again at the next start.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..functions import histogram
from ..functions.times import day_epoch, day_text
from ..operators.aggregates import less, merged, quota_from, rollup
from ..operators.filters import EventFilter
from ..operators.store import Store
from ..sources.ingest import ingest
from . import metrics


@dataclass(frozen=True)
class Sink:
    spark: SparkSession
    root: str
    max_bytes: int | None = None

    @property
    def store(self) -> Store:
        """The same events with all that a store can do: listings, deletion, retention, archives."""
        return Store(self.spark, self.root, self.max_bytes)

    def events(self, which: EventFilter = EventFilter()) -> DataFrame:
        """Events that match and are not deleted."""
        return self.store.read(which)

    def rejects(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/rejects").drop("batch")

    def rollup(self) -> DataFrame:
        """The daily cube as stored, less what was deleted; quotas by day, statistics and rollup pages read it and no events."""
        return less(self._cells(*self._rollup_parts()), self.store.taken())

    def quota(self, user_id: str | None = None, api_key_id: str | None = None, from_ns: int = 0, to_ns: int | None = None) -> DataFrame:
        """Spend and number of events of a user, a key or both: whole days from the rollup, the rest of a day from its events."""
        return quota_from(self.rollup(), self.events(), user_id, api_key_id, from_ns, to_ns)

    def latency(self, keys: list[str], wanted: dict[str, float]) -> DataFrame:
        """Quantiles of the time of calls by some of ``day, tier, provider``, from stored histograms; deleted events count on."""
        return histogram.quantiles(self.spark.read.parquet(f"{self.root}/latency"), keys, wanted)

    def compact_rollup(self) -> int | None:
        """Make one table of the partial cubes of all micro-batches but the newest, which may still come again.

        The table is written under the number of the last micro-batch in it; readers take the largest that is whole and
        the partial cubes after it, so nothing is counted twice or missed wherever the job ends. Returns that number.
        """
        base, later = self._rollup_parts()
        if len(later) < 2:
            return base
        upto = later[-2]
        self._cells(base, later[:-1]).write.mode("overwrite").parquet(f"{self.root}/rollup_base/upto={upto}")
        for n in later[:-1]:
            self.drop(f"rollup/batch={n}")
        if base is not None:
            self.drop(f"rollup_base/upto={base}")
        return upto

    def _rollup_parts(self) -> tuple[int | None, list[int]]:
        """Number of the compacted table, and of the micro-batches after it."""
        def numbers(name: str) -> list[int]:
            fs, path = self.path(name)
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
            return sorted(int(f.getPath().getName().split("=")[1]) for f in (fs.listStatus(path) if fs.exists(path) else []) if "=" in f.getPath().getName() and fs.exists(hadoop(f.getPath(), "_SUCCESS")))

        base = max(numbers("rollup_base"), default=None)
        return base, [n for n in numbers("rollup") if base is None or n > base]

    def _cells(self, base: int | None, later: list[int]) -> DataFrame:
        paths = [f"{self.root}/rollup/batch={n}" for n in later] + ([f"{self.root}/rollup_base/upto={base}"] if base is not None else [])
        return merged(self.spark.read.parquet(*paths))

    def path(self, name: str):
        """The file system and the path of a folder below the root."""
        return Store(self.spark, self.root)._fs(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        fs, path = self.path(name)
        fs.delete(path, True)

    def write(self, batch: int, events: DataFrame, rejects: DataFrame) -> None:
        self.store.check_room()
        events = events.withColumn("day", day_text()).hint("rebalance", "tier", "day").sortWithinPartitions("tier", "day", "ts_ns")
        events, of_events = metrics.of_events(events)
        events.write.mode("overwrite").partitionBy("tier", "day").parquet(f"{self.root}/events/batch={batch}")
        stored = self.spark.read.schema(events.schema).parquet(f"{self.root}/events/batch={batch}")
        rollup(stored).write.mode("overwrite").parquet(f"{self.root}/rollup/batch={batch}")
        histogram.counts(stored, [day_epoch().alias("day"), "tier", "provider"], "total_ms").write.mode("overwrite").parquet(f"{self.root}/latency/batch={batch}")
        rejects, of_rejects = metrics.of_rejects(rejects)
        rejects.write.mode("overwrite").parquet(f"{self.root}/rejects/batch={batch}")
        fs, path = self.path(f"events/batch={batch}")
        found = metrics.row(batch, of_events, of_rejects, fs.getContentSummary(path).getLength())
        self.spark.createDataFrame([found], metrics.METRICS).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/metrics/n={batch}")

    def metrics(self) -> DataFrame:
        """A row for each micro-batch: what was stored, at what cost, of which tiers, and what was refused, why."""
        return self.spark.read.schema(metrics.METRICS).parquet(f"{self.root}/metrics/n=*")

    def sample(self, at_ns: int) -> None:
        """Add the files and bytes of each tier as they are now to the samples; only the listing is read."""
        sizes = self.store.tier_sizes().groupBy("tier").agg(F.countDistinct("day").alias("days"), F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
        sizes.select(F.lit(at_ns).alias("at_ns"), "*").coalesce(1).write.mode("append").parquet(f"{self.root}/samples")

    def samples(self) -> DataFrame:
        return self.spark.read.schema("at_ns long, tier string, days long, files long, bytes long").parquet(f"{self.root}/samples")


def stream_ingest(spark: SparkSession, lines_path: str, sink: Sink, catalog: Callable[[], DataFrame], checkpoint: str, tier: str = "free",
                  max_files: int = 64, every: str | None = None) -> StreamingQuery:
    """Start the query; without ``every`` it ends when all that is there has been read. ``max_files`` bounds a micro-batch."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(lines_path)

    def each(batch: DataFrame, number: int) -> None:
        now = F.expr("unix_micros(current_timestamp()) * 1000")
        # the same line in the same place has the same id if the micro-batch runs again
        id_ = F.concat(F.lpad(F.lit(str(number)), 10, "0"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0"))
        events, rejects = ingest(batch, catalog(), now, id_, F.lit(tier))
        sink.write(number, events, rejects)

    writer = lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def stream_rollup(spark: SparkSession, facts_path: str, schema, prepare: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """The daily cube of a stream of files, as partial cubes; ``prepare`` gives priced events."""
    def each(batch: DataFrame, number: int) -> None:
        rollup(prepare(batch)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = spark.readStream.schema(schema).parquet(facts_path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return merged(spark.read.parquet(out))
