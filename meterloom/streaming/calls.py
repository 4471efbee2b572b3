"""Streaming ingest of whole calls: keys, token buckets and replays decided before the events are stored.

A line is ``{"token", "idempotency_key", "at_ns", "body"}``: what the client sent beside its JSON body, and
when it arrived. A call is checked as a service would check it: its key, its key's token bucket, its
body, and whether its idempotency key was accepted within the time before. Buckets and idempotency keys are states
of the query (``stateful``), so a micro-batch that runs again finds the same.

A line that is no such object, or has no arrival time, is refused with its text as it came; it takes no
token and no key. The keys are read when the query starts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.ingest import authenticated, normalise, reasons
from .ingest import Sink
from .stateful import first_seen, rocksdb, token_bucket

CALL = "token string, idempotency_key string, at_ns long, body string"


@dataclass(frozen=True)
class Limits:
    """``rps`` and ``burst`` of each key (0: no limit), and for how long an idempotency key counts (0: never)."""

    rps: float = 0.0
    burst: float = 1.0
    ttl_s: int = 300


def decided(lines: DataFrame, keys: DataFrame | None, limits: Limits, lateness: str = "1 hour") -> DataFrame:
    """Streaming ``lines`` (``value``) as ``seq, at_ns, line, value, key_id, tier, reason``; ``reason`` is null for what is stored.

    Calls of one time are ordered by a hash of their line; equal lines can stand for each other.
    """
    c = F.col("c")
    rows = lines.select(F.xxhash64("value").alias("seq"), F.col("value").alias("line"), F.from_json("value", CALL).alias("c"))
    rows = rows.select("seq", "line", c["token"].alias("token"), c["idempotency_key"].alias("idempotency_key"), F.coalesce(c["at_ns"], F.lit(0)).alias("at_ns"), c["body"].alias("value"),
                       F.when(c["at_ns"].isNull(), "malformed call").alias("refused"))
    if keys is None:
        rows = rows.drop("token").withColumns({"key_id": F.lit(None).cast("string"), "tier": F.lit("free")})
    else:
        rows = authenticated(rows, keys).withColumn("refused", F.coalesce("refused", F.when(F.col("key_id").isNull(), "unauthorized")))
    watermark = lateness
    if limits.rps > 0:
        rows = rows.withColumn("bucket", F.when(F.col("refused").isNull(), F.col("key_id")))
        rows = token_bucket(rows, limits.rps, limits.burst, "bucket", "at_ns", "seq", watermark)
        rows = rows.withColumn("refused", F.coalesce("refused", F.when(~F.col("admitted"), "rate limited"))).drop("bucket", "admitted", "wait_s")
        watermark = None
    rows = reasons(rows, F.col("at_ns")).withColumn("reason", F.coalesce("refused", "reason")).drop("event", "refused")
    if limits.ttl_s > 0:  # only what would be stored takes an idempotency key
        rows = rows.withColumn("taking", F.when(F.col("reason").isNull(), F.col("idempotency_key")))
        rows = first_seen(rows, "taking", "at_ns", "seq", limits.ttl_s, watermark)
        rows = rows.withColumn("reason", F.coalesce("reason", F.when(~F.col("accepted"), "replayed"))).drop("taking", "accepted")
    return rows.drop("idempotency_key")


def stream_calls(spark: SparkSession, lines_path: str, sink: Sink, catalog: Callable[[], DataFrame], checkpoint: str, keys: Callable[[], DataFrame] | None = None,
                 limits: Limits = Limits(), max_files: int = 64, every: str | None = None) -> StreamingQuery:
    """Start the query. The catalog is read anew for each micro-batch; without ``keys`` all calls are let in, without a key of their own.

    Refused calls are rejects with their reason, their body and the line as it came. A call of an unknown key has no bucket and takes none.
    """
    def each(batch: DataFrame, number: int) -> None:
        staged = f"{sink.root}/state/calls/batch={number}"
        batch.write.mode("overwrite").parquet(staged)  # once, as each use of the micro-batch would walk its states again
        rows = spark.read.schema(batch.schema).parquet(staged)
        rows = rows.withColumn("id", F.concat(F.lpad(F.lit(str(number)), 10, "0"), F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")))
        good = reasons(rows.where("reason is null").drop("reason"), F.col("at_ns")).drop("reason")
        events = normalise(good, catalog(), F.col("at_ns"), F.col("id"), F.col("tier"), F.col("key_id"))
        sink.write(number, events, rows.where("reason is not null").select("id", "value", "line", "key_id", "reason"))
        sink.drop(f"state/calls/batch={number - 1}")

    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(lines_path)
    with rocksdb(spark):
        writer = decided(lines, keys() if keys else None, limits).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
