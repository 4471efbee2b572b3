"""Registered queries of the engine, each over the facts of the test data, and the same in DuckDB's SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, flags, money, text
from ..functions.times import day_epoch, day_text
from ..operators import aggregates as A
from ..operators import archive, filters, store
from ..operators.cost import compute_cost
from ..operators.filters import EventFilter
from ..sources import catalog, versions
from ..sources.events import FACTS_DUCKDB, facts
from ..schema import EVENT
from ..streaming import keyed, stateful
from ..streaming.calls import Limits, stream_calls
from ..streaming.ingest import Sink, stream_rollup
from . import derived, examples

CUTOFF = 1_705_276_800 * 10**9  # 2024-01-15
USER, KEY = "user_7", "key_3"
_USAGE_OF_FACTS = {"input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "reasoning_tokens"}


def usage_of_facts(name: str):
    return F.col(name) if name in _USAGE_OF_FACTS else F.lit(0).cast("long")


def example_catalog(spark: SparkSession) -> DataFrame:
    return catalog.held(spark, catalog.entries(spark.createDataFrame([(examples.CATALOG,)], "json string")), examples.CATALOG)


def priced_rows(rows: DataFrame, **options) -> DataFrame:
    rows = catalog.with_rates(rows, example_catalog(rows.sparkSession))
    cost = F.when(F.col("rates").isNotNull(), compute_cost(F.col("provider"), usage_of_facts, catalog.rate_of, **options)).otherwise(0)
    return rows.withColumn("cost_nanodollars", cost.cast("long")).drop("rates")


def _as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What events cost at the prices of their time."""
    rows = versions.with_rates_as_of(facts(spark, sf_dir), spark.createDataFrame(examples.VERSIONS, "at_ns long, json string"))
    cost = F.when(F.col("rates").isNotNull(), compute_cost(F.col("provider"), usage_of_facts, catalog.rate_of)).otherwise(0)
    return rows.select("id", F.col("rates.canonical").alias("canonical"), cost.cast("long").alias("cost_nanodollars"))


def priced(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return priced_rows(facts(spark, sf_dir), **options)


# SQL of the same

_RATES = {"": (2500, 10000, 1250, 3000, 15000, 300, 3750, 100, 400), "batch": (1250, 5000, 1250, 3000, 15000, 300, 3750, 100, 400),
          "above": (2500, 10000, 1250, 6000, 22500, 600, 7500, 100, 400), "hour": (2500, 10000, 1250, 3000, 15000, 300, 6000, 100, 400)}


def _cost_sql(which: str = "") -> str:
    oi, oo, orr, ai, ao, ar, ac, gi, go = _RATES[which]
    i, o, r, c, t = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "reasoning_tokens")
    return (f"CASE provider WHEN 'openai' THEN greatest({i} - {r}, 0) * {oi} + {r} * {orr} + ({o} + {t}) * {oo} "
            f"WHEN 'anthropic' THEN {i} * {ai} + {r} * {ar} + {c} * {ac} + ({o} + {t}) * {ao} "
            f"ELSE greatest({i} - {r}, 0) * {gi} + {r} * {gi} + ({o} + {t}) * {go} END")


def _with(body: str, which: str = "") -> str:
    return f"WITH facts AS ({FACTS_DUCKDB}), priced AS (SELECT *, CAST({_cost_sql(which)} AS BIGINT) AS cost_nanodollars FROM facts), cube AS ({_CUBE}) {body}"


#: (from, model, entry, input, output, cache read, cache creation) of the versions of the example catalog; nulls where a version has no entry.
_PRICES = ", ".join(f"({at}, {row})" for (at, _), rows in zip(examples.VERSIONS, [
    ["'gpt-4o', 'gpt-4o', 2500, 10000, 1250, NULL", "'claude-sonnet-4-20250514', 'claude-sonnet-4-20250514', 3000, 15000, 300, 3750", "'gemini-2.0-flash', 'gemini/gemini-2.0-flash', 100, 400, 100, NULL"],
    ["'gpt-4o', 'gpt-4o', 2000, 8000, 1000, NULL", "'gemini-2.0-flash', NULL, NULL, NULL, NULL, NULL"], ["'gemini-2.0-flash', 'gemini/gemini-2.0-flash', 200, 800, 200, NULL"]]) for row in rows)
_DAY = "ts_ns // 1000000000 - (ts_ns // 1000000000) % 86400"
_DAYTEXT = "strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%d')"
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cost_nanodollars"))
_CUBE = (f"SELECT {_DAY} AS day, coalesce(user_id, '') AS user_id, coalesce(api_key_id, '') AS api_key_id, model, provider, count(*) AS event_count, CAST(sum(is_error) AS BIGINT) AS error_count, {_SUMS} "
         "FROM priced GROUP BY ALL")
_RESUM = f"CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(error_count) AS BIGINT) AS error_count, {_SUMS}"
_EVENT = "id, ts_ns, user_id, model, provider, http_status, cost_nanodollars"
_NEWEST = "ORDER BY ts_ns DESC, id DESC"


def _events(df: DataFrame) -> DataFrame:
    return df.select("id", "ts_ns", "user_id", "model", "provider", "http_status", "cost_nanodollars")


def _cost(**options):
    return lambda s, d: priced(s, d, **options).select("id", "cost_nanodollars")


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder, where ``spark.checkpoint.dir`` says or, without it, in a test."""
    return f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='meterloom-')}/{name}-{uuid.uuid4().hex}"


def _archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old events archived and, as far as the manifest says that they may match, read back beside the live ones."""
    root = _folder(spark, "archive")
    events = priced(spark, sf_dir)
    archive.append_manifest(archive.write_chunks(archive.candidates(events, CUTOFF), f"{root}/chunks", created_at=0, chunk=40).where("error IS NULL").drop("error"), f"{root}/manifest")
    which = EventFilter(provider="openai", from_ns=CUTOFF - 3 * 86_400 * 10**9, to_ns=CUTOFF + 86_400 * 10**9)
    return _events(archive.events_of(events.where(F.col("ts_ns") > CUTOFF), archive.read_manifest(spark, f"{root}/manifest"), which))


def _manifests(events: DataFrame) -> DataFrame:
    """Manifest rows of what could be archived, with a made-up size of ten bytes an event."""
    return A.archive_groups(archive.candidates(events, CUTOFF)).withColumns({"compressed_bytes": F.col("event_count") * 10, "archive_id": F.concat_ws("-", "user_id", "day")})


_MANIFESTS = (f"SELECT coalesce(user_id, '_none') AS user_id, {_DAYTEXT} AS day, count(*) AS event_count, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns, count(*) * 10 AS compressed_bytes FROM priced WHERE ts_ns <= {CUTOFF} GROUP BY ALL")


def _stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _folder(spark, "stream")
    rows = facts(spark, sf_dir)
    rows.write.mode("overwrite").parquet(f"{base}/facts")
    return stream_rollup(spark, f"{base}/facts", rows.schema, priced_rows, f"{base}/rollup", f"{base}/checkpoint")


def _after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store with all events, then without those with errors and those of a user."""
    events = priced(spark, sf_dir)
    held = store.Store(spark, _folder(spark, "store"))
    held.append(events.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields if f.name in events.columns)))
    held.delete(held.read().where("is_error = 1").select("id"))
    held.erase_user(USER)
    return _events(held.read())


def _kept(spark: SparkSession, sf_dir: str) -> store.Store:
    """A store with all events."""
    events = priced(spark, sf_dir)
    held = store.Store(spark, _folder(spark, "store"))
    held.append(events.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields if f.name in events.columns)))
    return held


def stored_sink(spark: SparkSession, sf_dir: str) -> Sink:
    """All events as a stream's sink has them, of two micro-batches."""
    events = priced(spark, sf_dir)
    missing = {f.name: F.lit(None).cast(f.dataType) for f in EVENT.fields if f.name not in events.columns}
    events = events.withColumns(missing).select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT.fields))
    sink = Sink(spark, _folder(spark, "sink"))
    for batch in range(2):
        sink.write(batch, events.where(F.pmod(F.crc32("id"), F.lit(2)) == batch), spark.createDataFrame([], "id string, value string, reason string"))
    return sink


def _quota_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota for each of some bounds, from the stored rollup and the edges."""
    sink, rows = stored_sink(spark, sf_dir), None
    for n, (lo, hi) in enumerate(_BOUNDS):
        row = sink.quota(USER, from_ns=lo, to_ns=hi).select(F.lit(n).alias("bound"), "cost_nanodollars", "event_count")
        rows = row if rows is None else rows.unionByName(row)
    return rows


def _rollup_after_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = stored_sink(spark, sf_dir)
    sink.store.erase_user(USER)
    sink.store.delete(sink.events().where("is_error = 1").select("id"))
    return sink.rollup()


def _streamed_after_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of streamed events after a user was erased and days that are too old were dropped."""
    sink = stored_sink(spark, sf_dir)
    sink.store.erase_user(USER)
    sink.store.collect_garbage(1_706_745_600 * 10**9, _KEEP)
    return _events(sink.events())


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events, errors and cost of a sink by tier, from the figures of its micro-batches."""
    found = stored_sink(spark, sf_dir).metrics()
    whole = found.agg(F.sum("errors").alias("errors"), F.sum("cost_nanodollars").cast("long").alias("cost_nanodollars"), F.collect_list("stored_by_tier").alias("parts"))
    each = whole.select("errors", "cost_nanodollars", F.explode("parts").alias("part")).select("errors", "cost_nanodollars", F.explode("part").alias("tier", "n"))
    return each.groupBy("tier", "errors", "cost_nanodollars").agg(F.sum("n").alias("stored"))


#: Bounds of quotas: inside two days, on days, inside one day, open.
_BOUNDS = [(CUTOFF - 3 * 86_400 * 10**9 + 12_345, CUTOFF + 5 * 86_400 * 10**9 + 77), (CUTOFF, CUTOFF + 86_400 * 10**9 - 1), (CUTOFF + 3_600 * 10**9, CUTOFF + 40_000 * 10**9), (CUTOFF + 1, None)]
_QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def _stream_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored events by user, of a stream of calls whose idempotency key is the user and counts for a day."""
    base = _folder(spark, "calls")
    body = F.to_json(F.struct("model", "provider", "user_id"))
    facts(spark, sf_dir).select(F.to_json(F.struct(F.col("user_id").alias("idempotency_key"), F.col("ts_ns").alias("at_ns"), body.alias("body")))).write.text(f"{base}/lines")
    sink = Sink(spark, f"{base}/out")
    stream_calls(spark, f"{base}/lines", sink, lambda: example_catalog(spark), f"{base}/checkpoint", limits=Limits(ttl_s=86_400)).awaitTermination()
    return A.rollup_rows(sink.rollup()).groupBy("user_id").agg(F.sum("event_count").alias("accepted"))


def _in_batches(walk):
    """A stateful walk over the facts in the order of time, in micro-batches of a fourth of them, with a restart after each second one.

    A fourth is written by all tasks. Files come by their age, so a run takes as many at once as its first fourth has, and its second has no more.
    """
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base = _folder(spark, "walk")
        rows = facts(spark, sf_dir).select("id", "ts_ns", "user_id", "api_key_id")
        cuts = sorted(set(rows.agg(F.percentile_approx("ts_ns", [0.25, 0.5, 0.75])).first()[0] or []))
        for n, (lo, hi) in enumerate(zip([None, *cuts], [*cuts, None])):
            part = rows.where(F.lit(True) if lo is None else F.col("ts_ns") > lo).where(F.lit(True) if hi is None else F.col("ts_ns") <= hi)
            if n % 2 == 0:
                part.write.parquet(f"{base}/in/part={n}")
                files = len(spark.read.parquet(f"{base}/in/part={n}").inputFiles())
            else:
                part.coalesce(files).write.parquet(f"{base}/in/part={n}")
            if n % 2 or hi is None:
                with stateful.rocksdb(spark):
                    lines = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{base}/in/part=*").select(*rows.columns)
                    walk(lines).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(f"{base}/out")

    return run


_KEEP = {"free": 7, "pro": 14}
_STATUS = EventFilter(status_from=400, status_below=500)
_ALL = EventFilter(user_id=USER, model="claude-sonnet-4-20250514", provider="anthropic", from_ns=CUTOFF - 86_400 * 10**9 * 10, to_ns=CUTOFF)
_CURSOR = (CUTOFF, "00000000000000000000005000")
def queries() -> dict:
    def scan(f):
        return lambda s, d: f(priced(s, d))

    def cube(f):
        return lambda s, d: f(A.rollup(priced(s, d)))

    return derived.queries() | {
        "cost_default": _cost(), "cost_batch": _cost(is_batch=True), "cost_long_context": _cost(context_bucket="above_200k"), "cost_cache_1h": _cost(cache_ttl="hours1"),
        "cost_geo": (lambda s, d: priced(s, d, geo="non_us", geo_multiplier=F.lit(1.25)).select("id", "cost_nanodollars")),
        "cost_as_of_versions": _as_of,
        "sink_metrics": _metrics, "quota_from_rollup": _quota_bounds, "rollup_after_erasure": _rollup_after_erasure, "streamed_after_retention": _streamed_after_retention,
        "events_newest_by_days": lambda s, d: _events(_kept(s, d).newest(EventFilter(provider="openai"), 100)),
        "latency_by_provider_and_day": lambda s, d: stored_sink(s, d).latency(["provider", "day"], _QUANTILES), "latency_by_tier": lambda s, d: stored_sink(s, d).latency(["tier"], _QUANTILES),
        "quota_user": scan(lambda e: A.quota(e, user_id=USER, from_ns=CUTOFF)), "quota_key": scan(lambda e: A.quota(e, api_key_id=KEY)),
        "quota_user_and_key": scan(lambda e: A.quota(e, USER, "key_0")), "quota_empty": scan(lambda e: A.quota(e, "nobody")),
        "rollup_daily": lambda s, d: A.rollup(priced(s, d)),
        "rollup_user_page": cube(lambda c: filters.offset_page(A.rollup_rows(c, user_id=USER), A.ordered(A.ROLLUP_ORDER), 10, 5)),
        "stats_total": cube(A.stats), "stats_by_model": cube(lambda c: A.stats(c, by_model=True)), "stats_provider": cube(lambda c: A.stats(c, "gemini", True)), "stats_empty": cube(lambda c: A.stats(c, "nobody")),
        "events_recent": scan(lambda e: _events(filters.newest(e))), "events_filter_all": scan(lambda e: _events(_ALL.apply(e))), "events_status_range": scan(lambda e: _events(_STATUS.apply(e))),
        "events_status_none": scan(lambda e: _events(EventFilter(status_below=200).apply(e))), "events_without_key": scan(lambda e: _events(EventFilter(api_key_id="", user_tag="blue").apply(e))),
        "events_cursor_page2": scan(lambda e: _events(filters.newest(e, EventFilter(tier="pro"), 25, _CURSOR))), "event_by_id": scan(lambda e: _events(filters.by_id(e, "0" * 22 + "0042"))),
        "events_summary": scan(lambda e: filters.summary(filters.newest(e, EventFilter(source="sdk"), 100)).select("id", "source", "ttft_ms", "streaming", "error_type")),
        "export_ndjson": scan(lambda e: filters.export_ndjson(_events(e), EventFilter(provider="gemini"))),
        "events_count": scan(lambda e: e.agg(F.count(F.lit(1)).alias("n"))),
        "latency_percentiles": scan(A.latency_percentiles),
        "table_view": scan(lambda e: filters.table_view(filters.newest(e, limit=20)).select("id", "tokens", "cost")),
        "tier_stats": scan(A.tier_stats), "gc_survivors": scan(lambda e: _events(store.gc_survivors(e, 1_706_745_600 * 10**9, _KEEP))),
        "tombstone_antijoin": scan(lambda e: _events(store.alive(e, e.where("is_error = 1").select("id")))), "erase_user": scan(lambda e: _events(store.alive(e, EventFilter(user_id=USER).apply(e).select("id")))),
        "archive_groups": scan(A.archive_groups), "archive_summary": scan(lambda e: A.archive_summary(_manifests(e))), "archive_by_user": scan(lambda e: A.archive_by_user(_manifests(e))),
        "manifest_overlap": scan(lambda e: archive.overlapping(_manifests(e), USER, CUTOFF - 5 * 86_400 * 10**9, CUTOFF).select("archive_id", "event_count")),
        "events_with_archive": _archive_round_trip,
        "archive_any_overlap": scan(lambda e: archive.any_overlap(_manifests(e), USER, CUTOFF - 5 * 86_400 * 10**9, CUTOFF)),
        "archive_no_overlap": scan(lambda e: archive.any_overlap(_manifests(e), "nobody", 0, CUTOFF)),
        "events_page_by_offset": scan(lambda e: _events(filters.offset_page(e, [F.desc("ts_ns"), F.desc("id")], 30, 60))),
        "stats_ordered": cube(lambda c: A.stats(c, by_model=True).orderBy(*A.ordered(A.STATS_ORDER)).limit(2)),
        "expired_older_than": scan(lambda e: _events(store.gc_survivors(e, 1_706_745_600 * 10**9, dict.fromkeys(store.TIERS, 10)))),
        "days": scan(lambda e: e.groupBy(day_epoch().alias("day"), day_text().alias("day_text")).agg(F.count(F.lit(1)).alias("n"))),
        "usage_merge_saturating": scan(lambda e: A.usage_merge(e.withColumn("input_tokens", F.col("input_tokens") * 400_000), ["provider"]).select("provider", "input_tokens", "output_tokens")),
        "cost_sum_saturating": scan(lambda e: e.groupBy("provider").agg(money.sum_saturating(F.col("cost_nanodollars").cast("decimal(38,0)") * F.lit(10**9).cast("decimal(12,0)")).alias("cost_nanodollars"))),
        "billable_input": scan(lambda e: e.groupBy("provider").agg(F.sum(money.total_billable_input(F.col("provider"), F.col)).alias("tokens"))), "total_output": scan(lambda e: e.groupBy("provider").agg(F.sum(money.total_output(F.col)).alias("tokens"))),
        "error_type_key": scan(lambda e: e.groupBy(errors.decode(errors.encode(errors.from_wire(F.col("error_type"), F.lit(None).cast("string"), F.col("http_status"))))["t"].alias("kind")).agg(F.count(F.lit(1)).alias("n"))),
        "tags_promoted": lambda s, d: s.read.parquet(f"{d}/events.parquet").groupBy(text.json_string(F.concat(F.lit('{"user_tag":"'), F.col("event_type"), F.lit('","session_tag":3}')), "user_tag").alias("user_tag")).agg(F.count(F.lit(1)).alias("n")),
        "flags_pack_unpack": scan(lambda e: e.withColumn("bits", flags.pack(lambda n: F.col(n) if n in ("streaming", "tool_calls", "ttft_ms", "http_status", "time_to_close_ms") else F.when(F.col("is_error") == 1, F.lit("e")) if n == "error_json" else F.lit(False)))
                                  .groupBy("bits", flags.unpack(F.col("bits"))["streaming"].alias("streaming")).agg(F.count(F.lit(1)).alias("n"))),
        "idempotent_first_seen": scan(lambda e: keyed.first_seen(e.select("id", "ts_ns", "user_id"), "user_id", ttl_s=86_400)),
        "token_bucket": scan(lambda e: keyed.token_bucket(e.select("id", "ts_ns", "api_key_id"), 0.0005, 2)),
        "stream_first_seen_state": _in_batches(lambda r: stateful.first_seen(r.select("id", "ts_ns", "user_id"), "user_id", ttl_s=86_400)),
        "stream_token_bucket_state": _in_batches(lambda r: stateful.token_bucket(r.select("id", "ts_ns", "api_key_id"), 0.0005, 2)),
        "stream_rollup_available_now": _stream_rollup, "stream_calls_accepted": _stream_calls,
        "stats_from_stored_rollup": lambda s, d: A.stats(_stream_rollup(s, d), by_model=True),
        "stored_rollup_page": lambda s, d: filters.offset_page(A.rollup_rows(_stream_rollup(s, d), user_id=USER), A.ordered(A.ROLLUP_ORDER), 10, 5),
        "store_after_deletes": _after_deletes,
    }


def oracle_sql() -> dict[str, str]:
    def events(where: str = "true", tail: str = "") -> str:
        return _with(f"SELECT {_EVENT} FROM priced WHERE {where} {tail}")

    def quota(where: str) -> str:
        return _with(f"SELECT CAST(coalesce(sum(cost_nanodollars), 0) AS BIGINT) AS cost_nanodollars, count(*) AS event_count FROM priced WHERE {where}")

    def cost(which: str) -> str:
        return _with("SELECT id, cost_nanodollars FROM priced", which)

    def stats(keys: str, where: str = "true") -> str:
        return _with(f"SELECT {keys}, {_RESUM} FROM cube WHERE {where} GROUP BY ALL" if keys != "''" else f"SELECT '' AS provider, '' AS model, {_RESUM} FROM cube WHERE {where} HAVING count(*) > 0")

    day, keep = 86_400 * 10**9, {t: (1_706_745_600 - n * 86_400) for t, n in _KEEP.items()}
    ts, id_ = _CURSOR
    quantile = "v - v % CAST(2 ** greatest(length(bin(v)) - 8, 0) AS BIGINT)"

    def latency(keys: str) -> str:
        own = ", ".join(f"list_transform([quantile_disc(total_ms, {q})], lambda v: {quantile})[1] AS {n}" for n, q in _QUANTILES.items())
        return _with(f"SELECT {keys}, count(*) AS n, {own} FROM (SELECT *, {_DAY} AS day FROM priced) GROUP BY ALL")

    recursive = f"WITH RECURSIVE facts AS ({FACTS_DUCKDB}), "
    first_seen = recursive + """rows AS (SELECT id, ts_ns, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts_ns, id) AS n FROM facts),
            walk AS (SELECT id, ts_ns, user_id, n, ts_ns AS last, true AS accepted FROM rows WHERE n = 1
              UNION ALL SELECT r.id, r.ts_ns, r.user_id, r.n, CASE WHEN r.ts_ns - w.last < 86400000000000 THEN w.last ELSE r.ts_ns END, r.ts_ns - w.last >= 86400000000000
              FROM walk w JOIN rows r ON r.user_id = w.user_id AND r.n = w.n + 1)
            SELECT id, ts_ns, user_id, accepted FROM walk"""
    survivors = " AND ".join(f"NOT (tier = '{t}' AND {_DAY} < {1_706_745_600 - 10 * 86_400})" for t in store.TIERS)
    overlap = "SELECT count(*) > 0 AS archived FROM ({m}) WHERE user_id = '{u}' AND max_ts_ns >= {a} AND min_ts_ns <= {b}"
    token_bucket = recursive + """rows AS (SELECT id, ts_ns, api_key_id, row_number() OVER (PARTITION BY api_key_id ORDER BY ts_ns, id) AS n FROM facts WHERE api_key_id IS NOT NULL),
            walk AS (SELECT id, ts_ns, api_key_id, n, 2::DOUBLE AS had FROM rows WHERE n = 1
              UNION ALL SELECT r.id, r.ts_ns, r.api_key_id, r.n, least(2::DOUBLE, CASE WHEN w.had >= 1 THEN w.had - 1 ELSE w.had END + CAST(r.ts_ns - w.ts_ns AS DOUBLE) / 1e9 * 0.0005::DOUBLE)
              FROM walk w JOIN rows r ON r.api_key_id = w.api_key_id AND r.n = w.n + 1)
            SELECT id, ts_ns, api_key_id, had >= 1 AS admitted, CASE WHEN had >= 1 THEN 0::DOUBLE ELSE (1 - had) / 0.0005::DOUBLE END AS wait_s FROM walk
            UNION ALL SELECT id, ts_ns, NULL, true, 0::DOUBLE FROM facts WHERE api_key_id IS NULL"""
    return derived.oracle_sql() | {
        "archive_any_overlap": _with(overlap.format(m=_MANIFESTS, u=USER, a=CUTOFF - 5 * day, b=CUTOFF)), "archive_no_overlap": _with(overlap.format(m=_MANIFESTS, u="nobody", a=0, b=CUTOFF)),
        "events_page_by_offset": events(tail=f"{_NEWEST} LIMIT 30 OFFSET 60"),
        "stats_ordered": _with(f"SELECT * FROM (SELECT provider, model, {_RESUM} FROM cube GROUP BY ALL) ORDER BY cost_nanodollars DESC, provider, model LIMIT 2"),
        "expired_older_than": events(survivors),
        "export_ndjson": _with("SELECT '{\"id\":\"' || id || '\",\"ts_ns\":' || ts_ns || ',\"user_id\":\"' || user_id || '\",\"model\":\"' || model || '\",\"provider\":\"' || provider || '\"' || coalesce(',\"http_status\":' || http_status, '') "
                               "|| ',\"cost_nanodollars\":' || cost_nanodollars || '}' AS value FROM priced WHERE provider = 'gemini'"),
        "latency_percentiles": _with("SELECT " + ", ".join(f"quantile_disc(total_ms, {q}) AS {n}" for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999))) + " FROM priced"),
        "stats_from_stored_rollup": stats("provider, model"), "stored_rollup_page": _with(f"SELECT * FROM cube WHERE user_id = '{USER}' ORDER BY day, user_id, api_key_id, model, provider LIMIT 10 OFFSET 5"),
        "store_after_deletes": events(f"is_error = 0 AND user_id <> '{USER}'"),
        "stream_calls_accepted": first_seen.replace("SELECT id, ts_ns, user_id, accepted FROM walk", "SELECT user_id, count(*) AS accepted FROM walk WHERE accepted GROUP BY user_id"),
        # a row at a time of every user, or key: whether it is taken, and the state after it
        "idempotent_first_seen": first_seen,
        "token_bucket": token_bucket, "stream_first_seen_state": first_seen, "stream_token_bucket_state": token_bucket,
        "cost_default": cost(""), "cost_batch": cost("batch"), "cost_long_context": cost("above"), "cost_cache_1h": cost("hour"),
        "cost_as_of_versions": f"""WITH facts AS ({FACTS_DUCKDB}), prices(at_ns, of, canonical, i, o, r, w) AS (VALUES {_PRICES})
            SELECT id, canonical, CAST(coalesce(CASE provider WHEN 'anthropic' THEN input_tokens * i + cache_read_input_tokens * r + cache_creation_input_tokens * w
              ELSE greatest(input_tokens - cache_read_input_tokens, 0) * i + cache_read_input_tokens * r END + (output_tokens + reasoning_tokens) * o, 0) AS BIGINT) AS cost_nanodollars
            FROM facts ASOF LEFT JOIN prices ON model = of AND ts_ns >= at_ns""",
        "cost_geo": _with("SELECT id, CAST(round(cost_nanodollars * 1.25::DOUBLE) AS BIGINT) AS cost_nanodollars FROM priced"),
        "quota_user": quota(f"user_id = '{USER}' AND ts_ns >= {CUTOFF}"), "quota_key": quota(f"api_key_id = '{KEY}'"), "quota_user_and_key": quota(f"user_id = '{USER}' AND api_key_id = 'key_0'"), "quota_empty": quota("user_id = 'nobody'"),
        "rollup_daily": _with("SELECT * FROM cube"), "stream_rollup_available_now": _with("SELECT * FROM cube"),
        "rollup_user_page": _with(f"SELECT * FROM cube WHERE user_id = '{USER}' ORDER BY day, user_id, api_key_id, model, provider LIMIT 10 OFFSET 5"),
        "stats_total": stats("''"), "stats_by_model": stats("provider, model"), "stats_provider": stats("provider, model", "provider = 'gemini'"), "stats_empty": stats("''", "provider = 'nobody'"),
        "sink_metrics": _with("SELECT tier, count(*) AS stored, (SELECT CAST(sum(is_error) AS BIGINT) FROM priced) AS errors, (SELECT CAST(sum(cost_nanodollars) AS BIGINT) FROM priced) AS cost_nanodollars FROM priced GROUP BY tier"),
        "quota_from_rollup": " UNION ALL ".join(f"(SELECT CAST({n} AS INTEGER) AS bound, * FROM ({quota(f"user_id = '{USER}' AND ts_ns >= {lo} AND ts_ns <= {2**63 - 1 if hi is None else hi}")}))" for n, (lo, hi) in enumerate(_BOUNDS)),
        "rollup_after_erasure": _with(f"SELECT * FROM cube").replace("FROM priced GROUP BY ALL", f"FROM priced WHERE user_id <> '{USER}' AND is_error = 0 GROUP BY ALL"),
        "streamed_after_retention": events(" AND ".join([f"user_id <> '{USER}'", *(f"NOT (tier = '{t}' AND {_DAY} < {c})" for t, c in keep.items())])),
        "events_newest_by_days": events("provider = 'openai'", f"{_NEWEST} LIMIT 100"), "latency_by_provider_and_day": latency("provider, day"), "latency_by_tier": latency("tier"),
        "events_recent": events(tail=f"{_NEWEST} LIMIT 50"),
        "events_filter_all": events(f"user_id = '{USER}' AND model = 'claude-sonnet-4-20250514' AND provider = 'anthropic' AND ts_ns BETWEEN {CUTOFF - 10 * day} AND {CUTOFF}"),
        "events_status_range": events("http_status >= 400 AND http_status < 500"), "events_status_none": events("coalesce(http_status, 0) < 200"), "events_without_key": events("api_key_id IS NULL AND user_tag = 'blue'"),
        "events_cursor_page2": events(f"tier = 'pro' AND (ts_ns < {ts} OR (ts_ns = {ts} AND id < '{id_}'))", f"{_NEWEST} LIMIT 25"), "event_by_id": events(f"id = '{'0' * 22}0042'"),
        "events_summary": _with(f"SELECT id, source, ttft_ms, streaming, error_type FROM (SELECT * FROM priced WHERE source = 'sdk' {_NEWEST} LIMIT 100)"),
        "events_count": _with("SELECT count(*) AS n FROM priced"),
        "table_view": _with(f"SELECT id, input_tokens + output_tokens AS tokens, printf('$%.8f', cost_nanodollars / 1e9) AS cost FROM priced {_NEWEST} LIMIT 20"),
        "tier_stats": _with("SELECT tier, count(*) AS event_count, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns FROM priced GROUP BY tier"),
        "gc_survivors": events(" AND ".join(f"NOT (tier = '{t}' AND {_DAY} < {c})" for t, c in keep.items())),
        "tombstone_antijoin": events("is_error = 0"), "erase_user": events(f"user_id <> '{USER}'"),
        "archive_groups": _with(f"SELECT coalesce(user_id, '_none') AS user_id, {_DAYTEXT} AS day, count(*) AS event_count, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns FROM priced GROUP BY ALL"),
        "archive_summary": _with(f"SELECT count(*) AS archives, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes, min(min_ts_ns) AS oldest_ts_ns FROM ({_MANIFESTS})"),
        "archive_by_user": _with(f"SELECT user_id, CAST(sum(event_count) AS BIGINT) AS event_count, CAST(sum(compressed_bytes) AS BIGINT) AS compressed_bytes FROM ({_MANIFESTS}) GROUP BY user_id"),
        "manifest_overlap": _with(f"SELECT user_id || '-' || day AS archive_id, event_count FROM ({_MANIFESTS}) WHERE user_id = '{USER}' AND max_ts_ns >= {CUTOFF - 5 * day} AND min_ts_ns <= {CUTOFF}"),
        "events_with_archive": events(f"provider = 'openai' AND ts_ns BETWEEN {CUTOFF - 3 * day} AND {CUTOFF + day}"),
        "days": _with(f"SELECT {_DAY} AS day, {_DAYTEXT} AS day_text, count(*) AS n FROM priced GROUP BY ALL"),
        "usage_merge_saturating": _with("SELECT provider, CAST(least(sum(input_tokens * 400000), 4294967295) AS BIGINT) AS input_tokens, CAST(least(sum(output_tokens), 4294967295) AS BIGINT) AS output_tokens FROM priced GROUP BY provider"),
        "cost_sum_saturating": _with("SELECT provider, CAST(least(sum(CAST(cost_nanodollars AS HUGEINT) * 1000000000), 9223372036854775807) AS BIGINT) AS cost_nanodollars FROM priced GROUP BY provider"),
        "billable_input": _with("SELECT provider, CAST(sum(CASE WHEN provider = 'anthropic' THEN input_tokens + cache_creation_input_tokens + cache_read_input_tokens ELSE input_tokens END) AS BIGINT) AS tokens FROM priced GROUP BY provider"),
        "total_output": _with("SELECT provider, CAST(sum(output_tokens + reasoning_tokens) AS BIGINT) AS tokens FROM priced GROUP BY provider"),
        "error_type_key": _with("SELECT error_type AS kind, count(*) AS n FROM priced GROUP BY error_type"), "tags_promoted": "SELECT event_type AS user_tag, count(*) AS n FROM events GROUP BY event_type",
        "flags_pack_unpack": _with("SELECT CAST(bits AS INTEGER) AS bits, bits % 2 = 1 AS streaming, count(*) AS n FROM (SELECT CASE WHEN streaming THEN 1 ELSE 0 END + CASE WHEN tool_calls THEN 2 ELSE 0 END + CASE WHEN ttft_ms IS NOT NULL THEN 256 ELSE 0 END "
                                   "+ CASE WHEN http_status IS NOT NULL THEN 512 ELSE 0 END + CASE WHEN is_error = 1 THEN 1024 ELSE 0 END + CASE WHEN time_to_close_ms IS NOT NULL THEN 2048 ELSE 0 END AS bits FROM priced) GROUP BY ALL"),
    }


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spend by provider and model, from raw facts through prices and the daily cube."""
    return A.stats(A.rollup(priced(spark, sf_dir)), by_model=True).orderBy(*A.ordered(A.STATS_ORDER))
