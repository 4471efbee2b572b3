"""Scalar functions, prices, ingest, store and archive on small hand-made rows."""

import json
import math
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterloom import schema
from meterloom.functions import errors, money, text, times
from meterloom.operators import aggregates, archive, filters, store
from meterloom.operators.cost import RATES, compute_cost
from meterloom.plans import examples, queries
from meterloom.sources import catalog, config, ingest

#: provider, model, (in, out, read, create), options, nanodollars
GOLDENS = [
    ("openai", "gpt-4o", (2048, 512, 0, 0), {}, 10_240_000), ("openai", "gpt-4o", (2048, 512, 1024, 0), {}, 8_960_000), ("openai", "gpt-4o", (2048, 512, 0, 0), {"is_batch": True}, 5_120_000),
    ("anthropic", "claude-sonnet-4-20250514", (500, 200, 2000, 300), {}, 6_225_000), ("anthropic", "claude-sonnet-4-20250514", (500, 200, 0, 300), {"cache_ttl": "hours1"}, 6_300_000),
    ("bedrock", "claude-sonnet-4-20250514", (1000, 500, 500, 200), {}, 11_400_000), ("gemini", "gemini/gemini-2.0-flash", (10000, 500, 0, 0), {}, 1_200_000),
]


def one(spark, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}")


def test_schema_is_pinned():
    assert schema.SCHEMA_ID == 1
    assert [f.name for f in schema.EVENT.fields][:6] == ["id", "ts_ns", "user_id", "api_key_id", "model", "provider"]
    assert len(schema.DIMS) == 14 and len(schema.LABELS) == 8 and len(schema.EVENT.fields) == 47


def test_goldens(spark):
    for provider, model, (i, o, r, c), options, expected in GOLDENS:
        row = spark.createDataFrame([(provider, model, i, o, r, c)], "provider string, model string, input_tokens long, output_tokens long, cache_read_input_tokens long, cache_creation_input_tokens long").withColumn("reasoning_tokens", F.lit(0))
        assert queries.priced_rows(row, **options).first()["cost_nanodollars"] == expected


def test_cost_saturates_and_multiplies(spark):
    row = spark.range(1)
    rates = {r: F.lit(None).cast("long") for r in RATES} | {"input": F.lit(2500), "output": F.lit(2**62)}
    usage = lambda u: F.lit(2**32 - 1 if u == "output_tokens" else 0)
    assert row.select(compute_cost(F.lit("openai"), usage, rates.__getitem__).alias("c")).first()["c"] == 2**63 - 1
    usage = lambda u: F.lit(4200 if u == "input_tokens" else 0)
    c = compute_cost(F.lit("openai"), usage, rates.__getitem__, geo="non_us", geo_multiplier=F.lit(1.25))
    assert row.select(c.alias("c")).first()["c"] == 13_125_000


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.integers(0, 99_999)] * 5), min_size=20, max_size=40))
def test_cost_properties(spark, rows):
    names = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "reasoning_tokens"]
    df = spark.createDataFrame(rows, ", ".join(f"{n} long" for n in names)).withColumns({"provider": F.lit("anthropic"), "model": F.lit("claude-sonnet-4-20250514"), "more": F.lit(1)})
    base = queries.priced_rows(df).withColumnRenamed("cost_nanodollars", "a")
    grown = queries.priced_rows(base.withColumn("output_tokens", F.col("output_tokens") + 1))
    assert grown.where("a < 0 or cost_nanodollars < a").count() == 0


def test_catalog_rules(spark):
    got = {r["model"]: r for r in queries.example_catalog(spark).collect()}
    assert {"gpt-4o", "gemini-2.0-flash", "gpt-5-mini", "mixed/case-model", "case-model"} <= got.keys()
    assert "sample_spec" not in got and "image-only" not in got and "broken" not in got
    assert got["gpt-5-mini"]["canonical"] == "azure/gpt-5-mini-2025-08-07"  # a tie goes to the smallest
    own = got["openai/gpt-5-mini"]
    assert own["search_query"] == 30_000_000 and own["max_input_tokens"] is None and got["case-model"]["search_query"] == 35_000_000


def test_lookup_never_mixes_entries(spark):
    c = catalog.with_names(catalog.rates(catalog.entries(spark.createDataFrame([(json.dumps({
        "m-2024-01-01": {"input_cost_per_token": 1e-6}, "m": {"input_cost_per_token": 2e-6, "cache_read_input_token_cost": 5e-7}}),)], "json string"))))
    row = catalog.with_rates(one(spark, "m-2024-01-01").withColumnRenamed("x", "model"), c).first()
    assert row["rates"]["input"] == 1000 and row["rates"]["cache_read"] is None


def test_text_functions(spark):
    f = lambda v, fn: one(spark, v).select(fn(F.col("x")).alias("y")).first()["y"]
    assert f("  GPT-À \n", text.normalize_model) == "gpt-À"
    assert f("a-20240101", text.strip_date_suffix) == "a" and f("-20240101", text.strip_date_suffix) == "-20240101"
    assert f("é" * 200, lambda c: text.cut_bytes(c, 255)) == "é" * 127
    assert f("0xABCDEF0123456789abcdef0123456789", text.trace_id) == "abcdef0123456789abcdef0123456789" and f("xyz", text.trace_id) is None
    assert f("id:secret", text.key_id) == "id" and f(":x", text.key_id).startswith("key_")
    for ip, ok in (("192.0.2.1", True), ("256.1.1.1", False), ("2001:db8::1", True), ("::", True), ("1::2::3", False), ("fe80", False)):
        assert (f(ip, text.client_ip) == ip) is ok, ip
    assert f('{"a":5}', lambda c: text.json_string(c, "a")) == "" and f('{"a":"v"}', lambda c: text.json_string(c, "a")) == "v" and f("no json", lambda c: text.json_string(c, "a")) == ""


def test_time_functions(spark):
    f = lambda v: one(spark, v).select(times.rfc3339_to_ns(F.col("x")).alias("y")).first()["y"]
    assert f("2023-11-14T22:13:20.123456789Z") == 1_700_000_000_123_456_789 and f("2023-11-14T23:13:20+01:00") == 1_700_000_000 * 10**9 and f("yesterday") is None
    row = one(spark, 1_700_000_000_999_999_999, "long").withColumnRenamed("x", "ts_ns").select(times.day_epoch().alias("d"), times.day_text().alias("t")).first()
    assert row["d"] == 1_699_920_000 and row["t"] == "2023-11-14"


def test_money(spark):
    f = lambda v, fn, kind="long": one(spark, v, kind).select(fn(F.col("x")).alias("y")).first()["y"]
    assert f(-(2**63), money.cost_display) == "-$9223372036.85477580" and f(5_123_000, money.cost_display) == "$0.00512300"
    assert f(2.5e-9, money.dollars_to_nanos, "double") == 3 and f(None, money.dollars_to_nanos, "double") is None
    assert spark.createDataFrame([(2**63 - 1,), (1,)], "x long").select(money.sum_saturating(F.col("x")).alias("y")).first()["y"] == 2**63 - 1


def test_errors_round_trip(spark):
    rows = spark.createDataFrame([(k, "m", 418) for k in errors.KINDS + ["strange"]], "k string, m string, s int")
    e = errors.from_wire(F.col("k"), F.col("m"), F.col("s"))
    for r in rows.select("k", e.alias("e"), errors.decode(errors.encode(e)).alias("d")).collect():
        assert r["e"] == r["d"] and r["e"]["t"] == (r["k"] if r["k"] in errors.KINDS else "other")
    for at in ("limit", "param"):
        body = lambda n: json.dumps({"error": {"type": "x_context_window", at: n if at == "limit" else {"limit": n}}})  # noqa: B023, E731
        rows = spark.createDataFrame([(400, body(n), n) for n in (0, 9, 10**6, 2**32 - 1, 2**32, -1)], "status int, body string, n long")
        for r in rows.select("n", errors.from_response(F.col("status"), F.col("body"))["l"].alias("l")).collect():
            assert r["l"] == (r["n"] if 0 <= r["n"] < 2**32 else 0)


def test_ingest(spark):
    lines = spark.createDataFrame([(p,) for p in examples.PAYLOADS], "value string").withColumn("n", F.monotonically_increasing_id())
    events, rejects = ingest.ingest(lines, queries.example_catalog(spark), F.lit(examples.NOW_NS), F.lpad(F.col("n").cast("string"), 26, "0"), F.lit("free"))
    assert events.schema.names == schema.EVENT.names
    rows = events.collect()
    assert len(rows) == examples.REASONS.count(None) and rejects.count() == len(examples.PAYLOADS) - len(rows)
    by = {(r["model"], r["cost_nanodollars"]): r for r in rows}
    assert ("gpt-4o", 10_240_000) in by and ("", 0) in by
    claude = by["claude-sonnet-4-20250514", 6_225_000]
    assert claude["error_type"] == "other" and claude["streaming"] and claude["client_ip"] == "192.0.2.1" and claude["trace_id"] == "abcdef0123456789" * 2
    demo = next(r for r in rows if r["user_tag"] == "demo")
    assert demo["session_tag"] == "" and demo["ts_ns"] == 1_700_000_000_123_456_789
    own = by["m", 77]
    assert own["provider"] == "openai_compatible" and own["provider_base_url"] == "my-proxy" and own["client_ip"] is None and own["method"] == "POST"


def test_batches(spark):
    bodies = spark.createDataFrame([('{"events":[{"model":"a"},{"model":"b"}]}',), ('{"events":[]}',)], "value string")
    assert [(r["position"], json.loads(r["value"])["model"]) for r in ingest.batch_items(bodies).collect()] == [(0, "a"), (1, "b")]


def _events(spark, n=9):
    lines = spark.createDataFrame([(i, json.dumps({"model": "gpt-4o", "provider": "openai", "user_id": f"u{i % 2}", "timestamp": 1_700_000_000_000_000_000 + i // 3 * 86_400 * 10**9, "cost_nanodollars": 1000})) for i in range(n)], "n long, value string")
    tier = F.element_at(F.array(*(F.lit(t) for t in store.TIERS)), (F.col("n") % 3 + 1).cast("int"))
    return ingest.ingest(lines, queries.example_catalog(spark), F.lit(examples.NOW_NS), F.lpad(F.col("n").cast("string"), 26, "0"), tier)[0]


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    assert s.read().count() == 0
    s.append(_events(spark))
    assert aggregates.quota(s.read(), "u0").first().asDict() == {"cost_nanodollars": 5000, "event_count": 5}
    ids = spark.createDataFrame([("0" * 25 + "1",), ("unknown",)], "id string")
    assert s.delete(ids) == {"asked": 2, "deleted": 1} and s.delete(ids)["deleted"] == 0 and s.read().count() == 8
    assert s.erase_user("u0") == 5 and s.read().count() == 3
    s.collect_garbage(1_700_000_000_000_000_000 + 30 * 86_400 * 10**9, {"free": 7, "pro": 0})
    assert {t for t, _ in s.partitions()} == {"pro", "team"}
    before = s.read().count()
    for tier, day in s.partitions():
        s.compact(tier, day)
    assert s.read().count() == before
    with pytest.raises(store.StorageFull):
        store.Store(spark, str(tmp_path), 1).append(_events(spark))


def test_filters_reach_the_scan(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.append(_events(spark))
    plan = s.read(filters.EventFilter(user_id="u1", tier="pro", from_ns=1_700_000_000_000_000_000))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(user_id,u1)" in plan and "tier#" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_pages_are_complete(spark):
    events = spark.createDataFrame([(f"{i:03d}", 5) for i in range(25)], "id string, ts_ns long").withColumns({c: F.lit(None).cast("string") for c in ("user_id",)})
    seen, cursor = [], None
    while True:
        rows, more, cursor = filters.page(events, limit=10, cursor=cursor)
        seen += [r["id"] for r in rows]
        if not more:
            break
    assert seen == [f"{i:03d}" for i in range(24, -1, -1)]


def test_archive_round_trip(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/store")
    s.append(_events(spark, 12))
    before = {r["id"] for r in s.read().collect()}
    cutoff = 1_700_000_000_000_000_000 + 2 * 86_400 * 10**9
    assert archive.archive(s, f"{tmp_path}/chunks", f"{tmp_path}/manifest", cutoff, 1)["archived"] == 9
    manifests = archive.read_manifest(spark, f"{tmp_path}/manifest")
    assert aggregates.archive_summary(manifests).first()["archives"] == 6 and {r["user_id"] for r in manifests.collect()} == {"u0", "u1"}
    both = archive.live_and_archived(s.read(), archive.read_chunks(spark, manifests), filters.EventFilter())
    assert {r["id"] for r in both.collect()} == before and s.read().count() == 3


def test_chunks_are_bounded_and_in_time_order(spark, tmp_path):
    events = spark.range(2500).select(F.format_string("%05d", "id").alias("id"), (F.lit(1_700_000_000_000_000_000) + F.pmod(F.col("id") * 7919, F.lit(2500)) * 10**9).alias("ts_ns"), F.lit("a/b=c").alias("user_id"))
    made = archive.write_chunks(events, str(tmp_path / "chunks"), 1, chunk=300)
    rows = made.orderBy("min_ts_ns").collect()
    assert len(rows) == 9 and max(r["event_count"] for r in rows) == 300 and all(a["max_ts_ns"] < b["min_ts_ns"] for a, b in zip(rows, rows[1:])) and {r["user_id"] for r in rows} == {"a/b=c"}
    archive.append_manifest(made, str(tmp_path / "manifest"))
    manifests = archive.read_manifest(spark, str(tmp_path / "manifest"))
    span = filters.EventFilter(user_id="a/b=c", from_ns=1_700_000_000_000_000_000 + 1100 * 10**9, to_ns=1_700_000_000_000_000_000 + 1300 * 10**9)
    some = archive.overlapping(manifests, span.user_id, span.from_ns, span.to_ns)
    read = archive.read_chunks(spark, some)
    assert some.count() == 2 and read.count() == 600
    live = events.where("id < '00100'").withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema.EVENT.fields if f.name not in events.columns})
    got = archive.events_of(live, manifests.unionByName(manifests), span)
    assert got.count() == 201 == got.select("id").distinct().count()
    assert archive.any_overlap(manifests, "a/b=c", 0, 10**18 * 2).first()[0] and not archive.any_overlap(manifests, "nobody").first()[0]
    broken = next((tmp_path / "chunks").rglob("*.jsonl.zst"))
    broken.write_bytes(b"not zstd")
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    assert archive.read_chunks(spark, manifests, skip_bad=True).count() in (2200, 2400)


def test_small_chunks_come_back_together_and_from_all_tasks(spark, tmp_path):
    """Outcomes and events of chunks of one event: a batch of rows for many of them, and no few tasks that read them all."""
    import pyarrow as pa

    rows = [{"archive_user": f"u{i:04d}", "archive_day": "2024-01-01", "archive_chunk": 0, "line": json.dumps({"id": str(i), "ts_ns": i}), "ts_ns": i} for i in range(archive.ROWS + 10)]
    given = pa.RecordBatch.from_pylist(rows)
    made = list(archive._chunk_writer(str(tmp_path), "run", 1)(iter(given.slice(at, 500) for at in range(0, len(rows), 500))))
    assert [b.num_rows for b in made] == [archive.ROWS, 10] and {x for b in made for x in b.column("error").to_pylist()} == {None}
    read = list(archive._chunk_reader(archive.MOST)(iter(made)))
    assert [b.num_rows for b in read] == [archive.ROWS, 10] and [json.loads(x)["ts_ns"] for b in read for x in b.column("line").to_pylist()] == list(range(len(rows)))
    manifests = spark.createDataFrame([r for b in made for r in b.to_pylist()], archive.OUTCOME).drop("error")
    events = archive.read_all(spark, manifests.unionByName(manifests))
    assert events.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and events.count() == len(rows)


def test_a_chunk_that_fails_leaves_its_events_live(spark, tmp_path):
    s = store.Store(spark, f"{tmp_path}/store")
    s.append(_events(spark, 12))
    cutoff = 1_700_000_000_000_000_000 + 2 * 86_400 * 10**9
    (tmp_path / "chunks" / "u1").mkdir(parents=True)
    (tmp_path / "chunks" / "u1" / "2023-11-15").write_text("in the way of a folder")
    first = archive.archive(s, f"{tmp_path}/chunks", f"{tmp_path}/manifest", cutoff, 1)
    assert first["failed"] == 2 and first["archived"] == 7 and first["chunks"] == 5 and first["compressed_bytes"] > 0
    live = {r["id"]: (r["user_id"], filters.day_of(r["ts_ns"])) for r in s.read().collect()}
    assert len(live) == 5 and sum(v == ("u1", "2023-11-15") for v in live.values()) == 2
    (tmp_path / "chunks" / "u1" / "2023-11-15").unlink()
    second = archive.archive(s, f"{tmp_path}/chunks", f"{tmp_path}/manifest", cutoff, 2)
    assert (second["archived"], second["failed"]) == (2, 0)
    manifests = archive.read_manifest(spark, f"{tmp_path}/manifest")
    ids = [r["id"] for r in archive.read_chunks(spark, manifests).collect()]
    assert len(ids) == len(set(ids)) == 9 and manifests.count() == 6 and s.read().count() == 3


def test_bad_chunks_are_rows_of_error(spark, tmp_path):
    import gzip

    import zstandard

    made = archive.write_chunks(_events(spark, 15), str(tmp_path / "chunks"), 1).drop("error").collect()
    places = sorted(r["s3_key"] for r in made)
    n = {r["s3_key"]: r["event_count"] for r in made}
    text = archive.unpacked(open(places[4], "rb").read()).decode()
    open(places[0], "wb").write(b"garbled")
    open(places[1], "wb").write(zstandard.ZstdCompressor().compress(b"x" * 5000))
    os.remove(places[2])
    open(places[3], "wb").write(zstandard.ZstdCompressor().compress(b'{"id":"only"}\n' * n[places[3]]))
    open(places[4], "wb").write(gzip.compress(text.encode()))  # older archives
    manifests = spark.createDataFrame(made, schema.MANIFEST)
    rows = archive.read_all(spark, manifests, most=4000).collect()
    errors_ = {r["archive_id"]: r["archive_error"] for r in rows if r["archive_error"]}
    by_place = {r["s3_key"]: errors_.get(r["archive_id"]) for r in made}
    assert all(by_place[p] for p in places[:4]) and not any(by_place[p] for p in places[4:])
    assert "4000 bytes" in by_place[places[1]] and "no event" in by_place[places[3]]
    assert sum(r["id"] is not None for r in rows) == sum(n[p] for p in places[4:]) == archive.read_chunks(spark, manifests, skip_bad=True).count()
    with pytest.raises(Exception, match="archive|chunk|zstd|No such|error"):
        archive.read_chunks(spark, manifests).collect()


def test_compaction_that_broke_off_is_finished(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path))
    for _ in range(2):
        s.append(_events(spark))
    tier, day = s.partitions()[0]
    path = f"{s.events_path}/tier={tier}/day={day}"
    n = spark.read.parquet(path).count()
    s.delete(spark.read.parquet(path).select("id").limit(1))
    left = s.read().count()
    settle, calls = store.Store._settle, []
    monkeypatch.setattr(store.Store, "_settle", lambda self, *a: settle(self, *a) if not calls.append(a) and len(calls) == 1 else None)
    s.compact(tier, day)  # written, but not put in place
    assert spark.read.parquet(path).count() == n
    monkeypatch.setattr(store.Store, "_settle", settle)
    s.compact(tier, day)
    assert spark.read.parquet(path).count() < n and s.read().count() == left
    sizes = {(r["tier"], r["day"]): r for r in s.tier_sizes().collect()}
    assert sizes.keys() == set(s.partitions()) and all(r["files"] and r["bytes"] for r in sizes.values())
    assert s.delete_older(1_700_000_000_000_000_000 + 30 * 86_400 * 10**9, 29) > 0 and {d for _, d in s.partitions()} == {"2023-11-15", "2023-11-16"}
    assert s.collect_all_garbage(1_700_000_000_000_000_000 + 30 * 86_400 * 10**9, 28) and {d for _, d in s.partitions()} == {"2023-11-16"}


def test_archives_are_reachable(spark, tmp_path):
    assert archive.reachable(spark, str(tmp_path / "none yet")) and not archive.reachable(spark, "no-such-scheme://place/x")


def test_manifest_overlap(spark):
    rows = spark.createDataFrame([("a", "u", 10, 20), ("b", "u", 30, 40), ("c", "w", 10, 20)], "archive_id string, user_id string, min_ts_ns long, max_ts_ns long")
    assert [r["archive_id"] for r in archive.overlapping(rows, "u", 15, 30).collect()] == ["a", "b"] and archive.overlapping(rows, "u", 21, 29).count() == 0


def test_config():
    c = config.load("default_tier = 'pro'\n[retention_days]\nfree = 7\n", {"METERLOOM_ARCHIVE_AFTER_DAYS": "5", "METERLOOM_RETENTION_DAYS__FREE": "9"})
    assert c.default_tier == "pro" and c.retention_days == {"free": 9} and c.archive_after_days == 5 and not c.warnings()
    assert config.Config().warnings()
    with pytest.raises(ValueError):
        config.load("nonsense = 1")


def _files_read(frame):
    """Files that the scans of a plan read, after it ran."""
    def scans(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return scans(plan.executedPlan())
        if kind.endswith("QueryStageExec"):
            return scans(plan.plan())
        own = plan.metrics().get("numFiles").get().value() if kind == "FileSourceScanExec" else 0
        return own + sum(scans(plan.children().apply(i)) for i in range(plan.children().size()))

    frame.collect()
    return scans(frame._jdf.queryExecution().executedPlan())


def test_newest_reads_as_few_days_as_it_takes(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    day, start = 86_400 * 10**9, 1_700_006_400 * 10**9
    rows = spark.range(3000).select(F.format_string("%05d", "id").alias("id"), (F.lit(start) + F.col("id") * (day // 100)).alias("ts_ns"), F.lit("free").alias("tier"), F.when(F.col("id") % 100 == 7, "rare").otherwise("often").alias("user_id"))
    s.append(rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.EVENT.fields)))

    def days(frame):
        return {f.split("/day=")[1][:10] for f in frame.inputFiles() if "/day=" in f}

    first = s.newest(limit=50)
    assert [r["id"] for r in first.collect()] == [f"{i:05d}" for i in range(2999, 2949, -1)] and len(days(first)) == 1
    assert len(days(s.newest(limit=150))) == 3  # one day, then two more
    assert len(days(s.newest(filters.EventFilter(user_id="rare"), 5))) == 7
    assert s.newest(filters.EventFilter(user_id="none"), 5).count() == 0 and s.newest(filters.EventFilter(tier="pro")).count() == 0
    old = s.newest(filters.EventFilter(from_ns=start + 3 * day, to_ns=start + 5 * day), 10)
    assert [r["id"] for r in old.collect()] == [f"{i:05d}" for i in range(500, 490, -1)] and len(days(old)) <= 3
    s.delete(spark.createDataFrame([("02999",)], "id string"))
    seen, cursor = [], None
    while page := s.newest(filters.EventFilter(user_id="rare"), 7, cursor).collect():
        seen += [r["id"] for r in page]
        cursor = (page[-1]["ts_ns"], page[-1]["id"])
    assert seen == [f"{i:05d}" for i in range(2907, 0, -100)]
    assert s.newest(limit=1).first()["id"] == "02998"


def test_quota_reads_only_the_edges(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    s.append(_events(spark, 30))
    cube, start, day = aggregates.rollup(s.read()), 1_700_000_000_000_000_000, 86_400 * 10**9
    for lo, hi in ((start, None), (start + 1, start + 3 * day), (0, start + 4 * day - 1), (start // day * day + day, start // day * day + 2 * day - 1), (start, start), (start + 5, start + 6)):
        got = aggregates.quota_from(cube, s.read(), "u1", from_ns=lo, to_ns=hi).first()
        want = filters.EventFilter(user_id="u1", from_ns=lo, to_ns=hi).apply(s.read()).agg(F.coalesce(F.sum("cost_nanodollars"), F.lit(0)), F.count("id")).first()
        assert tuple(got) == tuple(want), (lo, hi)
    written = spark.createDataFrame(cube.collect(), cube.schema)

    def files(lo, hi=None):
        return _files_read(aggregates.quota_from(written, s.read(), "u1", from_ns=lo, to_ns=hi))

    every = _files_read(s.read())
    assert every == 30 and files(start + 1, start + 3 * day) == 6 and files(start // day * day) == 0
    with pytest.raises(ValueError):
        aggregates.quota_from(cube, s.read())


def test_histograms_merge_and_keep_their_bound(spark):
    import random

    from meterloom.functions import histogram

    rng = random.Random(1)
    values = [(rng.choice("ab"), int(rng.expovariate(1) * 10 ** rng.randint(0, 9))) for _ in range(4000)] + [("a", None), ("a", -3), ("c", 2**62)]
    rows = spark.createDataFrame(values, "k string, v long").repartition(3)
    for bits in (3, 7):
        names = {r["v"]: r["b"] for r in rows.where("v >= 0").select("v", histogram.bucket(F.col("v"), bits).alias("b")).collect()}
        assert all(b <= v < b + max(b >> bits, 1) or b == v for v, b in names.items()) and all(b == v for v, b in names.items() if v < 2 ** (bits + 1))
        cut = max(v.bit_length() for v in names) - bits
        assert len(set(names.values())) <= 2**bits * (cut + 1)
    halves = histogram.counts(rows.where("v % 2 = 0"), ["k"], "v").unionByName(histogram.counts(rows.where("v % 2 != 0"), ["k"], "v"))
    got = {r["k"]: r for r in histogram.quantiles(halves, ["k"], {"p1": 0.01, "p50": 0.5, "p999": 0.999, "all": 1.0}).collect()}
    for k in "abc":
        own = sorted(max(v, 0) for x, v in values if x == k and v is not None)
        assert got[k]["n"] == len(own)
        for name, q in (("p1", 0.01), ("p50", 0.5), ("p999", 0.999), ("all", 1.0)):
            exact = own[max(math.ceil(q * len(own)), 1) - 1]
            assert got[k][name] <= exact <= got[k][name] * (1 + 2**-7)


def test_latency_percentiles_are_exact(spark):
    """Among more different numbers than a sketch keeps, dealt in no order; ranks that are whole, too."""
    for n in (400_001, 400_000):
        rows = spark.range(n).select((F.pmod(F.col("id") * 7919, F.lit(n)) * 1001 - 1000).alias("total_ms")).unionByName(spark.createDataFrame([(None,)], "total_ms long"))
        want = {name: (-(-n * q // 1000) - 1) * 1001 - 1000 for name, q in (("p50", 500), ("p95", 950), ("p99", 990), ("p999", 999))}
        assert aggregates.latency_percentiles(rows.repartition(16)).first().asDict() == want
    assert set(aggregates.latency_percentiles(rows.where("false")).first()) == {None}
