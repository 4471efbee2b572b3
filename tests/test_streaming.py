"""Streams give what batches give; folds over a key match a plain loop."""

import json
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from meterloom.operators import aggregates, archive, filters
from meterloom.plans import examples, queries
from meterloom.streaming import keyed, metrics, stateful
from meterloom.streaming.calls import Limits, stream_calls
from meterloom.streaming.ingest import Sink, stream_ingest


def test_token_bucket(spark):
    calls = spark.createDataFrame([(str(i), "k", int(t * 1e9)) for i, t in enumerate((0, 0.1, 0.2, 1.5))] + [("x", None, 0), ("y", None, 0)], "id string, api_key_id string, ts_ns long")
    got = {r["id"]: r for r in keyed.token_bucket(calls, rps=1, burst=2).collect()}
    assert [got[i]["admitted"] for i in "0123xy"] == [True, True, False, True, True, True] and abs(got["2"]["wait_s"] - 0.8) < 1e-9


def test_replays(spark):
    rows = spark.createDataFrame([(str(i), "k", t * 10**9) for i, t in enumerate((0, 100, 299, 300, 350, 601))] + [("x", None, 5)], "id string, idempotency_key string, ts_ns long")
    got = {r["id"]: r["accepted"] for r in keyed.first_seen(rows, ttl_s=300).collect()}
    assert [got[i] for i in "012345x"] == [True, False, False, True, False, True, True]


def test_rollup_of_a_stream_is_the_same_twice(spark, data):
    first, second = ({tuple(r) for r in queries.queries()["stream_rollup_available_now"](spark, data).collect()} for _ in range(2))
    assert first == second


def test_rows_without_a_key_are_not_shuffled(spark):
    calls = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit(None).cast("string").alias("api_key_id"), F.col("id").alias("ts_ns"))
    got = keyed.token_bucket(calls, rps=1, burst=1)
    assert got.where("admitted and wait_s = 0").count() == 1000 and got.columns == ["id", "api_key_id", "ts_ns", "admitted", "wait_s"]


def test_stream_ingest_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    late = {"model": "gpt-4o", "provider": "openai", "timestamp": "2020-02-02T00:00:00Z", "usage": {"input_tokens": 1}}
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(p for p in examples.PAYLOADS if "\n" not in p))
    sink = Sink(spark, str(tmp_path / "out"))

    def go():
        stream_ingest(spark, str(tmp_path / "in"), sink, lambda: queries.example_catalog(spark), str(tmp_path / "check")).awaitTermination()

    go()
    n = sink.events().count()
    (tmp_path / "in" / "b.jsonl").write_text(json.dumps(late))
    go()
    assert sink.events().count() == n + 1 and sink.rejects().count() == len(examples.PAYLOADS) - n
    cube = sink.rollup()
    assert {tuple(r) for r in cube.collect()} == {tuple(r) for r in aggregates.rollup(sink.events()).select(*cube.columns).collect()}
    assert cube.agg(F.sum("event_count")).first()[0] == n + 1


def test_full_sink_ends_the_stream_and_loses_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sink, full = (Sink(spark, str(tmp_path / "out"), most) for most in (None, 1))

    def go(sink, name):
        line = {"model": "gpt-4o", "provider": "openai", "timestamp": "2024-02-02T00:00:00Z", "usage": {"input_tokens": 1}}
        (tmp_path / "in" / name).write_text(json.dumps(line))
        stream_ingest(spark, str(tmp_path / "in"), sink, lambda: queries.example_catalog(spark), str(tmp_path / "check")).awaitTermination()

    go(full, "a.jsonl")
    with pytest.raises(StreamingQueryException, match="1 bytes or more"):
        go(full, "b.jsonl")
    assert sink.events().count() == 1
    go(sink, "c.jsonl")
    assert sink.events().count() == 3 and sink.events().select("id").distinct().count() == 3


def test_calls_are_let_in_as_one_after_the_other(spark, tmp_path):
    """Keys, buckets and replays over several micro-batches, one of them run again, as in a plain loop over all calls."""
    (tmp_path / "in").mkdir()
    sink, rng, at = Sink(spark, str(tmp_path / "out")), random.Random(5), 1_700_000_000 * 10**9
    keys = {"t1": "alpha", "t2": "beta"}
    limits, tokens, seen, want = Limits(rps=0.5, burst=3, ttl_s=20), {}, {}, []
    table = spark.createDataFrame([(t, k, "pro", i) for i, (t, k) in enumerate(keys.items())], "token string, key_id string, tier string, position int")

    def go():
        stream_calls(spark, str(tmp_path / "in"), sink, lambda: queries.example_catalog(spark), str(tmp_path / "check"), lambda: table, limits).awaitTermination()

    for batch in range(3):
        lines = []
        for _ in range(40):
            at += rng.choice([1, 300, 2000]) * 10**6
            n, token, idem, model = len(want), rng.choice(["t1", "t1", "t2", "nobody", None]), rng.choice(["a", "b", "c", None]), rng.choice(["gpt-4o", "gpt-4o", ""])
            lines.append(json.dumps({"token": token, "idempotency_key": idem, "at_ns": at, "body": json.dumps({"model": model, "provider": "openai", "user_id": str(n)})}))
            key, reason = keys.get(token), None
            if key:
                had, last = tokens.get(key, (3.0, at))
                had = min(3.0, had + (at - last) / 1e9 * 0.5)
                tokens[key] = (had - 1 if had >= 1 else had, at)
                reason = None if had >= 1 else "rate limited"
            else:
                reason = "unauthorized"
            reason = reason or (None if model else "model is required")
            if not reason and idem:
                if idem in seen and at - seen[idem] < 20 * 10**9:
                    reason = "replayed"
                else:
                    seen[idem] = at
            want.append((str(n), key, reason))
        (tmp_path / "in" / f"{batch}.jsonl").write_text("\n".join(lines))
        go()
        if batch == 1:  # as if the commit had been lost: the micro-batch comes again
            for name in ("1", ".1.crc"):
                (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
            go()
    got = [(r["user_id"], r["api_key_id"], None) for r in sink.events().collect()]
    got += [(json.loads(r["value"])["user_id"], r["key_id"], r["reason"]) for r in sink.rejects().collect()]
    assert sorted(got, key=lambda r: int(r[0])) == want
    assert {r for _, _, r in want} == {None, "unauthorized", "rate limited", "model is required", "replayed"}
    assert {r["tier"] for r in sink.events().select("tier").distinct().collect()} == {"pro"}
    before = {tuple(r) for r in sink.rollup().collect()}
    assert sink.compact_rollup() == 1 and {tuple(r) for r in sink.rollup().collect()} == before and sink.compact_rollup() == 1
    assert sink.rollup().agg(F.sum("event_count")).first()[0] == sum(r is None for _, _, r in want)


def _walk(spark, tmp_path, walk, batches, schema):
    """Rows out of a stateful walk that starts anew for each batch of rows, and the rows of its states after each."""
    states, reader = [], spark.readStream.schema(schema)
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        with stateful.rocksdb(spark):
            query = walk(reader.parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        operators = query.lastProgress["stateOperators"]
        assert all(o["numRowsDroppedByWatermark"] == 0 for o in operators)
        states.append({r["key"]["k"] for r in spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "check")).collect()})
    return spark.read.parquet(str(tmp_path / "out")).collect(), states


def test_fourths_are_written_by_all_tasks(spark, data, tmp_path, monkeypatch):
    """Whatever files the events are in, a micro-batch is a fourth of them and the rows are the same."""
    monkeypatch.setattr(queries, "_folder", lambda spark, name: f"{tmp_path}/{name}")
    spark.read.parquet(f"{data}/events.parquet").repartition(4, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in queries.queries()["stream_first_seen_state"](spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in queries.queries()["idempotent_first_seen"](spark, data).collect()}
    parts = [list((tmp_path / "walk" / "in" / f"part={n}").glob("*.parquet")) for n in range(4)]
    assert all(len(p) > 1 for p in parts) and sorted(p.name for p in (tmp_path / "walk" / "checkpoint" / "commits").iterdir() if not p.name.startswith(".")) == list("0123")


def test_a_key_asks_its_state_once():
    """A key whose rows change nothing is one call to the state store, a new one three."""
    from pyspark.sql import Row

    class Handle(list):
        def getValueState(self, *_):
            return self

        def __getattr__(self, name):
            return lambda *x: self.append((name, *x))

        value = None

        def exists(self):
            self.append(("exists",))
            return self.value is not None

        def get(self):
            self.append(("get",))
            return self.value

    rows = [Row(id=str(i), k="x", ts_ns=i * 10**9, **{stateful.SALT: 0}) for i in (3, 1, 2)]
    for value, calls in ((None, [("get",), ("registerTimer", 11_000), ("update", (10**9, 11_000))]), ((0, 10_000), [("get",)])):
        walk, handle = stateful.Replays("ts_ns", "id", 10 * 10**9), Handle()
        handle.value = value
        walk.init(handle)
        got = list(walk.handleInputRows(("x", 0), iter(rows), None))
        assert [r.asDict() for r in got] == [{"id": str(i), "k": "x", "ts_ns": i * 10**9, "accepted": value is None and i == 1} for i in (1, 2, 3)]
        assert list(handle) == calls


def test_state_ends_with_its_time(spark, tmp_path):
    schema, second = "id string, k string, ts_ns long", 10**9
    batches = [[("a", "x", 0), ("b", "x", 5 * second), ("c", "y", 9 * second), ("n", None, 0)], [("d", "x", 11 * second), ("e", "z", 100 * second)], [("f", "z", 105 * second), ("g", "late", 2 * second), ("h", "x", 112 * second)]]
    rows, states = _walk(spark, tmp_path, lambda r: stateful.first_seen(r, "k", ttl_s=10, lateness="1 second"), batches, schema)
    assert {r["id"]: r["accepted"] for r in rows} == dict(a=True, b=False, c=True, n=True, d=True, e=True, f=False, g=True, h=True)
    # the watermark of a micro-batch is that of the one before: x and y end when z has moved it
    assert states[0] == {"x", "y"} and states[1] == {"x", "y", "z"} and states[2] == {"x", "z"}  # what comes late is over at once


def test_buckets_that_are_full_have_no_state(spark, tmp_path):
    schema, second = "id string, k string, ts_ns long", 10**9
    batches = [[("a", "x", 0), ("b", "x", 1)], [("c", "y", 60 * second)], [("d", "y", 61 * second), ("e", "x", 62 * second), ("f", "x", 62 * second)]]
    rows, states = _walk(spark, tmp_path, lambda r: stateful.token_bucket(r, rps=1, burst=1, key="k", lateness="1 second"), batches, schema)
    assert {r["id"]: r["admitted"] for r in rows} == dict(a=True, b=False, c=True, d=True, e=True, f=False)
    assert states[0] == {"x"} and states[1] == {"x", "y"} and states[2] == {"x", "y"}


def test_refused_lines_are_kept_as_they_came(spark, tmp_path):
    (tmp_path / "in").mkdir()
    body = json.dumps({"model": "gpt-4o", "provider": "openai"})
    lines = ["no json at all", json.dumps({"body": body}), json.dumps({"body": body, "at_ns": "soon"}), json.dumps({"at_ns": 1_700_000_000 * 10**9, "body": body}), json.dumps({"at_ns": 1_700_000_000 * 10**9}), "[1]"]
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(lines))
    sink = Sink(spark, str(tmp_path / "out"))
    stream_calls(spark, str(tmp_path / "in"), sink, lambda: queries.example_catalog(spark), str(tmp_path / "check")).awaitTermination()
    assert {(r["line"], r["reason"]) for r in sink.rejects().collect()} == {(lines[0], "malformed call"), (lines[1], "malformed call"), (lines[2], "malformed call"), (lines[4], "malformed"), (lines[5], "malformed call")}
    assert [r["ts_ns"] for r in sink.events().collect()] == [1_700_000_000 * 10**9]


def test_a_sink_is_a_store(spark, tmp_path):
    """What a stream wrote is listed, deleted, archived and dropped like the rest, and its rollup follows."""
    (tmp_path / "in").mkdir()
    sink, start, day = Sink(spark, str(tmp_path / "out")), 1_700_000_000, 86_400

    def lines(name, seconds):
        rows = [{"model": "gpt-4o", "provider": "openai", "user_id": f"u{i % 2}", "timestamp": (start + s) * 10**9, "usage": {"input_tokens": 100 + i}, "latency": {"total_ms": 1000 + i}} for i, s in enumerate(seconds)]
        (tmp_path / "in" / name).write_text("\n".join(json.dumps(r) for r in rows))
        stream_ingest(spark, str(tmp_path / "in"), sink, lambda: queries.example_catalog(spark), str(tmp_path / "check")).awaitTermination()

    def rebuilt():
        cube = sink.rollup()
        return {tuple(r) for r in cube.collect()} == {tuple(r) for r in aggregates.rollup(sink.events()).select(*cube.columns).collect()}

    lines("a.jsonl", [0, 1, day, 2 * day])
    lines("b.jsonl", [5, day + 5, 3 * day])
    s, days = sink.store, [filters.day_of((start + i * day) * 10**9) for i in range(4)]
    assert s.partitions() == [("free", d) for d in days] and rebuilt()
    assert sum(r["files"] for r in s.tier_sizes().collect()) >= 6
    gone = s.newest(limit=2)
    assert s.delete(gone.select("id")) == {"asked": 2, "deleted": 2} and sink.events().count() == 5 and rebuilt()
    assert s.delete(gone.select("id"))["deleted"] == 0 and s.erase_user("u1") == 2 and {r["user_id"] for r in sink.events().collect()} == {"u0"} and rebuilt()
    assert sink.quota("u1").first().asDict() == {"cost_nanodollars": 0, "event_count": 0} and sink.quota("u0", from_ns=(start + 1) * 10**9).first()["event_count"] == 2
    assert sink.latency(["provider"], {"p100": 1.0}).first()["n"] == 7
    before = {tuple(r) for r in sink.rollup().collect()}
    assert archive.due(s, (start + day) * 10**9) and archive.archive(s, f"{tmp_path}/chunks", f"{tmp_path}/manifest", (start + 10) * 10**9, 1)["archived"] == 2
    assert {tuple(r) for r in sink.rollup().collect()} == before and sink.events().count() == 1  # archived events stay counted
    assert s.delete_older((start + 10 * day) * 10**9, 9) >= 2 and {d for _, d in s.partitions()} == set(days[1:])
    assert s.collect_garbage((start + 30 * day) * 10**9, {"free": 7}) and sink.events().count() == 0
    lines("c.jsonl", [4 * day])
    assert sink.events().count() == 1 and s.partitions() == [("free", filters.day_of((start + 4 * day) * 10**9))]
    s.append(sink.events().drop("day").withColumn("id", F.concat("id", F.lit("x"))))  # both kinds in one store
    assert s.read().count() == 2 and s.newest(limit=5).count() == 2


def test_figures_are_those_of_what_was_written(spark, tmp_path):
    (tmp_path / "in").mkdir()
    sink, watch = Sink(spark, str(tmp_path / "out")), metrics.Watch()
    spark.streams.addListener(watch)
    try:
        for name in ("a", "b"):
            (tmp_path / "in" / f"{name}.jsonl").write_text("\n".join(p for p in examples.PAYLOADS if "\n" not in p))
            stream_ingest(spark, str(tmp_path / "in"), sink, lambda: queries.example_catalog(spark), str(tmp_path / "check")).awaitTermination()
    finally:
        spark.streams.removeListener(watch)
    rows = sink.metrics().orderBy("batch").collect()
    events, rejects = sink.events().collect(), sink.rejects().collect()
    assert [r["batch"] for r in rows] == [0, 1] and sum(r["stored"] for r in rows) == len(events) and sum(r["rejected"] for r in rows) == len(rejects)
    assert sum(r["cost_nanodollars"] for r in rows) == sum(e["cost_nanodollars"] for e in events) and sum(r["errors"] for r in rows) == sum(e["is_error"] for e in events)
    assert all(r["stored_by_tier"] == {"free": r["stored"]} and r["event_bytes"] > 0 for r in rows)
    reasons: dict = {}
    for r in rows:
        for k, n in r["rejected_by_reason"].items():
            reasons[k] = reasons.get(k, 0) + n
    assert reasons == {k: sum(x["reason"] == k for x in rejects) for k in {x["reason"] for x in rejects}} and "other" not in reasons
    sink.sample(5)
    sink.store.collect_all_garbage(10**9 * 86_400 * 40_000, 1)
    sink.sample(6)
    samples = {r["at_ns"]: r for r in sink.samples().collect()}
    assert samples.keys() == {5} and samples[5]["tier"] == "free" and samples[5]["files"] > 0 and samples[5]["bytes"] > 0
    assert sum(r["rows"] for r in watch.reports) % (2 * sum("\n" not in p for p in examples.PAYLOADS)) == 0 and not watch.failed  # a row counts each time it is read
