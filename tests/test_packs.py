"""Walks over packed rows decide like walks over rows, and give back every column as it was."""

import pyarrow as pa
from pyspark.sql import functions as F

from meterloom.sources.ingest import reasons
from meterloom.streaming import keyed, stateful

SCHEMA = "id string, k string, ts_ns long, wide struct<a: array<string>, b: map<string, double>>, day date, note string"


def test_a_key_goes_to_the_state_as_one_row():
    """Rows of few keys, in any order and over several batches, are one row a key; a large key is several packs, rows without a key go by their salt."""
    keys = ["x", "y", None, "x", "y", "x", None, "x", "x"]
    rows = pa.table({"id": [str(i) for i in range(9)], "k": keys, "ts_ns": list(range(9, 0, -1)), stateful.SALT: pa.array([0 if k else i for i, k in enumerate(keys)], pa.int64())})
    for most, sizes in ((100, [5, 2, 1, 1]), (2, [2, 2, 2, 1, 1, 1])):
        packs = pa.Table.from_batches(stateful.packing("k", "ts_ns", "id", most, 2**22, 1000, 2**26)(iter(rows.to_batches(max_chunksize=4)))).to_pylist()
        assert sorted((len(p[stateful.TIMES]) for p in packs), reverse=True) == sizes
        for p in packs:
            inner = pa.ipc.open_stream(p[stateful.PACK]).read_all()
            assert inner.column_names == ["id", "k", "ts_ns"] and set(inner["k"].to_pylist()) == {p["k"]}
            assert (inner["id"].to_pylist(), inner["ts_ns"].to_pylist()) == (p[stateful.IDS], p[stateful.TIMES])
        assert sorted(i for p in packs for i in p[stateful.IDS]) == [str(i) for i in range(9)]
    held = list(stateful.packing("k", "ts_ns", "id", 100, 2**22, 4, 2**26)(iter(rows.to_batches(max_chunksize=4))))
    assert sum(b.num_rows for b in held) == 7 and not list(stateful.packing("k", "ts_ns", "id", 9, 9, 9, 9)(iter([])))  # three times at most four rows are held


def test_packed_walks_decide_like_folds(spark, tmp_path, monkeypatch):
    """A key of many packs, of several batches that are held, is walked in the order of its times; wide columns come back as they were."""
    for name, n in (("PACK_ROWS", 7), ("HELD_ROWS", 50)):
        monkeypatch.setattr(stateful, name, n)
    rows = spark.range(600).selectExpr(
        "lpad(cast(id as string), 4, '0') id", "case when id % 5 = 0 then null when id % 2 = 0 then 'hot' else concat('é', id % 40) end k", "pmod(id * 7919, 601) * 1000000000 ts_ns",
        "case when id % 3 = 0 then null else named_struct('a', array('ü', null, cast(id as string)), 'b', map('p', id / 7)) end wide", "date_add(date'2024-01-01', cast(id % 30 as int)) day", "case when id % 4 = 0 then null else repeat('n', cast(id % 9 as int)) end note")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    rows = spark.read.schema(SCHEMA).parquet(f"{tmp_path}/in")
    walks = ((lambda r: stateful.first_seen(r, "k", ttl_s=20), lambda r: keyed.first_seen(r, "k", ttl_s=20)), (lambda r: stateful.token_bucket(r, 0.25, 2, "k"), lambda r: keyed.token_bucket(r, 0.25, 2.0, "k")))
    for n, (walk, fold) in enumerate(walks):
        with stateful.rocksdb(spark):
            query = walk(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")).writeStream.format("parquet").option("path", f"{tmp_path}/out{n}").option("checkpointLocation", f"{tmp_path}/check{n}").trigger(availableNow=True).start()
        query.awaitTermination()
        got, want = (sorted(map(repr, frame.collect())) for frame in (spark.read.parquet(f"{tmp_path}/out{n}"), fold(rows)))
        assert got == want and len(got) == 600


def test_rules_are_compiled(spark):
    """The JVM compiles no method of more than 8,000 bytes, and interprets it for every row."""
    found = reasons(spark.createDataFrame([("{}", 1)], "value string, at_ns long"), F.col("at_ns")).drop("event")
    stages = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenStringSeq(found._jdf.queryExecution().executedPlan())
    assert all(stages.apply(i)._3().maxMethodCodeSize() < 8_000 for i in range(stages.size()))


def test_the_last_time_of_all_has_no_future(spark):
    body = '{"model": "gpt-4o", "provider": "openai", "timestamp": 1700000000000000000}'
    lines = spark.createDataFrame([(body, 2**63 - 1), (body, 1_600_000_000 * 10**9)], "value string, at_ns long")
    assert [r["reason"] for r in reasons(lines, F.col("at_ns")).orderBy("at_ns").collect()] == ["timestamp is in the future", None]
