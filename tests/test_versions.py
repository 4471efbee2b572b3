"""Catalog versions: prices as of a time, refreshes that fail."""

import json
import random

import pytest
from pyspark.sql import functions as F

from meterloom.plans import examples, queries
from meterloom.sources import versions


def _json(**dollars):
    return json.dumps({k: {"input_cost_per_token": v} for k, v in dollars.items()})


def test_as_of_is_that_of_a_plain_search(spark):
    rng = random.Random(2)
    log = [(t, {m: rng.choice([1e-6, 2e-6, 3e-6]) for m in ("a", "b", "c-2024-01-01") if rng.random() < 0.7}) for t in range(0, 100, 10)]
    table = spark.createDataFrame([(t, _json(**v)) for t, v in log], "at_ns long, json string")
    events = [(i, rng.choice(["a", "B ", "c", "c-2024-01-01", "c-2024-02-02", "none", None]), rng.choice([-5, *range(0, 120, 5)])) for i in range(400)]
    got = {r["i"]: r["rate"] for r in versions.with_rates_as_of(spark.createDataFrame(events, "i int, model string, ts_ns long"), table).select("i", F.col("rates.input").alias("rate")).collect()}
    for i, model, at in events:
        now = next((v for t, v in reversed(log) if t <= at), {})
        name = (model or "").strip().lower()
        want = now.get(name, now.get("c-2024-01-01") if name.startswith("c") else None)
        assert got[i] == (None if want is None else round(want * 1e9)), (model, at)
    assert len(got) == 400


def test_stretches_join_versions_that_do_not_differ(spark):
    table = spark.createDataFrame([(t, _json(a=1e-6, b=t * 1e-6 + 1e-6)) for t in range(5)] + [(2, "[]")], "at_ns long, json string")
    rows = sorted((r["name"], r["from_ns"], r["to_ns"]) for r in versions.stretches(table).collect())
    assert rows == [("a", 0, versions.END), *(("b", t, t + 1) for t in range(4)), ("b", 4, versions.END)]


def test_a_failed_refresh_keeps_the_last_good_version(spark, tmp_path):
    log = versions.CatalogLog(spark, str(tmp_path / "catalog"))
    with pytest.raises(LookupError):
        log.current()
    assert log.refresh(lambda: _json(m=1e-6), 10**9)

    def gone():
        raise OSError("no answer")

    assert not log.refresh(gone, 2 * 10**9) and not log.refresh(lambda: "no json", 3 * 10**9) and not log.refresh(lambda: "{}", 4 * 10**9)
    assert [(r["model"], r["input"]) for r in log.current().collect()] == [("m", 1000)]
    assert log.status(61 * 10**9) == {"ok": 1, "failed": 3, "age_s": 60}
    assert log.refresh(lambda: _json(m=2e-6), 5 * 10**9) and log.current().first()["input"] == 2000
    assert [versions.next_refresh(0, 1000, lambda x=x: x) // 10**9 for x in (0, 0.5, 1)] == [900, 1000, 1100] and versions.next_refresh(0, 5) == 60 * 10**9


def test_query_changes_prices(spark, data):
    rows = queries.queries()["cost_as_of_versions"](spark, data)
    assert rows.where("canonical IS NULL").count() and rows.count() == spark.read.parquet(f"{data}/events.parquet").count()
    assert len({v for _, v in examples.VERSIONS}) == 3
