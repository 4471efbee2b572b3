"""Product codes against full scans."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from meterloom.llm import exponion

SCHEMA = "vec_id long, embedding array<float>, label int, row string, code string, ints string"


def brute(rows, parts=16, entries=64, rounds=2):
    """((vec_id, code, error) of each kept row, codebooks)."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) and abs(x) < 2**19 for x in r[1])]
    keyed = sorted((r for r in kept if r[0] is not None), key=lambda r: (r[0], len(r[1])))
    if not kept:
        return [], None
    n = len((keyed or sorted(kept, key=lambda r: len(r[1])))[0][1])
    width = -(-n // parts)
    ints = [(r, [math.floor(256 * float(np.float32(x))) for x in r[1]] + [0] * (width * parts - n)) for r in kept if len(r[1]) == n]
    first = sorted((r[0], v) for r, v in ints if r[0] is not None)[:entries] or [(0, [0] * (width * parts))]
    books = [[v[p * width : (p + 1) * width] for _, v in first] for p in range(parts)]

    def nearest(book, q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), e) for e, c in enumerate(book))

    def coded():
        return [[nearest(books[p], v[p * width : (p + 1) * width]) for p in range(parts)] for _, v in ints]

    for _ in range(rounds):
        found = coded()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p * width : (p + 1) * width] for (_, v), c in zip(ints, found) if c[p][1] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    return sorted(((r[0], bytes(e for _, e in c), sum(d for d, _ in c)) for (r, _), c in zip(ints, coded())), key=repr), books


def made(seed, n, dims):
    rnd = random.Random(seed)
    rows = [(rnd.choice([i, i, 3, None]), [rnd.choice([0.0, 0.25, -0.5, rnd.gauss(0, 0.3)]) for _ in range(dims)], rnd.choice([1, 2, None]), "mine", "mine", "mine") for i in range(n)]
    odd = [(n + 1, None), (n + 2, [0.1] * (dims - 1) + [None]), (n + 3, [math.nan] * dims), (n + 4, [math.inf] + [0.0] * (dims - 1)), (n + 5, []), (n + 6, [0.5] * (dims + 1)), (n + 7, [1e30] * dims), (n + 8, [5000.5, -5000.25] + [0.0] * (dims - 2))]
    return rows + [(*r, 7, "", "", "") for r in odd] + rows[:4]


@pytest.mark.parametrize("n, dims", [(5, 32), (150, 32), (150, 16), (90, 20)])
def test_against_full_scans(spark, n, dims):
    rows = made(n, n, dims)
    coded, books = exponion.compress(spark.createDataFrame(rows, SCHEMA).repartition(3))
    want, entries = brute(rows)
    assert books.transpose(0, 1, 2).tolist() == entries
    # extra columns stay; one named like a result is the caller's to rename
    got = sorted(((r["vec_id"], bytes(r[coded.columns.index("code", coded.columns.index("ints"))]), r["error"]) for r in coded.collect()), key=repr)
    assert got == want


def test_search_is_exact_and_looks_at_less():
    rnd = np.random.default_rng(4)
    for width, spread in ((4, 12), (2, 3), (1, 2), (4, 300)):
        entries = rnd.integers(-spread, spread, (64, width))
        entries[10] = entries[50]
        rows = rnd.integers(-spread, spread, (2000, width))
        want = ((rows[:, None] - entries[None]) ** 2).sum(2)
        s = exponion.Exponion(entries)
        for before in (np.zeros(2000, np.int64), rnd.integers(0, 64, 2000), want.argmin(1)):
            best, least, looked = s.nearest(rows, before)
            assert (best == want.argmin(1)).all() and (least == want.min(1)).all()  # argmin takes the lower index
        assert spread != 300 or looked < 2000 * 40


def test_values_at_the_bound():
    most = exponion._largest(4)
    entries = np.array([[most] * 4, [-most] * 4, [most - 1] * 4])
    best, least, _ = exponion.Exponion(entries).nearest(np.array([[-most] * 4, [most] * 4]), np.array([0, 1]))
    assert best.tolist() == [1, 0] and least.tolist() == [0, 0] and most >= 2**19 * 256


def test_query_is_that_of_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{data}/embeddings.parquet'")
    assert sorted(map(tuple, exponion.query(spark, data).collect())) == sorted(con.execute(exponion.oracle_sql()).fetchall())


def test_query_on_odd_rows(spark, tmp_path):
    rows = made(2, 80, 32)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    want, books = brute(rows)
    got = exponion.query(spark, str(tmp_path)).collect()
    assert sorted(((r["vec_id"], r["code"], r["error"]) for r in got), key=repr) == sorted(((i, c.hex(), e) for i, c, e in want), key=repr)
    assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(x) for p in books for e in p for x in e).encode()).hexdigest()}
    sums: dict = {}
    labels = {r[0]: r[2] for r in rows if r[0] is not None}
    for r in got:
        sums.setdefault(r["label_error"], 0)
        sums[r["label_error"]] += r["error"]
    assert all(k == v for k, v in sums.items()) and len(sums) >= 3 and labels


def test_decoded_is_near(spark, data):
    from pyspark.sql import functions as F

    vectors = spark.read.parquet(f"{data}/embeddings.parquet")
    coded, books = exponion.compress(vectors)
    rows = coded.join(vectors.select("vec_id", "embedding"), "vec_id").select("error", "embedding", exponion.decoded(F.col("code"), books).alias("back")).collect()
    for r in rows:
        far = sum((256 * a - 256 * b) ** 2 for a, b in zip(r["embedding"], r["back"]))
        assert abs(math.sqrt(far) - math.sqrt(r["error"])) <= 0.5 * math.sqrt(len(r["back"])) + 1e-6
