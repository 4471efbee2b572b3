"""Removal of repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import pytest

from meterloom.llm import superkmer

SCHEMA = "doc_id long, text string, key string, row string, ranges string"


def brute(rows, k=13):
    """(doc_id, words, removed, kept) of each row."""
    words = [(i, (x or "").split() if i is not None else []) for i, x, *_ in rows]
    first: dict = {}
    for i, ws in words:
        for at in range(len(ws) - k + 1):
            w = tuple(ws[at : at + k])
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, ws), (_, x, *_) in zip(words, rows):
        gone = {p for at in range(len(ws) - k + 1) if first[tuple(ws[at : at + k])] < i for p in range(at, at + k)}
        ws = (x or "").split()
        out.append((i, len(ws), len(gone), " ".join(w for p, w in enumerate(ws) if p not in gone)))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in frame.collect()), key=repr)


def made(seed, n=60, hot=True):
    rnd = random.Random(seed)
    passage = [f"hot{i}" for i in range(30)]
    rows = []
    for i in range(n):
        ws = [rnd.choice("abc") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 60))]
        if hot and i % 3 == 0:
            at = rnd.randint(0, len(ws))
            ws[at:at] = passage
        rows.append((rnd.choice([i, i // 2, 7, None]), rnd.choice([" ", "\n\t", "  "]).join(ws), "mine", "mine", "mine"))
    return rows + [(3, None, "", "", ""), (4, "", "", "", ""), (5, " \n ", "", "", ""), (6, "x " * 900, "", "", ""), (9, "x " * 700, "", "", ""), *rows[:5]]


@pytest.mark.parametrize("k, m", [(13, 3), (4, 1), (5, 5), (2, 2), (1, 1)])
def test_against_brute_force(spark, k, m):
    rows = made(k)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(superkmer.dedup(docs, k=k, m=m)) == brute(rows, k)


def test_weak_hashes_and_split_bins_change_nothing(spark, monkeypatch):
    rows = made(1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert rows_of(superkmer.dedup(docs, mask=3)) == brute(rows)  # four values for all windows: bytes tell them apart
    monkeypatch.setattr(superkmer, "LEAST", 1)
    monkeypatch.setattr(superkmer, "HEAVY", 0.5)
    assert rows_of(superkmer.dedup(docs, bin_bytes=64)) == brute(rows)
    bins = superkmer.Bins(4, superkmer.np.array([1] * 15 + [500]))
    assert bins.parts[15] > 1 and not bins.parts[:15].any()


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(superkmer, "PIECE", 20)
    monkeypatch.setattr(superkmer, "CHUNK", 100)
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("ab") for _ in range(n)) for n in (500, 3, 33, 0)]
    batch = superkmer.pa.table({"key": [2, 1, 0, 3], "text": texts}).to_batches()[0]
    got = []
    for text, rows, first in superkmer._chunks(batch, 5):
        w = superkmer.Windows(text, 5, 2)
        for f in w.first.tolist():
            own = int(w.text_of[f])
            start = f - int(superkmer.np.searchsorted(w.text_of, own)) + int(first[own])
            assert text[w.starts[f] : w.ends[f + 4]].decode().split() == texts[rows[own]].split()[start : start + 5]
            got.append((int(rows[own]), start))
    assert Counter(got) == Counter((i, at) for i, x in enumerate(texts) for at in range(len(x.split()) - 4))


def test_equal_windows_have_equal_minimisers():
    text = b"a b c d e f g\nx a b c d e f g\na b c d e f g y"
    w = superkmer.Windows(text, 7, 3)
    same = [i for i, f in enumerate(w.first) if text[w.starts[f] : w.ends[f + 6]] == b"a b c d e f g"]
    assert len(same) == 3 and len({int(w.least[i]) for i in same}) == len({int(w.hashes[i]) for i in same}) == 1 < len(set(w.hashes.tolist()))


def test_counts_are_exact(spark):
    rows = [r for r in made(5) if r[0] is not None]
    want: Counter = Counter()
    first: dict = {}
    for i, x, *_ in rows:
        ws = (x or "").split()
        for at in range(len(ws) - 12):
            w = " ".join(ws[at : at + 13])
            want[w] += 1
            first[w] = min(first.get(w, i), i)
    got = {r["window"]: (r["n"], r["first_key"]) for r in superkmer.window_counts(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()}
    assert got == {w: (n, first[w]) for w, n in want.items() if n > 1} and got


def test_query_is_that_of_sql(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    assert sorted(map(tuple, superkmer.query(spark, data).collect())) == sorted(con.execute(superkmer.oracle_sql()).fetchall())


def test_odd_rows_have_their_values(spark, odd, odd_rows=None):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = rows_of(superkmer.dedup(odd))
    assert got == brute(rows)
    assert {c for c in odd.columns if c != "text"} < set(superkmer.dedup(odd).columns)
    assert hashlib.sha256(b"").hexdigest() in {r["kept_sha256"] for r in superkmer.dedup(odd).selectExpr("sha2(kept, 256) AS kept_sha256").collect()}


def test_hashes_do_not_depend_on_what_is_around(monkeypatch):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.choice([1, 2, 40, 90]))) for _ in range(400)]
    text = " ".join(words).encode()
    monkeypatch.setattr(superkmer, "LONG", 64)
    whole = superkmer.Windows(text, 5, 2)
    monkeypatch.setattr(superkmer, "STEP", 100)
    assert (superkmer.Windows(text, 5, 2).hashes == whole.hashes).all()
    for at in (0, 57, 200):
        part = superkmer.Windows(" ".join(words[at : at + 30]).encode(), 5, 2)
        assert part.hashes.tolist() == whole.hashes[at : at + 26].tolist() and part.least.tolist() == whole.least[at : at + 26].tolist()
