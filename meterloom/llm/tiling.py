"""Operator 1, benchmark decontamination by greedy string tiling.

Texts are sequences of words in lower case. A document and a benchmark item become candidates by a
shared seed, ``LEAST`` words in a row. A candidate is tiled: running Karp-Rabin finds how long the longest common
stretch of unmarked words is, by halving the lengths that it may have, and all of that length are marked from the left; then come shorter ones, until no common
stretch of ``LEAST`` words is left unmarked. A round takes time that goes with document and item, whatever repeats in them, and tiles of one
length are of one round, so an item of n words has some 1.4 sqrt(n) rounds at most. Tiles do not overlap on either side and may come in any
order, so a passage that was cut up and reordered is still covered. The part of the item's words that
tiles cover is its coverage; from ``COVERAGE`` on the document holds the item.

The items go through the driver to the workers in slices of about ``SEEDS`` seeds, one at a time, each in a pass over the
documents; a pass shuffles nothing, and a document's result is made where the document is. A benchmark usually is one slice;
its size does not grow with the corpus.

Defined results: a null text is an empty one; an item without words is never found; an item of fewer
than ``LEAST`` words is found only as a whole; equal items are each found; repeated documents each get
their rows; an empty table of documents or items finds nothing.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

#: Words of the shortest tile and of a seed, and the least part of an item's words that tiles must cover.
LEAST, COVERAGE = 5, 0.5
#: Seeds of a slice of the benchmark.
SEEDS = 500_000

words = re.compile(r"\w+").findall
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def _runs(seq: list[int], free: bytearray, least: int) -> list[tuple[int, int]]:
    """Bounds of the runs of ``least`` or more unmarked words that the other side may have."""
    out, a = [], 0
    for b, x in enumerate([*seq, -1]):
        if x < 0 or not free[b]:
            if b - a >= least:
                out.append((a, b))
            a = b + 1
    return out


def _windows(seq: list[int], runs: list[tuple[int, int]], s: int):
    """(start, running hash) of every ``s`` words in the runs."""
    top = pow(_BASE, s, _MOD)
    for a, b in runs:
        h = 0
        for i in range(a, b):
            h = (h * _BASE + seq[i] + 1) % _MOD
            if i - a >= s:
                h = (h - (seq[i - s] + 1) * top) % _MOD
            if i - a >= s - 1:
                yield i - s + 1, h


def _longest(doc: list[int], item: list[int], in_doc: list[tuple[int, int]], in_item: list[tuple[int, int]], least: int, most: int) -> int:
    """Words of the longest common stretch of runs, 0 if none has ``least``. If there is one, there are shorter ones of each length."""
    def common(s: int) -> bool:
        starts = {h: i for i, h in _windows(item, in_item, s)}
        for d, h in _windows(doc, in_doc, s):
            i = starts.get(h)
            if i is not None and doc[d : d + s] == item[i : i + s]:
                return True
        return False

    lo, hi = least - 1, most
    while lo < hi:
        s = hi if hi == most and lo < least else (lo + hi + 1) // 2  # whole items are common
        if common(s):
            lo = s
        else:
            hi = s - 1
    return lo if lo >= least else 0


def _mark(doc: list[int], item: list[int], in_doc: list[tuple[int, int]], in_item: list[tuple[int, int]], s: int, free_doc: bytearray, free_item: bytearray) -> list[tuple[int, int, int]]:
    """Mark the common stretches of ``s`` words, the longest there are, from the left: (length, start, start)."""
    table, top, out = defaultdict(list), pow(_BASE, s, _MOD), []
    for i, h in _windows(item, in_item, s):
        table[h].append(i)
    for own in table.values():
        own.reverse()  # the leftmost is taken from the end
    for a, b in in_doc:
        d, h = a, None
        while d + s <= b and table:
            if h is None:
                h = 0
                for x in doc[d : d + s]:
                    h = (h * _BASE + x + 1) % _MOD
            own = table.get(h)
            while own and free_item.find(0, own[-1], own[-1] + s) >= 0:
                own.pop()  # marked since
            if own is not None and not own:
                del table[h]
            i = next((i for i in reversed(own or ()) if doc[d : d + s] == item[i : i + s] and free_item.find(0, i, i + s) < 0), None)
            if i is not None:
                out.append((s, d, i))
                free_doc[d : d + s] = free_item[i : i + s] = bytes(s)
                d, h = d + s, None
            else:
                if d + s < b:
                    h = (h * _BASE + doc[d + s] + 1 - (doc[d] + 1) * top) % _MOD
                d += 1
    return out


def tile(doc: list[int], item: list[int], least: int = LEAST) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of numbers (below 0: no word of the item): (length, start, start)."""
    free_doc, free_item = bytearray(b"\1" * (len(doc) + 1)), bytearray(b"\1" * (len(item) + 1))
    tiles, most = [], len(item)
    while True:
        in_doc, in_item = _runs(doc, free_doc, least), _runs(item, free_item, least)
        most = min([most, *(max((b - a for a, b in runs), default=0) for runs in (in_doc, in_item))])
        most = _longest(doc, item, in_doc, in_item, least, most)
        if not most:
            return tiles
        tiles += _mark(doc, item, in_doc, in_item, most, free_doc, free_item)


class Items:
    """A slice of the benchmark with its seeds; made once in each worker."""

    def __init__(self, items: list[tuple], least: int):
        self.least = least
        self.ids = [i for i, _ in items]
        split = [words((t or "").lower()) for _, t in items]
        self.vocabulary = {w: n for n, w in enumerate(dict.fromkeys(w for ws in split for w in ws))}
        self.words = [[self.vocabulary[w] for w in ws] for ws in split]
        self.at: dict[int, dict[int, list[int]]] = {}  # seed length, seed, items that have it
        for n, ws in enumerate(self.words):
            k = min(least, len(ws))
            for h in set(self._seeds(np.array(ws, np.int64), k)[1].tolist()) if k else ():
                self.at.setdefault(k, {}).setdefault(h, []).append(n)
        self.sorted = {k: np.array(sorted(v), np.uint64) for k, v in self.at.items()}

    @staticmethod
    def _seeds(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of ``k`` words in a row that the vocabulary knows, and their hashes."""
        n = len(ids) - k + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        gaps = np.concatenate(([0], np.cumsum(ids < 0)))
        starts = np.flatnonzero(gaps[k:] == gaps[:n])
        h = np.zeros(len(starts), np.uint64)
        for j in range(k):
            h = (h ^ (ids[starts + j] + 1).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        return starts, h

    def found(self, text: str | None) -> list[tuple]:
        """(item, covered words, words of the item, tiles) for every item that shares a seed with the text."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words((text or "").lower())], np.int64)
        candidates: dict[int, set[int]] = {}
        for k, known in self.sorted.items():
            starts, h = self._seeds(ids, k)
            at = np.searchsorted(known, h)
            at[at == len(known)] = 0
            hit = known[at] == h
            for d, x in zip(starts[hit].tolist(), h[hit].tolist()):
                for n in self.at[k][x]:
                    candidates.setdefault(n, set()).update(range(d, d + k))
        out = []
        for n, near in sorted(candidates.items()):
            # all stretches of the seed's length or more lie in its seeds; what is between them is left out
            places = sorted(near)
            doc, back = [], []
            for a, b in zip([-2, *places], places):
                if b != a + 1:
                    doc.append(-1)
                    back.append(-1)
                doc.append(int(ids[b]))
                back.append(b)
            tiles = [(back[d], i, m) for m, d, i in tile(doc, self.words[n], min(self.least, len(self.words[n])))]
            if tiles:
                out.append((self.ids[n], sum(m for _, _, m in tiles), len(self.words[n]), sorted(tiles)))
        return out


def _slices(benchmark: DataFrame, item: str, text: str, least: int, seeds: int):
    """The benchmark in slices of about ``seeds`` seeds, each a broadcast, made when it is asked for, with their number."""
    rows = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    total = rows.agg(F.sum(F.size(F.split("body", r"\W+")))).first()[0] or 0
    n = max(1, math.ceil(total / seeds))
    sc = benchmark.sparkSession.sparkContext
    for i in range(n):
        own = rows.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == i).collect()
        yield sc.broadcast(Items(sorted(((r["item"], r["body"]) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1])), least)), n


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text",
                 least: int = LEAST, coverage: float = COVERAGE, seeds: int = SEEDS) -> DataFrame:
    """``key, item_id, covered, n_words, coverage, tiles`` for every document and item with enough coverage.

    ``tiles`` has the first word in the document, the first word in the item and the length of each tile.
    """
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, item_id {benchmark.schema[item].dataType.simpleString()}, covered long, n_words long, coverage double, tiles array<struct<doc:int,item:int,words:int>>"
    tile_type = pa.list_(pa.struct([("doc", pa.int32()), ("item", pa.int32()), ("words", pa.int32())]))
    out = None
    for own, _ in _slices(benchmark, item, text, least, seeds):
        def run(batches, own=own):
            for batch in batches:
                for i in range(0, batch.num_rows, 1024):
                    part = batch.slice(i, 1024)
                    rows = [(k, *f) for k, t in zip(range(part.num_rows), part.column("body").to_pylist()) for f in own.value.found(t) if f[1] >= coverage * f[2]]
                    at, ids, covered, size, tiles = zip(*rows) if rows else ((),) * 5
                    yield pa.RecordBatch.from_arrays([
                        part.column("key").take(pa.array(at, pa.int64())), pa.array(ids, item_type), pa.array(covered, pa.int64()), pa.array(size, pa.int64()),
                        pa.array([c / n for c, n in zip(covered, size)], pa.float64()),
                        pa.array([[{"doc": d, "item": i, "words": m} for d, i, m in t] for t in tiles], tile_type),
                    ], [key, "item_id", "covered", "n_words", "coverage", "tiles"])

        item_type = pa.string() if benchmark.schema[item].dataType.simpleString() == "string" else pa.int64()
        found = docs.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", text: str = "text",
                  least: int = LEAST, coverage: float = COVERAGE, seeds: int = SEEDS) -> DataFrame:
    """``docs`` without the documents that hold an item; a filter, with no shuffle, written between slices if there are several."""
    for own, n in _slices(benchmark, item, text, least, seeds):
        def run(batches, own=own):
            for batch in batches:
                keep = [not any(f[1] >= coverage * f[2] for f in own.value.found(t)) for t in batch.column(text).to_pylist()]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if n > 1:  # a worker holds one slice at a time
            docs = written(docs, "decontaminated")
            own.unpersist()
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contaminated(documents(spark, sf_dir), benchmark)
