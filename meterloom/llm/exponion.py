"""Operator 13, product codes of vectors, with exponion search for the nearest entry.

A component becomes the integer ``floor(SCALE * x)``, a vector is cut into equal parts, and each part
is coded by the number of the nearest entry of its codebook. Codebooks start as the parts of the
vectors with the smallest keys; in each round all vectors are assigned and entries move to the floor of their means.

A search starts at the entry that the part had before, ``u`` away. An entry that is as near is at most ``2 u`` from
that entry (the triangle inequality; squared, ``4 u^2``), so of the entry's neighbours, sorted by their distance from
it once a codebook, only those inside this radius are looked at. Distances are squares of integers, and ties go to the
lower index, so codes are those of a full scan.

Spark holds the vectors: a round is one pass that writes the codes, and one that sums parts by
(part, entry, position), pre-aggregated in each task. Only the codebooks (``parts * entries`` entries) pass through the driver.

Defined results: rows are dropped whose vector is null, empty or holds a null or non-finite component, or one too large for
exact distances in 64 bits (for parts of 4 components, over 2 ** 19), and rows of another
length than the first kept key's. A length that the number of parts does not divide is filled
up with zeros. A null key is coded but starts no entry; repeated rows are coded each, and start an entry each; with fewer
rows than entries there are as many entries as rows, and without a key that is not null one entry of zeros; an
empty table gives an empty result. All other columns are kept.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


class Exponion:
    """Nearest entries of one codebook; ``entries`` are rows of int64."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        apart = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        self.near = np.argsort(apart, axis=1, kind="stable")
        self.apart = np.take_along_axis(apart, self.near, 1)

    def _from(self, rows: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((rows - self.entries[entry]) ** 2).sum(1)

    def nearest(self, rows: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(entry, squared distance) of each row from the entry that it had before, and how many distances that took."""
        best, least = before.copy(), self._from(rows, before)
        inside = np.zeros(len(rows), np.int64)  # neighbours within the radius
        for e in np.unique(before):
            own = before == e
            inside[own] = np.searchsorted(self.apart[e], 4 * least[own], side="right")
        by = np.argsort(-inside, kind="stable")
        ends = np.searchsorted(-inside[by], -np.arange(inside.max(initial=0)), side="left")  # rows with more than so many neighbours
        for nth, end in enumerate(ends):
            own = by[:end]
            entry = self.near[before[own], nth]
            far = self._from(rows[own], entry)
            better = (far < least[own]) | (far == least[own]) & (entry < best[own])
            best[own[better]], least[own[better]] = entry[better], far[better]
        return best, least, len(rows) + int(inside.sum())


def _largest(width: int) -> int:
    """Magnitude of integers up to which distances, radii and their sums over 16 parts fit 64 bits."""
    return math.isqrt(2**56 // max(1, width))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def whole(vectors: DataFrame, vector: str, parts: int, scale: int, row: list[str], key: str) -> tuple[DataFrame, np.ndarray, int]:
    """(``row`` and ``ints`` of the kept rows, parts of the first ``ENTRIES`` of them, width of a part)."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    rows = vectors.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(F.forall(x, _finite))
    scaled = F.transform(x, lambda c: F.floor(c * scale))
    rows = rows.select(F.struct(*row).alias("row"), F.col(key).alias("key"), F.transform(x, lambda c: c * scale).alias("real"), scaled.alias("ints"))
    first = rows.where("key IS NOT NULL").select("key", F.size("ints").alias("n")).orderBy("key", "n").first() or rows.select("key", F.size("ints").alias("n")).orderBy("n").first()
    n = first["n"] if first else parts
    width = -(-n // parts)
    most = float(_largest(width))
    rows = rows.where((F.size("ints") == n) & F.forall("real", lambda c: F.abs(c) <= most)).drop("real")
    if n % parts:
        rows = rows.withColumn("ints", F.concat("ints", F.array_repeat(F.lit(0).cast("long"), width * parts - n)))
    return rows, n, width


def _line(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def _assign(books: np.ndarray, final: bool):
    """A pass that gives each row its codes, from those it had."""
    parts, _, width = books.shape

    def run(batches):
        search = [Exponion(b) for b in books]
        for batch in batches:
            rows = _line(batch.column("ints"), parts * width)
            codes = batch.column("code").to_pylist() if "code" in batch.schema.names else None
            before = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, parts).astype(np.int64) if codes is not None else np.zeros((len(rows), parts), np.int64)
            error = np.zeros(len(rows), np.int64)
            out = np.empty((len(rows), parts), np.uint8)
            for p, s in enumerate(search):
                out[:, p], far, _ = s.nearest(rows[:, p * width : (p + 1) * width], before[:, p])
                error += far
            codes = pa.array([c.tobytes() for c in out], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("row"), codes, pa.array(error) if final else batch.column("ints")], ["row", "code", "error" if final else "ints"])

    return run


def _summed(parts: int, entries: int, width: int):
    """Sums of a task's parts: (slot, position, sum), the count at the position ``width``."""
    def run(batches):
        sums = np.zeros((parts * entries, width + 1), np.int64)
        for batch in batches:
            rows = _line(batch.column("ints"), parts * width).reshape(-1, parts, width)
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts).astype(np.int64)
            slots = (codes + entries * np.arange(parts)).ravel()
            np.add.at(sums, slots, np.concatenate([rows.reshape(-1, width), np.ones((len(slots), 1), np.int64)], 1))
        used = np.repeat(sums[:, width] > 0, width + 1)
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array((at // (width + 1)).astype(np.int32)), pa.array((at % (width + 1)).astype(np.int32)), pa.array(sums.ravel()[at])], ["slot", "position", "sum"])

    return run


def _moved(books: np.ndarray, coded: DataFrame) -> np.ndarray:
    parts, entries, width = books.shape
    found = coded.select("ints", "code").mapInArrow(_summed(parts, entries, width), "slot int, position int, sum long")
    found = found.groupBy("slot", "position").agg(F.sum(F.col("sum").cast("decimal(38,0)")).alias("sum")).collect()  # parts * entries * (width + 1) rows at most
    sums: dict[int, dict[int, int]] = {}
    for r in found:
        sums.setdefault(r["slot"], {})[r["position"]] = int(r["sum"])
    books = books.copy()
    for slot, own in sums.items():
        books[slot // entries, slot % entries] = [own[i] // own[width] for i in range(width)]
    return books


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(the kept rows without ``vector``, with ``code`` (a byte a part) and ``error``; the codebooks, part x entry x position)."""
    row = [c for c in vectors.columns if c != vector]
    rows, _, width = whole(vectors, vector, parts, scale, row, key)
    firsts = [r["ints"] for r in rows.where("key IS NOT NULL").orderBy("key", "ints").limit(entries).select("ints").collect()] or [[0] * (parts * width)]
    books = np.array(firsts, np.int64).reshape(-1, parts, width).transpose(1, 0, 2)
    coded, kind = rows.select("row", "ints"), rows.schema["row"].dataType.simpleString()
    for n in range(rounds):
        coded = written(coded.mapInArrow(_assign(books, False), f"row {kind}, code binary, ints array<long>"), f"codes-{n}")
        books = _moved(books, coded)
    done = coded.mapInArrow(_assign(books, True), f"row {kind}, code binary, error long")
    return done.select(*(F.col("row")[c].alias(c) for c in row), "code", "error"), books


def decoded(code: Column, books: np.ndarray, scale: int = SCALE) -> Column:
    """The vector that a code stands for: the middle of the cell of each component's integer."""
    book = F.array(*(F.array(*(F.array(*(F.lit((int(x) + 0.5) / scale) for x in e)) for e in part)) for part in books))
    at = lambda p: F.conv(F.hex(F.substring(code, p + 1, 1)), 16, 10).cast("int")
    return reduce(F.concat, [F.element_at(book[p], at(p) + 1) for p in range(len(books))])


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def query(spark, sf_dir: str) -> DataFrame:
    coded, books = compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))
    coded = written(coded, "codes")
    # every label has one sum; without the broadcast it is a shuffle, in which Spark splits hot labels
    sums = broadcast_if_small(written(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of"))
    rows = coded.join(sums, F.col("label").eqNullSafe(F.col("of")), "left")
    return rows.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle_sql() -> str:
    far = "list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i])))"
    assigned = f"SELECT uid, vec_id, label, p, q, min(struct_pack(d := {far}, e := e)) AS best FROM parts JOIN %s USING (p) GROUP BY ALL"
    rounds = "".join(f"""
coded{n} AS MATERIALIZED ({assigned % f"book{n}"}),
sums{n} AS (SELECT p, best.e AS e, i, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (SELECT p, best, unnest(q) AS x, unnest(range(len(q))) AS i FROM coded{n}) GROUP BY ALL),
means{n} AS (SELECT p, e, list(x ORDER BY i) AS m FROM sums{n} GROUP BY ALL),
book{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM book{n} LEFT JOIN means{n} USING (p, e)),""" for n in range(ROUNDS))
    return f"""
WITH kept AS (SELECT row_number() OVER () AS uid, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT uid, vec_id, label, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS q FROM kept, (SELECT unnest(range({PARTS})) AS p)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, q AS c FROM parts QUALIFY e < {ENTRIES}),{rounds}
coded AS MATERIALIZED ({assigned % f"book{ROUNDS}"}),
rows AS (SELECT uid, vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM coded GROUP BY ALL),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM rows, book"""
