"""Operator 4, SimHash near-duplicates found with vantage-point trees.

A fingerprint has 64 bits; two documents are linked if theirs differ in at most ``LIMIT`` bits, and a
component is what links reach. Distances between unrelated fingerprints of 64 bits pile up around 32,
so a single tree over all bits can prune little. The bits are therefore cut into ``BLOCKS`` blocks,
and there is a vantage-point tree for every choice of ``KEPT`` of them, over the distance in those
bits alone: two fingerprints within ``LIMIT`` differ in at most ``radius`` bits in some choice (the
pigeonhole principle; 3 blocks, 1 kept and limit 4 give radius 1). A node of a tree has a vantage
point and a bound on the distance to it. A fingerprint is at home in one leaf; by the triangle inequality
it also visits a branch across the bound only if its distance is within the radius of it. The leaves are the shards,
and a second tree, made of those at home, divides a shard in the same way. At the end of both those at home are
compared in full with all that are there or visit, so every link is found. What a leaf gives is no pairs but stars, a
row for each fingerprint at most. Vantage points come from a sample of some ``SAMPLE`` fingerprints a shard; it decides
how even the shards are, never what is found. At the median a quarter to a third of a tree's fingerprints lie within the radius of
the bound, so they are in about 1.3 ** levels shards, and in as many more leaves.

Copies are folded into one fingerprint before any search. Components are found by large-star and
small-star rounds over DataFrames, each with a checkpoint; hubs, and fingerprints that many rows share, are joined by broadcasts of bounded size.

Defined results: a null or empty text has fingerprint zero, linked like any other; repeated rows are
linked; a component is named by its smallest key, null where all its keys are null; an empty table
gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, documents, hex16, joined, written

WORDS, SEED, LIMIT = 4, 42, 4
BLOCKS, KEPT = 3, 1
#: Fingerprints at home in a shard that the trees aim at, the most levels (for 10**9 fingerprints), the sample for a shard, and fingerprints of the last leaf.
LEAF, DEPTH, SAMPLE, LAST = 4096, 18, 16, 32


# fingerprints


def fingerprints_of(texts: list, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """SimHash of each text as uint64: XXH64 of every shingle, repeats included; a bit wins with over half."""
    from xxhash import xxh64_intdigest as xxh

    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    rows: list[int] = []
    starts: list[int] = []

    def flush():
        if rows:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
            sizes = np.diff([*starts, len(hashes)])
            out[rows] = np.packbits(2 * votes > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
        for kept in (hashes, rows, starts):
            kept.clear()

    for row, text in enumerate(texts):
        found = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
        if not found:
            continue
        rows.append(row)
        starts.append(len(hashes))
        line = b" ".join(found)
        ends = np.cumsum([len(w) + 1 for w in found]) - 1
        begins = [0, *(ends[:-1] + 1).tolist()]
        n = max(1, len(found) - words + 1)
        hashes += [xxh(line[a:b], seed) for a, b in zip(begins[:n], ends[-n:].tolist())]
        if len(hashes) > 50_000:
            flush()
    flush()
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", into: str = "fp", words: int = WORDS) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a bigint with the same bits."""
    names = docs.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{into}` bigint"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                fp = fingerprints_of(part.column(text).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(fp.view(np.int64))], [*names, into])

    return docs.mapInArrow(run, schema)


# trees


def radius(limit: int, blocks: int, kept: int) -> int:
    """The most bits in which the best ``kept`` of ``blocks`` blocks can differ when ``limit`` bits differ in all."""
    each, more = divmod(limit, blocks)
    return kept * each + max(0, kept - (blocks - more))


def masks(blocks: int = BLOCKS, kept: int = KEPT) -> list[int]:
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(own, kept)]


class Tree:
    """A vantage-point tree over masked fingerprints, in arrays; node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, sample: np.ndarray, mask: int, depth: int, seed: int):
        self.mask, self.depth = np.uint64(mask), depth
        self.vantage = np.zeros(2**depth - 1, np.uint64)
        self.bound = np.full(2**depth - 1, 64, np.int16)  # a node without sample sends all to its left
        rng = np.random.default_rng(seed)
        parts = {0: sample & self.mask}
        for node in range(2**depth - 1):
            own = parts.pop(node, np.empty(0, np.uint64))
            if len(own) < 2:
                continue
            point = own[rng.integers(len(own))]
            d = np.bitwise_count(own ^ point)
            # of the two bounds next to the median, the one that halves better
            at = int(np.median(d))
            bound = min((at - 1, at), key=lambda b: abs(2 * int((d <= b).sum()) - len(d)))
            self.vantage[node], self.bound[node] = point, bound
            parts[2 * node + 1], parts[2 * node + 2] = own[d <= bound], own[d > bound]

    def leaves(self, fps: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """(index into ``fps``, leaf) for every leaf that can hold a point within ``reach``."""
        own, at, node = fps & self.mask, np.arange(len(fps)), np.zeros(len(fps), np.int64)
        for _ in range(self.depth):
            d = np.bitwise_count(own[at] ^ self.vantage[node]).astype(np.int16)
            left, right = d - reach <= self.bound[node], d + reach > self.bound[node]
            at, node = np.concatenate((at[left], at[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return at, node


def links(home: np.ndarray, guests: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect each of ``home`` with all of both within ``limit``, as stars: at most one for each fingerprint."""
    both = np.concatenate((home, guests))
    step = max(1, (1 << 20) // max(1, len(both)))
    alone = np.concatenate([(np.bitwise_count(home[i : i + step, None] ^ both) <= limit).sum(1) == 1 for i in range(0, len(home), step)] or [np.zeros(0, bool)])
    home, a, b = home[~alone], [], []
    while len(home):  # a component at a time; what has been reached is not compared again
        root, front, seen, home = home[0], home[:1], guests[:0], home[1:]
        while len(front) or len(seen):
            near, met = np.zeros(len(home), bool), np.zeros(len(guests), bool)
            for x in front:
                near |= np.bitwise_count(home ^ x) <= limit
                met |= np.bitwise_count(guests ^ x) <= limit
            for x in seen if len(home) else ():
                near |= np.bitwise_count(home ^ x) <= limit
            front, home, seen, guests = home[near], home[~near], guests[met], guests[~met]
            a += [front, seen]
            b.append(np.full(len(front) + len(seen), root))
    return np.concatenate(a or [both[:0]]), np.concatenate(b or [both[:0]])


def shard_links(home: np.ndarray, guests: np.ndarray, mask: int, reach: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a shard, found in the leaves of a tree of those at home."""
    depth = int(np.ceil(np.log2(max(1, len(home) / LAST))))
    tree = Tree(home, mask, depth, 0)
    at, leaf = tree.leaves(home, 0)
    all_ = np.concatenate((home, guests))
    there, visited = tree.leaves(all_, reach)
    own = leaf[np.argsort(at)]  # where each at home is
    other = (there >= len(home)) | (visited != own[np.minimum(there, len(home) - 1)])
    there, visited = there[other], visited[other]
    at, there = at[np.argsort(leaf, kind="stable")], there[np.argsort(visited, kind="stable")]
    leaf, visited = np.sort(leaf), np.sort(visited)
    out = []
    for x in np.unique(leaf):
        (i, j), (k, m) = np.searchsorted(leaf, (x, x + 1)), np.searchsorted(visited, (x, x + 1))
        out.append(links(home[at[i:j]], all_[there[k:m]], limit))
    return tuple(np.concatenate([o[n] for o in out] or [home[:0]]) for n in (0, 1))


def near_pairs(fps: DataFrame, limit: int = LIMIT, blocks: int = BLOCKS, kept: int = KEPT) -> DataFrame:
    """Links ``(a, b)`` that connect the distinct fingerprints in the column ``fp`` (written, without repeats)."""
    reach, count = radius(limit, blocks, kept), fps.count()
    depth = int(min(DEPTH, max(0, np.ceil(np.log2(max(1, count) / LEAF)))))
    share = SAMPLE * 2**depth / max(1, count)
    sample = fps.where(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1, share) * (1 << 30))).select("fp").toArrow()
    sample = np.sort(sample.column("fp").to_numpy().view(np.uint64))
    forest = [Tree(sample, mask, depth, seed) for seed, mask in enumerate(masks(blocks, kept))]
    shared = fps.sparkSession.sparkContext.broadcast(forest)

    def route(batches):
        for batch in batches:
            own = batch.column("fp").to_numpy().view(np.uint64)
            for t, tree in enumerate(shared.value):
                at, leaf = tree.leaves(own, 0)
                own_leaf = leaf[np.argsort(at)]
                there, visited = tree.leaves(own, reach)
                guest = visited != own_leaf[there]
                at, leaf, home = np.concatenate((at, there[guest])), np.concatenate((leaf, visited[guest])), np.arange(len(at) + guest.sum()) < len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(leaf.astype(np.int32)), pa.array(own[at].view(np.int64)), pa.array(home)], ["tree", "leaf", "fp", "home"])

    def compare(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        own, home = shard["fp"].to_numpy().view(np.uint64), shard["home"].to_numpy()
        a, b = shard_links(own[home], own[~home], masks(blocks, kept)[key[0]], reach, limit)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    shards = fps.select("fp").mapInArrow(route, "tree int, leaf int, fp bigint, home boolean")
    return shards.groupBy("tree", "leaf").applyInPandas(compare, "a bigint, b bigint")


def components(pairs: DataFrame) -> DataFrame:
    """``(node, root)`` for all ends of ``pairs`` (a, b) but the roots: the smallest node reached.

    Large-star and small-star rounds until nothing changes. Only minima are gathered for a node,
    never its neighbours, and hubs take them by a broadcast, so a hub is no large group.
    """
    def flat(df):
        return df.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()

    def mark(df):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())

    def least(df):  # the smallest neighbour of each node
        return written(df.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")), "least")

    edges = checkpoint(flat(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    before = mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        own = least(both).withColumn("m", F.least("u", "m"))
        large = checkpoint(flat(joined(both.where("v > u"), own, "u", before[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))))
        # a node's smaller neighbours and itself go to the smallest of them
        small = joined(large, least(large), "u", before[0]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = checkpoint(flat(small.select("e.u", "e.v")))
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def rooted(rows: DataFrame, first: Column, limit: int = LIMIT) -> DataFrame:
    """``(fp, first, n, root)`` for every fingerprint of ``rows`` (written): the smallest ``first``, its rows, and the fingerprint that its component is known by."""
    fps = written(rows.groupBy("fp").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "fingerprints")
    roots = components(near_pairs(fps, limit))
    return fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))


def with_component(rows: DataFrame, key: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """``rows`` (``key``, ``fp``; written) with ``component_id``."""
    found = written(rooted(rows, F.col(key), limit), "rooted")
    names = written(found.groupBy("root").agg(F.min("first").alias("component_id"), F.count(F.lit(1)).alias("n")), "components")
    ids = written(joined(found.select("fp", "root", F.col("n").alias("rows")), names, "root", found.count()).select("fp", "component_id", F.col("rows").alias("n")), "ids")
    return joined(rows, ids, "fp", rows.count())


def query(spark, sf_dir: str) -> DataFrame:
    rows = written(with_fingerprint(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "fp"), "simhash")
    return with_component(rows).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component of ``docs``: one of the smallest key (null only where all are), of its texts the one with the smallest hash, and any one of its repeats."""
    names = docs.columns
    rows = docs.select(F.struct(*names).alias("row"))
    rows = rows.select(F.col(f"row.{key}").alias("key"), F.xxhash64(F.coalesce(f"row.{text}", F.lit(""))).alias("print"), "row")
    marks = with_fingerprint(rows.select("key", "print", F.col(f"row.{text}").alias("body")), "body").select("key", "print", "fp")
    marks = written(marks, "simhash")
    # a key can be null or stand in several components, so one row is chosen for each root; rows with a key come first
    first = F.struct(F.col("key").isNull().alias("none"), F.col("key").alias("k"), F.col("print").alias("p"))
    kept = rooted(marks, first).groupBy("root").agg(F.min("first").alias("first")).select("first.k", "first.p")
    kept = rows.join(kept, F.col("key").eqNullSafe(F.col("k")) & (F.col("print") == F.col("p")), "left_semi")
    return kept.dropDuplicates(["key", "print"]).select(*(F.col(f"row.{c}").alias(c) for c in names))
