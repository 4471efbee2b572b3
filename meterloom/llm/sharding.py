"""Operator 8, sharding by a hierarchical weighted hash tree. DataFrame functions only.

A topology is a tree region > rack > shard with a weight on every shard; a node weighs what its
shards weigh. A row descends level by level: at each level every child draws ``-ln(u) / weight``
with ``u`` in (0, 1) hashed from the row's key and the child's path, and the smallest draw wins, so
a child gets rows in proportion to its weight. A draw depends on no other child. Changing a weight
therefore moves rows only into or out of the subtrees on the path of that weight, and a subtree that
is added beside the others (``grow``) takes rows only into itself, which is the law ``key``.

Defined results: a null key hashes as an absent value, so all null keys share one shard; a null text
counts 8 bytes with CRC-32 0; rows with equal keys share a shard and get slots of their own; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, shuffle_partitions, written

#: What a row costs in a shard's file besides its text.
ROW_OVERHEAD = 8


@dataclass(frozen=True)
class Node:
    """A leaf has a shard number and a weight of its own; an inner node has children."""

    name: str
    shard: int | None = None
    leaf_weight: float = 1.0
    children: tuple["Node", ...] = ()

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.leaf_weight

    @property
    def shards(self) -> list[int]:
        return [s for c in self.children for s in c.shards] if self.children else [self.shard]


def topology(regions: int = 2, racks: int = 3, shards: int = 4, weights: dict[int, float] | None = None) -> Node:
    """An even tree; shard numbers run from 0 in region, rack, shard order."""
    weights = weights or {}
    number = iter(range(regions * racks * shards))
    return Node("root", children=tuple(
        Node(f"region{r}", children=tuple(
            Node(f"rack{k}", children=tuple(
                Node(f"shard{(n := next(number))}", n, weights.get(n, 1.0)) for _ in range(shards)
            )) for k in range(racks)
        )) for r in range(regions)
    ))


def grow(tree: Node, weight: float = 1.0) -> Node:
    """One more shard, in a region of its own: the weights of the other regions stay as they are."""
    n, r = max(tree.shards) + 1, len(tree.children)
    new = Node(f"region{r}", children=(Node("rack0", children=(Node(f"shard{n}", n, weight),)),))
    return Node(tree.name, children=(*tree.children, new))


def _draw(key: Column, path: str, weight: float) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double") + F.lit(0.5)) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def _below(key: Column, path: str, node: Node, numbers: list[int]) -> Column:
    """The number of the child of ``node`` that wins the draw."""
    if len(node.children) == 1:
        return F.lit(numbers[0])
    draws = [F.struct(_draw(key, f"{path}/{c.name}", c.weight).alias("draw"), F.lit(n).alias("child")) for c, n in zip(node.children, numbers) if c.weight > 0]
    return F.array_min(F.array(*draws))["child"]


def with_shard(rows: DataFrame, key: str, tree: Node, into: str) -> DataFrame:
    """``rows`` with the shard number of ``key`` in the column ``into``; no row needs another row.

    One projection a level: the nodes of a level are numbered, and a row that stands at node i
    draws among the children of i only.
    """
    level, at = [(tree.name, tree)], None
    while any(node.children for _, node in level):
        below = [(f"{path}/{c.name}", c) for path, node in level for c in node.children or (node,)]
        steps, n = [], 0
        for path, node in level:
            numbers = list(range(n, n := n + len(node.children or (node,))))
            steps.append(_below(F.col(key), path, node, numbers) if node.children else F.lit(numbers[0]))
        pick = steps[0]
        if len(steps) > 1:
            pick = F.when(at == 0, steps[0])
            for i, step in enumerate(steps[1:], 1):
                pick = pick.when(at == i, step)
        rows, at, level = rows.withColumn(into, pick.cast("int")), F.col(into), below
    return rows.withColumn(into, F.element_at(F.array(*(F.lit(node.shard) for _, node in level)), at + 1))


def assign(docs: DataFrame, tree: Node, grown: Node | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs``.

    ``slot`` numbers a shard's rows from 0 in the order of a hash of the row. A shard is cut into
    hash ranges that are numbered on their own and moved up by the counts of the ranges before, so
    no task has to hold a whole shard.
    """
    spark = docs.sparkSession
    bits = max(4, math.ceil(math.log2(max(2, shuffle_partitions(spark)))))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    rows = with_shard(rows, "key", tree, "shard")
    rows = with_shard(rows, "key", grown, "grown_shard") if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    rows = rows.withColumn("at", F.xxhash64("key", "text_crc32", F.lit("slot"))).withColumn("stretch", F.shiftright("at", 64 - bits).cast("int"))
    rows = written(rows, "shards")
    counts = rows.groupBy("shard", "stretch").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "stretch", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = Window.partitionBy("shard", "stretch").orderBy("at", "key", "text_crc32", "size")
    numbered = rows.withColumn("row", F.row_number().over(own).cast("long") - 1)
    return numbered.join(starts, ["shard", "stretch"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("row")).alias("slot"), "grown_shard",
    )


def query(spark, sf_dir: str) -> DataFrame:
    tree = topology()
    return assign(documents(spark, sf_dir), tree, grow(tree))
