"""Operator 12, a Merkle manifest of a table, with authentication paths by fractal traversal.

A leaf is the SHA-256 of a row's fields. The leaves of a group, ascending by key, are joined in runs of
``FANOUT``, level by level, to the group's subroot, and the subroots, ascending by group, to the root. A path
has the siblings of each level from the leaf up; folding a leaf with it gives the root only if the leaf is the one of the manifest.

Leaves are numbered by ranges of (group, key) that are counted and sorted apart, so a group with a third of
all rows is many ranges. ``FANOUT ** HEIGHT`` leaves with aligned numbers are a block, a row of the written table of
blocks with its root. The levels above are built by grouping, a level a table, and each block gets its own path there by
joins. Paths of a block's leaves then come by fractal traversal: a level keeps the children of the node above the current leaf
(the existing subtree) and builds those of the next one (the desired subtree) by one leaf a round, so it keeps
``HEIGHT`` existing and desired subtrees of ``FANOUT`` digests, whatever the block; the block's path above is appended.

Defined results: a null field is ``-``; a null key comes first in its group and is never tampered with; a null group is one
of its own, before all others; rows with the same key are ordered by their leaves, and equal ones follow each
other, each with its own path; a table of one row is its own subroot and root, with an empty path; an
empty table gives an empty result. Columns that are no fields are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, shuffle_partitions, written

#: Nodes that are joined to one, and levels of a block.
FANOUT, HEIGHT = 16, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCK = "group string, block long, keys array<bigint>, leaves array<binary>, changed array<binary>, height int, root string"


def leaf(*fields: Column) -> Column:
    """Digest of a row: each field as the number of its bytes, a colon and itself, ``-`` if null."""
    texts = (f.cast("string") for f in fields)
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def tampered(key: Column, text: Column) -> Column:
    """``text`` in lower case where 5 divides the key's CRC-32."""
    return F.when(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


def group_code(group: Column) -> Column:
    """A string that is ordered as the group, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """``rows`` (written) with ``pos``, from 0 in each group, and ``of``, the rows of the group."""
    ranges = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), group, *order)
    ranges = written(ranges.withColumn("part", F.spark_partition_id()), "merkle-ranges")
    counts = ranges.groupBy("part", group).agg(F.count(F.lit(1)).alias("n"))
    along = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", group, F.coalesce(F.sum("n").over(along), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy(group)).alias("of"))
    starts = broadcast_if_small(written(starts, "merkle-starts"))
    nth = F.row_number().over(Window.partitionBy("part", group).orderBy(*order)) - 1
    return ranges.withColumn("nth", nth).join(starts, ["part", group]).withColumn("pos", F.col("start") + F.col("nth")).drop("part", "nth", "start")


def _joined(nodes: list[bytes]) -> list[bytes]:
    return [sha256(b"".join(nodes[i : i + FANOUT])).hexdigest().encode() for i in range(0, len(nodes), FANOUT)]


def height_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    height = 0
    while n > 1:
        n, height = -(-n // FANOUT), height + 1
    return height


def _block(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    height = min(HEIGHT, height_of(table.column("of")[0].as_py()))
    nodes = [d.hex().encode() for d in table.column("leaf").to_pylist()]
    for _ in range(height):
        nodes = _joined(nodes)
    lists = (pa.array([table.column(c).to_pylist()], pa.list_(t)) for c, t in (("key", pa.int64()), ("leaf", pa.binary()), ("changed", pa.binary())))
    return pa.Table.from_arrays([pa.array([key[0].as_py()]), pa.array([key[1].as_py()]), *lists, pa.array([height], pa.int32()), pa.array([nodes[0].decode()])], [f.split()[0] for f in BLOCK.split(", ")])


def upper(nodes: DataFrame, group: str) -> tuple[DataFrame, list[DataFrame]]:
    """(``group, root``, and a level a table with ``group, run, digests``) over ``nodes`` (written; ``group, pos, digest``).

    A group that is down to one node is in no further level.
    """
    runs, tops = [], []
    while True:
        many = nodes.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
        tops.append(nodes.join(broadcast_if_small(many.where("n = 1")), group, "left_semi").select(group, F.col("digest").alias("root")))
        nodes = nodes.join(broadcast_if_small(many.where("n > 1")), group, "left_semi")
        run = nodes.groupBy(group, F.floor(F.col("pos") / FANOUT).alias("run")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("own"))
        run = written(run.select(group, "run", F.col("own.digest").alias("digests")), f"merkle-level-{len(runs)}")
        if run.isEmpty():
            break
        runs.append(run)
        nodes = run.select(group, F.col("run").alias("pos"), F.sha2(F.concat_ws("", "digests"), 256).alias("digest"))
    top = tops[0]
    for t in tops[1:]:
        top = top.unionAll(t)
    return written(top, "merkle-tops"), runs


def with_path(rows: DataFrame, group: str, pos: str, runs: list[DataFrame], path: str) -> DataFrame:
    """``rows`` with the siblings on the way up from ``pos``: for each level the digests of the run and which of them is on the way."""
    rows, at = rows.withColumn(path, F.array().cast("array<struct<digests: array<string>, own: int>>")), F.col(pos)
    for n, run in enumerate(runs):
        own = run.select(F.col(group).alias("run_group"), F.col("run").alias("run_number"), "digests")
        up = F.floor(at / FANOUT ** (n + 1))
        rows = rows.join(broadcast_if_small(own, 20_000), (F.col(group) == F.col("run_group")) & (up == F.col("run_number")), "left")
        step = F.struct("digests", (F.floor(at / FANOUT**n) % FANOUT).cast("int").alias("own"))
        rows = rows.withColumn(path, F.when(F.col("digests").isNull(), F.col(path)).otherwise(F.concat(F.col(path), F.array(step)))).drop("run_group", "run_number", "digests")
    return rows


@dataclass(frozen=True)
class Manifest:
    """``blocks``: the written blocks with ``subroot`` and ``path``, what stands above them; ``root``: hex, empty for an empty table."""

    blocks: DataFrame
    root: str


def manifest(leaves: DataFrame) -> Manifest:
    """The tree over ``leaves``: ``group`` (not null), ``key`` (bigint), ``leaf`` and ``changed`` (binary; the leaf that is found now)."""
    rows = numbered(written(leaves, "merkle-leaves"), "group", "key", "leaf")
    blocks = rows.withColumn("block", F.floor(F.col("pos") / FANOUT**HEIGHT)).groupBy("group", "block").applyInArrow(_block, BLOCK)
    blocks = written(blocks, "merkle-blocks")
    subroots, runs = upper(blocks.select("group", F.col("block").alias("pos"), F.col("root").alias("digest")), "group")
    groups = numbered(subroots.withColumn("all", F.lit(0)), "all", "group").withColumnRenamed("root", "subroot")
    groups = written(groups, "merkle-groups")
    top, above = upper(groups.select("all", "pos", F.col("subroot").alias("digest")), "all")
    root = top.first()
    groups = with_path(groups, "all", "pos", above, "above").select("group", "subroot", "above")
    blocks = with_path(blocks, "group", "block", runs, "within").join(broadcast_if_small(written(groups, "merkle-paths"), 20_000), "group")
    return Manifest(blocks.withColumn("path", F.concat("within", "above")).drop("within", "above"), root["root"] if root else "")


class Desired:
    """The next subtree of a level, built by one leaf at a time: a stack that keeps less than a run for each level below."""

    def __init__(self, level: int):
        self.stack: list[list[bytes]] = [[] for _ in range(level + 1)]

    def add(self, node: bytes) -> None:
        for own in self.stack[:-1]:
            own.append(node)
            if len(own) < FANOUT:
                return
            node = _joined(own)[0]
            own.clear()
        self.stack[-1].append(node)

    def children(self) -> list[bytes]:
        """The nodes of the subtree's level; runs that are not full end here, as those are the last."""
        carried: list[bytes] = []
        for own in self.stack[:-1]:
            own += carried
            carried = _joined(own) if own else []
        return self.stack[-1] + carried


def traverse(leaves, height: int) -> Iterator[list[tuple[bytes, bytes]]]:
    """For each leaf of a block in turn, (what stands left of it, right of it) in the run of each level; ``leaves[i]`` is a hex digest."""
    n, existing, desired = len(leaves), [], []
    for level in range(height):
        first = Desired(level)
        for i in range(min(n, FANOUT ** (level + 1))):
            first.add(leaves[i])
        existing.append(first.children())
        desired.append(Desired(level))
    sides: list[tuple[bytes, bytes]] = [(b"", b"")] * height
    for i in range(n):
        for level in range(height):
            if i % FANOUT**level == 0:
                own = i // FANOUT**level % FANOUT
                sides[level] = b"".join(existing[level][:own]), b"".join(existing[level][own + 1 :])
        yield sides
        for level in range(height):
            width = FANOUT ** (level + 1)
            if i + width < n:
                desired[level].add(leaves[i + width])
            if (i + 1) % width == 0:
                existing[level], desired[level] = desired[level].children(), Desired(level)


class Hexed:
    """A list of digests whose items are read as hex."""

    def __init__(self, values: list[bytes]):
        self.values = values

    def __len__(self) -> int:
        return len(self.values)

    def __getitem__(self, i: int) -> bytes:
        return self.values[i].hex().encode()


def _paths(whole: bool):
    names = ["key", "leaf", "subroot", "proof_sha256", "folded_root"] + ["proof"] * whole

    def rows(block: dict) -> Iterator[tuple]:
        above = [(b"".join(d[:own]), b"".join(d[own + 1 :])) for d, own in (([x.encode() for x in p["digests"]], p["own"]) for p in block["path"])]
        tail = b"".join(a + b for a, b in above)
        leaves = Hexed(block["leaves"])
        for key, own, changed, sides in zip(block["keys"], leaves.values, block["changed"], traverse(leaves, block["height"])):
            node = changed.hex().encode()
            for left, right in (*sides, *above):
                node = sha256(left + node + right).hexdigest().encode()
            siblings = b"".join(a + b for a, b in sides) + tail
            proof = ([[{"left": a.decode(), "right": b.decode()} for a, b in (*sides, *above)]],) if whole else ()
            yield key, own.hex(), block["subroot"], sha256(siblings).hexdigest(), node.decode(), *(p[0] for p in proof)

    def run(batches):
        types = [pa.int64(), *[pa.string()] * 4] + [pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))] * whole
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(zip(*rows(batch.slice(i, 1).to_pylist()[0])))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(found, types)], names)

    return run


def authenticated(tree: Manifest, whole: bool = False) -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of every leaf.

    ``folded_root`` is what the row's leaf as it is now gives with the siblings of the manifest. With ``whole``,
    ``proof`` has them, level by level, as the digests left and right of the path.
    """
    kind = "key long, leaf string, subroot string, proof_sha256 string, folded_root string" + ", proof array<struct<left string, right string>>" * whole
    rows = tree.blocks.select("keys", "leaves", "changed", "height", "subroot", "path").mapInArrow(_paths(whole), kind)
    return rows.withColumns({"root": F.lit(tree.root), "verified": F.col("folded_root") == F.lit(tree.root)})


def leaves_of(docs: DataFrame, key: str = "doc_id", group: str = "source", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """Leaves of ``docs``, and those of its rows as tampered with."""
    now = [tampered(F.col(key), F.col(f)) if f == text else F.col(f) for f in fields]
    return docs.select(group_code(F.col(group)).alias("group"), F.col(key).cast("long").alias("key"), F.unhex(leaf(*map(F.col, fields))).alias("leaf"), F.unhex(leaf(*now)).alias("changed"))


def query(spark, sf_dir: str) -> DataFrame:
    done = authenticated(manifest(leaves_of(documents(spark, sf_dir))))
    return done.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def oracle_sql(levels: int = 6) -> str:
    """SQL for groups of at most ``FANOUT ** levels`` rows, and as many groups."""
    def fields(text: str) -> str:
        parts = [f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || CAST({f} AS VARCHAR), '-')" for f in (*FIELDS[:-1], text)]
        return f"sha256({' || '.join(parts)})"

    def tree(name: str, rows: str, g: str) -> str:
        out = [f"{name}0 AS MATERIALIZED (SELECT {g} AS g, pos, d, count(*) OVER (PARTITION BY {g}) AS n FROM {rows})"]
        for k in range(levels):
            run = f"list(d) OVER (PARTITION BY g, pos // {FANOUT} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
            out.append(f"{name}_sides{k} AS MATERIALIZED (SELECT g, pos, n, array_to_string(r[: pos % {FANOUT}], '') AS l, array_to_string(r[pos % {FANOUT} + 2 :], '') AS r FROM (SELECT *, {run} AS r FROM {name}{k}))")
            out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT g, pos, d, count(*) OVER (PARTITION BY g) AS n FROM (
  SELECT g, CASE WHEN n = 1 THEN 0 ELSE pos // {FANOUT} END AS pos, CASE WHEN n = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY pos)) END AS d FROM {name}{k} GROUP BY g, n, CASE WHEN n = 1 THEN 0 ELSE pos // {FANOUT} END))""")
        return ",\n".join(out)

    # the CRC-32 of a decimal number, bit by bit
    start = "list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)))"
    crc = f"xor(list_reduce({start}, lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
    steps, last = [], "start"
    for name, g, at in (("t", "g", "pos"), ("s", "'all'", "s_pos")):
        for k in range(levels):
            steps.append(f"""{name}_walk{k} AS MATERIALIZED (SELECT w.* EXCLUDE (proof, node), proof || CASE WHEN s.n = 1 THEN '' ELSE s.l || s.r END AS proof,
  CASE WHEN s.n = 1 THEN node ELSE sha256(s.l || node || s.r) END AS node FROM {last} w JOIN {name}_sides{k} s ON s.g = {"w.g" if name == "t" else g} AND s.pos = {"w.pos" if name == "t" else "w.s_pos"} // {FANOUT**k})""")
            last = f"{name}_walk{k}"
    return f"""
WITH docs AS (SELECT doc_id, coalesce('=' || source, '') AS g, {fields("text")} AS leaf,
  {fields("CASE WHEN " + crc + " % 5 = 0 THEN translate(text, '" + UPPER + "', '" + LOWER + "') ELSE text END")} AS changed FROM documents),
places AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS d FROM docs),
{tree("t", "places", "g")},
groups AS MATERIALIZED (SELECT g AS of, d, row_number() OVER (ORDER BY g) - 1 AS pos FROM t{levels}),
{tree("s", "groups", "'all'")},
start AS MATERIALIZED (SELECT p.doc_id, p.leaf, p.g, p.pos, q.d AS subroot, q.pos AS s_pos, '' AS proof, p.changed AS node FROM places p JOIN groups q ON p.g = q.of),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, (SELECT d FROM s{levels}) AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = (SELECT d FROM s{levels}) AS verified FROM {last}"""
