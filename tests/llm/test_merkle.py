"""The Merkle manifest against a tree built leaf by leaf."""

import hashlib
import random
import zlib

import duckdb
import pytest

from meterloom.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def levels(nodes):
    """All levels of the tree over ``nodes``, leaves first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def way(tree, at):
    """(left, right) on the way up from the leaf at ``at``."""
    for level in tree[:-1]:
        run = level[at // 16 * 16 : at // 16 * 16 + 16]
        yield run[: at % 16], run[at % 16 + 1 :]
        at //= 16


def brute(rows):
    """``rows``: (doc_id, source, lang, n_chars, text)."""
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = levels([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for nth, g in enumerate(order):
        for at, (_, _, own, row) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            i, text = row[0], row[4]
            if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node, path = leaf((*row[:4], text)), [*way(trees[g], at), *way(top, nth)]
            for left, right in path:
                node = h(*left, node, *right)
            out.append((i, own, trees[g][-1][0], root, h(*(x for a, b in path for x in (*a, *b))), node, node == root))
    return sorted(out, key=repr)


def found(spark, rows, partitions=3):
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(partitions).selectExpr("*", "'mine' AS leaf", "'mine' AS pos", "'mine' AS `group`")
    got = merkle.authenticated(merkle.manifest(merkle.leaves_of(docs)))
    return sorted((tuple(r[c] for c in ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 17, 300])
def test_against_brute_force(spark, n):
    rnd = random.Random(n)
    rows = [(rnd.choice([i, i, 5, None]), rnd.choice(["a", "é", "", None, f"s{i % 40}"]), rnd.choice(["en", None]), rnd.choice([i, None]), rnd.choice([None, "", "Some TEXT ÄÖ", f"Doc {i} A"])) for i in range(n)]
    rows += rows[:3]
    assert found(spark, rows) == brute(rows)


def test_blocks_and_what_is_above(spark):
    rows = [(i, "hot" if i % 20 else "cold", "en", 1, f"Text {i % 97}") for i in range(9_500)] + [(10_000 + i, f"g{i:03}", None, None, None) for i in range(30)]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 16, 17, 255, 257, 300, 4096])
def test_traversal(n):
    leaves = [h(str(i)) for i in range(n)]
    for height in {merkle.height_of(n), 3}:
        tree = levels(leaves)
        while len(tree) <= height:  # the last block of a large group has all its levels
            tree.append([h(*tree[-1][i : i + 16]) for i in range(0, len(tree[-1]), 16)])
        got = merkle.traverse([x.encode() for x in leaves], height)
        for at, sides in enumerate(got):
            assert sides == [("".join(a).encode(), "".join(b).encode()) for a, b in way(tree[: height + 1], at)]
        assert at == n - 1


def test_desired_subtrees_are_small():
    desired = merkle.Desired(2)
    for i in range(4096):
        desired.add(h(str(i)).encode())
        assert sum(map(len, desired.stack)) <= 3 * 16
    assert [x.decode() for x in desired.children()] == levels([h(str(i)) for i in range(4096)])[2]


def test_whole_proofs_fold_to_the_root(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    tree = merkle.manifest(merkle.leaves_of(docs))
    for r in merkle.authenticated(tree, whole=True).collect():
        node = r["leaf"]
        for side in r["proof"]:
            node = h(side["left"], node, side["right"])
        assert node == tree.root


def test_query_is_that_of_sql_and_of_brute_force(spark, data):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{data}/documents.parquet'")
    got = sorted(map(tuple, merkle.query(spark, data).collect()))
    assert got == sorted(con.execute(merkle.oracle_sql()).fetchall())
    assert sorted(got, key=repr) == brute(con.execute("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall())


def test_odd_rows_have_their_values(spark, odd):
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in odd.collect()]
    want = brute([(r[0], r[1], r[2], r[3], r[4]) for r in rows])
    got = merkle.authenticated(merkle.manifest(merkle.leaves_of(odd))).collect()
    assert sorted((tuple(r[c] for c in ("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got), key=repr) == want
