"""Operator 5, language-model scores by prediction by partial matching over bytes.

Training documents give counts of every context of ``ORDER`` bytes with the byte that follows (or the
end of the text). A shorter context counts a byte once for each next longer context that has seen it
(update exclusion: what a longer context predicts is not counted again). Together they are the nodes
of a trie that reads a context from its last byte backwards. At a node the model predicts by method D: a byte seen c
times of n has (c - 1/2) / n, and the escape to the next shorter context has half the number of
distinct bytes over n. Bytes that a longer context has seen are excluded from the shorter ones. What
no context has seen shares what is left evenly. The score of a text is the sum of log10 probabilities
of its bytes and its end, with A-Z in lower case as everywhere in this operator.

The trie is a table of nodes. The bytes seen in a context have all been seen in its suffix too, so a
node needs only its own counts and how much of its suffix's counts they exclude (``covered``). Documents are scored in one pass:
the ``HEAD_CODES`` most frequent pairs of context and byte go to the workers with their logarithms, some 12
bytes each, and any other pair is met by a join with the trie, for which each task sends on what it has not
found, once for each document and pair. The joins go level by level over distinct pairs, at most 257
of which share a key. Word counts for the base score go the same way, with the ``HEAD`` most frequent words.
No result depends on these two bounds.

Defined results: a null or empty text is its end alone; repeated rows are counted and scored each; a
null key counts as the empty text in the choice of held-out rows; without training documents every
byte is even and no token known; an empty table gives an empty result. A long text is read in windows
of ``WINDOW`` bytes.
"""

from __future__ import annotations

import functools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, written

ORDER = 5
#: Pairs of context and byte, and words, that go to the workers.
HEAD_CODES, HEAD = 4_000_000, 200_000
#: Distinct words or contexts that a task gathers before it passes them on, and positions that it looks at together.
GATHERED, WINDOW = 500_000, 400_000
END = 256  # the symbol after the last byte
FOLDS, HELD_OUT = 7, 2


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _bytes(text) -> bytes:
    return (text or "").encode().lower()  # of bytes: A-Z alone


# counting


def _codes(pieces: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Context and symbol of every position as one number, and where each piece starts.

    A piece has ``ORDER`` bytes of context before its positions; the last position of one that ends a text is ``END``.
    """
    raw = np.frombuffer(b"".join(p for p, _ in pieces), np.uint8)
    lengths = np.array([len(p) - ORDER for p, _ in pieces])
    starts = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat((np.arange(len(pieces)) + 1) * ORDER, lengths)
    symbol = raw[at].astype(np.int64)
    symbol[(starts + lengths - 1)[[end for _, end in pieces]]] = END
    context = np.zeros(len(at), np.int64)
    for k in range(ORDER, 0, -1):
        context = (context << 8) | raw[at - k]
    return (context << 9) | symbol, starts


def _windows(texts: list[bytes], size: int = WINDOW):
    """(codes, starts, numbers of the texts) of all positions, ``size`` at most at a time. Before a text are zero bytes."""
    pieces: list = []
    rows: list[int] = []
    room = size
    for row, t in enumerate(texts):
        whole, end = bytes(ORDER) + t + b"\0", len(t) + 1
        for a in range(0, end, size):
            b = min(end, a + size)
            if b - a > room:
                yield *_codes(pieces), np.array(rows)
                pieces, rows, room = [], [], size
            pieces.append((whole[a : b + ORDER], b == end))
            rows.append(row)
            room -= b - a
    if pieces:
        yield *_codes(pieces), np.array(rows)


def _parts(batches, column: str, size: int = 1_000_000):
    """Texts of the batches in lists of about ``size`` bytes, with the part of the batch."""
    for batch in batches:
        texts = [_bytes(t) for t in batch.column(column).to_pylist()]
        i = 0
        while i < len(texts):
            j, n = i + 1, len(texts[i])
            while j < len(texts) and n + len(texts[j]) <= size:
                n += len(texts[j])
                j += 1
            yield batch.slice(i, j - i), texts[i:j]
            i = j


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (its bytes) and ``n`` over all rows of ``docs``."""
    def count(batches):
        known: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(known.keys(), pa.binary()), pa.array(known.values(), pa.int64())], ["word", "n"])

        for _, texts in _parts(batches, "body"):
            for t in texts:
                known.update(t.split())
            if len(known) > GATHERED:
                yield out()
                known = Counter()
        yield out()

    rows = docs.select(F.col(text).alias("body")).mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def context_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``code`` (context << 9 | symbol) and ``n`` over all positions of ``docs``."""
    def count(batches):
        codes, counts, size = [], [], 0

        def merged():
            all_codes, at = np.unique(np.concatenate(codes), return_inverse=True)
            return all_codes, np.bincount(at, np.concatenate(counts)).astype(np.int64)

        for _, texts in _parts(batches, "body"):
            for own, _, _ in _windows(texts):
                c, n = np.unique(own, return_counts=True)
                codes.append(c)
                counts.append(n)
                size += len(c)
                if size > 4 * GATHERED:
                    c, n = merged()
                    codes, counts, size = [c], [n], len(c)
                    if size > 2 * GATHERED:
                        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["code", "n"])
                        codes, counts, size = [], [], 0
        if codes:
            c, n = merged()
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(n)], ["code", "n"])

    rows = docs.select(F.col(text).alias("body")).mapInArrow(count, "code long, n long")
    return rows.groupBy("code").agg(F.sum("n").alias("n"))


# the trie


def _cut(code: Column, k: int) -> Column:
    """The pair with the last ``k`` bytes of context."""
    return code.bitwiseAND((1 << (8 * k + 9)) - 1)


def _context(code: Column) -> Column:
    return F.shiftright(code, 9)


def trie(counts: DataFrame) -> list[DataFrame]:
    """The nodes of each order: ``context, total, distinct, covered`` and ``symbols``, those seen with their counts.

    ``counts`` has ``code`` and ``n`` of the full order. ``covered`` is what the next shorter context counts for the same symbols.
    A context has at most 257 symbols and 256 longer contexts, so no key of these shuffles is hot.
    """
    levels: list[DataFrame] = []
    for k in range(ORDER, -1, -1):
        if k < ORDER:
            counts = written(counts.groupBy(_cut(F.col("code"), k).alias("code")).agg(F.count(F.lit(1)).alias("n")), f"order{k}")
        levels.insert(0, counts.groupBy(_context(F.col("code")).alias("context")).agg(
            F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"),
            F.collect_list(F.struct(F.col("code").bitwiseAND(511).cast("int").alias("symbol"), F.col("n").alias("n"))).alias("symbols")))
    out = [levels[0].withColumn("covered", F.lit(0).cast("long"))]
    for k in range(1, ORDER + 1):
        shorter = levels[k - 1].select(F.col("context").alias("suffix"), F.col("symbols").alias("all"))
        own = levels[k].withColumn("suffix", F.col("context").bitwiseAND((1 << 8 * (k - 1)) - 1)).join(shorter, "suffix")
        mine = F.transform("symbols", lambda s: s["symbol"])
        covered = F.aggregate(F.filter("all", lambda s: F.array_contains(mine, s["symbol"])), F.lit(0).cast("long"), lambda n, s: n + s["n"])
        out.append(own.select("context", "total", "distinct", "symbols", covered.alias("covered")))
    return [written(nodes, f"trie{k}") for k, nodes in enumerate(out)]


def _hit(n: Column, total: Column) -> Column:
    return F.log10(n - F.lit(0.5)) - F.log10(total)


def _missed(distinct: Column, total: Column) -> Column:
    return F.log10(distinct) - F.log10(F.lit(2) * total)


def logs_of(codes: DataFrame, nodes: list[DataFrame]) -> DataFrame:
    """``code, log`` of pairs of the full order (``codes``, each once and written), seen in training or not.

    From the shortest context up: ``below`` is the logarithm of what follows when the context of a
    row has not seen the symbol, with what that context has seen excluded.
    """
    before = None
    for k, node in enumerate(nodes):
        rows = codes if k == ORDER else codes.select(_cut(F.col("code"), k).alias("code")).distinct()
        symbol = F.col("code").bitwiseAND(511)
        n = F.get(F.filter("symbols", lambda s: s["symbol"] == symbol), 0)["n"]
        rows = rows.withColumn("context", _context(F.col("code"))).join(node, "context", "left").select("code", "total", "distinct", "covered", n.alias("n"))
        if before is None:
            rows = rows.withColumn("below", -F.log10(F.lit(257) - F.coalesce("distinct", F.lit(0))))
        else:
            shorter = before.select(*(F.col(c).alias(f"shorter_{c}") for c in before.columns))
            rows = rows.join(shorter, _cut(F.col("code"), k - 1) == F.col("shorter_code"))
            total = F.col("shorter_total") - F.coalesce("covered", F.lit(0))
            open_ = F.col("shorter_distinct") - F.coalesce("distinct", F.lit(0))
            below = F.when(F.col("shorter_n").isNotNull(), _hit(F.col("shorter_n"), total)).when(open_ > 0, _missed(open_, total) + F.col("shorter_below"))
            rows = rows.select("code", "total", "distinct", "n", F.coalesce(below, "shorter_below").alias("below"))
        before = written(rows.select("code", "total", "distinct", "n", "below"), f"escapes{k}")
    at = F.when(F.col("n").isNotNull(), _hit(F.col("n"), F.col("total"))).when(F.col("total").isNotNull(), _missed(F.col("distinct"), F.col("total")) + F.col("below")).otherwise(F.col("below"))
    return before.select("code", at.alias("log"))


# what goes to the workers


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` (written) from a least ``n`` on, the smallest that leaves no more than ``most``; ``n`` is told apart by sixteenths of a power of two."""
    step = F.floor(F.log2("n") * 16)
    least, room = None, most
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect(), reverse=True):  # at most 1,008 steps
        room -= r["rows"]
        if room < 0:
            break
        least = r["step"]
    return counts.where(F.lit(False) if least is None else step >= least)


class Head:
    """Logarithms of codes in a table with open places; it looks up many at a time."""

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.bits = max(4, (2 * len(codes)).bit_length())
        self.codes, self.logs = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.float32)
        left, at = np.arange(len(codes)), self._place(codes)
        while len(left):
            free = self.codes[at] < 0
            self.codes[at[free]] = codes[left[free]]  # of those that meet in a place one gets it
            got = self.codes[at] == codes[left]
            self.logs[at[got]] = logs[left[got]]
            left, at = left[~got], self._next(at[~got])

    def _place(self, codes: np.ndarray) -> np.ndarray:
        return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The logarithms, 0 for the unknown, and the places of the unknown."""
        at = self._place(codes)
        there, out = self.codes.take(at), self.logs.take(at)
        left = np.flatnonzero(there != codes)
        at, there, unknown = at[left], there[left], []
        out[left] = 0
        while len(left):
            empty = there < 0
            unknown.append(left[empty])
            left, at = left[~empty], self._next(at[~empty])
            there = self.codes.take(at)
            hit = there == codes[left]
            out[left[hit]] = self.logs.take(at[hit])
            left, at, there = left[~hit], at[~hit], there[~hit]
        return out, np.sort(np.concatenate(unknown)) if unknown else left


@functools.lru_cache(1)
def _head(_, shared) -> Head:
    return Head(*shared.value)


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", head_codes: int = HEAD_CODES, head: int = HEAD) -> DataFrame:
    """``key, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), held_out(F.col(key)).alias("held_out"))
    training = rows.where("not held_out")
    n_docs = training.count()
    words = written(word_counts(training, "body"), "words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    train_tokens, distinct = sums["n"] + n_docs, sums["v"] + (n_docs > 0)
    most = most_frequent(words, head).toArrow()
    frequent = sc.broadcast(dict(zip(most.column("word").to_pylist(), most.column("n").to_pylist())))
    nodes = trie(written(context_counts(training, "body"), "contexts"))
    pairs = nodes[ORDER].select("context", "total", F.explode("symbols").alias("s"))
    pairs = pairs.select(F.shiftleft("context", 9).bitwiseOR(F.col("s.symbol")).alias("code"), F.col("s.n").alias("n"), _hit(F.col("s.n"), F.col("total")).cast("float").alias("log"))
    known = most_frequent(pairs, head_codes).select("code", "log").toArrow()
    shared = sc.broadcast((known.column("code").to_numpy(), known.column("log").to_numpy()))
    end_known, end_log = int(n_docs > 0), float(np.log10(n_docs + 1))
    types = [pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.int64(), pa.int64()]
    names = ["uid", "key", "held_out", "n_tokens", "n_known", "base", "score", "word", "code", "times"]

    def run(batches):
        log_of, table = frequent.value, _head(getattr(shared, "id", id(shared)), shared)
        logs = dict(zip(log_of, np.log10(np.fromiter(log_of.values(), np.float64, len(log_of)) + 1.0).tolist()))

        def out(n: int, **given):
            kinds = [t or part.schema.field("key").type for t in types]
            return pa.RecordBatch.from_arrays([given[c] if isinstance(given.get(c), pa.Array) else pa.array(given[c], t) if c in given else pa.nulls(n, t) for c, t in zip(names, kinds)], names)

        for part, texts in _parts(batches, "body"):
            uid = part.column("uid").to_numpy()
            n_tokens, n_known, base = [], [], []
            rest: list[list] = [[], [], []]
            for u, t in zip(uid.tolist(), texts):
                tokens = t.split()
                found = [x for x in map(logs.get, tokens) if x is not None]
                n_tokens.append(len(tokens) + 1)
                n_known.append(len(found) + end_known)
                base.append(sum(found) + end_log)
                if len(found) < len(tokens):
                    rare = Counter(w for w in tokens if w not in logs)
                    for column, values in zip(rest, ([u] * len(rare), rare.keys(), rare.values())):
                        column += values
            if rest[0]:
                yield out(len(rest[0]), uid=rest[0], word=rest[1], times=rest[2])
            scores = np.zeros(len(texts))
            for codes, starts, numbers in _windows(texts):
                found, unknown = table(codes)
                np.add.at(scores, numbers, np.add.reduceat(found, starts, dtype=np.float64))
                if len(unknown):
                    of = numbers[np.searchsorted(starts, unknown, "right") - 1]
                    missing = codes[unknown]
                    order = np.lexsort((missing, of))
                    of, missing = of[order], missing[order]
                    first = np.flatnonzero(np.concatenate(([True], (of[1:] != of[:-1]) | (missing[1:] != missing[:-1]))))
                    yield out(len(first), uid=uid[of[first]], code=missing[first], times=np.diff([*first, len(of)]))
            yield out(len(texts), uid=part.column("uid"), key=part.column("key"), held_out=part.column("held_out"), n_tokens=n_tokens, n_known=n_known, base=base, score=scores)

    schema = f"uid long, key {rows.schema['key'].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, code long, times long"
    table = written(rows.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(run, schema), "scored")
    rare = table.where("word is not null").join(words, "word").select("uid", F.col("times").alias("known"), (F.col("times") * F.log10(F.col("n") + F.lit(1.0))).alias("base"), F.lit(0.0).alias("score"))
    unseen = table.where("code is not null").select("uid", "code", "times")
    logs = logs_of(written(unseen.select("code").distinct(), "unseen"), nodes)
    unseen = unseen.join(logs, "code").select("uid", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("times") * F.col("log")).alias("score"))
    more = rare.unionAll(unseen).groupBy("uid").agg(*(F.sum(c).alias(f"more_{c}") for c in ("known", "base", "score")))
    scored = table.where("n_tokens is not null").drop("word", "code", "times").join(more, "uid", "left")

    def whole(column: str, of: str) -> Column:
        return F.col(column) + F.coalesce(f"more_{of}", F.lit(0))

    over = float(np.log10(train_tokens + distinct + 1))
    return scored.select(
        F.col("key").alias(key), "held_out", "n_tokens", whole("n_known", "known").alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (whole("base", "base") - F.col("n_tokens") * F.lit(over)).alias("base_score"), whole("score", "score").alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir).select("doc_id", "text"))
