"""Operator 11, removal of repeated passages by super-k-mer partitioning.

A window is ``k`` consecutive words of one document. Its minimiser is the smallest hash of the
``m``-word sequences in it, so equal windows have equal minimisers, and neighbouring windows mostly
share theirs: such a run travels as one string, a super-k-mer, to the bin of its minimiser. There all
windows are sorted by hash, equal hashes are compared byte by byte, and every window learns exactly how often and in
which smallest document it stands. A window that also starts in a document with a smaller key is
repeated; words that a repeated window covers are removed. Windows are judged on the input.

A task first joins what it has read: of a string that it saw in several documents only the smallest travels, as in the
others all its windows are repeated already. Bins follow the size of the corpus. A first pass counts the windows
of all bins; one that has ``HEAVY`` times its share (a passage with many different neighbours, say) is split by the windows' own
hashes, each window alone. A minimiser with less than a 65,536th of all windows is never split.
Strings are packed into blocks of zstd for each bin. Found ranges of words are grouped by row, and joined with the texts.

Defined results: a null text has no words; a row with a null key keeps all its words and
takes none from others; rows with the same key take nothing from each other, so repeated rows
are cut alike; fewer than ``k`` words are no window; long texts are read in pieces that overlap by ``k - 1`` words; an
empty table gives an empty result. Keys are integers. Rows are told apart by key and XXH64 of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import documents

K, M = 13, 2
#: Bytes of text that are read at once, that a task joins before it sends, and that make a bin; bytes that are hashed at once, and of a word that is hashed alone.
CHUNK, JOIN, BIN, STEP, LONG = 2 << 20, 16 << 20, 4 << 20, 1 << 20, 1 << 16
#: Words of a piece of a long text. Times its share that a bin may have, and windows that it has then at least. Bits of the bins that are counted.
PIECE, HEAVY, LEAST, COUNTED = 100_000, 4, 50_000, 16
BLOCKS = "bin int, strings binary, keys array<long>, counts array<long>, at array<int>, print array<long>, start array<int>, end array<int>"
RANGES = "key long, print long, start int, end int"

_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    def line(x):
        out = np.full(n, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return line(_ODD), line(pow(_ODD, -1, 2**64))


def _mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of ``values[first:last]`` for each pair, whatever stands around it."""
    size = 1 << max(16, len(values).bit_length())
    power, inverse = _powers(size)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * power[: len(values)], out=sums[1:])
    return _mixed((sums[last] - sums[first]) * inverse[first])


def _words(text: bytes, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word; memory depends on ``STEP`` and ``LONG``, not on the text."""
    out = np.empty(len(starts), np.uint64)
    alone = np.flatnonzero(ends - starts > LONG)
    steps = np.searchsorted(starts, np.arange(0, len(raw), STEP))
    cuts = np.unique(np.concatenate([[0, len(starts)], alone, alone + 1, steps]))
    single = set(alone.tolist())
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        if a in single:
            out[a] = xxh64_intdigest(text[starts[a] : ends[a]])
        else:
            at = starts[a]
            out[a:b] = _spans(raw[at : ends[b - 1]].astype(np.uint64), starts[a:b] - at, ends[a:b] - at)
    return out


class Windows:
    """The windows of texts in one buffer: words parted by a space, texts by a line feed."""

    def __init__(self, text: bytes, k: int, m: int):
        raw = np.frombuffer(text, np.uint8)
        ends = np.flatnonzero((raw == 32) | (raw == 10))
        self.starts, self.ends = np.append(0, ends + 1), np.append(ends, len(raw))
        self.text_of = np.append(0, np.cumsum(raw[ends] == 10)).astype(np.int32)
        n = len(self.starts) - k + 1
        words = _words(text, raw, self.starts, self.ends)
        self.first = np.flatnonzero(self.text_of[: max(n, 0)] == self.text_of[k - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.hashes = _spans(words, self.first, self.first + k)
        grams = _spans(words, np.arange(len(words) - m + 1), np.arange(m, len(words) + 1)) if n > 0 else words
        width, wide = k - m + 1, 1
        while 2 * wide <= width:  # the least of a window, from windows half as wide
            grams, wide = np.minimum(grams[: len(grams) - wide], grams[wide:]), 2 * wide
        self.least = _mixed(np.minimum(grams[self.first], grams[self.first + width - wide]))  # minima are small numbers; mixed they fill the bins evenly


class Bins:
    """Which bin a window goes to: that of its minimiser, or one of those that a heavy bin is split into."""

    def __init__(self, bits: int, counts: np.ndarray):
        self.bits, self.counted = bits, min(bits, COUNTED)
        mean = counts.sum() / max(1, len(counts))
        self.parts = np.where(counts > max(HEAVY * mean, LEAST), np.ceil(counts / max(mean, LEAST / HEAVY)), 0).astype(np.int64)
        self.base = (1 << bits) + np.cumsum(self.parts) - self.parts

    def of(self, windows: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(bin, whether it is split) of each window."""
        coarse = (windows.least >> np.uint64(64 - self.counted)).astype(np.int64)
        parts = self.parts[coarse]
        fine = (windows.least >> np.uint64(64 - self.bits)).astype(np.int64)
        return np.where(parts > 0, self.base[coarse] + (windows.hashes % np.maximum(parts, 1).astype(np.uint64)).astype(np.int64), fine), parts > 0


def _chunks(batch, k: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """(buffer, row of the batch, number of the first word) of its texts, by ascending key and as long as ``CHUNK``."""
    parts, rows, first, size = [], [], [], 0
    texts = batch.column("text").cast(pa.binary())
    for row in np.argsort(batch.column("key").to_numpy(), kind="stable").tolist():
        words = (texts[row].as_py() or b"").split()
        for at in range(0, len(words) - k + 1, PIECE):
            parts.append(b" ".join(words[at : at + PIECE + k - 1]))
            rows.append(row)
            first.append(at)
            size += len(parts[-1])
            if size >= CHUNK:
                yield b"\n".join(parts), np.array(rows), np.array(first)
                parts, rows, first, size = [], [], [], 0
    if parts:
        yield b"\n".join(parts), np.array(rows), np.array(first)


def _counted(bits: int, k: int, m: int):
    def run(batches):
        found = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for text, _, _ in _chunks(batch, k):
                found += np.bincount((Windows(text, k, m).least >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], ["bin", "n"])

    return run


class Joined:
    """Super-k-mers of a task's documents, each string once, until they are sent."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {}
        self.keys, self.bins, self.counts = (np.zeros(0, np.int64) for _ in range(3))
        self.own, self.done, self.size = [], [], 0

    def add(self, text: bytes, windows: Windows, bins: np.ndarray, split: np.ndarray, keys: np.ndarray, prints: np.ndarray, first_word: np.ndarray, k: int) -> None:
        at, least = windows.first, windows.least
        if not len(at):
            return
        new = np.ones(len(at), bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (windows.text_of[at[1:]] != windows.text_of[at[:-1]]) | split[1:]
        runs = np.flatnonzero(new)
        begin, last = at[runs], at[np.append(runs[1:], len(at)) - 1]
        own = windows.text_of[begin]
        numbers, before = self.numbers, len(self.numbers)
        ids = np.fromiter((numbers.setdefault(text[a:b], len(numbers)) for a, b in zip(windows.starts[begin].tolist(), windows.ends[last + k - 1].tolist())), np.int64, len(runs))
        key, found = keys[own], len(numbers) - before
        fresh, seen = np.unique(ids, return_index=True)
        seen = seen[fresh >= before]
        self.keys, self.bins, self.counts = np.append(self.keys, key[seen]), np.append(self.bins, bins[runs][seen]), np.append(self.counts, np.zeros(found, np.int64))
        np.add.at(self.counts, ids, 1)
        text_starts = np.searchsorted(windows.text_of, own)
        start = begin - text_starts + first_word[own]
        end = start + (last - begin) + k
        later = key > self.keys[ids]  # a document before has the whole string
        self.own.append((ids[~later], prints[own][~later], start[~later]))
        self.done.append((key[later], prints[own][later], start[later], end[later]))
        self.size += len(text)

    def sent(self, spread: int) -> Iterator[pa.RecordBatch]:
        import zstandard

        def lists(values, counts, kind):
            return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), pa.array(values.astype(kind)))

        def none(kind, n):
            return pa.nulls(n, kind)

        names = [f.split()[0] for f in BLOCKS.split(", ")]
        if self.numbers:
            strings = np.empty(len(self.numbers), object)
            strings[:] = list(self.numbers)
            order = np.argsort(self.bins, kind="stable")
            sizes = np.cumsum(np.fromiter(map(len, strings[order]), np.int64, len(order)))
            block = np.ones(len(order), bool)  # of one bin, and of a chunk's size at most or of one string
            block[1:] = (np.diff(self.bins[order]) != 0) | (np.diff(sizes // CHUNK) != 0)
            bounds = np.append(np.flatnonzero(block), len(order))
            press = zstandard.ZstdCompressor(level=3)
            packed = [press.compress(b"\n".join(strings[order[a:b]])) for a, b in zip(bounds, bounds[1:])]
            ids, prints, start = (np.concatenate(x) for x in zip(*self.own))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            by = np.argsort(place[ids], kind="stable")
            where = place[ids][by]
            of_block = np.searchsorted(bounds, where, side="right") - 1
            n_own, n_strings = np.bincount(of_block, minlength=len(packed)), np.diff(bounds)
            yield pa.RecordBatch.from_arrays([
                pa.array(self.bins[order][bounds[:-1]].astype(np.int32)), pa.array(packed, pa.binary()), lists(self.keys[order], n_strings, np.int64), lists(self.counts[order], n_strings, np.int64),
                lists(where - bounds[of_block], n_own, np.int32), lists(prints[by], n_own, np.int64), lists(start[by], n_own, np.int32), none(pa.list_(pa.int32()), len(packed)),
            ], names)
        key, prints, start, end = (np.concatenate(x) for x in zip(*self.done)) if self.done else (np.zeros(0, np.int64),) * 4
        if len(key):
            n = np.array([len(key)])
            yield pa.RecordBatch.from_arrays([
                pa.array([spread], pa.int32()), none(pa.binary(), 1), lists(key, n, np.int64), none(pa.list_(pa.int64()), 1),
                none(pa.list_(pa.int32()), 1), lists(prints, n, np.int64), lists(start, n, np.int32), lists(end, n, np.int32),
            ], names)


def _packed(bins: Bins, k: int, m: int):
    def run(batches):
        joined = Joined()
        for batch in batches:
            keys, prints = batch.column("key").to_numpy(), batch.column("print").to_numpy()
            for text, rows, first_word in _chunks(batch, k):
                windows = Windows(text, k, m)
                joined.add(text, windows, *bins.of(windows), keys[rows], prints[rows], first_word, k)
                if joined.size >= JOIN:
                    yield from joined.sent(int(keys[rows[0]] % (1 << bins.bits)))
                    joined = Joined()
            if joined.size:  # keys start again in the next batch
                yield from joined.sent(int(keys[0] % (1 << bins.bits)))
                joined = Joined()

    return run


def _sorted(table: pa.Table, k: int, m: int, mask: int):
    """All windows of a bin by hash: buffer, bounds in it, string of each, groups of equal windows, and the strings' keys and counts."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    parts, size, strings = [], 0, 0
    hashes, starts, ends, of = [], [], [], []
    for block in table.column("strings").to_pylist():
        if block is None:
            continue
        text = press.decompress(block)
        w = Windows(text, k, m)
        hashes.append(w.hashes & np.uint64(mask))
        starts.append(w.starts[w.first] + size)
        ends.append(w.ends[w.first + k - 1] + size)
        of.append(w.text_of[w.first] + strings)
        parts.append(text)
        size, strings = size + len(text), strings + int(w.text_of[-1]) + 1
    if not parts:
        return None
    text = b"".join(parts)
    hashes, starts, ends, of = (np.concatenate(x) for x in (hashes, starts, ends, of))
    order = np.argsort(hashes, kind="stable")
    hashes, starts, ends, of = hashes[order], starts[order], ends[order], of[order]
    same = np.append(False, hashes[1:] == hashes[:-1])
    places = np.flatnonzero(same | np.append(same[1:], False))
    group = np.cumsum(~same) - 1
    if len(places):  # equal hashes are compared byte by byte; what differs becomes a group of its own
        first: dict = {}
        fresh, at = int(group[-1]) + 1, group[places].tolist()
        for i, g, a, b in zip(places.tolist(), at, starts[places].tolist(), ends[places].tolist()):
            window = text[a:b]
            if (had := first.setdefault(g, window)) != window:
                own = first.setdefault((g, window), fresh)
                fresh += own == fresh
                group[i] = own
    return text, starts, ends, of, group


def _lists(table: pa.Table, name: str, strings: bool = True) -> np.ndarray:
    """The values of a list column in the blocks with strings, or in the others."""
    column = table.column(name).filter(table.column("strings").is_valid() if strings else table.column("strings").is_null())
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks] or [np.zeros(0, np.int64)]).astype(np.int64)


def _judged(table: pa.Table, k: int, m: int, mask: int) -> pa.Table:
    """The ranges of words in a bin's documents that repeated windows cover."""
    out = [tuple(_lists(table, c, False) for c in ("keys", "print", "start", "end"))]
    found = _sorted(table, k, m, mask)
    if found:
        _, starts, _, of, group = found
        keys = _lists(table, "keys")
        least = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, keys[of])
        back = np.argsort(starts, kind="stable")  # in the order of the text again, for runs of repeated windows of a string
        of, group = of[back], group[back]
        places = np.flatnonzero(keys[of] > least[group])
        of, nth = of[places], places - np.searchsorted(of, of[places])
        edge = np.ones(len(nth), bool)
        edge[1:] = (of[1:] != of[:-1]) | (nth[1:] != nth[:-1] + 1)
        runs = np.flatnonzero(edge)
        run_of, begin, last = of[runs], nth[runs], nth[np.append(runs[1:], len(nth)) - 1] if len(runs) else nth
        # each row that has a string has its runs
        sizes = [len(x) if x is not None else 0 for x in table.column("keys").filter(table.column("strings").is_valid()).to_pylist()]
        owns = [len(x) if x is not None else 0 for x in table.column("at").filter(table.column("strings").is_valid()).to_pylist()]
        string = _lists(table, "at") + np.repeat(np.append(0, np.cumsum(sizes)[:-1]), owns)
        lo, hi = np.searchsorted(run_of, string), np.searchsorted(run_of, string, side="right")
        n = hi - lo
        row = np.repeat(np.arange(len(string)), n)
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        at = _lists(table, "start")[row]
        out.append((keys[string][row], _lists(table, "print")[row], at + begin[run], at + last[run] + k))
    key, prints, start, end = (np.concatenate(x) for x in zip(*out))
    return pa.table({"key": key, "print": prints, "start": start.astype(np.int32), "end": end.astype(np.int32)})


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M, bin_bytes: int = BIN) -> DataFrame:
    """The super-k-mers of ``docs`` in blocks by bin (``BLOCKS``)."""
    rows = _rows(docs, key, text)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(26, max(4, math.ceil(math.log2(size / bin_bytes + 1))))
    counted = min(bits, COUNTED)
    counts = np.zeros(1 << counted, np.int64)
    found = rows.mapInArrow(_counted(counted, k, m), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # 65,536 rows at most
    counts[found.column("bin").to_numpy()] = found.column("n").to_numpy()
    return rows.mapInArrow(_packed(Bins(bits, counts), k, m), BLOCKS)


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M, mask: int = 2**64 - 1, **sizes) -> DataFrame:
    """``key, print, start, end``: ranges of words that repeated windows cover; they may overlap. ``mask``: the bits of hashes that sorting uses."""
    return blocks(docs, key, text, k, m, **sizes).groupBy("bin").applyInArrow(lambda table: _judged(table, k, m, mask), RANGES)


def window_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M, least: int = 2, **sizes) -> DataFrame:
    """``window, n, first_key`` of every window that stands ``least`` times or more in all documents."""
    def run(table):
        kept: tuple = ([], [], [])
        if found := _sorted(table, k, m, 2**64 - 1):
            text, starts, ends, of, group = found
            n, first = np.zeros(int(group.max()) + 1, np.int64), np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
            np.add.at(n, group, _lists(table, "counts")[of])
            np.minimum.at(first, group, _lists(table, "keys")[of])
            groups, at = np.unique(group, return_index=True)
            at, groups = at[n[groups] >= least], groups[n[groups] >= least]
            kept = ([text[a:b].decode() for a, b in zip(starts[at], ends[at])], n[groups], first[groups])
        return pa.table([pa.array(kept[0], pa.string()), pa.array(kept[1], pa.int64()), pa.array(kept[2], pa.int64())], ["window", "n", "first_key"])

    return blocks(docs, key, text, k, m, **sizes).groupBy("bin").applyInArrow(run, "window string, n long, first_key long")


def _cut(batches):
    for batch in batches:
        words, removed, kept = [], [], []
        for text, ranges in zip(batch.column("text").cast(pa.binary()), batch.column("ranges").to_pylist()):
            own = (text.as_py() or b"").split()
            words.append(len(own))
            if ranges:
                stays = np.ones(len(own), bool)
                for r in ranges:
                    stays[r["start"] : r["end"]] = False
                own = [own[i] for i in np.flatnonzero(stays)]
            removed.append(words[-1] - len(own))
            kept.append(b" ".join(own))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["row", "n_words", "n_removed", "kept"])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, m: int = M, mask: int = 2**64 - 1, **sizes) -> DataFrame:
    """``docs`` without ``text``, with ``n_words``, ``n_removed`` and ``kept``, the words that stay, joined by one space."""
    ranges = repeated(docs, key, text, k, m, mask, **sizes)
    # of repeated rows the ranges are the same, so the set of a row is bounded by its words
    ranges = ranges.groupBy("key", "print").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    names = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*names).alias("row"), F.col(text).alias("text"), F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("print"))
    rows = rows.join(ranges, ["key", "print"], "left").select("row", "text", "ranges")
    done = rows.mapInArrow(_cut, f"row {rows.schema['row'].dataType.simpleString()}, n_words long, n_removed long, kept string")
    return done.select(*(F.col("row")[c].alias(c) for c in names), "n_words", "n_removed", "kept")


def query(spark, sf_dir: str) -> DataFrame:
    done = dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def oracle_sql() -> str:
    return f"""
WITH docs AS (SELECT row_number() OVER () AS uid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda w: w <> '') AS words FROM documents),
places AS (SELECT uid, doc_id, words, unnest(range(1, len(words) - {K - 2})) AS nth FROM docs WHERE len(words) >= {K}),
windows AS (SELECT uid, doc_id, nth, array_to_string(list_slice(words, nth, nth + {K - 1}), ' ') AS w FROM places),
firsts AS (SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w),
covered AS (SELECT DISTINCT uid, unnest(range(nth, nth + {K})) AS nth FROM windows JOIN firsts USING (w) WHERE first_id < doc_id),
gone AS (SELECT uid, list(nth) AS nths FROM covered GROUP BY uid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(nths), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN nths IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(nths, i)) END, ' '), '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (uid)"""
