"""Operator 3, byte-level BPE by recursive queries in DuckDB, one database in each Python worker.

A task splits its texts by the vocabulary's pattern and gives the pieces it has not met to DuckDB, each
once. There, rows of (word, position, token) join the table of merges; each round contracts every
word's leftmost pair of lowest rank, until no word has a pair. A piece that is a token itself is that
token. Decoding joins ids with the vocabulary and puts the bytes together in the order of positions.

A piece of over ``SHORT`` bytes (a run of spaces, a line of letters) is contracted in overlapping windows. Tokens are the
piece's own exactly if each two neighbours are what their bytes contract to by themselves: the first
contraction over an edge would happen between the two alone as well. So where two windows have a
token in common, what is before it in the one and after it in the other join to the ids of both; where
they have none, a window is taken anew from an edge between tokens, and twice as long if need be.

Defined results: a null text is an empty one, with no ids and no bytes; repeated rows each get their
row; an empty table gives an empty result. Memory follows the longest text and the bounded table of
known pieces; the rows of a query are bounded whatever the pieces are.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Kept, documents

#: Pieces whose ids a worker keeps (twice as many at most), and pieces in one query.
KNOWN, CHUNK = 300_000, 10_000
#: Bytes of the longest piece that is contracted whole, of a window and of what two windows share, windows looked at together, and rows of all rounds of a query.
SHORT, WINDOW, SHARED, WINDOWS, ROWS = 96, 64, 32, 4096, 600_000
#: Ids that are decoded as one list.
IDS = 8192
#: Bytes of a longer piece whose ids are kept for the next text; beyond, it stands alone.
KEEP = 4096

#: Code points below which ``narrow`` spells classes out: Latin letters.
NARROW = 0x250


def narrow(pattern: str) -> str:
    """``pattern`` for the standard library, the same for texts of code points below ``NARROW``: classes spelt out."""
    import regex

    def members(escape: str) -> str:
        return "".join(re.escape(chr(c)) for c in range(NARROW) if regex.fullmatch(escape, chr(c)))

    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|[\[\]]|[^\\\[\]]+", pattern):
        if part in "[]":
            inside = part == "["
        elif part[0] == "\\" and part[1] in "pPsS":
            part = members(part) if inside else f"[{members(part)}]"
        out.append(part)
    return "".join(out)


# best: rank, then positions of the pair's left and right token and of the token after them, {bits} each
_SQL = """
WITH RECURSIVE state(round, word, pos, nxt, tok) AS (
  SELECT 0, word, pos, pos + 1, tok FROM rows
  UNION ALL
  (SELECT s.round + 1, s.word, s.pos,
          CASE WHEN s.pos = p.l THEN p.after ELSE s.nxt END,
          CASE WHEN s.pos = p.l THEN p.id ELSE s.tok END
   FROM state s JOIN (
     SELECT word, (best >> 3 * {bits})::INT AS id, (best >> 2 * {bits}) & {mask} AS l, (best >> {bits}) & {mask} AS r, best & {mask} AS after
     FROM (SELECT a.word, min((m.id::{wide} << 3 * {bits}) | (a.pos::{wide} << 2 * {bits}) | (a.nxt::{wide} << {bits}) | b.nxt) AS best
           FROM state a
           JOIN state b ON ((a.word::BIGINT << {bits}) | a.nxt) = ((b.word::BIGINT << {bits}) | b.pos)
           JOIN merges m ON m.pair = ((a.tok::BIGINT << 32) | b.tok)
           GROUP BY a.word)
   ) p ON s.word = p.word
   WHERE s.pos <> p.r{more}))
SELECT word, list(tok ORDER BY pos) AS ids
FROM state JOIN (SELECT word, max(round) AS round FROM state GROUP BY word) USING (word, round)
GROUP BY word ORDER BY word
"""

_DECODE_SQL = """
SELECT word, string_agg(hex(v.bytes), '' ORDER BY pos) AS hexed
FROM ids JOIN vocabulary v USING (id) GROUP BY word
"""


class Bpe:
    """A vocabulary in DuckDB. ``ranks``: path of a file of base64 tokens and ranks; ``pattern``: what splits a text."""

    def __init__(self, ranks: str, pattern: str):
        import duckdb
        import regex

        self.split_any = regex.compile(pattern).findall
        # nearly all texts have none but these characters, and the standard library then is twice as fast
        self.split_narrow, self.wide = re.compile(narrow(pattern)).findall, re.compile(f"[^{chr(0)}-{chr(NARROW - 1)}]").search
        with open(ranks, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.lengths = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.lengths[list(self.ranks.values())] = [len(token) for token in self.ranks]
        self.byte = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})
        self.db.register("given", pa.table({"id": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array(self.ranks.keys(), pa.binary())}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM given")
        pairs = [(a, b, rank) for token, rank in self.ranks.items() for i in range(1, len(token))
                 if (a := self.ranks.get(token[:i])) is not None and (b := self.ranks.get(token[i:])) is not None]
        left, right, rank = (np.array(x, np.int64) for x in zip(*pairs))
        self.db.register("given", pa.table({"pair": (left << 32) | right, "id": rank.astype(np.int32)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given")
        self.db.unregister("given")
        self.known = Kept(KNOWN)
        self.long: list[str] = []

    def split(self, text: str) -> list[str]:
        return self.split_any(text) if self.wide(text) else self.split_narrow(text)

    def _rows(self, words: list[bytes]) -> pa.Table:
        lengths = np.array([len(w) for w in words])
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        return pa.table({
            "word": np.repeat(np.arange(len(words), dtype=np.int32), lengths), "pos": np.arange(len(starts)) - starts,
            "tok": self.byte[np.frombuffer(b"".join(words), np.uint8)],
        })

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each piece."""
        whole = [self.ranks.get(w) for w in words]
        out: list = [[] if not w else [i] if i is not None else None for w, i in zip(words, whole)]
        short = [i for i, w in enumerate(words) if out[i] is None and len(w) <= SHORT]
        for i, ids in zip(short, self._contract([words[i] for i in short])):
            out[i] = ids
        for i, ids in enumerate(out):
            if ids is None:
                out[i] = self._joined(words[i])
        return out

    def _contract(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word by as many queries as keep their rows, at most half the square of a word's bytes each, within bounds."""
        out: list[list[int]] = []
        part: list[bytes] = []
        rows = 0
        for w in [*words, None]:
            more = len(w) * (len(w) + 3) // 2 if w is not None else 0
            if part and (w is None or len(part) == CHUNK or rows + more > ROWS):
                out += self._query(part)
                part, rows = [], 0
            if w is not None:
                part.append(w)
                rows += more
        return out

    def _query(self, words: list[bytes]) -> list[list[int]]:
        longest = max(map(len, words))
        bits, wide = (14, "BIGINT") if longest < 1 << 14 else (28, "HUGEINT")
        rounds = max(1, ROWS // longest) if len(words) == 1 else longest
        sql = _SQL.format(bits=bits, mask=(1 << bits) - 1, wide=wide, more=f" AND s.round < {rounds}" if rounds < longest else "")
        rows = self._rows(words)
        while True:
            self.db.register("rows", rows)
            got = self.db.sql(sql).to_arrow_table().column("ids").to_pylist()
            if len(words) > 1 or len(rows) - len(got[0]) < rounds:
                return got
            tokens = np.array(got[0], np.int32)  # a long word goes on where the query left it
            rows = pa.table({"word": np.zeros(len(tokens), np.int32), "pos": np.arange(len(tokens)), "tok": tokens})

    def _spans(self, start: int, ids: list[int]) -> list[tuple[int, int]]:
        """(end, id) of each token of a window at ``start``."""
        ends = start + np.cumsum(self.lengths[ids])
        return list(zip(ends.tolist(), ids))

    def _joined(self, word: bytes) -> list[int]:
        """Ids of a long word from those of its windows."""
        n, step = len(word), WINDOW - SHARED
        done = self._spans(0, self._contract([word[:WINDOW]])[0])  # ends and ids of the tokens so far; they are those of a part from 0 on
        known: dict[bytes, list[int]] = {}

        def of(part: bytes) -> list[int]:
            if part not in known:
                known[part] = self._contract([part])[0]
            return known[part]

        def join(start: int, own: list[tuple[int, int]]) -> bool:
            """Go on with a window at ``start`` after a token that both have."""
            at = {end: i for i, (end, _) in enumerate(own)}
            k = len(done) - 1
            while k >= 0 and done[k][0] > start:
                i = at.get(done[k][0])
                if i is not None and own[i][1] == done[k][1]:
                    if i + 1 < len(own):
                        done[k + 1 :] = own[i + 1 :]
                    return True
                k -= 1
            return False

        for first in range(0, n, step * WINDOWS):
            starts = range(max(first, step), min(n, first + step * WINDOWS), step)
            known = {}
            parts = list(dict.fromkeys(word[a : a + WINDOW] for a in starts))
            known.update(zip(parts, self._contract(parts)))
            for a in starts:
                b = min(n, a + WINDOW)
                size = WINDOW
                if done[-1][0] >= b or join(a, self._spans(a, known[word[a:b]])):
                    continue
                while done[-1][0] < b:  # no token in common: from an edge that is sure to be one here
                    k = len(done) - 1
                    while k > 0 and done[k - 1][0] > done[-1][0] - size // 2:
                        k -= 1
                    start = done[k - 1][0] if k else 0
                    own = self._spans(start, of(word[start : start + size]))
                    if not k and start + size >= n:
                        done[:] = own
                    elif not k:
                        if own[-1][0] > done[-1][0]:
                            done[:] = own
                        size *= 2
                    elif not join(start, own) or own[-1][0] <= done[-1][0] < b:
                        size *= 2
        return [i for _, i in done]

    def unmerge(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids; long lists are decoded in parts."""
        if sum(map(len, ids)) <= 16 * IDS:
            return self._decode(ids)
        parts = [(n, x[i : i + IDS]) for n, x in enumerate(ids) for i in range(0, len(x), IDS)]
        out: list[list[bytes]] = [[] for _ in ids]
        first = 0
        while first < len(parts):
            last, size = first, 0
            while last < len(parts) and size + len(parts[last][1]) <= 16 * IDS:
                size += len(parts[last][1])
                last += 1
            for b, (n, _) in zip(self._decode([x for _, x in parts[first:last]]), parts[first:last]):
                out[n].append(b)
            first = last
        return [b"".join(x) for x in out]

    def _decode(self, ids: list[list[int]]) -> list[bytes]:
        lengths = np.array([len(x) for x in ids], np.int64)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(lengths.sum()))
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        out = [b""] * len(ids)
        self.db.register("ids", pa.table({"word": np.repeat(np.arange(len(ids), dtype=np.int32), lengths), "pos": np.arange(len(flat)) - starts, "id": flat}))
        got = self.db.sql(_DECODE_SQL).to_arrow_table()
        for w, h in zip(got.column("word").to_pylist(), got.column("hexed").to_pylist()):
            out[w] = bytes.fromhex(h)
        return out

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; afterwards ``known`` has the ids (in decimal, joined) and the decoded bytes of all of them."""
        split = [self.split(t) for t in texts]
        known = self.known
        for p in self.long:
            known.pop(p, None)
            known.old.pop(p, None)
        self.long = []
        new = known.missing(set().union(*split))
        for i in range(0, len(new), CHUNK):
            part = new[i : i + CHUNK]
            ids = self.merge([p.encode() for p in part])
            for p, x, b in zip(part, ids, self.unmerge(ids)):
                known[p] = (",".join(map(str, x)), b)
                if len(b) > KEEP:
                    self.long.append(p)
        return split


@functools.cache
def bpe(ranks: str, pattern: str) -> Bpe:
    """The database of this Python worker, which outlives a task."""
    return Bpe(ranks, pattern)


def _by_text(docs: DataFrame, text: str, made, fields: str) -> DataFrame:
    """``docs`` with what ``made`` gives for the texts of a part of a batch, a list for each of ``fields``."""
    names = [f.split()[0] for f in fields.split(", ")]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in docs.schema)}, {fields}"

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                new = made(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, *names])

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``text``."""
    def made(texts):
        own = bpe(ranks, pattern)
        split = own.pieces([t or "" for t in texts])
        ids = [np.fromstring(",".join([own.known[p][0] for p in ps]), np.int32, sep=",") if ps else np.empty(0, np.int32) for ps in split]
        return [pa.array(ids, pa.list_(pa.int32()))]

    return _by_text(docs, text, made, f"{into} array<int>")


def decode(docs: DataFrame, ranks: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the token ids stand for."""
    return _by_text(docs, ids, lambda lists: [pa.array(bpe(ranks, pattern).unmerge([x or [] for x in lists]), pa.binary())], f"{into} binary")


def digests(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with the number of ids, and SHA-256 of the ids in decimal and of the bytes decoded from them."""
    def made(texts):
        own = bpe(ranks, pattern)
        split = own.pieces([t or "" for t in texts])
        found = [[own.known[p] for p in ps] for ps in split]
        ids = [",".join([f[0] for f in fs]) for fs in found]
        return [
            pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(b"".join([f[1] for f in fs])).hexdigest() for fs in found]),
        ]

    return _by_text(docs, text, made, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, ranks: str, pattern: str, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids`` and ``round_trip``: whether the ids decode to the text's bytes."""
    def made(texts):
        own = bpe(ranks, pattern)
        split = own.pieces([t or "" for t in texts])
        found = [[own.known[p] for p in ps] for ps in split]
        ids = [np.fromstring(",".join([f[0] for f in fs]), np.int32, sep=",") if fs else np.empty(0, np.int32) for fs in found]
        same = [b"".join([f[1] for f in fs]) == (t or "").encode() for t, fs in zip(texts, found)]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
        return [pa.array(np.diff(ends), pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(ids))), pa.array(same)]

    return _by_text(docs, text, made, "n_tokens long, ids array<int>, round_trip boolean")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = documents(spark, sf_dir).select("doc_id", F.col("text"))
    return digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")
