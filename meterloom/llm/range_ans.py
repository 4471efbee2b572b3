"""Operator 7, token ids as binary files coded by a static range asymmetric numeral system.

Documents are dealt by ranges of their key, ordered inside a range, tokenised and cut into segments of
whole documents. A segment is one row of the table of files: the keys and lengths of its documents and
a payload that stands for itself. A payload holds one frequency table, shared by its blocks, and blocks
that know nothing of each other. A block interleaves up to 1,024 coders, has a checksum and, every 128
steps, a checkpoint (coder states and place in the stream), so decoding can start at any block or
checkpoint and any number of tasks can read at once.

Defined results: a null text is an empty one and gives the end id alone; repeated keys are ordered by a
hash of their text and each keep a row; null keys come first; an empty table gives an empty result.
A task holds one segment (2,097,152 ids, or one document if that is longer).
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept, broadcast_if_small, documents, written

SCALE = 20  # bits of the frequency scale; more than there are symbols in any of the public vocabularies
LOW = np.uint64(1 << 31)  # a coder's state stays in [2**31, 2**63), words have 32 bits
LANES, BLOCK, SEGMENT, STEPS = 1024, 1 << 18, 1 << 21, 128
MAGIC = b"mlRA"
HEAD, BLOCK_HEAD = struct.Struct("<4sBII"), struct.Struct("<IHHII")


# the codec, over numpy arrays


def frequencies(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that occur, and their frequencies scaled to 2**SCALE with none below 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols].astype(np.float64)
    total = 1 << SCALE
    if len(symbols) > total:
        raise ValueError("more symbols than the frequency scale has places")
    scaled = np.maximum(1, np.floor(counts * (total / counts.sum()))).astype(np.int64)
    over = int(scaled.sum()) - total
    if over <= 0:
        scaled[np.argmax(scaled)] -= over
    for i in np.argsort(-scaled) if over > 0 else ():
        took = min(over, int(scaled[i]) - 1)
        scaled[i] -= took
        over -= took
        if not over:
            break
    return symbols.astype(np.uint32), scaled.astype(np.uint32)


def _encode_block(at: np.ndarray, freq: np.ndarray, low: np.ndarray, cheap: int) -> bytes:
    """``at``: places of the ids in the table. The last steps are coded first."""
    n = len(at)
    lanes = int(min(LANES, 1 << max(0, (n // 64).bit_length() - 1)))
    steps = -(-n // lanes)
    rows = np.full(steps * lanes, cheap, np.int64)
    rows[:n] = at
    rows = rows.reshape(steps, lanes)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    states: list[bytes] = []
    sizes = np.zeros(steps, np.int64)
    limit = np.uint64(63 - SCALE)
    for t in range(steps - 1, -1, -1):
        f, c = freq[rows[t]], low[rows[t]]
        full = state >= (f << limit)
        if full.any():
            out = state[full]
            words.append(out.astype(np.uint32))
            sizes[t] = len(out)
            state[full] = out >> np.uint64(32)
        q = state // f
        state = (q << np.uint64(SCALE)) + (state - q * f) + c
        if t % STEPS == 0:
            states.append(state.tobytes())
    places = np.concatenate(([0], np.cumsum(sizes)[:-1]))[::STEPS].astype("<u4")
    stream = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
    body = places.tobytes() + b"".join(states[::-1]) + stream.astype("<u4").tobytes()
    return BLOCK_HEAD.pack(n, lanes, len(states), len(stream), zlib.crc32(body)) + body


def encode(ids: np.ndarray) -> bytes:
    """A payload: one frequency table, then the blocks."""
    if not len(ids):
        return HEAD.pack(MAGIC, SCALE, 0, 0)
    symbols, freq = frequencies(ids)
    place = np.zeros(int(symbols[-1]) + 1, np.int64)
    place[symbols] = np.arange(len(symbols))
    wide = freq.astype(np.uint64)
    low = np.concatenate(([0], np.cumsum(wide)[:-1])).astype(np.uint64)
    table = zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    blocks = [_encode_block(place[ids[i : i + BLOCK]], wide, low, int(np.argmax(freq))) for i in range(0, len(ids), BLOCK)]
    return HEAD.pack(MAGIC, SCALE, len(symbols), len(blocks)) + struct.pack("<I", len(table)) + table + b"".join(blocks)


def _opened(payload: bytes):
    magic, scale, n_symbols, n_blocks = HEAD.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a payload of this format")
    if not n_blocks:
        return scale, None, None, []
    size = struct.unpack_from("<I", payload, HEAD.size)[0]
    at = HEAD.size + 4
    table = np.frombuffer(zlib.decompress(payload[at : at + size]), "<u4")
    symbols, freq = np.cumsum(table[:n_symbols], dtype=np.uint32), table[n_symbols:]
    at, blocks = at + size, []
    for _ in range(n_blocks):
        n, lanes, n_states, n_words, crc = BLOCK_HEAD.unpack_from(payload, at)
        blocks.append((at, n, lanes, n_states, n_words, crc))
        at += BLOCK_HEAD.size + 4 * n_states + 8 * lanes * n_states + 4 * n_words
    return scale, symbols, freq, blocks


def _decode_block(payload: bytes, block: tuple, scale: int, freq: np.ndarray, low: np.ndarray, of: np.ndarray, checkpoint: int = 0) -> np.ndarray:
    at, n, lanes, n_states, n_words, crc = block
    at += BLOCK_HEAD.size
    size = 4 * n_states + 8 * lanes * n_states + 4 * n_words
    if zlib.crc32(memoryview(payload)[at : at + size]) != crc:
        raise ValueError("a block's checksum does not match")
    places = np.frombuffer(payload, "<u4", n_states, at)
    state = np.frombuffer(payload, "<u8", lanes, at + 4 * n_states + 8 * lanes * checkpoint).astype(np.uint64)
    words = np.frombuffer(payload, "<u4", n_words, at + 4 * n_states + 8 * lanes * n_states)
    pos, first, steps = int(places[checkpoint]), checkpoint * STEPS, -(-n // lanes)
    out = np.empty((steps - first, lanes), of.dtype)
    mask, shift, word = np.uint64((1 << scale) - 1), np.uint64(scale), np.uint64(32)
    for t in range(steps - first):
        slot = state & mask
        out[t] = s = of[slot]
        state = freq[s] * (state >> shift) + slot - low[s]
        need = np.flatnonzero(state < LOW)
        if len(need):
            state[need] = (state[need] << word) | words[pos : pos + len(need)]
            pos += len(need)
    return out.reshape(-1)[: n - first * lanes]


def decode(payload: bytes, block: int | None = None, checkpoint: int = 0) -> np.ndarray:
    """All ids of a payload; or those of one block, from a checkpoint on."""
    scale, symbols, freq, blocks = _opened(payload)
    if not blocks:
        return np.empty(0, np.uint32)
    wide = freq.astype(np.uint64)
    low = np.concatenate(([0], np.cumsum(wide)[:-1])).astype(np.uint64)
    of = np.repeat(np.arange(len(symbols), dtype=np.int32), freq)
    if block is not None:
        return symbols[_decode_block(payload, blocks[block], scale, wide, low, of, checkpoint)]
    return symbols[np.concatenate([_decode_block(payload, b, scale, wide, low, of) for b in blocks])]


# tokenising: white space never is in a token of this vocabulary, so words are encoded once each

#: Words whose ids a worker keeps (twice as many at most), words in one call, and bytes of text looked at together.
KEPT_WORDS, CALL, TOGETHER = 600_000, 512, 16_000_000
#: ASCII punctuation but the apostrophe between a letter and a word's end: always tokens of its own.
_TAIL = re.compile(r"(?<=[a-z])[!-&(-/:-@\[-`{-~]+\Z")


class Words:
    """Ids of whole texts as little-endian 16- or 32-bit integers, word by word; the words seen are kept up to a bound.

    Added tokens (``special``: as the library does unless told otherwise) are cut out of a text first,
    as the tokenizer does itself. What is between them is cut at ASCII white space, which the tokenizer
    drops, and letters A-Z are lowered, which it does too. Arrow does that for many texts at once and
    numbers the different words, so Python sees each of them once; punctuation is cut from the end of a new
    one. A vocabulary whose added tokens look at what is around them, or at normalised text, is left to
    the tokenizer, text by text.
    """

    def __init__(self, path: str, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        from tokenizers import Tokenizer

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.plain.encode_special_tokens = True  # for words: none is an added token, but one can become it when lowered
        self.known = Kept(KEPT_WORDS)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        added = self.tokenizer.get_added_tokens_decoder()
        self.whole = any(t.normalized or t.single_word or t.lstrip or t.rstrip or not t.special for t in added.values())
        self.added = {t.content: np.array([i], self.dtype) for i, t in added.items()} if special else {}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        #: By id: whether a token ends a word. Where the vocabulary does not tell, none does.
        suffix = getattr(self.plain.model, "end_of_word_suffix", None)
        self.last = np.zeros(max(self.plain.get_vocab().values()) + 1, bool)
        self.last[[i for t, i in self.plain.get_vocab().items() if suffix and t.endswith(suffix)]] = True

    def _encoded(self, words: list[str]):
        """(word, ids) of each word. Words of letters are encoded many at a time and told apart by the tokens that end a word."""
        letters = [t for t in words if t.isalpha()] if self.last.any() else []
        alone = [t for t in words if not t.isalpha()] if letters else words
        size = self.dtype.itemsize
        for i in range(0, len(letters), CALL):
            part = letters[i : i + CALL]
            ids = np.array(self.plain.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                alone += part
                continue
            raw, at = ids.tobytes(), (size * ends).tolist()
            yield from zip(part, map(raw.__getitem__, map(slice, [0, *at[:-1]], at)))
        for i in range(0, len(alone), 10_000):
            part = alone[i : i + 10_000]
            for t, e in zip(part, self.plain.encode_batch_fast(part, add_special_tokens=False)):
                yield t, np.array(e.ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        """Put the ids of all ``words`` into the table."""
        known = self.known
        new = known.missing(set(words))
        tails = {w: m.start() for w in new if (m := _TAIL.search(w))}
        parts = {w for w in new if w not in tails}
        for w, at in tails.items():
            parts |= {w[:at], w[at:]}
        known.update(self._encoded([p for p in parts if p not in known]))
        known.update((w, known[w[:at]] + known[w[at:]]) for w, at in tails.items())

    def _plain(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        rows = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = rows.flatten().dictionary_encode()
        words = pc.ascii_lower(coded.dictionary).to_pylist()  # not of texts: wrong for a slice of an array
        self._learn(words)
        found = [self.known[w] for w in words]
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        at = np.concatenate(([0], np.cumsum(size)))
        of_word = pa.LargeListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(found), self.dtype)))
        ids = of_word.take(coded.indices).flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate(([0], np.cumsum(size[coded.indices.to_numpy()])))[np.cumsum(rows.value_lengths().to_numpy(zero_copy_only=False))]
        return np.split(ids, ends[:-1])

    def _with_added(self, text: str) -> np.ndarray:
        """Ids of a text that holds added tokens."""
        parts = self.cut.split(text)
        between = self._plain(pa.array(parts[::2], pa.string()))
        return np.concatenate([between[i // 2] if i % 2 == 0 else self.added[p] for i, p in enumerate(parts)])

    def __call__(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each of ``texts``, none of which is null."""
        if not len(texts):
            return []
        if self.whole:
            return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        holds = np.zeros(len(texts), bool)
        for token in self.added:
            holds |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not holds.any():
            return self._plain(texts)
        out = self._plain(pc.if_else(pa.array(holds), "", texts))
        for i in np.flatnonzero(holds):
            out[i] = self._with_added(texts[int(i)].as_py())
        return out


@functools.cache
def words(path: str, special: bool) -> Words:
    """The tokenizer of this Python worker, which outlives a task."""
    return Words(path, special)


def _together(batches, size: int = TOGETHER):
    """Parts of the batches with about ``size`` bytes of text each; a longer text is alone."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


FILES = "file int, segment int, n_ids long, keys array<long>, lengths array<long>, payload binary"


def encode_files(docs: DataFrame, tokenizer: str, end_id: int, special: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the files: one for each segment, in ascending order of ``(file, segment)`` and, inside, of the key."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("tie", F.xxhash64("body"))
    rows = rows.repartitionByRange("key", "tie").sortWithinPartitions("key", "tie").select("key", "body")

    def write(batches):
        ids_of, file, segment = words(tokenizer, special), TaskContext.get().partitionId(), 0
        end = np.array([end_id], ids_of.dtype)
        keys: list = []
        coded: list[np.ndarray] = []
        size = 0

        def row():
            ids = np.concatenate(coded)
            return pa.RecordBatch.from_pydict({
                "file": pa.array([file], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()),
                "keys": pa.array([keys], pa.list_(pa.int64())), "lengths": pa.array([[len(a) + 1 for a in coded[::2]]], pa.list_(pa.int64())),
                "payload": pa.array([encode(ids)], pa.binary()),
            })

        for part in _together(batches):
            for k, ids in zip(part.column("key").to_pylist(), ids_of(part.column("body"))):
                n = len(ids) + 1
                if keys and size + n > SEGMENT:
                    yield row()
                    keys, coded, size, segment = [], [], 0, segment + 1
                keys.append(k)
                coded += [ids, end]
                size += n
        if keys:
            yield row()

    return rows.mapInArrow(write, FILES)



def placed(files: DataFrame) -> DataFrame:
    """``files`` with ``start``, the ids of all segments before: sums inside each file, moved up by the sums of the files."""
    sizes = files.select("file", "segment", "n_ids")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    totals = sizes.groupBy("file").agg(F.sum("n_ids").alias("n")).select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "segment", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("inner"))
    starts = starts.join(totals, "file").select("file", "segment", (F.col("base") + F.col("inner")).alias("start"))
    return files.join(broadcast_if_small(starts), ["file", "segment"])


def _read(files: DataFrame, made, schema: str) -> DataFrame:
    def read(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in ("keys", "lengths", "start", "payload")}
                ids, at, start = decode(row["payload"].as_py()).astype("<u4"), 0, row["start"].as_py()
                lengths = row["lengths"].values.to_numpy()
                ends = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                yield made(row["keys"].values, start + ends - lengths, lengths, [raw[4 * (e - n) : 4 * e] for n, e in zip(lengths.tolist(), ends.tolist())])

    return placed(files).select("keys", "lengths", "start", "payload").mapInArrow(read, schema)


def decode_files(files: DataFrame) -> DataFrame:
    """``key, start, n_tokens, ids`` (little-endian 32-bit) of every document, read back from the files."""
    def made(keys, starts, lengths, ids):
        return pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([bytes(x) for x in ids], pa.binary())], ["key", "start", "n_tokens", "ids"])

    return _read(files, made, "key long, start long, n_tokens long, ids binary")


def checked_files(files: DataFrame) -> DataFrame:
    """As ``decode_files``, with the CRC-32 of the ids in their place."""
    def made(keys, starts, lengths, ids):
        return pa.RecordBatch.from_arrays([keys, pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(files, made, "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    files = encode_files(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return checked_files(written(files, "ids"))
