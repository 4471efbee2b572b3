"""Operator 6, a quality classifier by co-training.

Two logistic classifiers look at a document from sides that do not share a feature. The content view
has the frequencies of hashed pairs of bytes. The metadata view has what a listing of the page tells:
language, source, length, and counts of lines, words, capitals, digits, marks and repeated words. Both
are fitted to labelled rows; in each round, each picks the rows without a label of which it is
surest, in the proportion of the classes, and gives them with its label to the other. Each view is
calibrated on labelled rows that were never trained on (Platt), a third logistic fit on the same rows
weighs the two, and all documents are scored by it.

Fitting sees a bounded sample of labelled rows, ``LABELLED`` by a hash of the key. In every round both views score
all rows; the surest are a top-k over all that have no label, and only their features, ``GIVEN`` rows for each
view and round, come to the driver. The scores cover whole texts of all rows, with no shuffle.

Defined results: a null or empty text has all frequencies 0 and is scored like any other; null language
and source are values of their own; several labels of a key count by their mean, 0.5 upwards as good;
with no labels, fewer than 8 or labels of one class only, every document gets the share of good labels (1 without
any) and is kept accordingly; repeated rows each get their score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

#: Bound of the labelled sample for fitting; the part of it that is kept for calibration.
LABELLED, CALIBRATION = 6000, 4
#: Rounds of exchange, and rows that a view gives away in a round.
ROUNDS, GIVEN = 4, 200
#: Buckets of byte pairs, of sources and of languages.
PAIRS, SOURCES, LANGUAGES = 1024, 32, 8
#: Documents with a lower probability of good quality are rejected; below one half, as a clean document lost costs more.
KEEP = 0.35

# classes of bytes: other, line end, other white space, lower, upper, digit, mark, beyond ASCII
_CLASS = np.zeros(256, np.uint8)
_CLASS[10], _CLASS[[9, 11, 12, 13, 32]] = 1, 2
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 3, 4, 5, 7
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _CLASS[_a:_b] = 6


def content_features(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), np.uint8).astype(np.int32)
    if len(raw) < 2:
        return np.zeros(PAIRS, np.float32)
    pairs = (raw[:-1] * 59 + raw[1:] * 7) & (PAIRS - 1)
    return (np.bincount(pairs, minlength=PAIRS) * (32.0 / len(pairs))).astype(np.float32)


def metadata_features(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    text = text or ""
    raw = np.frombuffer(text.encode(), np.uint8)
    shares = np.bincount(_CLASS[raw], minlength=8) / max(1, len(raw))
    words = text.split()
    out = np.zeros(14 + LANGUAGES + SOURCES, np.float32)
    out[:8] = 4 * shares
    out[8] = np.log1p(len(raw)) / 10
    out[9] = len(text) / (len(words) + 1) / 10
    out[10] = len(set(words)) / (len(words) + 1)
    out[11] = text.count("|") / (len(words) + 1)
    out[12] = np.log1p(text.count("\n")) / 10
    out[13] = max(map(len, words), default=0) / 100
    out[14 + crc32((lang or "").encode()) % LANGUAGES] = 1
    out[14 + LANGUAGES + crc32((source or "").encode()) % SOURCES] = 1
    return out


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, steps: int = 150, decay: float = 1e-4) -> np.ndarray:
    """Weights (the last is the bias) by full-batch Adam; classes weigh the same together."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1]) if start is None else start.copy()
    good = max(1, int(y.sum()))
    weight = np.where(y == 1, 0.5 / good, 0.5 / max(1, len(y) - good))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = x.T @ ((_sigmoid(x @ w) - y) * weight) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _raw(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn raw scores into probabilities; Newton steps with Platt's smoothed targets."""
    good = y.sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    x, w = np.stack([z, np.ones_like(z)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - target) + 1e-6 * w)
    return float(w[0]), float(w[1])


class Model:
    """Two views with their calibration, and the weights of both."""

    def __init__(self, views: list[np.ndarray], platt: list[tuple[float, float]], both: np.ndarray):
        self.views, self.platt, self.both = views, platt, both

    def __call__(self, xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        logits = [a * _raw(x, w) + b for x, w, (a, b) in zip(xs, self.views, self.platt)]
        return _sigmoid(logits[0]), _sigmoid(logits[1]), _sigmoid(_raw(np.stack([np.clip(z, -12, 12) for z in logits], 1), self.both))


def cotrain(xs: list[np.ndarray], y: np.ndarray, surest: Callable, rounds: int = ROUNDS, given: int = GIVEN) -> Model:
    """``xs``: the two views of the labelled rows.

    ``surest(views, bad, good)`` gives for each of the two views what it is surest of and has not been given away: (features
    in both views, labels) of at most ``bad`` rows that it finds below one half and ``good`` above.
    """
    kept = np.arange(len(y)) % CALIBRATION == 0
    own = [([x[~kept]], [y[~kept]]) for x in xs]
    views: list = [None, None]
    share = float(y[~kept].mean())
    for r in range(rounds + 1):
        for v in (0, 1):
            views[v] = fit_logistic(np.concatenate(own[v][0]), np.concatenate(own[v][1]), views[v], 200 if r == 0 else 60)
        if r < rounds:
            for v, (features, labels) in enumerate(surest(views, max(1, round(given * (1 - share))), max(1, round(given * share)))):
                own[1 - v][0].append(features[1 - v])
                own[1 - v][1].append(labels)
    held = [_raw(x[kept], w) for x, w in zip(xs, views)]
    platt = [_platt(z, y[kept]) for z in held]
    both = np.stack([np.clip(a * z + b, -12, 12) for z, (a, b) in zip(held, platt)], 1)
    return Model(views, platt, fit_logistic(both, y[kept], np.array([0.5, 0.5, 0.0]), 100, 1e-3))


SIZES = (PAIRS, 14 + LANGUAGES + SOURCES)


def _views(part: pa.RecordBatch, text: str = "body", lang: str = "lang", source: str = "source") -> list[np.ndarray]:
    texts = part.column(text).to_pylist()
    rows = [content_features(t) for t in texts], [metadata_features(*r) for r in zip(texts, part.column(lang).to_pylist(), part.column(source).to_pylist())]
    return [np.stack(r) if r else np.zeros((0, n), np.float32) for r, n in zip(rows, SIZES)]


def _featured(rows: DataFrame) -> tuple[list[np.ndarray], np.ndarray, list]:
    """The two views of a bounded number of rows (``key``, ``body``, ``lang``, ``source``, ``y``), on the driver, with ``y`` and the keys."""
    def run(batches):
        for batch in batches:
            features = [pa.array(list(x), pa.list_(pa.float32())) for x in _views(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("y"), *features], ["key", "y", "content", "metadata"])

    got = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, y double, content array<float>, metadata array<float>").toArrow()
    views = [np.array(got.column(c).combine_chunks().flatten(), np.float32).reshape(got.num_rows, n) for c, n in zip(("content", "metadata"), SIZES)]
    return views, np.array(got.column("y").fill_null(0)).astype(np.int64), got.column("key").to_pylist()


def _view_scores(rows: DataFrame, views: list[np.ndarray]) -> DataFrame:
    """``key`` and the raw score of each view for all rows; 24 bytes a row."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                zs = [pa.array(_raw(x, w).astype(np.float64)) for x, w in zip(_views(part), views)]
                yield pa.RecordBatch.from_arrays([part.column("key"), *zs], ["key", "content", "metadata"])

    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, content double, metadata double")


def _meta(docs: DataFrame) -> list:
    """Language and source, null where the table has no such column."""
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
        labelled: int = LABELLED, rounds: int = ROUNDS, given: int = GIVEN) -> Model | float:
    """A model; or, where the labels cannot tell classes apart, the share of good ones."""
    spark = docs.sparkSession
    marks = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("key")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    marks = marks.orderBy(F.xxhash64("key"), "key").limit(labelled)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("body"), *_meta(docs))
    # of repeated keys any one; what is sent to join them is bounded
    some = rows.join(F.broadcast(marks), "key").dropDuplicates(["key"]).orderBy(F.xxhash64("key"))
    xs, y, _ = _featured(some)
    if len(y) < 2 * CALIBRATION or len(np.unique(y)) < 2 or len(np.unique(y[np.arange(len(y)) % CALIBRATION == 0])) < 2 or len(np.unique(y[np.arange(len(y)) % CALIBRATION > 0])) < 2:
        return float(y.mean()) if len(y) else 1.0
    marked = labels.where(F.col(key).isNotNull()).select(F.col(key).alias("key")).distinct()
    gone: set = set()  # at most 2 * given * rounds keys

    def surest(views, bad, good):
        free = written(_view_scores(rows.where("key is not null"), views).join(marked, "key", "left_anti"), "view-scores")
        picked: list[dict] = []
        for view in ("content", "metadata"):
            z, own = F.col(view), {}
            for label, most, there, order in ((0, bad, z < 0, F.asc(view)), (1, good, z > 0, F.desc(view))):
                # as many more as may be taken already
                top = free.where(there).select("key", view).distinct().orderBy(order, "key").limit(most + len(gone)).collect()
                found = dict.fromkeys(r["key"] for r in top if r["key"] not in gone and r["key"] not in own)
                own |= dict.fromkeys(list(found)[:most], label)
            gone.update(own)
            picked.append(own)
        keys = spark.createDataFrame([(k, float(y)) for own in picked for k, y in own.items()], f"key {rows.schema['key'].dataType.simpleString()}, y double")
        features, _, order = _featured(rows.join(F.broadcast(keys), "key").dropDuplicates(["key"]))
        at = {k: i for i, k in enumerate(order)}
        return [([x[[at[k] for k in sorted(own)]] for x in features], np.array([own[k] for k in sorted(own)], np.int64)) for own in picked]

    return cotrain(xs, y, surest, rounds, given)


def score(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """``docs`` with ``p_content``, ``p_metadata``, ``p_good`` and ``keep``."""
    names = docs.columns
    new = ["p_content", "p_metadata", "p_good", "keep"]
    if isinstance(model, float):
        return docs.withColumns({**{c: F.lit(model) for c in new[:3]}, "keep": F.lit(model >= KEEP)})
    rows = docs.select("*", *(c.alias(f"view_{n}") for n, c in zip(("lang", "source"), _meta(docs))))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "p_content double, p_metadata double, p_good double, keep boolean"])

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                a, b, p = model(_views(part, text, "view_lang", "view_source"))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], pa.array(a), pa.array(b), pa.array(p), pa.array(p >= KEEP)], [*names, *new])

    return rows.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text", "lang", "source"), model).drop("text", "lang", "source")
