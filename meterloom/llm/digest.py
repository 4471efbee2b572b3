"""Operator 10, canonical exact digests of documents. DataFrame functions only.

The canonical form of a text is NFKC, full case folding, NFKC again, every run of white space as one
space, trimmed. The fingerprint is two XXH64 lanes of it (32 hex digits). ``classes`` groups by the
fingerprint and compares the canonical bytes inside every bucket that has more than one row, so that
two texts of one class are equal in canonical form whatever the hash does.

Defined results: a null text is an empty one; repeated rows and equal texts share a class, which is
named by its smallest key; a table of one row is its own next row; an empty table gives an empty
result. A digest knows equal and unequal only, so the likeness of two fingerprints is 1 or 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, documents, hex16, shuffle_partitions, written


def canonical(text: Column) -> Column:
    """Canonical form, through the ICU library that Spark ships for its collations."""
    def nfkc(c):
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"[\s\p{Z}\x1c-\x1f\x85]+", " "))


def lanes(canon: Column) -> Column:
    return F.struct(F.xxhash64(canon).alias("h1"), F.xxhash64(F.lit("second lane"), canon).alias("h2"))


def hexed(h: Column) -> Column:
    return F.concat(hex16(h["h1"]), hex16(h["h2"]))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """Classes of equal canonical texts with two rows or more.

    Returns ``(h1, h2, class_id, class_size)`` and, only if the byte comparison ever finds different
    texts under one hash, ``(key, h1, h2, class_id, class_size)`` for the rows of those buckets.
    Copies of a text are folded before the shuffle, so a text that a third of all rows share is a
    row a task.
    """
    # two steps, as an expression through reflection must not be copied into both lanes
    canon = docs.select(F.col(key).alias("key"), canonical(F.col(text)).alias("canon"))
    rows = canon.select("key", "canon", lanes(F.col("canon")).alias("h")).select("key", "canon", "h.h1", "h.h2")
    buckets = rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h1", "h2")
    buckets = written(buckets, "buckets")
    shared = rows.join(broadcast_if_small(buckets), ["h1", "h2"], "left_semi")
    texts = shared.groupBy("h1", "h2", "canon").agg(F.min("key").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    found = written(
        texts.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_texts"), F.min("class_id").alias("class_id"), F.sum("class_size").alias("class_size")),
        "classes",
    )
    split = found.where("n_texts > 1").select("h1", "h2")
    sure = found.where("n_texts = 1").select("h1", "h2", "class_id", "class_size")
    if split.isEmpty():
        return sure, None
    apart = shared.join(split, ["h1", "h2"], "left_semi").join(texts, ["h1", "h2", "canon"])
    return sure, apart.where("class_size > 1").select("key", "h1", "h2", "class_id", "class_size").distinct()


def with_next(docs: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """``docs`` with ``next``, a struct of ``carried`` of the next row by descending key; after the last the first.

    The keys are cut at approximate quantiles into more ranges than there are shuffle partitions;
    each is ordered on its own, and its last row takes the first row of the next range.
    """
    n = 4 * shuffle_partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx(key, [i / n for i in range(1, n)], 10 * n).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    bounds = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<bigint>")
    ranged = docs.withColumn("range", F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col(key))), F.lit(0)))
    order = Window.partitionBy("range").orderBy(F.desc_nulls_last(key), *carried)
    took = F.struct(*carried)
    ordered = ranged.select("*", F.lead(took).over(order).alias("next"), F.row_number().over(order).alias("nth"))
    heads = ordered.where("nth = 1").select("range", took.alias("head"))
    along = Window.orderBy(F.desc("range"))
    back = heads.select("range").select(
        "range", F.coalesce(F.lead("range").over(along), F.max("range").over(Window.partitionBy())).alias("then")
    )
    then = back.join(heads.withColumnRenamed("range", "then"), "then").select(F.col("range").alias("of"), "head")
    joined = ordered.join(then, (F.col("range") == F.col("of")) & F.col("next").isNull(), "left")
    return joined.withColumn("next", F.coalesce("next", "head")).drop("of", "head", "nth", "range")


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.select("*", canonical(F.col("text")).alias("canon")).select("doc_id", "text", lanes(F.col("canon")).alias("h"))
    rows = with_next(rows, "doc_id", ["text", "h"])
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.select(
        "doc_id", "h", n.cast("long").alias("n_chars"), F.col("next.h").alias("next_h"),
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next.text", F.lit(1), half)).alias("edited"),
    )
    rows = rows.select("*", canonical(F.col("edited")).alias("canon"))
    rows = rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        hexed(F.col("h")).alias("fingerprint"), lanes(F.col("canon")).alias("edited_h"), "h", "next_h",
    )
    rows = rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", hexed(F.col("edited_h")).alias("edited_fingerprint"),
        (F.col("h") == F.col("edited_h")).cast("double").alias("near_edited"),
        (F.col("h") == F.col("next_h")).cast("double").alias("near_next"),
        F.col("h.h1").alias("h1"), F.col("h.h2").alias("h2"),
    )
    sure, apart = classes(docs)
    rows = rows.join(broadcast_if_small(sure), ["h1", "h2"], "left")
    if apart is not None:
        apart = apart.select(F.col("key").alias("doc_id"), "h1", "h2", F.col("class_id").alias("own_id"), F.col("class_size").alias("own_size"))
        rows = rows.join(apart, ["doc_id", "h1", "h2"], "left").withColumns(
            {"class_id": F.coalesce("own_id", "class_id"), "class_size": F.coalesce("own_size", "class_size")}
        ).drop("own_id", "own_size")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
        F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
    )
