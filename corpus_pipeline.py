"""From ``documents`` to token ids: five stages, each written and read again before the next.

Each stage calls one operator of ``meterloom.llm`` on all that the stage before kept, and all but the
last return the columns of ``documents``. Rejected are: documents of low quality, all but one of each
near-duplicate group, and documents that hold a benchmark item. Secrets are blanked out, not the
documents that hold them. SQL can express none of the first, second, third and fifth, so there is no
``ORACLE_SQL``; the tests hold the rows against brute force.

Defined results: null and empty texts pass the stages like any other; as their fingerprints are zero they are one
near-duplicate group, of which one row stays, with no token. Rows with a null key are kept and dropped like others;
of repeated rows one stays. Columns beyond those of the table stay until the last stage, whatever their
names. Without labels all documents are kept by the first stage, without benchmark items by the third; an empty
table of documents gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterloom.llm import bpe_sql, cotrain, secret_ledger, simhash_vp, tiling
from meterloom.llm.common import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    model = cotrain.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.score(docs, model).where("keep").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group whose SimHash fingerprints are linked."""
    return simhash_vp.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which tiles cover no benchmark item."""
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets blanked out."""
    return secret_ledger.clean(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether decoding them gives its text back."""
    import public_tokenizers

    return bpe_sql.tokenized(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN).drop("text")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("secrets", secrets), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
