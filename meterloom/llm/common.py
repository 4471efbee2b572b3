"""What the training-data operators share: reading tables, the shared folder, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of a few fixed-width columns (hashes, ids, counts) that may be broadcast: 200,000
#: rows of at most 100 bytes are 20 MB. Beyond it the same join is left to a shuffle.
BROADCAST_ROWS = 200_000
#: Keys that are treated as hot at most, and rows that a key has at least then.
HOT_KEYS, HOT_ROWS = 100_000, 100


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session without that setting (a local test) gets a folder of its own.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="meterloom-"))
    return sc.getCheckpointDir().rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    A lost executor then costs the tasks of one later stage, not everything before the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (a shuffle join).

    ``df`` is counted, so pass a table that is written or checkpointed.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def joined(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``table`` (written; one row a key, with ``n``, the rows of ``rows`` that have it), whatever keys are hot.

    Of ``total`` rows, at most ``HOT_KEYS`` keys have over a ``HOT_KEYS``th each. These are broadcast, and
    their rows stay where they are; only the others are shuffled by the key. ``n`` is dropped.
    """
    hot = F.col("n") > max(HOT_ROWS, total // HOT_KEYS)
    most, rest = F.broadcast(table.where(hot).drop("n")), table.where(~hot).drop("n")
    return rows.join(most, key).unionByName(rows.join(most.select(key), key, "left_anti").join(rest, key))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hex16(col: Column) -> Column:
    """A bigint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


class Kept(dict):
    """A bounded table of what a worker has worked out: two generations, the older dropped when the newer is full.

    ``missing(keys)`` gives the keys to work out and put in; afterwards all ``keys`` are in the table.
    """

    def __init__(self, bound: int):
        super().__init__()
        self.bound, self.old = bound, {}

    def missing(self, keys: set) -> list:
        if len(self) > self.bound:
            self.old = dict(self)
            self.clear()
        old = self.old
        for k in (new := keys - self.keys()) & old.keys():
            self[k] = old.pop(k)
        return [k for k in new if k not in self]
