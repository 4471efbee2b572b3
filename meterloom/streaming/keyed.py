"""Folds over the rows of a key in time order: replays within a time, and token buckets.

Rows are dealt by key and ordered by (key, time); a task walks them in batches and carries one key's
state from batch to batch. A key with any number of rows takes no more memory than any other, but it is one
task's, as each row depends on the one before. Rows without a key depend on none and stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType


def _fold(rows: DataFrame, key: str, order: list[str], make: Callable, outputs: list[StructField], carried: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with what ``make()(row values of order and carried)`` returns for each; one state a key, rows without a key alone.

    ``carried``: columns, alike in all rows of a key, with the state that the key had before.
    """
    schema = StructType([*rows.schema.fields, *outputs])
    names = [f.name for f in outputs]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, step = object(), None
        for batch in batches:
            out = []
            for k, *values in zip(batch[key], *(batch[c] for c in (*order, *carried))):
                if step is None or k != at:
                    at, step = k, make()
                out.append(step(*values))
            yield batch.assign(**{n: [o[i] for o in out] for i, n in enumerate(names)})

    keyed = rows.where(F.col(key).isNotNull()).repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)
    alone = rows.where(F.col(key).isNull()).select("*", *(F.lit(v).cast(f.dataType).alias(f.name) for f, v in zip(outputs, make()(0, None))))
    return keyed.unionByName(alone)


def first_seen(events: DataFrame, key: str = "idempotency_key", at_ns: str = "ts_ns", id_: str = "id", ttl_s: int = 300, since: str | None = None) -> DataFrame:
    """``events`` with ``accepted``: false for a repeat less than ``ttl_s`` after the last that was accepted.

    The time runs from the accepted event and repeats do not prolong it. Rows without a key are accepted.
    ``since``: a column with the time at which a key was accepted before, negative for never.
    """
    def make():
        last = None

        def step(ts, _, before=-1):
            nonlocal last
            if last is None and before >= 0:
                last = before
            if last is not None and ts - last < ttl_s * 10**9:
                return (False,)
            last = ts
            return (True,)

        return step

    return _fold(events, key, [at_ns, id_], make, [StructField("accepted", BooleanType())], (since,) if since else ())


def token_bucket(calls: DataFrame, rps: float, burst: float, key: str = "api_key_id", at_ns: str = "ts_ns", id_: str = "id", had: tuple[str, str] | None = None, left: str | None = None) -> DataFrame:
    """``calls`` with ``admitted`` and ``wait_s``, what a rejected call must wait. Calls without a key are admitted.

    ``had``: columns with the tokens that a key had before and the time of that, negative for a key that is new.
    ``left``: a column to add, the tokens of the key after the call.
    """
    def make():
        tokens, last = float(burst), None

        def step(ts, _, before=0.0, before_at=-1):
            nonlocal tokens, last
            if last is None and before_at >= 0:
                tokens, last = before, before_at
            if last is not None:
                tokens = min(burst, tokens + max(ts - last, 0) / 1e9 * rps)
            last = ts if last is None else max(ts, last)
            if admitted := tokens >= 1:
                tokens -= 1
            return admitted, 0.0 if admitted else (1 - tokens) / rps, tokens

        return step

    outputs = [StructField("admitted", BooleanType()), StructField("wait_s", DoubleType()), *([StructField(left, DoubleType())] if left else [])]
    return _fold(calls, key, [at_ns, id_], make, outputs, had or ())
