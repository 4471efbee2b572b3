"""Replays and token buckets of a stream, with the state of a key in Spark's state store.

A key's rows of a micro-batch are put in the order of time and walked from the state that the micro-batch before
left; what a key needs is one row of state. A timer at the time when that row says no more than a new key's
(the idempotency time is over, the bucket is full again) takes it out. Timers follow the event time of
the stream's newest row less ``lateness``, so state goes by the time of the calls, not by that of the machine that reads
them, and a backlog that is read late decides as it would have then.

The watermark moves timers only: its column is dropped before the state, so rows that come late
are decided like others. A row without a key has no state; such rows are spread over ``SPREAD`` groups.
A micro-batch is sorted by (time, id); rows that a later micro-batch brings count as later, as they would at a service.

A walk looks at the time and the id of a row only, and a row that goes to the state alone costs far more than its decision. A key's
rows are therefore packed: one row with their times and ids and, as Arrow bytes that the walk hands on unread, all their columns.
A pack has at most ``PACK_ROWS`` rows and about ``PACK_BYTES``, a task packs at most ``HELD_ROWS`` or ``HELD_BYTES`` at once, and a key may have any number of packs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, LongType, StructField, StructType

SPREAD, SALT = 256, "spread_of_no_key"
TIMES, IDS, PACK = "times_of_pack", "ids_of_pack", "rows_of_pack"
PACK_ROWS, PACK_BYTES, HELD_ROWS, HELD_BYTES = 10_000, 2**22, 500_000, 2**26
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB, which timers need, and run no micro-batch for timers alone: those go off with the next rows."""
    settings = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


class Walk(StatefulProcessor):
    """Rows of a key in order. ``step`` decides a row and gives the new state, ``until`` the time in ns at which the state is over."""

    state = ""

    def __init__(self, at_ns: str, id_: str, outputs: list[str]):
        self.order, self.outputs = [at_ns, id_], outputs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", f"{self.state}, wakes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        if key[0] is None:
            found = self.alone()
            for row in rows:
                yield self.decided(row, found)
            return
        own = sorted(rows, key=lambda row: tuple((row[c] is None, row[c]) for c in self.order))
        for row, found in zip(own, self.walked([row[self.order[0]] for row in own])):
            yield self.decided(row, found)

    def walked(self, times: list) -> list[tuple]:
        """What is found for each row of the key, and the state after them in the store."""
        before, out = self.held.get(), []
        had, wakes = (tuple(before[:-1]), before[-1]) if before is not None else (None, None)
        for at in times:
            had, found = self.step(had, at)
            out.append(found)
        wake = -(-self.until(had) // 10**6)
        if wake != wakes:
            if wakes is not None:
                self.handle.deleteTimer(wakes)
            self.handle.registerTimer(wake)
        if before is None or tuple(before) != (*had, wake):
            self.held.update((*had, wake))
        return out

    def decided(self, row: Row, found: tuple) -> Row:
        """A row, whose last column is the salt, with what was found."""
        return Row(*row.__fields__[:-1], *self.outputs)(*row[:-1], *found)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held = self.held.get()
        if held is not None and held[-1] <= expiredTimerInfo.getExpiryTimeInMs():
            self.held.clear()
        yield from ()

    def close(self) -> None:
        pass


class Replays(Walk):
    state = "at_ns long"

    def __init__(self, at_ns: str, id_: str, ttl_ns: int):
        super().__init__(at_ns, id_, ["accepted"])
        self.ttl_ns = ttl_ns

    def alone(self):
        return (True,)

    def step(self, had, at):
        new = had is None or at - had[0] >= self.ttl_ns
        return ((at,) if new else had), (new,)

    def until(self, had):
        return had[0] + self.ttl_ns


class Buckets(Walk):
    state = "tokens double, at_ns long"

    def __init__(self, at_ns: str, id_: str, rps: float, burst: float):
        super().__init__(at_ns, id_, ["admitted", "wait_s"])
        self.rps, self.burst = rps, float(burst)

    def alone(self):
        return True, 0.0

    def step(self, had, at):
        tokens, last = had or (self.burst, at)
        tokens = min(self.burst, tokens + max(at - last, 0) / 1e9 * self.rps)
        taken = tokens >= 1
        return (tokens - taken, max(at, last)), (taken, 0.0 if taken else (1 - tokens) / self.rps)

    def until(self, had):
        return had[1] + int((self.burst - had[0]) / self.rps * 1e9) + 1


class PackedWalk(StatefulProcessor):
    """A walk over the packs of a key: each comes out with what was found for its rows, a list for each column."""

    def __init__(self, walk: Walk):
        self.walk = walk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.walk.init(handle)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        out = Row(PACK, *self.walk.outputs)
        if key[0] is None:
            found = self.walk.alone()
            for pack in rows:
                yield out(pack[PACK], *([f] * len(pack[TIMES]) for f in found))
            return
        packs = list(rows)
        own = sorted((at is None, at, id_ is None, id_, p, i) for p, pack in enumerate(packs) for i, (at, id_) in enumerate(zip(pack[TIMES], pack[IDS])))
        found = [[[None] * len(pack[TIMES]) for _ in self.walk.outputs] for pack in packs]
        for (*_, p, i), values in zip(own, self.walk.walked([call[1] for call in own])):
            for column, value in zip(found[p], values):
                column[i] = value
        for pack, columns in zip(packs, found):
            yield out(pack[PACK], *columns)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.walk.handleExpiredTimer(key, timerValues, expiredTimerInfo)

    def close(self) -> None:
        self.walk.close()


def packing(key: str, at_ns: str, id_: str, pack_rows: int, pack_bytes: int, held_rows: int, held_bytes: int) -> Callable:
    """For ``mapInArrow``: rows as packs of one key and salt."""
    def packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held).combine_chunks()
        groups = rows[key].combine_chunks().dictionary_encode("encode").indices.to_numpy() * np.int64(SPREAD) + rows[SALT].to_numpy()
        order = np.argsort(groups, kind="stable")
        rows, groups, most = rows.take(order).combine_chunks(), groups[order], max(1, min(pack_rows, pack_bytes * rows.num_rows // max(rows.nbytes, 1)))
        first = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        cuts = [c for a, b in zip(first, np.append(first[1:], len(groups))) for c in range(a, b, most)]
        inner, bodies = rows.drop_columns([SALT]).to_batches()[0], []
        for a, b in zip(cuts, [*cuts[1:], len(groups)]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, inner.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
                writer.write_batch(inner.slice(a, b - a))
            bodies.append(sink.getvalue().to_pybytes())
        ends = pa.array([*cuts, len(groups)], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, rows[c].combine_chunks()) for c in (at_ns, id_)]
        heads = rows.select([key, SALT]).take(cuts).combine_chunks()
        whole = pa.table([*heads.columns, *lists, pa.array(bodies, pa.binary())], [key, SALT, TIMES, IDS, PACK])
        size = max(1, held_bytes // 8 * len(cuts) // max(whole.nbytes, 1))
        yield from whole.to_batches(max_chunksize=size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, size = [], 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            n, size = n + batch.num_rows, size + batch.nbytes
            if n >= held_rows or size >= held_bytes:
                yield from packed(held)
                held, n, size = [], 0, 0
        if held:
            yield from packed(held)

    return run


def unpacking(outputs: list[str], at_once: int) -> Callable:
    """For ``mapInArrow``: the rows of packs again, with what was found for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, start, held, n = [batch.column(o).flatten() for o in outputs], 0, [], 0
            for i, body in enumerate(batch.column(PACK)):
                held.append(pa.ipc.open_stream(body.as_buffer()).read_all())
                n += held[-1].num_rows
                if n >= at_once or i == batch.num_rows - 1:
                    rows = pa.concat_tables(held).combine_chunks()
                    for name, values in zip(outputs, found):
                        rows = rows.append_column(name, values.slice(start, n))
                    yield from rows.to_batches(max_chunksize=at_once)
                    start, held, n = start + n, [], 0

    return run


def _walked(rows: DataFrame, key: str, walk: Walk, outputs: list[StructField], lateness: str | None) -> DataFrame:
    timed, types = rows, rows.schema
    at, id_ = walk.order
    if lateness:
        timed = rows.withColumn("_event_time", F.timestamp_micros(F.expr(f"`{at}` div 1000"))).withWatermark("_event_time", lateness)
    salt = F.when(F.col(key).isNull(), F.pmod(F.xxhash64(id_), F.lit(SPREAD))).otherwise(F.lit(0)).alias(SALT)
    packs = StructType([StructField(key, types[key].dataType), StructField(SALT, LongType()), StructField(TIMES, ArrayType(types[at].dataType)), StructField(IDS, ArrayType(types[id_].dataType)), StructField(PACK, BinaryType())])
    found = StructType([StructField(PACK, BinaryType()), *(StructField(o.name, ArrayType(o.dataType)) for o in outputs)])
    packed = timed.select(*rows.columns, salt).repartition(key, SALT).mapInArrow(packing(key, at, id_, PACK_ROWS, PACK_BYTES, HELD_ROWS, HELD_BYTES), packs)
    decided = packed.groupBy(key, SALT).transformWithState(PackedWalk(walk), found, "Append", "EventTime")
    return decided.mapInArrow(unpacking([o.name for o in outputs], PACK_ROWS), StructType([*types.fields, *outputs]))


def first_seen(rows: DataFrame, key: str = "idempotency_key", at_ns: str = "ts_ns", id_: str = "id", ttl_s: int = 300, lateness: str | None = "1 hour") -> DataFrame:
    """Streaming ``rows`` with ``accepted``: false for a repeat less than ``ttl_s`` after the last that was accepted.

    Start it inside ``rocksdb``. ``lateness``: null where a walk before has set the watermark.
    """
    return _walked(rows, key, Replays(at_ns, id_, ttl_s * 10**9), [StructField("accepted", BooleanType())], lateness)


def token_bucket(rows: DataFrame, rps: float, burst: float, key: str = "api_key_id", at_ns: str = "ts_ns", id_: str = "id", lateness: str | None = "1 hour") -> DataFrame:
    """Streaming ``rows`` with ``admitted`` and ``wait_s``, what a rejected call must wait. Start it inside ``rocksdb``."""
    return _walked(rows, key, Buckets(at_ns, id_, rps, burst), [StructField("admitted", BooleanType()), StructField("wait_s", DoubleType())], lateness)
