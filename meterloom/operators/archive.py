"""Archives: chunks of a user's day as zstd JSON lines, a manifest of them, and reads of live and archived events together.

A chunk is one object, ``user/day/run-number.jsonl.zst``, that the task which has its rows writes under another name, moves
into place, and reads again. Its outcome is a row, its figures or what went wrong, and only chunks with
figures come into the manifest: events of the others stay live. Reads open the objects that the manifest names, in
tasks, and give a row of error for each that cannot be used; nothing lists folders. A task that runs again writes the same objects.

Objects are read and written by Arrow's file systems, so a place is a path or a URL that they know.
"""

from __future__ import annotations

import gzip
import io
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.times import DAY, SECOND, day_text
from ..schema import EVENT, MANIFEST
from .filters import EventFilter, day_of

#: Events of the largest chunk, and slots of a day in which events are numbered.
CHUNK, SLOTS = 10_000, 96
#: Bytes of the largest chunk that is read, unpacked; level of compression.
MOST, LEVEL = 100 << 20, 3
#: Rows of a batch that a task gives back: outcomes of chunks written, events of chunks read.
ROWS = 2000
OUTCOME = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in MANIFEST.fields) + ", error string"


def _place(url: str):
    """(file system, path) of a place."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def unpacked(packed: bytes, most: int = MOST) -> bytes:
    """What zstd or gzip has packed; an error beyond ``most`` bytes, before more is unpacked."""
    import zstandard

    source = gzip.GzipFile(fileobj=io.BytesIO(packed)) if packed[:2] == b"\x1f\x8b" else zstandard.ZstdDecompressor().stream_reader(packed, read_across_frames=True)
    out = source.read(most + 1)
    if len(out) > most:
        raise ValueError(f"more than {most} bytes")
    return out


def _folder(name: str) -> str:
    """A name as one level of a path or a URL, whatever is in it."""
    return quote(name, safe="").replace("~", "~7E").replace(".", "~2E").replace("%", "~")


def _put(place: str, lines: list[str]) -> int:
    """Write an object whole or not at all, and read it again; its bytes."""
    import zstandard

    text = "".join(line + "\n" for line in lines).encode()
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(text)
    fs, path = _place(place)
    folder, _, name = path.rpartition("/")
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    fs.create_dir(folder, recursive=True)
    with fs.open_output_stream(part, compression=None) as out:
        out.write(packed)
    fs.move(part, path)
    with fs.open_input_stream(path, compression=None) as back:
        if unpacked(back.read(), len(text)) != text:
            raise OSError("what was read back differs")
    return len(packed)


def _chunk_writer(root: str, run: str, created_at: int):
    """Writes the chunks of a task, whose rows come chunk by chunk, and gives a row of outcome for each."""
    def outcome(key: tuple, lines: list[str], times: list[int]) -> dict:
        user, day, number = key
        place = f"{root}/{_folder(user)}/{day}/{run}-{number}.jsonl.zst"
        row = {"archive_id": f"{run}-{user}-{day}-{number}", "user_id": user, "day": day, "s3_key": place, "event_count": len(lines),
               "min_ts_ns": min(times), "max_ts_ns": max(times), "created_at": created_at, "compressed_bytes": None, "error": None}
        try:
            return row | {"compressed_bytes": _put(place, lines)}
        except Exception as e:  # whatever the place throws: the other chunks go on
            return row | {"error": f"{type(e).__name__}: {e}"[:1000]}

    def run_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "bigint": pa.int64()}
        fields = pa.schema([(f.split()[0], types[f.split()[1]]) for f in OUTCOME.split(", ")])
        key, lines, times, done = None, [], [], []
        for batch in batches:
            for own, line, at in zip(zip(*(batch.column(c).to_pylist() for c in CHUNK_KEYS)), batch.column("line").to_pylist(), batch.column("ts_ns").to_pylist()):
                if own != key and lines:
                    done.append(outcome(key, lines, times))
                    lines, times = [], []
                    if len(done) == ROWS:  # a batch of one row takes Spark longer than its chunk
                        yield pa.RecordBatch.from_pylist(done, schema=fields)
                        done = []
                key = own
                lines.append(line)
                times.append(at)
        if lines:
            done.append(outcome(key, lines, times))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=fields)

    return run_task


def _tasks(spark: SparkSession) -> int:
    """How many tasks write or read objects. Given as a number, as rows that are few bytes would else be put together in a few tasks, however many objects they stand for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


CHUNK_KEYS = ["archive_user", "archive_day", "archive_chunk"]


def write_chunks(events: DataFrame, root: str, created_at: int, chunk: int = CHUNK) -> DataFrame:
    """Write ``events`` below ``root`` and return the outcomes: rows of a manifest with ``error``, null for a chunk that is there.

    Events are numbered in the order of time inside a user's day, so a day of any size is cut into chunks of at most
    ``chunk`` events that follow each other. The numbers are made in slots of the day and moved up by the counts of the
    slots before, so no task orders a whole day. The outcomes are written below ``root`` once, with the objects.
    """
    spark = events.sparkSession
    run = uuid.uuid4().hex
    user = F.when(F.coalesce("user_id", F.lit("")) == "", "_none").otherwise(F.col("user_id"))
    line = F.to_json(F.struct(*(F.col(c) for c in events.columns)))
    rows = events.select("ts_ns", "id", line.alias("line"), user.alias("archive_user"), day_text().alias("archive_day"), F.floor(F.pmod("ts_ns", F.lit(DAY * SECOND)) / F.lit(DAY * SECOND // SLOTS)).cast("int").alias("archive_slot"))
    keys = ["archive_user", "archive_day", "archive_slot"]
    before = Window.partitionBy(*keys[:2]).orderBy("archive_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ts_ns", "id")) - 1
    rows = rows.withColumn("archive_nth", nth).join(starts, keys)
    rows = rows.withColumn("archive_chunk", F.floor((F.col("start") + F.col("archive_nth")) / F.lit(chunk)).cast("long"))
    # by a plain hash, as a rebalance may deal one chunk to two tasks
    rows = rows.repartition(_tasks(spark), *CHUNK_KEYS).sortWithinPartitions(*CHUNK_KEYS, "ts_ns", "id").select(*CHUNK_KEYS, "ts_ns", "line")
    rows.mapInArrow(_chunk_writer(root, run, created_at), OUTCOME).write.json(f"{root}/_outcomes/{run}")
    return spark.read.schema(OUTCOME).json(f"{root}/_outcomes/{run}")


def append_manifest(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest rows; lines that are no JSON are skipped."""
    return spark.read.schema(MANIFEST).option("mode", "DROPMALFORMED").json(path).where("archive_id is not null")


def _overlapping(manifests: DataFrame, user_id: str | None, from_ns: int | None, to_ns: int | None) -> DataFrame:
    rows = manifests
    if user_id is not None:
        rows = rows.where(F.col("user_id") == user_id)
    if from_ns is not None:
        rows = rows.where(F.col("max_ts_ns") >= from_ns)
    if to_ns is not None:
        rows = rows.where(F.col("min_ts_ns") <= to_ns)
    return rows


def overlapping(manifests: DataFrame, user_id: str | None = None, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """Archives of a user whose events may lie in the interval, oldest first."""
    return _overlapping(manifests, user_id, from_ns, to_ns).orderBy("min_ts_ns", "archive_id")


def any_overlap(manifests: DataFrame, user_id: str | None = None, from_ns: int | None = None, to_ns: int | None = None) -> DataFrame:
    """One row, ``archived``: whether any archive's events may lie in the interval."""
    found = _overlapping(manifests, user_id, from_ns, to_ns).limit(1)
    return found.agg((F.count(F.lit(1)) > 0).alias("archived"))


def _objects(place: str, most: int) -> bytes:
    """The text of a chunk: an object, or, of older archives, a folder of them."""
    from pyarrow import fs as files

    fs, path = _place(place)
    found = [path]
    if fs.get_file_info(path).type == files.FileType.Directory:
        found = sorted(f.path for f in fs.get_file_info(files.FileSelector(path)) if not f.base_name.startswith((".", "_")))
    out = b""
    for one in found:
        with fs.open_input_stream(one, compression=None) as source:
            out += unpacked(source.read(), most - len(out))
    return out


def _chunk_reader(most: int):
    names = ["archive_id", "line", "error"]

    def rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for own, place, count in zip(*(batch.column(c).to_pylist() for c in ("archive_id", "s3_key", "event_count"))):
                error, lines = None, []
                try:
                    lines = [x for x in _objects(place, most).decode().split("\n") if x]
                    if count is not None and len(lines) != count:
                        raise ValueError(f"{len(lines)} events where the manifest has {count}")
                except Exception as e:  # of a chunk that cannot be used no event is read
                    error, lines = f"{type(e).__name__}: {e}"[:1000], [None]
                for line in lines:
                    held.append((own, line, error))
                    if len(held) == ROWS:
                        yield rows(held)
                        held = []
        if held:
            yield rows(held)

    return run


def read_all(spark: SparkSession, manifests: DataFrame, most: int = MOST) -> DataFrame:
    """Events of the archives with ``archive_id`` and ``archive_error``; of a chunk that is missing, garbled, longer than ``most`` bytes or of another count, one row with the error only.

    A line that is no event is an error of its own row; the others of its chunk are read.
    """
    # dealt out first: after dropDuplicates Spark leaves the same repartition away
    rows = manifests.select("archive_id", "s3_key", "event_count").repartition(_tasks(spark), "archive_id").dropDuplicates(["archive_id"])
    rows = rows.mapInArrow(_chunk_reader(most), "archive_id string, line string, error string")
    rows = rows.withColumn("e", F.from_json("line", EVENT)).withColumn("error", F.coalesce("error", F.when(F.col("e.id").isNull() | F.col("e.ts_ns").isNull(), "a line that is no event")))
    return rows.select(*(F.when(F.col("error").isNull(), F.col("e")[n]).alias(n) for n in EVENT.names), "archive_id", F.col("error").alias("archive_error"))


def read_chunks(spark: SparkSession, manifests: DataFrame, skip_bad: bool = False) -> DataFrame:
    """Events of the archives. A chunk that cannot be used fails the query, or, with ``skip_bad``, is left out; ``read_all`` says which it is."""
    rows = read_all(spark, manifests)
    if skip_bad:
        return rows.where("archive_error IS NULL").select(*EVENT.names)
    said = F.raise_error(F.concat(F.lit("archive chunk "), F.col("archive_id"), F.lit(": "), F.col("archive_error")))
    return rows.where(F.when(F.col("archive_error").isNotNull(), said.cast("boolean")).otherwise(True)).select(*EVENT.names)


def candidates(events: DataFrame, cutoff_ns: int) -> DataFrame:
    """What is old enough to be archived."""
    return events.where(F.col("ts_ns") <= cutoff_ns)


def live_and_archived(live: DataFrame, archived: DataFrame, which: EventFilter) -> DataFrame:
    """Both under the whole filter, an event that is in both once: the live row. Only ids of live events are shuffled."""
    names = [c for c in archived.columns if c in live.columns]
    live = which.apply(live)
    old = which.apply(archived).select(*names).dropDuplicates(["id"])  # two runs may have archived it
    return live.select(*names).unionByName(old.join(live.select("id"), "id", "left_anti"))


def events_of(live: DataFrame, manifests: DataFrame, which: EventFilter) -> DataFrame:
    """Live and archived events that match, of the archives only those that the manifest says may hold some."""
    user = "_none" if which.user_id == "" else which.user_id
    return live_and_archived(live, read_chunks(live.sparkSession, _overlapping(manifests, user, which.from_ns, which.to_ns)), which)


def archive(store, root: str, manifest_path: str, cutoff_ns: int, created_at: int, chunk: int = CHUNK) -> dict[str, int]:
    """Write, read back, record, and only then delete what was recorded: whatever fails leaves its events live.

    Says how many events and chunks were archived, with how many bytes, and how many events failed, to be tried again by the next run.
    """
    rows = candidates(store.read(EventFilter(to_ns=cutoff_ns)), cutoff_ns)
    outcomes = write_chunks(rows.drop("day"), root, created_at, chunk)
    made = outcomes.where("error IS NULL").drop("error")
    append_manifest(made, manifest_path)
    store.delete(read_chunks(store.spark, made).select("id"), counted=True)
    good = F.col("error").isNull()
    sums = {"archived": F.sum(F.when(good, F.col("event_count"))), "chunks": F.sum(good.cast("long")), "compressed_bytes": F.sum("compressed_bytes"), "failed": F.sum(F.when(~good, F.col("event_count")))}
    return outcomes.agg(*(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in sums.items())).first().asDict()


def reachable(spark: SparkSession, root: str) -> bool:
    """Whether the place of the archives answers; one where nothing has been written yet does."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    except Exception:  # whatever the file system of the place throws
        return False
    return True


def due(store, cutoff_ns: int, most_bytes: int | None = None) -> bool:
    """Whether to archive: some day is wholly older than the cutoff, or the store is larger than ``most_bytes``."""
    return any(day < day_of(cutoff_ns) for _, day in store.partitions()) or most_bytes is not None and store.size_bytes() > most_bytes
