"""The event store: Parquet by tier and day, a table of tombstones, retention by dropping partitions.

Deleting writes a tombstone; reads leave tombstoned ids out by an anti join. Erasing and garbage collection
are jobs over partitions. What a stream has written, ``batch=N/tier=.../day=...``, is read, deleted and dropped like the rest.

The rollup is a table of its own. A tombstone holds what its event had added to the rollup, written with the id in one
commit, so a rollup is corrected by what was deleted without reading an event; archiving and retention leave its sums as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.times import DAY, SECOND, day_text
from ..schema import EVENT, ROLLUP_KEYS, ROLLUP_SUMS
from .aggregates import rollup
from .filters import DEFAULT_EVENTS, EventFilter, day_of, newest

#: Columns of an event that the rollup counts; in a tombstone they are null if the event stays counted.
COUNTED = ["ts_ns", *ROLLUP_KEYS[1:], "is_error", *ROLLUP_SUMS[2:]]
TOMBSTONES = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EVENT.fields if f.name in ("id", *COUNTED))
#: Ids up to which the tombstones are broadcast to the readers instead of shuffled with the events.
BROADCAST_IDS = 200_000
#: Tiers that always exist.
TIERS = ("free", "pro", "team")


class StorageFull(RuntimeError):
    pass


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    root: str
    max_bytes: int | None = None

    @property
    def events_path(self) -> str:
        return f"{self.root}/events"

    @property
    def tombstones_path(self) -> str:
        return f"{self.root}/tombstones"

    # writing

    def check_room(self) -> None:
        if self.max_bytes is not None and self.size_bytes() >= self.max_bytes:
            raise StorageFull(f"the store has {self.max_bytes} bytes or more")

    def append(self, events: DataFrame) -> None:
        """One commit; what it wrote is visible after it and only then. Rows of a day are put together, large days in several files."""
        self.check_room()
        rows = events.withColumn("day", day_text()).withColumn("tier", F.coalesce(F.nullif("tier", F.lit("")), F.lit("free")))
        rows = rows.hint("rebalance", "tier", "day").sortWithinPartitions("tier", "day", "ts_ns")
        rows.write.mode("append").partitionBy("tier", "day").option("compression", "zstd").option("parquet.bloom.filter.enabled#id", "true").option("parquet.bloom.filter.enabled#user_id", "true").parquet(self.events_path)

    def delete(self, ids: DataFrame, counted: bool = False) -> dict[str, int]:
        """Tombstones for the live events with the ids; ids that are unknown or deleted already do no harm. Says how many were asked for and how many were there.

        ``counted``: the rollup goes on counting them, as those that are archived.
        """
        ids = ids.select(F.col("id").cast("string").alias("id"))
        return {"asked": ids.count(), "deleted": self._bury(self.read().join(ids.distinct(), "id", "left_semi"), counted)}

    def erase_user(self, user_id: str) -> int:
        """Tombstones for all live events of a user, in one pass, which also take them out of the rollup; archives keep theirs."""
        return self._bury(self.read(EventFilter(user_id=user_id)), False)

    def _bury(self, rows: DataFrame, counted: bool) -> int:
        n = Observation()
        rows = rows.select("id", *(F.lit(None).cast(EVENT[c].dataType).alias(c) if counted else F.col(c) for c in COUNTED))
        rows.observe(n, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(self.tombstones_path)
        return n.get["n"]

    def taken(self) -> DataFrame:
        """The cube of all that was deleted and is no longer counted, each event once."""
        return rollup(self.tombstones().where("ts_ns IS NOT NULL").dropDuplicates(["id"]))

    # reading

    def _table(self, path: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def tombstones(self) -> DataFrame:
        return self._table(self.tombstones_path, TOMBSTONES)

    def _stored(self, folders: list | None = None) -> DataFrame:
        """All events with ``day``, those that were appended and those of a stream's micro-batches, or those of some of their folders."""
        names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in EVENT.fields)
        if folders is None:
            paths = {top: [f"{self.events_path}/{top}=*"] for top in self._tops()}
        else:
            paths = {}
            for path in folders:
                paths.setdefault("batch" if path.getParent().getParent().getName().startswith("batch=") else "tier", []).append(path.toString())
        reader = self.spark.read.option("basePath", self.events_path)
        found = [reader.schema(f"{names}, day string{more}").parquet(*paths[top]).drop("batch") for top, more in (("tier", ""), ("batch", ", batch string")) if top in paths]
        if not found:
            return self.spark.createDataFrame([], f"{names}, day string")
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def read(self, which: EventFilter = EventFilter()) -> DataFrame:
        """Events that match and are not deleted; the filter is under the anti join, tiers and days prune partitions."""
        return alive(which.apply(self._stored()), self.tombstones())

    def newest(self, which: EventFilter = EventFilter(), limit: int = DEFAULT_EVENTS, cursor: tuple[int, str | None] | None = None) -> DataFrame:
        """The newest live events that match, at most ``limit``, from as few days as it takes.

        Days are read from the newest on, each time twice as many or as many as those before let expect to be enough, until ``limit`` rows are found or no day is left: whatever is in an older
        day is older. The bounds of the filter and the cursor leave out days without reading them.
        """
        places = {k: v for k, v in self._places().items() if which.tier is None or k[0] == which.tier}
        days = sorted({d for _, d in places}, reverse=True)
        hi = min(x for x in (which.to_ns, cursor[0] if cursor else None, 2**63 - 1) if x is not None)
        days = [d for d in days if d <= day_of(hi) and (which.from_ns is None or d >= day_of(which.from_ns))]
        at, tombstones = 1, self.tombstones()
        while True:
            some = [p for (_, d), paths in places.items() if d in days[:at] for p in paths]
            found = newest(alive(which.apply(self._stored(some)), tombstones), limit=limit, cursor=cursor)
            n = 0 if at >= len(days) else found.select("id").count()
            if at >= len(days) or n >= limit:
                return found
            at = max(2 * at + 1, -(-5 * at * limit // (4 * n)) if n else 4 * at)

    # retention

    def collect_garbage(self, now_ns: int, keep_days: dict[str, int]) -> list[tuple[str, str]]:
        """Drop the days of each tier that end before its cutoff; 0 keeps for ever, a day across the cutoff stays."""
        gone, places = [], self._places()
        for tier, days in keep_days.items():
            if days > 0:
                cutoff = day_of(now_ns - days * DAY * SECOND)
                gone += [(tier, d) for t, d in sorted(places) if t == tier and d < cutoff]
        fs, _ = self._fs(self.events_path)
        for partition in gone:
            for path in places[partition]:
                fs.delete(path, True)
        return gone

    def delete_older(self, now_ns: int, days: int) -> int:
        """Drop the days of all tiers that end before ``days`` days ago; says how many files went."""
        if days <= 0:
            raise ValueError("days must be positive")
        cutoff = day_of(now_ns - days * DAY * SECOND)
        fs, _ = self._fs(self.events_path)
        files = 0
        for (_, day), paths in self._places().items():
            for path in paths if day < cutoff else ():
                files += sum(f.getPath().getName().startswith("part-") for f in fs.listStatus(path))
                fs.delete(path, True)
        return files

    def collect_all_garbage(self, now_ns: int, keep_days: int) -> list[tuple[str, str]]:
        """Garbage collection where tiers have no times of their own."""
        return self.collect_garbage(now_ns, {t: keep_days for t, _ in self.partitions()})

    def tier_sizes(self) -> DataFrame:
        """``tier, day, files, bytes`` of the partitions, from the listing of the files."""
        rows, (fs, _) = [], self._fs(self.events_path)
        for (tier, day), paths in sorted(self._places().items(), key=lambda x: x[0]):
            files = [f.getLen() for path in paths for f in fs.listStatus(path) if f.getPath().getName().startswith("part-")]
            rows.append((tier, day, len(files), sum(files)))
        return self.spark.createDataFrame(rows, "tier string, day string, files long, bytes long")

    def _folders(self, path) -> list:
        """Folders of partitions below a path."""
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [f.getPath() for f in (fs.listStatus(path) if fs.exists(path) else []) if "=" in f.getPath().getName()]

    def _tops(self) -> set[str]:
        """What the folders below the events are of: ``tier`` where events were appended, ``batch`` where a stream wrote them."""
        return {p.getName().split("=")[0] for p in self._folders(self._fs(self.events_path)[1])}

    def _roots(self) -> list:
        """The folders that have those of tiers in them."""
        fs, path = self._fs(self.events_path)
        return [path, *(p for p in self._folders(path) if p.getName().startswith("batch="))]

    def _places(self) -> dict[tuple[str, str], list]:
        """Folders of each (tier, day), one for each micro-batch that had some of it; from one listing."""
        out: dict[tuple[str, str], list] = {}
        for root in self._roots():
            for tier in self._folders(root):
                if (t := tier.getName()).startswith("tier="):
                    for day in self._folders(tier):
                        out.setdefault((t[5:], day.getName()[4:]), []).append(day)
        return out

    def partitions(self) -> list[tuple[str, str]]:
        """(tier, day) from the folders, without reading a file."""
        return sorted(self._places())

    def compact(self, tier: str, day: str) -> None:
        """One partition's many small files rewritten, without what is deleted. What a stream wrote stays by micro-batches.

        The new files are written where no reader looks, below the partition. Only when all are there
        the old ones go and the new take their place; a run that ended between is finished by the next.
        """
        path = f"{self.events_path}/tier={tier}/day={day}"
        if not self._fs(path)[0].exists(self._fs(path)[1]):
            return
        new = f"{path}/_compacted"
        self._settle(path, new)
        rows = alive(self.spark.read.parquet(path), self.tombstones())
        rows.hint("rebalance").sortWithinPartitions("ts_ns").write.mode("overwrite").option("compression", "zstd").parquet(new)
        self._settle(path, new)

    def _settle(self, path: str, new: str) -> None:
        """Put the files of a whole rewrite in the place of those that it was made from; what is not whole goes."""
        fs, at = self._fs(path)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        made, moving = hadoop(new), hadoop(f"{path}/_moving")
        if fs.exists(made) and not fs.exists(hadoop(made, "_SUCCESS")):
            fs.delete(made, True)
        if fs.exists(made) and not fs.exists(moving):
            for f in fs.listStatus(at):
                if f.getPath().getName().startswith("part-"):
                    fs.delete(f.getPath(), False)
            fs.mkdirs(moving)  # from here on the files of the partition are new ones
        if fs.exists(moving):
            for f in fs.listStatus(made) if fs.exists(made) else []:
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), hadoop(at, f.getPath().getName()))
            fs.delete(made, True)
            fs.delete(moving, True)

    def size_bytes(self) -> int:
        fs, path = self._fs(self.root)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p


def alive(events: DataFrame, tombstones: DataFrame) -> DataFrame:
    ids = tombstones.select("id").distinct()
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return events.join(ids, "id", "left_anti")


def gc_survivors(events: DataFrame, now_ns: int, keep_days: dict[str, int]) -> DataFrame:
    """What garbage collection leaves, as a filter over whole days."""
    dead = F.lit(False)
    for tier, days in keep_days.items():
        if days > 0:
            dead |= (F.col("tier") == tier) & (day_text() < day_of(now_ns - days * DAY * SECOND))
    return events.where(~dead)
