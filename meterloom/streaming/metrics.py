"""Figures of a stream, counted in the pass that writes what they are of.

An ``Observation`` adds aggregates to the plan of a write, so a micro-batch is not read again for its figures. They
are written with the micro-batch, under its number, and so are the same if it runs again. ``Watch`` keeps what the query itself reports:
rows read (each time that they are), how long a micro-batch took, rows of state and rows that came too late for it.
"""

from __future__ import annotations

import json
from collections import deque

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators.store import TIERS
from ..sources.ingest import SENT_USAGE

#: Why something is refused; other reasons are counted together.
REASONS = ("malformed", "malformed call", "unknown_field", "missing_field", "model is required", "provider is required", "model too long", "provider too long", *(f"{u} exceeds maximum" for u in SENT_USAGE),
           "cost_nanodollars is negative", "cost_nanodollars exceeds maximum", "timestamp is before 2020-01-01", "timestamp is in the future", "invalid timestamp", "user_id too long", "api_key_id too long", "org_id too long",
           "project_id too long", "route_id too long", "endpoint too long", "metadata too large", "unauthorized", "rate limited", "replayed")
METRICS = "batch long, stored long, errors long, cost_nanodollars decimal(38,0), stored_by_tier map<string,long>, rejected long, rejected_by_reason map<string,long>, event_bytes long"


def _each(column: str, values: tuple[str, ...], name: str) -> list[Column]:
    return [F.count_if(F.col(column) == v).alias(f"{name}{i}") for i, v in enumerate(values)]


def of_events(events: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    cost = F.coalesce(F.sum(F.col("cost_nanodollars").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return events.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("is_error"), F.lit(0)).alias("errors"), cost.alias("cost"), *_each("tier", TIERS, "tier")), seen


def of_rejects(rejects: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return rejects.observe(seen, F.count(F.lit(1)).alias("n"), *_each("reason", REASONS, "reason")), seen


def _named(found: dict, values: tuple[str, ...], name: str) -> dict[str, int]:
    out = {v: n for i, v in enumerate(values) if (n := found[f"{name}{i}"])}
    rest = found["n"] - sum(out.values())
    return out | ({"other": rest} if rest else {})


def row(batch: int, events: Observation, rejects: Observation, event_bytes: int) -> tuple:
    """A row of ``METRICS``, after both writes."""
    e, r = events.get, rejects.get
    return batch, e["n"], e["errors"], e["cost"], _named(e, TIERS, "tier"), r["n"], _named(r, REASONS, "reason"), event_bytes


class Watch(StreamingQueryListener):
    """The newest reports of the queries of a session; add it with ``spark.streams.addListener``."""

    def __init__(self, keep: int = 1000):
        self.reports: deque = deque(maxlen=keep)
        self.failed: deque = deque(maxlen=keep)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        states = p.get("stateOperators", [])
        self.reports.append({
            "query": p["id"], "batch": p["batchId"], "rows": p["numInputRows"], "rows_per_s": p.get("processedRowsPerSecond", 0.0), "ms": p["durationMs"].get("triggerExecution", 0),
            "state_rows": sum(s["numRowsTotal"] for s in states), "state_bytes": sum(s["memoryUsedBytes"] for s in states), "too_late": sum(s["numRowsDroppedByWatermark"] for s in states),
        })

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failed.append((str(event.id), event.exception))
