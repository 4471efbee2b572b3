"""Ingest: JSON lines to events and rejects. All narrow, so one stage with the price join and the write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import errors, providers, text
from ..functions.times import SECOND, rfc3339_to_ns
from ..operators.cost import compute_cost
from ..schema import EVENT, FLAGS, INGEST, SENT_USAGE, USAGE
from .catalog import rate_of, with_rates

#: Bounds of the wire format; lengths are in bytes.
MAX_BATCH, MAX_TOKENS, MAX_COST = 10_000, 10_000_000, 10**12
MIN_TS_NS, FUTURE_NS = 1_577_836_800 * SECOND, 86_400 * SECOND
MAX_MODEL, MAX_PROVIDER, MAX_ATTRIBUTION, MAX_ENDPOINT, MAX_METADATA = 256, 128, 256, 512, 65_536
U32, U16 = 2**32 - 1, 2**16 - 1
MAX_KEYS = 100_000


def _items(column: str) -> Column:
    return F.from_json(F.get_json_object(column, "$.events"), "array<string>")


def batch_items(batches: DataFrame, column: str = "value") -> DataFrame:
    """The items of batch bodies ``{"events": [...]}`` with their place; a body with too many or none gives no item but a row of ``batch_rejects``."""
    items = _items(column)
    others = [c for c in batches.columns if c not in (column, "position", "value")]
    return batches.select(*others, F.posexplode(F.when(F.size(items).between(1, MAX_BATCH), items)).alias("position", "value"))


def batch_rejects(batches: DataFrame, column: str = "value") -> DataFrame:
    """Bodies that are refused as a whole, with ``reason``."""
    n = F.size(_items(column))
    reason = F.when(F.coalesce(n, F.lit(-1)) < 0, "malformed batch").when(n == 0, "empty batch").when(n > MAX_BATCH, "too many events")
    return batches.withColumn("reason", reason).where("reason is not null")


def batch_outcomes(batches: DataFrame, now_ns: Column, body: str = "body", column: str = "value") -> DataFrame:
    """``body, position, reason``: a row for each item, ``reason`` null where it is accepted, and one without position for a body refused as a whole."""
    items = reasons(batch_items(batches, column), now_ns).select(body, F.col("position").cast("long").alias("position"), "reason")
    return items.unionByName(batch_rejects(batches, column).select(body, F.lit(None).cast("long").alias("position"), "reason"))


def authenticated(calls: DataFrame, keys: DataFrame, token: str = "token", default_tier: str = "free") -> DataFrame:
    """``calls`` with ``key_id`` (null if no key has the token) and ``tier``, instead of the token.

    ``keys``: ``token, key_id, tier, position``; of equal tokens the last counts. It is configuration, some thousands of rows, broadcast up to ``MAX_KEYS``.
    """
    last = keys.groupBy(F.col("token").alias("_token")).agg(F.max_by(F.struct("key_id", "tier"), "position").alias("_key"))
    if keys.limit(MAX_KEYS + 1).count() <= MAX_KEYS:
        last = F.broadcast(last)
    rows = calls.join(last, F.col(token) == F.col("_token"), "left")
    return rows.withColumns({"key_id": F.col("_key.key_id"), "tier": F.coalesce("_key.tier", F.lit(default_tier))}).drop(token, "_token", "_key")


def parse(lines: DataFrame, column: str = "value") -> DataFrame:
    """``lines`` with ``event`` (of the ingest schema, defaults filled in) and ``malformed`` (a reason or null)."""
    raw = F.col(column)
    kept = StructType([*INGEST.fields, StructField("_bad", StringType())])
    rows = lines.withColumn("_e", F.from_json(raw, kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})).withColumn("_v", F.try_parse_json(raw))
    extra = F.size(F.array_except(F.json_object_keys(raw), F.array(*(F.lit(f.name) for f in INGEST.fields)))) > 0

    def outside(path: str, most: int) -> Column:
        c = F.col(f"_e.{path}")
        return (c < 0) | (c > most)

    ranges = [outside(f"usage.{u}", U32) for u in SENT_USAGE] + [outside(f"latency.{n}", U32) for n in ("ttft_ms", "total_ms", "time_to_close_ms")]
    ranges += [outside("http_status", U16), outside("error.status", U16), F.col("_e.error").isNotNull() & F.col("_e.error.kind").isNull()]
    broken = reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), ranges, F.coalesce(F.col("_e._bad").isNotNull(), F.lit(True)) | F.col("_v").isNull())
    missing = F.col("_e.model").isNull() | F.col("_e.provider").isNull()
    kind = F.schema_of_variant(F.try_variant_get("_v", "$.timestamp", "variant"))
    e = F.col("_e")

    def filled(name: str, fields, default) -> Column:
        return F.struct(*(F.coalesce(e[name][f], F.lit(default)).alias(f) for f in fields)).alias(name)

    plain = [f.name for f in INGEST.fields if f.name not in ("usage", "latency", "flags", "method", "endpoint", "metadata")]
    metadata = F.try_variant_get("_v", "$.metadata", "variant")
    event = F.struct(
        *(e[n].alias(n) for n in plain), filled("usage", SENT_USAGE, 0), filled("flags", FLAGS[:5], False),
        F.struct(e["latency"]["ttft_ms"].alias("ttft_ms"), F.coalesce(e["latency"]["total_ms"], F.lit(0)).alias("total_ms"), e["latency"]["time_to_close_ms"].alias("time_to_close_ms")).alias("latency"),
        F.when(F.schema_of_variant(metadata) != "VOID", F.to_json(metadata)).alias("metadata"), F.coalesce(e["method"], F.lit("POST")).alias("method"), F.coalesce(e["endpoint"], F.lit("")).alias("endpoint"),
        F.when(kind == "BIGINT", e["timestamp"].try_cast("long")).alias("epoch_ns"), F.when(kind == "STRING", e["timestamp"]).alias("iso"),
    )
    malformed = F.when(broken, "malformed").when(extra, "unknown_field").when(missing, "missing_field").when(kind.isNotNull() & ~kind.isin("BIGINT", "STRING", "VOID"), "malformed")
    return rows.withColumns({"event": event, "malformed": malformed}).drop("_e", "_v")


def invalid(event: Column, now_ns: Column) -> Column:
    """The first rule that an event breaks, null if none.

    The rules are an array and no chain of conditions: Spark makes one method of a chain, and one of more than 8,000 bytes is never compiled by the JVM.
    """
    def longer(name, most):
        return F.octet_length(event[name]) > most

    rules = [
        ("model is required", event["model"] == ""), ("provider is required", event["provider"] == ""),
        ("model too long", longer("model", MAX_MODEL)), ("provider too long", longer("provider", MAX_PROVIDER)),
        *((f"{u} exceeds maximum", event["usage"][u] > MAX_TOKENS) for u in SENT_USAGE),
        ("cost_nanodollars is negative", event["cost_nanodollars"] < 0), ("cost_nanodollars exceeds maximum", event["cost_nanodollars"] > MAX_COST),
        ("timestamp is before 2020-01-01", event["epoch_ns"] < MIN_TS_NS), ("timestamp is in the future", event["epoch_ns"] > F.try_add(now_ns, F.lit(FUTURE_NS))),
        *((f"{n} too long", longer(n, MAX_ATTRIBUTION)) for n in ("user_id", "api_key_id", "org_id", "project_id", "route_id")),
        ("endpoint too long", longer("endpoint", MAX_ENDPOINT)), ("metadata too large", longer("metadata", MAX_METADATA)),
    ]
    return F.get(F.array_compact(F.array(*(F.when(broken, F.lit(name)) for name, broken in rules))), F.lit(0))


def reasons(lines: DataFrame, now_ns: Column, column: str = "value") -> DataFrame:
    """``lines`` with ``event`` and ``reason``, null for what is accepted. A bad ISO timestamp is the last to be seen."""
    rows = parse(lines, column)
    e = F.col("event")
    iso = F.when(e["iso"].isNotNull() & rfc3339_to_ns(e["iso"]).isNull(), F.lit("invalid timestamp"))
    return rows.withColumn("reason", F.coalesce("malformed", invalid(e, now_ns), iso)).drop("malformed")


def normalise(accepted: DataFrame, catalog: DataFrame, now_ns: Column, event_id: Column, tier: Column, authenticated_key: Column | None = None) -> DataFrame:
    """Events of the stored schema from the column ``event``, priced unless they bring a cost.

    ``authenticated_key``: the key that was used; it replaces what the client claims.
    """
    e = F.col("event")
    key = F.coalesce(authenticated_key, e["api_key_id"]) if authenticated_key is not None else e["api_key_id"]
    rows = accepted.withColumns({"_id": event_id, "_tier": tier, "_key": key, "_now": now_ns, "model": text.normalize_model(e["model"]), "provider": providers.provider_key(e["provider"])})
    rows = with_rates(rows, catalog)
    usage = {u: (e["usage"][u] if u in SENT_USAGE else F.lit(0)).cast("long") for u in USAGE}
    priced = F.when(F.col("rates").isNotNull(), compute_cost(F.col("provider"), usage.__getitem__, rate_of)).otherwise(0)
    error = errors.from_wire(e["error"]["kind"], e["error"]["message"], e["error"]["status"])
    columns = {
        **{n: text.or_empty(e[n]) for n in ("user_id", "org_id", "project_id", "source", "request_id", "user_agent")}, **usage,
        "id": F.col("_id"), "ts_ns": F.coalesce(e["epoch_ns"], rfc3339_to_ns(e["iso"]), F.col("_now")), "api_key_id": text.or_empty(F.col("_key")),
        "model": F.col("model"), "provider": F.col("provider"), "route_id": F.coalesce(e["route_id"], F.lit("default")), "model_family": F.lit(""),
        "endpoint": e["endpoint"], "tier": F.col("_tier"), "error_type": text.or_empty(error["t"]), "error_json": errors.encode(error), "is_error": error.isNotNull().cast("int"),
        "user_tag": text.json_string(e["metadata"], "user_tag"), "session_tag": text.json_string(e["metadata"], "session_tag"), "metadata_json": e["metadata"],
        "cost_nanodollars": F.coalesce(e["cost_nanodollars"], priced), "total_ms": e["latency"]["total_ms"], "ttft_ms": e["latency"]["ttft_ms"],
        "time_to_close_ms": e["latency"]["time_to_close_ms"], "http_status": e["http_status"],
        **{f: e["flags"][f] for f in FLAGS[:5]}, "budget_blocked": F.lit(False),
        "trace_id": text.trace_id(e["trace_id"]), "client_ip": text.client_ip(e["client_ip"]), "method": text.http_method(e["method"]),
        "provider_base_url": providers.provider_base_url(e["provider"]),
    }
    return rows.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in EVENT.fields))


def ingest(lines: DataFrame, catalog: DataFrame, now_ns: Column, event_id: Column, tier: Column, authenticated_key: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of JSON lines in the column ``value``."""
    rows = reasons(lines, now_ns)
    return normalise(rows.where("reason is null"), catalog, now_ns, event_id, tier, authenticated_key), rows.where("reason is not null").drop("event")
