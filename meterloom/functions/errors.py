"""Errors of providers: from a response, from the wire, to the stored JSON and back.

An error is a struct ``t`` (kind), ``m`` (message), ``r`` (seconds to wait), ``l`` (context limit), ``s`` (status).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import cut_bytes

KINDS = ["rate_limited", "invalid_request", "auth_failed", "context_length_exceeded", "content_filtered", "upstream_timeout", "upstream_unavailable", "other"]
#: Statuses that say what happened, and, tried in this order where they do not, parts of the type that the body names.
STATUSES = [("auth_failed", [401, 403]), ("rate_limited", [429]), ("upstream_timeout", [408, 504]), ("upstream_unavailable", [502, 503])]
PARTS = [("rate_limited", ["rate_limit", "too_many_requests", "throttling"]), ("auth_failed", ["auth", "permission"]), ("context_length_exceeded", ["context_length", "too_long", "context_window"]),
         ("content_filtered", ["content_filter", "safety", "blocked"]), ("upstream_timeout", ["timeout"])]
TYPE = "struct<t:string,m:string,r:bigint,l:bigint,s:int>"


def make(kind, message=None, wait=None, limit=None, status=None) -> Column:
    def col(x, kind):
        return (x if isinstance(x, Column) else F.lit(x)).cast(kind)

    return F.struct(col(kind, "string").alias("t"), col(message, "string").alias("m"), col(wait, "long").alias("r"), col(limit, "long").alias("l"), col(status, "int").alias("s"))


def _text(v: Column, path: str) -> Column:
    """The string at a path; null if there is another kind of value."""
    at = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(at) == "STRING", F.try_variant_get(v, path, "string"))


def _number(v: Column, path: str) -> Column:
    at = F.try_variant_get(v, path, "variant")
    n = F.when(F.schema_of_variant(at) == "BIGINT", F.try_variant_get(v, path, "long"))
    return F.when(n >= 0, n)


def from_response(status: Column, body: Column) -> Column:
    """The class of a failed call: the status first, then what the body says."""
    v = F.try_parse_json(body)
    kind = F.coalesce(_text(v, "$.error.type"), _text(v, "$.__type"), _text(v, "$.error.status"))
    message = F.coalesce(_text(v, "$.error.message"), _text(v, "$.message"), _text(v, "$.error"))
    wait = F.coalesce(_number(v, "$.error.retry_after"), _number(v, "$.retry_after"))
    limit = F.coalesce(_number(v, "$.error.param.limit"), _number(v, "$.error.limit"))
    limit = F.when(limit <= 2**32 - 1, limit)
    rest = cut_bytes(F.coalesce(message, body), 256)
    with_fields = {"rate_limited": {"wait": wait}, "context_length_exceeded": {"limit": F.coalesce(limit, F.lit(0))}, "content_filtered": {"message": F.coalesce(message, kind)}}
    rules = [(status.isin(*found), k) for k, found in STATUSES] + [(F.lower(kind).rlike("|".join(parts)), k) for k, parts in PARTS]
    said = F.coalesce(*(F.when(rule, make(k, **with_fields.get(k, {}))) for rule, k in rules))
    return F.coalesce(said, F.when(status == 400, make("invalid_request", rest)), make("other", rest, status=status))


def from_wire(kind: Column, message: Column, status: Column) -> Column:
    """The error of an ingested event; a kind that is not known becomes ``other``."""
    said = F.coalesce(message, F.lit(""))
    return F.when(kind.isNotNull(), (
        F.when(kind.isin("rate_limited", "auth_failed", "upstream_timeout", "upstream_unavailable"), make(kind))
        .when(kind.isin("invalid_request", "content_filtered"), make(kind, said))
        .when(kind == "context_length_exceeded", make(kind, limit=F.lit(0)))
        .otherwise(make("other", said, status=F.coalesce(status, F.lit(0))))
    ))


def encode(error: Column) -> Column:
    """Compact JSON; fields that are null are left out."""
    return F.to_json(error)


def decode(json: Column) -> Column:
    """The struct again, with the defaults of each kind; null if the JSON or its kind is not known."""
    e = F.from_json(json, TYPE)
    kind = e["t"]
    return F.when(kind.isin(*KINDS), F.struct(
        kind.alias("t"),
        F.when(kind.isin("invalid_request", "content_filtered", "other"), F.coalesce(e["m"], F.lit(""))).alias("m"),
        F.when(kind == "rate_limited", e["r"]).alias("r"),
        F.when(kind == "context_length_exceeded", F.coalesce(e["l"], F.lit(0))).alias("l"),
        F.when(kind == "other", F.coalesce(e["s"], F.lit(0))).alias("s"),
    ))
