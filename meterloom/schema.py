"""Schemas. Names and types are pinned by a test; a change needs a new ``SCHEMA_ID``."""

from __future__ import annotations

from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

SCHEMA_ID = 1

DIMS = ["user_id", "api_key_id", "model", "provider", "source", "org_id", "project_id", "route_id", "model_family", "endpoint", "tier", "error_type", "user_tag", "session_tag"]
USAGE = ["input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "reasoning_tokens", "audio_input_tokens", "audio_output_tokens", "image_tokens", "video_seconds", "tool_use_tokens", "search_queries"]
#: The usage counters that a client can send.
SENT_USAGE = [u for u in USAGE if u not in ("video_seconds", "search_queries")]
LABELS = ["error_json", "request_id", "trace_id", "client_ip", "user_agent", "metadata_json", "method", "provider_base_url"]
FLAGS = ["streaming", "tool_calls", "reasoning", "stream_incomplete", "cache_used", "budget_blocked"]


def _fields(names, kind):
    return [StructField(n, kind) for n in names]


EVENT = StructType([
    StructField("id", StringType()), StructField("ts_ns", LongType()), *_fields(DIMS, StringType()), *_fields(USAGE, LongType()),
    StructField("cost_nanodollars", LongType()), StructField("total_ms", LongType()), StructField("ttft_ms", LongType()), StructField("time_to_close_ms", LongType()),
    StructField("http_status", IntegerType()), StructField("is_error", IntegerType()), *_fields(FLAGS, BooleanType()), *_fields(LABELS, StringType()),
])

INGEST = StructType([
    StructField("model", StringType()), StructField("provider", StringType()), StructField("cost_nanodollars", LongType()),
    StructField("usage", StructType(_fields(SENT_USAGE, LongType()))),
    StructField("latency", StructType(_fields(["ttft_ms", "total_ms", "time_to_close_ms"], LongType()))),
    StructField("timestamp", StringType()), StructField("method", StringType()), StructField("endpoint", StringType()), StructField("http_status", IntegerType()),
    *_fields(["source", "user_id", "api_key_id", "org_id", "project_id", "route_id"], StringType()),
    StructField("flags", StructType(_fields(FLAGS[:5], BooleanType()))),
    StructField("error", StructType([StructField("kind", StringType()), StructField("message", StringType()), StructField("status", IntegerType())])),
    *_fields(["trace_id", "request_id", "client_ip", "user_agent", "metadata"], StringType()),
])

ROLLUP_KEYS = ["day", "user_id", "api_key_id", "model", "provider"]
ROLLUP_SUMS = ["event_count", "error_count", "input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens", "cost_nanodollars"]

MANIFEST = StructType([
    StructField("archive_id", StringType()), StructField("user_id", StringType()), StructField("day", StringType()), StructField("s3_key", StringType()),
    *_fields(["event_count", "min_ts_ns", "max_ts_ns", "compressed_bytes", "created_at"], LongType()),
])

SUMMARY = ["id", "ts_ns", "user_id", "api_key_id", "org_id", "project_id", "model", "provider", "source", "endpoint", "http_status", "input_tokens", "output_tokens", "cache_read_input_tokens",
           "cache_creation_input_tokens", "reasoning_tokens", "cost_nanodollars", "total_ms", "ttft_ms", "streaming", "error_type", "metadata_json"]
