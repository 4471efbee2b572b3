"""Event tables: a partitioned store on disk, and facts derived from the plain ``events`` table of the test data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# one text for both engines; only the names of a type and of two functions differ
_FACTS = """
SELECT lpad(CAST(event_id AS {text}), 26, '0') AS id, {ts_ns} AS ts_ns,
  concat('user_', CAST(user_id AS {text})) AS user_id,
  CASE WHEN user_id % 10 = 0 THEN NULL ELSE concat('key_', CAST(user_id % 7 AS {text})) END AS api_key_id,
  CASE user_id % 4 WHEN 2 THEN 'pro' WHEN 3 THEN 'team' ELSE 'free' END AS tier,
  CASE user_id % 3 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' ELSE 'gemini' END AS provider,
  CASE user_id % 3 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'claude-sonnet-4-20250514' ELSE 'gemini-2.0-flash' END AS model,
  CASE user_id % 5 WHEN 0 THEN 'sdk' WHEN 1 THEN 'proxy' ELSE NULL END AS source,
  CASE event_id % 4 WHEN 0 THEN 'blue' WHEN 1 THEN 'green' ELSE NULL END AS user_tag,
  CASE WHEN event_id % 6 = 0 THEN concat('s', CAST(event_id % 9 AS {text})) ELSE NULL END AS session_tag,
  CASE WHEN event_type = 'error' THEN 429 WHEN event_id % 50 = 0 THEN NULL ELSE 200 END AS http_status,
  CASE WHEN event_type = 'error' THEN 'rate_limited' ELSE NULL END AS error_type,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error,
  k * 10 AS input_tokens, k * 5 AS output_tokens,
  CASE WHEN event_type = 'view' THEN k * 4 ELSE 0 END AS cache_read_input_tokens,
  CASE WHEN event_type = 'purchase' THEN k * 2 ELSE 0 END AS cache_creation_input_tokens,
  CASE WHEN event_type = 'signup' THEN k ELSE 0 END AS reasoning_tokens,
  k * 3 AS total_ms, CASE WHEN event_id % 7 = 0 THEN NULL ELSE k END AS ttft_ms,
  CASE WHEN event_id % 7 = 0 THEN k * 2 ELSE NULL END AS time_to_close_ms, event_id % 2 = 0 AS streaming, event_id % 3 = 0 AS tool_calls
FROM (SELECT *, CAST({k} AS bigint) AS k FROM {table})
"""
FACTS_DUCKDB = _FACTS.format(text="varchar", ts_ns="epoch_us(ts) * 1000", k="json_extract_string(props, '$.k')", table="events")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage facts of the test data; plain integer arithmetic, so that SQL elsewhere gives the same."""
    ts = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) * 1000"
    text = _FACTS.format(text="string", ts_ns=ts, k="get_json_object(props, '$.k')", table="{events}")
    return spark.sql(text, events=spark.read.parquet(f"{sf_dir}/events.parquet"))
