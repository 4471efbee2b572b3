"""Queries of the functions over inputs that both engines derive from the given tables by the same expressions.

An input is a list of (expression, name) over one table; ``$text`` stands for the name of the string type.
The functions run in Spark; the SQL says again, from their rules, what must come out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import errors, money, providers, text
from ..sources import catalog, ingest

#: Nanoseconds that count as now for the payloads: 2024-01-15.
NOW_NS = 1_705_276_800 * 10**9


def _case(number: str, values: list[str]) -> str:
    return f"CASE {number} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _quoted(values) -> list[str]:
    return [f"'{v}'" for v in values]


def _rows(spark: SparkSession, sf_dir: str, table: str, exprs: list[tuple[str, str]]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e.replace('$text', 'string')} AS `{n}`" for e, n in exprs))


def _sql(table: str, exprs: list[tuple[str, str]]) -> str:
    return "SELECT " + ", ".join(f'{e.replace("$text", "varchar")} AS "{n}"' for e, n in exprs) + f" FROM {table}"


# hosts

_FIXED = [h for k, h in providers.HOSTS.items() if k not in ("gemini_vertex", "bedrock", "azure_openai", "ollama", "opencode", "opencode_zen")]
_HOST = _case("event_id", [
    *_quoted(_FIXED), "concat('zone', CAST(user_id AS $text), '-aiplatform.googleapis.com')", "concat('bedrock-runtime.zone-', CAST(user_id % 5 AS $text), '.amazonaws.com')", "concat('bedrock-runtime.', event_type, '.invalid')",
    "concat(event_type, CAST(user_id AS $text), '.openai.azure.com')", "'opencode.ai'", "concat('localhost:', CAST(11430 + user_id % 9 AS $text))", "'localhost'", "'127.0.0.1'", "concat('host', CAST(user_id AS $text), '.invalid')"])
HOSTS = [(f"CASE WHEN user_id % 2 = 0 THEN upper({_HOST}) ELSE {_HOST} END", "host"), (f"concat({_case('user_id', _quoted(['/v1/', '/zen/go/v1/', '/zen/', '/api/', '/']))}, event_type)", "path")]


def _hosts(spark, sf_dir):
    rows = _rows(spark, sf_dir, "events", HOSTS)
    return rows.groupBy("host", "path", providers.provider_of_host(F.col("host"), F.col("path")).alias("provider")).agg(F.count(F.lit(1)).alias("n"))


def _hosts_sql() -> str:
    exact = " ".join(f"WHEN h = '{h}' THEN '{k}'" for k, h in providers.HOSTS.items() if h in _FIXED)
    return (f"SELECT host, path, CASE {exact} WHEN suffix(h, 'aiplatform.googleapis.com') THEN 'gemini_vertex' WHEN starts_with(h, 'bedrock-runtime.') AND suffix(h, '.amazonaws.com') THEN 'bedrock' "
            "WHEN suffix(h, '.openai.azure.com') THEN 'azure_openai' WHEN h = 'opencode.ai' AND starts_with(path, '/zen/go') THEN 'opencode' WHEN h = 'opencode.ai' AND starts_with(path, '/zen') THEN 'opencode_zen' "
            "WHEN (h IN ('localhost', '127.0.0.1') OR starts_with(h, 'localhost:')) AND (starts_with(path, '/api/') OR suffix(h, ':11434')) THEN 'ollama' END AS provider, count(*) AS n "
            f"FROM (SELECT *, lower(host) AS h FROM ({_sql('events', HOSTS)})) GROUP BY ALL")


# errors of providers: every status with every part of a type, in every shape of body

_PARTS = [p for _, parts in errors.PARTS for p in parts]
_KIND = f"concat('x', CAST(user_id AS $text), '_', {_case('user_id', [*_quoted(_PARTS), "upper('Timeout')", "'nothing_known'"])}, '_error')"
_SAID = "concat('call ', CAST(event_id AS $text))"
ERRORS = [
    (f"CAST({_case('event_id', [str(s) for s in sorted({x for _, xs in errors.STATUSES for x in xs} | {400, 418, 500})])} AS int)", "status"),
    (_case("event_id", [f"""concat('{{"error":{{"type":"', {_KIND}, '","message":"', {_SAID}, '"}}}}')""", f"""concat('{{"__type":"', {_KIND}, '","message":"', {_SAID}, '"}}')""",
                        f"""concat('{{"error":{{"status":"', {_KIND}, '"}}}}')""", f"""concat('{{"error":"', {_SAID}, '"}}')""", _SAID]), "body"),
]


def _errors(spark, sf_dir):
    return _rows(spark, sf_dir, "events", ERRORS).groupBy("status", "body", errors.from_response(F.col("status"), F.col("body"))["t"].alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _errors_sql() -> str:
    by_status = " ".join(f"WHEN status IN ({', '.join(map(str, xs))}) THEN '{k}'" for k, xs in errors.STATUSES)
    by_part = " ".join(f"WHEN contains(t, '{p}') THEN '{k}'" for k, parts in errors.PARTS for p in parts)
    found = "lower(coalesce(try(json_extract_string(j, '$.error.type')), try(json_extract_string(j, '$.__type')), try(json_extract_string(j, '$.error.status'))))"
    return (f"SELECT status, body, CASE {by_status} {by_part} WHEN status = 400 THEN 'invalid_request' ELSE 'other' END AS kind, count(*) AS n FROM "
            f"(SELECT status, body, {found} AS t FROM (SELECT *, CASE WHEN json_valid(body) THEN body END AS j FROM ({_sql('events', ERRORS)}))) GROUP BY ALL")


# payloads: each breaks one rule, or none


def _payload(fields: str) -> str:
    return f"concat('{{', {fields}, '}}')"


_ID = "CAST(event_id AS $text)"
_BOTH = """'"model":"m', event_type, '","provider":"openai"'"""
_CASES: list[tuple[str, str | None]] = [
    (_payload(f"""{_BOTH}, ',"usage":{{"input_tokens":', {_ID}, '}}'"""), None), (_payload(""" '"model":"","provider":"openai","user_id":"', event_type, '"'"""), "model is required"),
    (_payload(""" '"model":"m', event_type, '","provider":""'"""), "provider is required"), (_payload(""" '"model":"m', event_type, '"'"""), "missing_field"),
    (_payload(f"""{_BOTH}, ',"more":', {_ID}"""), "unknown_field"), (f"concat('no json ', {_ID})", "malformed"), (_payload(f"""{_BOTH}, ',"usage":{{"input_tokens":', CAST(10000001 + event_id AS $text), '}}'"""), "input_tokens exceeds maximum"),
    (_payload(f"""{_BOTH}, ',"usage":{{"output_tokens":-', CAST(event_id + 1 AS $text), '}}'"""), "malformed"), (_payload(f"""{_BOTH}, ',"cost_nanodollars":-', CAST(event_id + 1 AS $text)"""), "cost_nanodollars is negative"),
    (_payload(f"""{_BOTH}, ',"cost_nanodollars":', CAST(1000000000001 + event_id AS $text)"""), "cost_nanodollars exceeds maximum"), (_payload(f"""{_BOTH}, ',"timestamp":', CAST(event_id * 1000 AS $text)"""), "timestamp is before 2020-01-01"),
    (_payload(f"""{_BOTH}, ',"timestamp":', CAST(4102444800000000000 + event_id AS $text)"""), "timestamp is in the future"), (_payload(f"""{_BOTH}, ',"timestamp":"day ', {_ID}, '"'"""), "invalid timestamp"),
    (_payload(f"""{_BOTH}, ',"user_id":"', repeat('u', CAST(257 + user_id % 7 AS int)), '"'"""), "user_id too long"), (_payload(f"""{_BOTH}, ',"endpoint":"', repeat('e', CAST(513 + user_id % 7 AS int)), '"'"""), "endpoint too long"),
    (_payload(_BOTH), None), (_payload(f"""{_BOTH}, ',"method":"GET","endpoint":"/v1/', event_type, '","usage":{{"output_tokens":', {_ID}, '}},"latency":{{"total_ms":', CAST(user_id AS $text), '}},"flags":{{"streaming":true}}'"""), None),
]
LINES = [("event_id", "n"), (_case("event_id", [c for c, _ in _CASES]), "value")]
_REASON = _case("n", ["NULL" if r is None else f"'{r}'" for _, r in _CASES])


def _lines(spark, sf_dir):
    return ingest.reasons(_rows(spark, sf_dir, "events", LINES), F.lit(NOW_NS))


def _reject_counts(spark, sf_dir):
    return _lines(spark, sf_dir).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _defaults(spark, sf_dir):
    return _lines(spark, sf_dir).where("reason is null").select("n", "event.method", "event.endpoint", "event.usage.output_tokens", "event.latency.total_ms", "event.flags.streaming")


def _defaults_sql() -> str:
    full = f"event_id % {len(_CASES)} = {len(_CASES) - 1}"
    none = " OR ".join(f"event_id % {len(_CASES)} = {i}" for i, (_, r) in enumerate(_CASES) if r is None)
    return (f"SELECT event_id AS n, CASE WHEN {full} THEN 'GET' ELSE 'POST' END AS method, CASE WHEN {full} THEN '/v1/' || event_type ELSE '' END AS endpoint, CASE WHEN {full} THEN event_id ELSE 0 END AS output_tokens, "
            f"CASE WHEN {full} THEN user_id ELSE 0 END AS total_ms, {full} AS streaming FROM events WHERE {none}")


# batches of payloads

_GOOD, _BAD = _payload(_BOTH), _payload(""" '"model":"","provider":"', event_type, '"'""")
BATCHES = [("event_id", "body"), (_case("event_id", [
    f"concat('{{\"events\":[', {_GOOD}, ',', {_BAD}, ',', {_GOOD}, ']}}')", "'{\"events\":[]}'", f"concat('{{\"items\":[', {_ID}, ']}}')", f"concat('broken ', {_ID})", f"concat('{{\"events\":[', {_GOOD}, ']}}')",
    f"CASE WHEN event_id % 600 = 5 THEN concat('{{\"events\":[', repeat('1,', 10000), {_ID}, ']}}') ELSE '{{\"events\":null}}' END"]), "value")]


def _batches(spark, sf_dir):
    return ingest.batch_outcomes(_rows(spark, sf_dir, "events", BATCHES), F.lit(NOW_NS))


def _batches_sql() -> str:
    none = "CAST(NULL AS BIGINT)"
    outcomes = [("event_id % 6 IN (0, 4)", "CAST(0 AS BIGINT)", "NULL"), ("event_id % 6 = 0", "CAST(1 AS BIGINT)", "'model is required'"), ("event_id % 6 = 0", "CAST(2 AS BIGINT)", "NULL"), ("event_id % 6 = 1", none, "'empty batch'"),
                ("event_id % 6 IN (2, 3) OR (event_id % 6 = 5 AND event_id % 600 <> 5)", none, "'malformed batch'"), ("event_id % 600 = 5", none, "'too many events'")]
    return " UNION ALL ".join(f"SELECT event_id AS body, {p} AS position, CAST({r} AS VARCHAR) AS reason FROM events WHERE {w}" for w, p, r in outcomes)


# keys and their tiers

CALLS = [("event_id", "call"), ("CASE WHEN event_id % 50 = 0 THEN NULL ELSE concat('t', CAST(user_id % 40 AS $text)) END", "token")]
KEYS = [("concat('t', CAST(c_custkey % 30 AS $text))", "token"), ("concat('key_', CAST(c_custkey AS $text))", "key_id"), ("lower(c_mktsegment)", "tier"), ("c_custkey", "position")]
TOKENS = [("event_id", "n"), (_case("event_id", ["concat('key_', CAST(user_id AS $text), ':', event_type)", "concat('k', CAST(user_id AS $text), ':a:b')", "concat('bare', CAST(user_id AS $text))", "concat(':', event_type)"]), "raw")]


def _tiers(spark, sf_dir):
    return ingest.authenticated(_rows(spark, sf_dir, "events", CALLS), _rows(spark, sf_dir, "customer", KEYS))


def _key_ids_sql() -> str:
    digits = " || ".join(f"CASE WHEN substr(d, {2 * i + 1}, 1) = '0' THEN substr(d, {2 * i + 2}, 1) ELSE substr(d, {2 * i + 1}, 2) END" for i in range(4))
    return f"SELECT n, raw, CASE WHEN strpos(raw, ':') > 1 THEN split_part(raw, ':', 1) ELSE 'key_' || {digits} END AS key_id FROM (SELECT *, sha256(raw) AS d FROM ({_sql('events', TOKENS)}))"


# traces, costs, names

TRACES = [("event_id", "n"), (_case("event_id", [f"concat('0x', upper(md5({_ID})))", f"md5({_ID})", f"substr(md5({_ID}), 2)", f"concat('z', substr(md5({_ID}), 2))", f"concat('0X', md5({_ID}))", "NULL"]), "raw")]
COSTS = [("event_id", "n"), (_case("event_id", ["event_id", "-event_id", "event_id * 1000000007", "-event_id * 1000000007", "9223372036854775807 - event_id", "-9223372036854775807 - 1 + event_id"]), "nanos")]
MODELS = [("event_id", "n"), (f"concat({_case('event_id', ['chr(32)', 'chr(9)', "''", 'concat(chr(13), chr(10))'])}, {_case('user_id', ["'GPT-'", "'Claude '", "'ÀB'", "'x'"])}, upper(event_type), {_case('user_id', ["''", 'chr(32)', 'chr(9)'])})", "raw")]
PROVIDERS = [("event_id", "n"), (_case("event_id", [*_quoted(["OpenAI", "opencode-ZEN", "BEDROCK", "Gemini_Vertex"]), "concat('Proxy-', CAST(user_id AS $text))", "lower(event_type)"]), "raw")]
ENDS = [(_case("event_id", _quoted([*providers.HOSTS, providers.OTHER])), "provider"), ("CASE WHEN user_id % 3 = 0 THEN concat('proxy', CAST(user_id AS $text), '.invalid') END", "base_url")]


def _ends(spark, sf_dir):
    rows = _rows(spark, sf_dir, "events", ENDS)
    return rows.groupBy("provider", "base_url", providers.canonical_host(F.col("provider"), F.col("base_url")).alias("host"), providers.auth_header(F.col("provider")).alias("header")).agg(F.count(F.lit(1)).alias("n"))


def _ends_sql() -> str:
    host = " ".join(f"WHEN '{k}' THEN '{h}'" for k, h in providers.HOSTS.items())
    header = " ".join(f"WHEN '{k}' THEN '{h}'" for k, h in providers.HEADERS.items())
    return f"SELECT provider, base_url, CASE provider {host} ELSE base_url END AS host, CASE provider {header} ELSE 'authorization' END AS header, count(*) AS n FROM ({_sql('events', ENDS)}) GROUP BY ALL"


def _providers_sql() -> str:
    key = "replace(lower(raw), 'opencode-zen', 'opencode_zen')"
    known = ", ".join(_quoted(providers.HOSTS))
    return f"SELECT n, raw, CASE WHEN {key} IN ({known}) THEN {key} ELSE 'openai_compatible' END AS provider, CASE WHEN {key} IN ({known}) THEN NULL ELSE raw END AS base_url FROM ({_sql('events', PROVIDERS)})"


# a catalog with an entry for each part, some of which claim the same names

_MODEL = "concat('model-', CAST(CAST(floor(p_partkey / 4) AS bigint) AS $text))"
ENTRIES = [
    (_case("p_partkey", [f"concat('maker/', {_MODEL}, '-2024-0', CAST(1 + p_size % 9 AS $text), '-15')", f"concat('Other/', upper({_MODEL}))", f"concat({_MODEL}, '-2024051', CAST(p_size % 10 AS $text))", f"concat('maker/', {_MODEL}, '-x')",
                         "concat('image-', CAST(p_partkey AS $text))"]), "entry"),
    (_case("p_partkey", [f"""concat('{{"input_cost_per_token":', CAST(1 + p_partkey % 90 AS $text), 'e-06,"output_cost_per_token":', CAST(1 + p_size AS $text), 'e-06,"max_input_tokens":', CAST(p_partkey AS $text), '}}')""",
                         """concat('{"input_cost_per_token":', CAST(1 + p_partkey % 90 AS $text), 'e-07,"mode":"chat","search_context_cost_per_query":0.0', CAST(1 + p_size % 9 AS $text), '}')""",
                         """concat('{"output_cost_per_token":', CAST(1 + p_size AS $text), 'e-06,"max_input_tokens":"many","mode":"', lower(p_type), '"}')""",
                         """concat('{"input_cost_per_token":', CAST(1 + p_partkey % 90 AS $text), 'e-08}')""", """concat('{"input_cost_per_image":', CAST(p_size AS $text), '}')"""]), "spec"),
]
NAMES = [("event_id", "n"), (f"concat({_case('event_id', ["'model-'", "'Model-'", "'maker/model-'", "' other/model-'"])}, CAST(user_id AS $text), {_case('user_id', ["''", "'-2024-02-02'", "'-20240101'", "'-x'"])})", "model")]


def _entries(spark, sf_dir):
    return catalog.with_names(catalog.rates(_rows(spark, sf_dir, "part", ENTRIES)))


_ALIASES = rf"""
entries AS ({_sql('part', ENTRIES)}),
priced AS (SELECT lower(trim(entry)) AS canonical, CAST(round(coalesce(CAST(json_extract(spec, '$.input_cost_per_token') AS DOUBLE), 0) * 1e9) AS BIGINT) AS input,
  CAST(round(coalesce(CAST(json_extract(spec, '$.output_cost_per_token') AS DOUBLE), 0) * 1e9) AS BIGINT) AS output, CAST(round(CAST(json_extract(spec, '$.search_context_cost_per_query') AS DOUBLE) * 1e9) AS BIGINT) AS search_query,
  CASE WHEN json_type(spec, '$.max_input_tokens') IN ('UBIGINT', 'BIGINT') THEN CAST(json_extract(spec, '$.max_input_tokens') AS BIGINT) END AS max_input_tokens, coalesce(json_extract_string(spec, '$.mode'), 'chat') AS mode
  FROM entries WHERE json_extract(spec, '$.input_cost_per_token') IS NOT NULL OR json_extract(spec, '$.output_cost_per_token') IS NOT NULL),
cut AS (SELECT *, CASE WHEN contains(canonical, '/') THEN substr(canonical, strpos(canonical, '/') + 1) END AS short FROM priced),
spread AS (SELECT *, canonical AS model, 0 AS rank FROM cut
  UNION ALL SELECT *, regexp_replace(canonical, '(.)(-\d{{4}}-\d{{2}}-\d{{2}}|-\d{{8}})$', '\1') AS model, 1 FROM cut WHERE regexp_matches(canonical, '.(-\d{{4}}-\d{{2}}-\d{{2}}|-\d{{8}})$')
  UNION ALL SELECT *, short, 2 FROM cut WHERE short IS NOT NULL
  UNION ALL SELECT *, regexp_replace(short, '(.)(-\d{{4}}-\d{{2}}-\d{{2}}|-\d{{8}})$', '\1'), 3 FROM cut WHERE regexp_matches(short, '.(-\d{{4}}-\d{{2}}-\d{{2}}|-\d{{8}})$')),
names AS (SELECT * FROM spread QUALIFY row_number() OVER (PARTITION BY model ORDER BY rank, canonical, input, output) = 1)"""


def _lookup(spark, sf_dir):
    return catalog.with_rates(_rows(spark, sf_dir, "events", NAMES), _entries(spark, sf_dir)).select("n", "model", F.col("rates.canonical").alias("canonical"), F.col("rates.input").alias("input"))


def queries() -> dict:
    def over(exprs, *columns):
        return lambda s, d: _rows(s, d, "events", exprs).select(*(c if isinstance(c, str) else c() for c in columns))

    return {
        "host_classify": _hosts, "error_classify": _errors, "validate_reasons": lambda s, d: _lines(s, d).select("n", "reason"), "reject_counts": _reject_counts, "ingest_defaults": _defaults,
        "batch_outcomes": _batches, "key_tiers": _tiers, "auth_key_ids": over(TOKENS, "n", "raw", lambda: text.key_id(F.col("raw")).alias("key_id")), "trace_ids": over(TRACES, "n", "raw", lambda: text.trace_id(F.col("raw")).alias("trace_id")),
        "cost_display": over(COSTS, "n", "nanos", lambda: money.cost_display(F.col("nanos")).alias("shown")), "normalize_model": over(MODELS, "n", "raw", lambda: text.normalize_model(F.col("raw")).alias("model")),
        "normalize_provider": over(PROVIDERS, "n", "raw", lambda: providers.provider_key(F.col("raw")).alias("provider"), lambda: providers.provider_base_url(F.col("raw")).alias("base_url")), "provider_ends": _ends,
        "catalog_alias_expand": lambda s, d: _entries(s, d).select("model", "canonical", "rank", "input", "output"), "catalog_limits": lambda s, d: _entries(s, d).where("rank = 0").select("model", "search_query", "max_input_tokens", "mode"),
        "catalog_lookup": _lookup,
    }


def oracle_sql() -> dict[str, str]:
    lines = f"SELECT event_id AS n, CAST({_REASON.replace('n %', 'event_id %')} AS VARCHAR) AS reason FROM events"
    shown = "CASE WHEN nanos < 0 THEN '-' ELSE '' END || '$' || CAST(abs(CAST(nanos AS HUGEINT)) // 1000000000 AS VARCHAR) || '.' || lpad(CAST((abs(CAST(nanos AS HUGEINT)) % 1000000000) // 10 AS VARCHAR), 8, '0')"
    bare = r"regexp_replace(k, '(.)(-\d{4}-\d{2}-\d{2}|-\d{8})$', '\1')"
    return {
        "host_classify": _hosts_sql(), "error_classify": _errors_sql(), "validate_reasons": lines, "reject_counts": f"SELECT reason, count(*) AS n FROM ({lines}) WHERE reason IS NOT NULL GROUP BY reason", "ingest_defaults": _defaults_sql(),
        "batch_outcomes": _batches_sql(), "auth_key_ids": _key_ids_sql(), "provider_ends": _ends_sql(), "normalize_provider": _providers_sql(),
        "key_tiers": f"SELECT call, k.key_id, coalesce(k.tier, 'free') AS tier FROM ({_sql('events', CALLS)}) c LEFT JOIN (SELECT token, arg_max(key_id, position) AS key_id, arg_max(tier, position) AS tier FROM ({_sql('customer', KEYS)}) GROUP BY token) k USING (token)",
        "trace_ids": f"SELECT n, raw, nullif(regexp_extract(lower(CASE WHEN starts_with(raw, '0X') THEN '' ELSE raw END), '^(?:0x)?([0-9a-f]{{32}})$', 1), '') AS trace_id FROM ({_sql('events', TRACES)})",
        "cost_display": f"SELECT n, nanos, {shown} AS shown FROM ({_sql('events', COSTS)})",
        "normalize_model": f"SELECT n, raw, translate(trim(raw, chr(9) || chr(10) || chr(13) || chr(32)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS model FROM ({_sql('events', MODELS)})",
        "catalog_alias_expand": f"WITH {_ALIASES} SELECT model, canonical, CAST(rank AS INTEGER) AS rank, input, output FROM names", "catalog_limits": f"WITH {_ALIASES} SELECT model, search_query, max_input_tokens, mode FROM names WHERE rank = 0",
        "catalog_lookup": f"WITH {_ALIASES}, asked AS (SELECT n, model, lower(trim(model)) AS k FROM ({_sql('events', NAMES)})) SELECT n, a.model, coalesce(e.canonical, b.canonical) AS canonical, coalesce(e.input, b.input) AS input FROM asked a LEFT JOIN names e ON e.model = k LEFT JOIN names b ON b.model = {bare}",
    }
