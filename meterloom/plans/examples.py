"""Small tables that queries and tests share: a catalog with its versions, and payloads."""

from __future__ import annotations

import json

#: Dollars for each token; the rates of the first three are public prices, the rest show the rules of the loader.
CATALOG = json.dumps({
    "sample_spec": {"input_cost_per_token": 1.0, "output_cost_per_token": 1.0},
    "gpt-4o": {"input_cost_per_token": 2.5e-06, "output_cost_per_token": 1e-05, "cache_read_input_token_cost": 1.25e-06, "input_cost_per_token_batches": 1.25e-06, "output_cost_per_token_batches": 5e-06, "mode": "chat"},
    "claude-sonnet-4-20250514": {
        "input_cost_per_token": 3e-06, "output_cost_per_token": 1.5e-05, "cache_read_input_token_cost": 3e-07, "cache_creation_input_token_cost": 3.75e-06, "cache_creation_input_token_cost_above_1hr": 6e-06,
        "input_cost_per_token_above_200k_tokens": 6e-06, "output_cost_per_token_above_200k_tokens": 2.25e-05, "cache_read_input_token_cost_above_200k_tokens": 6e-07, "cache_creation_input_token_cost_above_200k_tokens": 7.5e-06},
    "gemini/gemini-2.0-flash": {"input_cost_per_token": 1e-07, "output_cost_per_token": 4e-07},
    "openai/gpt-5-mini-2025-08-07": {"input_cost_per_token": 2.5e-07, "output_cost_per_token": 2e-06, "max_input_tokens": "many", "search_context_cost_per_query": {"search_context_size_low": 0.01, "search_context_size_high": 0.03}},
    "azure/gpt-5-mini-2025-08-07": {"input_cost_per_token": 9e-07, "output_cost_per_token": 9e-06},
    "Mixed/Case-Model": {"input_cost_per_token": 1e-06, "search_context_cost_per_query": 0.035, "max_input_tokens": 4096},
    "image-only": {"input_cost_per_image": 0.04},
    "broken": {"input_cost_per_token": "free"},
})

_CHANGED = json.loads(CATALOG) | {"gpt-4o": {"input_cost_per_token": 2e-06, "output_cost_per_token": 8e-06, "cache_read_input_token_cost": 1e-06}}
#: Versions of the catalog with the times from which they count, 2024-01-01, 10 and 20: one gets cheaper, one goes and comes back dearer.
VERSIONS = [
    (1_704_067_200 * 10**9, CATALOG), (1_704_844_800 * 10**9, json.dumps({k: v for k, v in _CHANGED.items() if "gemini" not in k})),
    (1_705_708_800 * 10**9, json.dumps(_CHANGED | {"gemini/gemini-2.0-flash": {"input_cost_per_token": 2e-07, "output_cost_per_token": 8e-07}})),
]

#: (value, label) of JSON bodies as clients send them.
PAYLOADS = [
    '{"model":"gpt-4o","provider":"openai","timestamp":1700000000000000000,"usage":{"input_tokens":2048,"output_tokens":512}}',
    '{"model":"  GPT-4o\\n","provider":"OpenAI","timestamp":"2023-11-14T22:13:20.123456789Z","usage":{"input_tokens":10},"metadata":{"user_tag":"demo","session_tag":5}}',
    '{"model":"","provider":"openai"}', '{"model":"m","provider":""}', '{"model":"m"}', '{"model":"m","provider":"p","extra":1}', "not json",
    '{"model":"m","provider":"p","usage":{"input_tokens":10000001}}', '{"model":"m","provider":"p","usage":{"input_tokens":-1}}', '{"model":"m","provider":"p","cost_nanodollars":-1}',
    '{"model":"m","provider":"p","cost_nanodollars":1000000000001}', '{"model":"m","provider":"p","timestamp":1000000000000000}', '{"model":"m","provider":"p","timestamp":4102444800000000000}',
    '{"model":"m","provider":"p","timestamp":"1999-01-01T00:00:00Z"}', '{"model":"m","provider":"p","timestamp":"yesterday"}', '{"model":"   ","provider":"p"}',
    json.dumps({"model": "é" * 129, "provider": "p"}, ensure_ascii=False), json.dumps({"model": "m", "provider": "p", "user_id": "u" * 257}), json.dumps({"model": "m", "provider": "p", "endpoint": "e" * 513}),
    json.dumps({"model": "m", "provider": "p", "metadata": "x" * 65_536}),
    '{"model":"claude-sonnet-4-20250514","provider":"anthropic","timestamp":1700000000000000000,"usage":{"input_tokens":500,"output_tokens":200,"cache_read_input_tokens":2000,"cache_creation_input_tokens":300},'
    '"error":{"kind":"context_length","status":400},"trace_id":"0xABCDEF0123456789abcdef0123456789","client_ip":"192.0.2.1","flags":{"streaming":true}}',
    '{"model":"m","provider":"my-proxy","cost_nanodollars":77,"client_ip":"999.1.1.1","trace_id":"zz","method":"bad method"}',
]
#: What happens to each payload, in order; null is accepted.
REASONS = [
    None, None, "model is required", "provider is required", "missing_field", "unknown_field", "malformed", "input_tokens exceeds maximum", "malformed", "cost_nanodollars is negative",
    "cost_nanodollars exceeds maximum", "timestamp is before 2020-01-01", "timestamp is in the future", None, "invalid timestamp", None, "model too long", "user_id too long", "endpoint too long", "metadata too large", None, None,
]
#: Nanoseconds that count as now for the payloads: 2024-01-15.
NOW_NS = 1_705_276_800 * 10**9
