"""Providers: keys, hosts, headers, and the classification of hosts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower

#: Key of a provider and its canonical host.
HOSTS = {
    "openai": "api.openai.com", "anthropic": "api.anthropic.com", "gemini": "generativelanguage.googleapis.com",
    "gemini_vertex": "aiplatform.googleapis.com", "bedrock": "bedrock-runtime.amazonaws.com", "azure_openai": "openai.azure.com",
    "mistral": "api.mistral.ai", "groq": "api.groq.com", "xai": "api.x.ai", "deepseek": "api.deepseek.com", "cohere": "api.cohere.com",
    "openrouter": "openrouter.ai", "ollama": "localhost", "opencode": "opencode.ai", "opencode_zen": "opencode.ai",
}
#: The header that carries the key, where it is not ``authorization``.
HEADERS = {"anthropic": "x-api-key", "gemini": "x-goog-api-key", "azure_openai": "api-key"}
OTHER = "openai_compatible"


def _of(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))[c]


def provider_key(raw: Column) -> Column:
    key = ascii_lower(raw)
    key = F.when(key == "opencode-zen", "opencode_zen").otherwise(key)
    return F.when(key.isin(*HOSTS), key).otherwise(OTHER)


def provider_base_url(raw: Column) -> Column:
    """What an unknown provider was called; null for the known."""
    return F.when(provider_key(raw) == OTHER, raw)


def canonical_host(key: Column, base_url: Column) -> Column:
    return F.coalesce(_of(key, HOSTS), base_url)


def auth_header(key: Column) -> Column:
    return F.coalesce(_of(key, HEADERS), F.lit("authorization"))


def provider_of_host(host: Column, path: Column) -> Column:
    """Key of the provider that serves a host and path, null if none is known to."""
    h = ascii_lower(host)
    exact = {v: k for k, v in HOSTS.items() if k not in ("gemini_vertex", "bedrock", "azure_openai", "ollama", "opencode", "opencode_zen")}
    exact["api.cohere.ai"] = "cohere"
    local = (h == "localhost") | h.startswith("localhost:") | (h == "127.0.0.1")
    return (
        F.when(h.isin(*exact), _of(h, exact))
        .when(h.endswith("aiplatform.googleapis.com"), "gemini_vertex")
        .when(h.startswith("bedrock-runtime.") & h.endswith(".amazonaws.com"), "bedrock")
        .when(h.endswith(".openai.azure.com"), "azure_openai")
        .when((h == "opencode.ai") & path.startswith("/zen/go"), "opencode")
        .when((h == "opencode.ai") & path.startswith("/zen"), "opencode_zen")
        .when(local & (path.startswith("/api/") | h.endswith(":11434")), "ollama")
    )
