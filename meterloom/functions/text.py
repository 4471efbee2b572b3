"""Strings as the wire format means them: ASCII case, Unicode trim, lengths in bytes."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def trim_unicode(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_model(c: Column) -> Column:
    return ascii_lower(trim_unicode(c))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def or_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def strip_date_suffix(c: Column) -> Column:
    """Without a trailing ``-YYYY-MM-DD`` or ``-YYYYMMDD``, as long as something stays."""
    return F.regexp_replace(c, r"(?<=.)(-[0-9]{4}-[0-9]{2}-[0-9]{2}|-[0-9]{8})$", "")


def cut_bytes(c: Column, most: int) -> Column:
    """At most ``most`` bytes, cut between characters."""
    cut = F.substring(c.cast("binary"), 1, most)
    # a character that the cut went through does not decode; at most three bytes are lost
    tries = [F.try_validate_utf8(F.substring(cut, F.lit(1), F.octet_length(cut) - i)) for i in range(4)]
    return F.when(F.octet_length(c) <= most, c).otherwise(F.coalesce(*tries))


def trace_id(c: Column) -> Column:
    """32 lower-case hex digits, with or without 0x before; null otherwise."""
    bare = F.regexp_replace(c, "^0x", "")
    return F.when(bare.rlike("^[0-9a-fA-F]{32}$"), F.lower(bare))


_V4 = r"((25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(\.(?!$)|$)){4}"
_G = "[0-9a-fA-F]{1,4}"


def client_ip(c: Column) -> Column:
    """An IPv4 or IPv6 address, null otherwise."""
    v6 = rf"(({_G}:){{7}}{_G}|(?=.*::)(?!.*::.*::)(?=([^:]*:){{2,7}}[^:]*$)({_G})?(:({_G})?){{2,7}})"
    return F.when(c.rlike(f"^{_V4}$") | c.rlike(f"^{v6}$"), c)


def http_method(c: Column) -> Column:
    return F.when(c.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$"), c).otherwise("POST")


def json_string(json: Column, field: str) -> Column:
    """A field of a JSON object if it is a string, '' otherwise."""
    v = F.variant_get(F.try_parse_json(json), f"$.{field}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise("")


def key_id(token: Column) -> Column:
    """Of ``id:secret`` the id; of a bare secret ``key_`` and four bytes of its SHA-256, without zero padding."""
    digest = F.sha2(token.cast("binary"), 256)
    short = F.concat(F.lit("key_"), *(F.regexp_replace(F.substring(digest, 2 * i + 1, 2), "^0(?=.)", "") for i in range(4)))
    return F.when(token.rlike("(?s)^[^:]+:."), F.substring_index(token, ":", 1)).otherwise(short)
