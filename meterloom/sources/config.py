"""Settings from TOML and ``METERLOOM_SECTION__KEY`` variables, checked once."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace


@dataclass(frozen=True)
class Config:
    default_tier: str = "free"
    retention_days: dict[str, int] = field(default_factory=lambda: {"free": 7, "pro": 90})
    archive_after_days: int = 30
    archive_chunk: int = 10_000
    idempotency_ttl_s: int = 300
    max_db_size_bytes: int = 0
    catalog_refresh_s: int = 86_400
    batch_size: int = 64
    flush_interval_ms: int = 50

    def warnings(self) -> list[str]:
        """Tiers whose events are dropped before they could be archived."""
        return [f"tier {t}: events go after {d} days, archiving starts after {self.archive_after_days}" for t, d in sorted(self.retention_days.items()) if 0 < d < self.archive_after_days]


def load(text: str = "", environ: dict[str, str] | None = None) -> Config:
    given = tomllib.loads(text)
    known = {f.name: f for f in fields(Config)}
    for name, value in (os.environ if environ is None else environ).items():
        if name.startswith("METERLOOM_"):
            at, keys = given, name[len("METERLOOM_"):].lower().split("__")
            for k in keys[:-1]:
                at = at.setdefault(k, {})
            at[keys[-1]] = int(value) if value.lstrip("-").isdigit() else value
    if unknown := given.keys() - known.keys():
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    config = replace(Config(), **given)
    for f in fields(Config):
        value = getattr(config, f.name)
        if f.type == "int" and (not isinstance(value, int) or value < 0):
            raise ValueError(f"{f.name} must be a number from 0 upwards")
    if any(not isinstance(d, int) or d < 0 for d in config.retention_days.values()):
        raise ValueError("retention_days must be numbers from 0 upwards")
    return config
