"""Settings: environment, then file, then defaults."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, fields
from pathlib import Path

#: What two of the settings may be.
COMPRESSIONS = ("gzip", "none")
LOG_LEVELS = ("trace", "debug", "info", "warn", "error")


class ConfigError(ValueError):
    """A setting is outside its bounds, or a file can't be read."""


@dataclass(frozen=True)
class Config:
    cache_enabled: bool = True
    cache_max_size: int = 52_428_800
    cache_max_entry: int = 102_400
    cache_ttl: int = 3600
    cache_compression: str = "gzip"
    db_path: str = os.path.join("~", ".config", "corvane", "store")
    log_level: str = "info"
    searxng_url: str | None = None
    search_backend: str | None = None
    default_strategy: str | None = None
    allow_private_networks: bool = False
    respect_robots_txt: bool = False
    default_extraction_mode: str = "markdown"
    http_server_enabled: bool = False
    http_server_port: int = 8080
    http_server_host: str = "127.0.0.1"

    def validate(self) -> Config:
        for name in ("cache_max_size", "cache_max_entry", "cache_ttl"):
            if getattr(self, name) <= 0:
                raise ConfigError(f"{name} must be > 0")
        if self.cache_max_entry > self.cache_max_size:
            raise ConfigError("cache_max_entry must be <= cache_max_size")
        if self.cache_compression not in COMPRESSIONS:
            raise ConfigError(f"cache_compression must be one of {COMPRESSIONS}")
        if self.log_level not in LOG_LEVELS:
            raise ConfigError(f"log_level must be one of {LOG_LEVELS}")
        return self


def _from_file(path: str) -> dict:
    raw = Path(path).read_text()
    try:
        return json.loads(raw) if path.endswith(".json") else tomllib.loads(raw)
    except ValueError as error:
        raise ConfigError(f"{path} can't be read: {error}") from error


def _from_text(kind: str, raw: str):
    """The value of an environment variable; None if it isn't one of the setting's kind."""
    if kind == "bool":
        return raw in {"true", "1"}
    if kind == "int":
        return int(raw) if raw.isascii() and raw.isdigit() else None
    return raw


_KINDS = {"bool": bool, "int": int}


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "CORVANE_") -> Config:
    """Settings of a TOML (or JSON) file, which the environment overrides; other keys, and values of another kind, are passed over."""
    env = dict(os.environ) if env is None else env
    found = _from_file(path) if path else {}
    given = {}
    for f in fields(Config):
        value = found.get(f.name)
        if isinstance(value, _KINDS.get(f.type, str)) and not (f.type == "int" and isinstance(value, bool)):
            given[f.name] = value
        if (raw := env.get(prefix + f.name.upper())) is not None and (value := _from_text(f.type, raw)) is not None:
            given[f.name] = value
    return Config(**given).validate()
