"""Settings: defaults, environment and .env overrides. Each group checks itself when it is made."""

from __future__ import annotations

import logging
import math
import os
import re
import sys
from dataclasses import dataclass, field, fields, replace

log = logging.getLogger(__name__)

ENV_PREFIX = "DOCQUARRY_"
REFERENCES, CONTENT = "references", "content"
SCHEME = re.compile(r"^[a-zA-Z][a-zA-Z0-9+\-.]*\Z")
MAX_BOOST = math.sqrt(sys.float_info.max)


class SettingsError(ValueError):
    pass


@dataclass(frozen=True)
class SearchSettings:
    max_results: int = 10
    in_memory: bool = False
    keywords_boost: float = 3.0
    heading_boost: float = 2.5
    title_boost: float = 2.0
    path_boost: float = 1.25
    content_boost: float = 1.0
    result_mode: str = REFERENCES

    def __post_init__(self):
        if self.result_mode not in (REFERENCES, CONTENT):
            raise SettingsError(f"unknown result mode {self.result_mode!r}, known are {REFERENCES} and {CONTENT}")
        # Weights are squared, so no boost may exceed the root of the largest double; NaN fails the comparison too.
        unusable = {name: boost for name, boost in self.boosts().items() if not 0 <= boost <= MAX_BOOST}
        if unusable or not any(self.boosts().values()):
            raise SettingsError(f"boosts have to lie between 0 and {MAX_BOOST:.3g}, one of them above 0: {unusable or self.boosts()}")

    def boosts(self) -> dict[str, float]:
        """Searchable field to boost, in clause order."""
        return {
            "keywords": self.keywords_boost,
            "heading_path": self.heading_boost,
            "source_title": self.title_boost,
            "path_labels": self.path_boost,
            "content": self.content_boost,
        }


@dataclass(frozen=True)
class Settings:
    content_dir: str = field(default_factory=os.getcwd)
    uri_scheme: str = "doc"
    cross_ref: bool = False
    search: SearchSettings = SearchSettings()

    def __post_init__(self):
        if not SCHEME.match(self.uri_scheme):
            raise SettingsError(f"not a URI scheme: {self.uri_scheme!r}")


TRUE_WORDS = frozenset({"1", "t", "true"})
FALSE_WORDS = frozenset({"0", "f", "false"})


def _convert(raw, kind: type, key: str):
    if not isinstance(raw, str):
        return raw
    try:
        if kind is bool:
            word = raw.strip().lower()
            if word not in TRUE_WORDS | FALSE_WORDS:
                raise ValueError(raw)
            return word in TRUE_WORDS
        return kind(raw)
    except ValueError:
        raise SettingsError(f"{key}: cannot read {raw!r} as {kind.__name__}") from None


def _read_dotenv(path: str) -> dict[str, str]:
    try:
        with open(path, encoding="utf-8") as file:
            lines = file.read().splitlines()
    except OSError:
        return {}
    pairs = (line.removeprefix("export ").split("=", 1) for line in map(str.strip, lines) if "=" in line and line[0] != "#")
    return {key.strip(): value.strip().strip("'\"") for key, value in pairs}


def load_settings(overrides: dict | None = None, env: dict | None = None, dotenv: str = ".env") -> Settings:
    """Highest wins: overrides, environment, .env file, defaults.

    Keys are dotted (``search.max_results``); the environment uses DOCQUARRY_SEARCH_MAX_RESULTS.
    """
    overrides = overrides or {}
    env = os.environ if env is None else env
    from_file = _read_dotenv(dotenv)

    def fill(current, prefix: str):
        changed = {}
        for item in fields(current):
            value = getattr(current, item.name)
            key = prefix + item.name
            if hasattr(value, "__dataclass_fields__"):
                changed[item.name] = fill(value, key + ".")
                continue
            name = ENV_PREFIX + key.replace(".", "_").upper()
            raw = next((s[k] for s, k in ((overrides, key), (env, name), (from_file, name)) if s.get(k) not in (None, "")), None)
            if raw is not None:
                changed[item.name] = _convert(raw, type(value), key)
        return replace(current, **changed)

    return fill(Settings(), "")


def summary(settings: Settings) -> dict[str, object]:
    shown: dict[str, object] = {name: getattr(settings, name) for name in ("content_dir", "uri_scheme", "cross_ref")}
    return shown | {f"search.{item.name}": getattr(settings.search, item.name) for item in fields(SearchSettings)}


def log_settings(settings: Settings, logger: logging.Logger = log) -> None:
    for key, value in summary(settings).items():
        logger.info("Config: %s value=%s", key, value)
