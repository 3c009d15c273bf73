"""Named detection policies from TOML or JSON files, read on the driver."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields
from pathlib import Path

from quarrylog.functions.scoring import THRESHOLDS, ScoringConfig, SourceThresholds
from quarrylog.functions.text import rule_source_text


class ConfigError(ValueError):
    """A policy file, or a combination of options, that can't be used."""


@dataclass(frozen=True)
class DetectionPolicy:
    name: str
    error_threshold: int = 5
    repeat_threshold: int = 5
    burst_threshold: int = 5
    burst_window_seconds: int = 60
    scoring: ScoringConfig = field(default_factory=ScoringConfig)
    sources: dict[str, SourceThresholds] = field(default_factory=dict)


DEFAULT_POLICY = DetectionPolicy("default")


def _table(value: object, where: str, known: Iterable[str] | None = None) -> dict:
    if not isinstance(value, dict):
        raise ConfigError(f"{where} must be an object")
    if known is not None and (other := sorted(set(value) - set(known))):
        raise ConfigError(f"{where}: unknown setting(s) {', '.join(other)}; known are {', '.join(sorted(known))}")
    return value


def _integers(table: dict, least: Mapping[str, int], where: str) -> dict[str, int]:
    for name in least:
        if name in table and (type(table[name]) is not int or table[name] < least[name]):
            raise ConfigError(f"{where}: {name} must be an integer >= {least[name]}, got {table[name]!r}")
    return {name: table[name] for name in least if name in table}


def _policy(name: str, value: object, where: str) -> DetectionPolicy:
    table = _table(value, where, (*THRESHOLDS, "scoring", "sources"))
    weights = {f.name: 0 for f in fields(ScoringConfig)}
    scoring = _integers(_table(table.get("scoring", {}), f"{where}.scoring", weights), weights, f"{where}.scoring")
    sources: dict[str, SourceThresholds] = {}
    for raw, own in _table(table.get("sources", {}), f"{where}.sources").items():
        source = rule_source_text(str(raw))
        if source is None:
            raise ConfigError(f"{where}: names of source overrides must not be blank")
        if source in sources:
            raise ConfigError(f"{where}: duplicate override for source {source!r}")
        at = f"{where}.sources[{source!r}]"
        sources[source] = SourceThresholds(**_integers(_table(own, at, THRESHOLDS), THRESHOLDS, at))
    try:
        return DetectionPolicy(name, **_integers(table, THRESHOLDS, where), scoring=ScoringConfig(**scoring), sources=sources)
    except ValueError as e:
        raise ConfigError(f"{where}.scoring: {e}") from e


def load_policies(path: str | Path) -> dict[str, DetectionPolicy]:
    path = Path(path)
    try:
        content = path.read_text(encoding="utf-8")
    except OSError as e:
        raise ConfigError(f"cannot read config file {path}: {e}") from e
    readers = {".json": json.loads, ".toml": tomllib.loads}
    if path.suffix.lower() not in readers:
        raise ConfigError(f"config file {path} must have the suffix .toml or .json")
    try:
        data = readers[path.suffix.lower()](content)
    except ValueError as e:
        raise ConfigError(f"config file {path} can't be parsed: {e}") from e
    policies = _table(data, f"config file {path}").get("policy")
    if not isinstance(policies, dict) or not policies:
        raise ConfigError(f"{path}: at least one [policy.<name>] table is needed")
    return {str(name): _policy(str(name), value, f"{path}: policy {name!r}") for name, value in policies.items()}


def resolve_policy(policies: Mapping[str, DetectionPolicy], name: str | None = None) -> DetectionPolicy:
    """The policy of that name; without one, `default`, or the only policy."""
    wanted = name if name is not None else "default" if "default" in policies else next(iter(policies)) if len(policies) == 1 else None
    if wanted is None:
        raise ConfigError("--policy is required: there are several policies, and none is named 'default'")
    if wanted not in policies:
        raise ConfigError(f"policy {wanted!r} is not defined (there are: {', '.join(sorted(policies))})")
    return policies[wanted]
