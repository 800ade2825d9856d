"""Configuration: which stores there are, and what holds for each. An unknown store, key or value is an error, never a default."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields

from attesta.functions.fixed import ADAPTIVE_LADDER, FRESH_DAYS, GATE, TRIGGER_TOKENS, WINDOW_CEILING, WINDOW_SHARE, WINDOW_TOKENS
from attesta.sources.writer import POLICIES


class ConfigError(ValueError):
    pass


@dataclass(frozen=True)
class StoreConfig:
    name: str
    path: str
    label: str = ""
    write_policy: str = "direct-allowed"
    fastpath: bool = True
    gate: float = GATE
    cues: bool = True
    fresh_days: float = FRESH_DAYS
    trigger_tokens: int = TRIGGER_TOKENS
    window_tokens: int = WINDOW_TOKENS
    budget: float = WINDOW_SHARE
    ceiling: float = WINDOW_CEILING
    ladder: tuple[int, ...] = ADAPTIVE_LADDER

    def __post_init__(self):
        kinds = {"str": str, "bool": bool, "float": (int, float), "int": int}
        for f in fields(self):
            v, kind = getattr(self, f.name), kinds.get(str(f.type))
            if kind and (not isinstance(v, kind) or isinstance(v, bool) and kind is not bool):
                raise ConfigError(f"{self.name}: {f.name} must be a {f.type}")
        if self.write_policy not in POLICIES:
            raise ConfigError(f"{self.name}: unknown write policy {self.write_policy!r}")
        if not 0 < self.budget <= self.ceiling <= 1:
            raise ConfigError(f"{self.name}: budget and ceiling must satisfy 0 < budget <= ceiling <= 1")
        if list(self.ladder) != sorted(set(self.ladder)) or not self.ladder:
            raise ConfigError(f"{self.name}: the ladder must rise")


@dataclass(frozen=True)
class Registry:
    stores: dict[str, StoreConfig]
    default: str
    modes: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str) -> Registry:
        with open(path, "rb") as f:
            return cls.of(tomllib.load(f), os.path.dirname(os.path.abspath(path)))

    @classmethod
    def of(cls, raw: dict, base: str = ".") -> Registry:
        """raw: stores (a table of tables; paths are relative to base), defaults, default, modes."""
        if extra := set(raw) - {"stores", "defaults", "default", "modes"}:
            raise ConfigError(f"unknown keys: {sorted(extra)}")
        known = {f.name for f in fields(StoreConfig)} - {"name"}
        stores: dict[str, StoreConfig] = {}
        for name, own in raw.get("stores", {}).items():
            merged = {**raw.get("defaults", {}), **own}
            if extra := set(merged) - known:
                raise ConfigError(f"{name}: unknown keys: {sorted(extra)}")
            if not merged.get("path"):
                raise ConfigError(f"{name}: a store needs a path")
            merged["path"] = merged["path"] if "://" in merged["path"] else os.path.normpath(os.path.join(base, merged["path"]))
            if "ladder" in merged:
                merged["ladder"] = tuple(merged["ladder"])
            stores[name] = StoreConfig(name=name, **merged)
        real = {}
        for s in stores.values():
            p = s.path if "://" in s.path else os.path.realpath(s.path)
            for other, q in real.items():
                if p == q or p.startswith(q + os.sep) or q.startswith(p + os.sep):
                    raise ConfigError(f"{s.name} and {other} share files")
            real[s.name] = p
        default = raw.get("default") or next(iter(stores), "")
        for target in (default, *raw.get("modes", {}).values()):
            if target not in stores:
                raise ConfigError(f"no store named {target!r}")
        return cls(stores, default, dict(raw.get("modes", {})))

    def store(self, selector: str | None = None) -> StoreConfig:
        """By name or mode; none means the default."""
        name = self.default if selector is None else self.modes.get(selector, selector)
        if name not in self.stores:
            raise ConfigError(f"no store or mode named {selector!r}")
        return self.stores[name]
