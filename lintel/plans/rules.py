"""Rules: decoding, checking, the registry of rule types, lanes, costs and shards."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession

COSTS = ("fast", "range", "tree", "heavy")
SEVERITIES = ("error", "warn")


class ConfigError(ValueError):
    """A rule that can't be used; the run ends with exit code 2."""


@dataclass(frozen=True)
class RuleType:
    name: str
    build: Callable[[DataFrame, Mapping[str, Any]], DataFrame]
    required: frozenset[str]
    optional: frozenset[str]
    cost: str = "fast"
    #: Whether the verdict needs the whole scope, not only changed files.
    whole: Callable[[Mapping[str, Any]], bool] = lambda params: False
    paths_only: bool = False
    #: Findings of one file, as an array of (line, message) over the columns of files; None where params ask for more.
    local: Callable[[Mapping[str, Any]], Column | None] = lambda params: None
    #: Aggregates over the files where a test holds, and the message that their values give (null: none); None likewise.
    total: Callable[[Mapping[str, Any], Column], tuple[list[Column], Callable[[list[Column]], Column]] | None] = lambda params, held: None
    #: Whether build() also takes all files, in the scope or not.
    universe: bool = False


TYPES: dict[str, RuleType] = {}


def rule_type(name: str, required: str = "", optional: str = "", cost: str = "fast", whole: bool | Callable[[Mapping[str, Any]], bool] = False, **more):
    """Registers build(files in scope, params) -> (path, line, message)."""

    def register(build: Callable[[DataFrame, Mapping[str, Any]], DataFrame]):
        decide = whole if callable(whole) else lambda params: whole
        TYPES[name] = RuleType(name, build, frozenset(required.split()), frozenset(optional.split()), cost, decide, **more)
        return build

    return register


@dataclass(frozen=True)
class Rule:
    id: str
    type: str
    params: Mapping[str, Any] = field(default_factory=dict)
    severity: str = "error"
    include: tuple[str, ...] = ("**",)
    exclude: tuple[str, ...] = ()
    preprocess: str = "raw"
    min_files: int | None = None
    tags: tuple[str, ...] = ()
    cost: str | None = None
    cure: str = ""
    production: bool = False
    #: Whether the rule also judges files that a generator wrote.
    generated: bool = False
    #: (marker, holders): declarations that a marker opens are blanked; so many places of the scope hold it.
    not_declaring: tuple[tuple[str, int], ...] = ()

    def __post_init__(self) -> None:
        from lintel.functions.lexers import INTERNAL, TRANSFORMS

        if not re.fullmatch(r"[a-z0-9]+(-[a-z0-9]+)*", self.id):
            raise ConfigError(f"{self.id!r}: ids are kebab-case")
        if self.severity not in SEVERITIES:
            raise ConfigError(f"{self.id}: unknown severity {self.severity!r}")
        if self.type not in TYPES:
            raise ConfigError(f"{self.id}: unknown type {self.type!r}")
        if self.preprocess not in set(TRANSFORMS) - INTERNAL and self.preprocess not in ("raw", "qualify-proto-go-alias"):
            raise ConfigError(f"{self.id}: unknown preprocessor {self.preprocess!r}")
        if self.cost is not None and self.cost not in COSTS:
            raise ConfigError(f"{self.id}: unknown cost {self.cost!r}")
        kind = TYPES[self.type]
        if missing := kind.required - set(self.params):
            raise ConfigError(f"{self.id}: {', '.join(sorted(missing))} is missing")
        if unknown := set(self.params) - kind.required - kind.optional:
            raise ConfigError(f"{self.id}: unknown {', '.join(sorted(unknown))}")

        for what, holders in (*self.not_declaring, *self.credentials):
            if not what or not isinstance(holders, int) or holders < 1:
                raise ConfigError(f"{self.id}: {what!r} needs the number of its holders, at least 1")
        if odd := [x for x, _ in self.credentials if not re.match(r"(?:\(\?[a-zA-Z]+\))?\^", x)]:
            raise ConfigError(f"{self.id}: a credential starts with ^, unlike {odd[0]!r}")

    @property
    def credentials(self) -> list[tuple[str, int]]:
        """(pattern, holders): lines that open a declaration which may do what the rule forbids."""
        entries = [x for key in ("require_absent", "none_of") for x in self.params.get(key) or [] if isinstance(x, Mapping)]
        return [(x["credential"], x.get("holders")) for x in entries if "credential" in x]

    @property
    def cost_class(self) -> str:
        return self.cost or TYPES[self.type].cost

    @property
    def whole(self) -> bool:
        return bool(self.not_declaring or self.credentials) or TYPES[self.type].whole(self.params)


_FIELDS = {"id", "type", "params", "severity", "scope", "preprocess", "tags", "cost", "cure"}
_SCOPE = {"include", "exclude", "min_files", "subject", "generated", "not_declaring"}


def decode(spec: Mapping[str, Any]) -> Rule:
    """A rule from a mapping; unknown keys are errors."""
    if unknown := set(spec) - _FIELDS:
        raise ConfigError(f"{spec.get('id')}: unknown {', '.join(sorted(unknown))}")
    scope = spec.get("scope", {}) or {}
    if unknown := set(scope) - _SCOPE:
        raise ConfigError(f"{spec.get('id')}: unknown {', '.join(sorted(unknown))} in scope")
    return Rule(
        id=str(spec.get("id", "")), type=str(spec.get("type", "")), params=spec.get("params", {}) or {}, severity=spec.get("severity", "error"), include=tuple(scope.get("include", ("**",))), exclude=tuple(scope.get("exclude", ())),
        preprocess=spec.get("preprocess", "raw"), min_files=scope.get("min_files"), tags=tuple(spec.get("tags", ())), cost=spec.get("cost"), cure=spec.get("cure", ""), production=scope.get("subject") == "production",
        generated=bool(scope.get("generated", False)), not_declaring=tuple(_holder(x, spec.get("id")) for x in scope.get("not_declaring", ())),
    )


def _holder(entry: Any, id: Any) -> tuple[str, int]:
    if not isinstance(entry, Mapping) or set(entry) != {"marker", "holders"}:
        raise ConfigError(f"{id}: not_declaring takes {{marker, holders}}")
    return entry["marker"], entry["holders"]


def load(text: str, packs: Iterable[str] = ()) -> list[Rule]:
    """Rules of a YAML text ({rules: [...]}); packs come first, and a local rule replaces one with its id."""
    import yaml

    found: dict[str, Rule] = {}
    for source in (*packs, text):
        body = yaml.safe_load(source) or {}
        if not isinstance(body, dict) or set(body) - {"rules"}:
            raise ConfigError("only `rules` is known at the top")
        own = [decode(x) for x in body.get("rules", []) or []]
        if len({r.id for r in own}) < len(own):
            raise ConfigError("an id occurs twice")
        found |= {r.id: r for r in own}
    return sorted(found.values(), key=lambda r: r.id)


def lane(rules: Iterable[Rule], cost: str | None = None, tags: Iterable[str] = ("all",)) -> list[Rule]:
    """Rules of a lane: of its cost, if it names one, and with one of its tags (or `all`)."""
    tags = set(tags)
    return [r for r in rules if cost in (None, r.cost_class) and ("all" in tags or tags & set(r.tags))]


def up_to_cost(rules: Iterable[Rule], most: str) -> tuple[list[Rule], list[Rule]]:
    """Rules that a cost limit keeps, and those it drops (which a run has to disclose)."""
    rules = [*rules]
    kept = [r for r in rules if COSTS.index(r.cost_class) <= COSTS.index(most)]
    return kept, [r for r in rules if r not in kept]


def shard(rules: Iterable[Rule], k: int, n: int, seconds: Mapping[str, float] | None = None, pins: Mapping[str, int] | None = None) -> list[Rule]:
    """Shard k (from 1) of n: pinned rules first, then the longest goes to the shard with the least so far."""
    seconds, pins = seconds or {}, pins or {}
    rules = [*rules]
    load_, of = [0.0] * n, {}
    for r in sorted((r for r in rules if r.id in pins), key=lambda r: r.id):
        of[r.id] = pins[r.id] - 1
        load_[of[r.id]] += seconds.get(r.id, 0)
    for r in sorted((r for r in rules if r.id not in pins), key=lambda r: (-seconds.get(r.id, 0), -COSTS.index(r.cost_class), r.id)):
        of[r.id] = min(range(n), key=lambda i: (load_[i], i))
        load_[of[r.id]] += seconds.get(r.id, 0) or 1e-9
    return [r for r in rules if of[r.id] == k - 1]


def as_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    rows = [(r.id, r.type, r.severity, r.cost_class, [*r.include], [*r.exclude], [*r.tags], json.dumps(dict(r.params), sort_keys=True)) for r in rules]
    return spark.createDataFrame(rows, "rule string, type string, severity string, cost string, include array<string>, exclude array<string>, tags array<string>, params string")
