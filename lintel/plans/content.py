"""Verdicts about supplied contents: rules that one file decides run, the others are deferred with a reason."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.plans import engine
from lintel.plans.rules import TYPES, Rule
from lintel.sources import corpus

SCHEMA, VERSION, SHOWN = 1, "1", 3
#: Types that one file decides.
LOCAL = frozenset(
    "binary-content file-naming file-size ordering forbidden-pattern go/expected-derives-from-actual go/func-line-budget "
    "go/call-confined-to-func-name go/guard-precedes-call dart/ref-after-await dart/numeric-field-validated "
    "dart/gate-reads-are-listened".split()
)
#: Types that one .sql file decides; in Go files, statements can come from elsewhere.
LOCAL_SQL = frozenset("sql/statement-predicate sql/locking-select-order sql/locking-target".split())


def deferral(rule: Rule, path: str) -> str | None:
    """Why a rule can't judge the file at path on its own, or None."""
    if rule.not_declaring:
        return "scope_not_declaring"
    if TYPES[rule.type].whole(rule.params):
        return "whole_tree_invariant"
    if rule.type in LOCAL and not rule.credentials and "census" not in rule.params or rule.type in LOCAL_SQL and path.lower().endswith(".sql"):
        return None
    return "content_only_not_supported"


def _digest(*parts: str | bytes) -> str:
    return "sha256:" + hashlib.sha256(b"\0".join(x.encode() if isinstance(x, str) else x for x in parts)).hexdigest()


def _scopes(files: DataFrame, rules: Sequence[Rule], tests: Sequence[str], generated: Sequence[str]) -> dict[str, tuple[set[str], set[str]]]:
    """By path: ids whose scope holds it, and ids that leave it out as generated; one pass for all rules."""
    outside = engine.any_glob(tests) if tests else F.lit(False)
    made = engine.is_generated(generated)
    named = lambda test: F.array_compact(F.array(*(F.when(test(r), F.lit(r.id)) for r in rules)))
    held = lambda r: engine.in_scope_test(r) & ~(outside if r.production else F.lit(False))
    rows = files.select("path", named(held).alias("held"), named(lambda r: held(r) & made & F.lit(not r.generated)).alias("made"))
    return {r["path"]: (set(r["held"]), set(r["made"])) for r in rows.collect()}


def check(spark: SparkSession, records: Sequence[tuple[str, str | bytes]], rules: Sequence[Rule], tests: Sequence[str] = (), generated: Sequence[str] = (), corpus_text: str = "") -> list[dict[str, Any]]:
    """A document for each record (path, content): coverage, findings and digests.

    Records that the same rules can judge share a plan; where a path occurs twice, each record has its own.
    """
    began = time.time()
    if len({path for path, _ in records}) < len(records):
        return [check(spark, [x], rules, tests, generated, corpus_text)[0] for x in records]
    files = corpus.memory(spark, records)
    scopes = _scopes(files, rules, tests, generated)
    why = {path: {r.id: deferral(r, path) for r in rules if r.id in held - made} for path, (held, made) in scopes.items()}
    found: dict[str, list[dict]] = {path: [] for path, _ in records}
    groups: dict[tuple[str, ...], list[str]] = {}
    for path, reasons in why.items():
        groups.setdefault(tuple(sorted(i for i, x in reasons.items() if x is None)), []).append(path)
    cures = {r.id: r.cure for r in rules}
    for ids, paths in groups.items():  # files that the same rules judge share a plan
        if ids:
            some = files.where(F.col("path").isin(paths))
            for f in engine.evaluate(some, [r for r in rules if r.id in ids], tests=tests, generated=generated, sort=True).collect():
                found[f["path"]].append({**f.asDict(), "cure": cures[f["rule"]], "explain": f"explain {f['rule']}"})
    out = []
    for path, content in records:
        held, made = scopes[path]
        ran = sorted(i for i, x in why[path].items() if x is None)
        later = sorted((i, x) for i, x in why[path].items() if x)
        got = found[path]
        whole, own = _digest(corpus_text or json.dumps([repr(r) for r in rules])), _digest(content)
        out.append({
            "schema_version": SCHEMA, "engine_version": VERSION, "corpus_hash": whole, "path": path, "content_hash": own,
            "status": "findings" if got else "clean" if ran else "no_eligible_rules",
            "coverage": {"rules_total": len(rules), "in_scope": len(held - made), "eligible": len(ran), "evaluated": len(ran), "deferred": len(later), "out_of_scope": len(rules) - len(held - made)},
            "evaluated_rule_ids": ran, "not_evaluated": [{"rule": i, "reason": x} for i, x in sorted([*later, *((i, "generated_excluded") for i in made)])],
            "findings": got, "findings_total": len(got), "findings_omitted": 0,
            "replay_handle": _digest(str(SCHEMA), VERSION, whole, path, own), "elapsed_ms": int(1000 * (time.time() - began)),
        })
    return out


def shortened(document: dict[str, Any]) -> dict[str, Any]:
    """The document with its first findings only."""
    return {**document, "findings": document["findings"][:SHOWN], "findings_omitted": max(0, document["findings_total"] - SHOWN)}


def failed(documents: Sequence[dict[str, Any]]) -> bool:
    """Whether an error was found; documents that aren't shortened tell."""
    return any(f["severity"] == "error" for d in documents for f in d["findings"])
