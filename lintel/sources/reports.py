"""Findings as text, JSON and annotations."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame

from lintel.plans.rules import Rule


def collected(findings: DataFrame) -> list[dict]:
    return [r.asDict() for r in findings.toLocalIterator()]


def human(rules: Iterable[Rule], found: Sequence[dict]) -> str:
    by = defaultdict(list)
    for f in found:
        by[f["rule"]].append(f)
    out, rules = [], sorted(rules, key=lambda r: r.id)
    for r in rules:
        own = by[r.id]
        verdict = "OK" if not own else f"{'FAIL' if any(f['severity'] == 'error' for f in own) else 'WARN'} — {len(own)} finding(s)"
        out.append(f"[{r.id}] {verdict}")
        for f in own:
            place = f["path"] + (f":{f['line']}" if f["line"] else "") if f["path"] else "(scope)"
            out.append(f"  {place}  {f['message']}")
        if own and r.cure:
            out.append(f"  Cure: {r.cure}")
    out.append(f"{len(rules)} rule(s), {sum(not by[r.id] for r in rules)} passed, {len(found)} finding(s)")
    return "\n".join(out) + "\n"


def as_json(rules: Iterable[Rule], found: Sequence[dict]) -> str:
    rules = [*rules]
    cures = {r.id: r.cure for r in rules}
    rows = [f | ({"cure": cures[f["rule"]]} if cures.get(f["rule"]) else {}) for f in found]
    failed = {f["rule"] for f in found}
    return json.dumps({"findings": rows, "summary": {"rules_total": len(rules), "rules_passed": sum(r.id not in failed for r in rules), "findings": len(found)}}, ensure_ascii=False, indent=2) + "\n"


def _escaped(x: str, more: str = "") -> str:
    for c in "%\r\n" + more:
        x = x.replace(c, f"%{ord(c):02X}")
    return x


def github(rules: Iterable[Rule], found: Sequence[dict]) -> str:
    cures = {r.id: r.cure for r in rules}
    out = []
    for f in found:
        where = ([f"file={_escaped(f['path'], ':,')}"] if f["path"] else []) + ([f"line={f['line']}"] if f["line"] else [])
        cure = f" Cure: {cures[f['rule']]}" if cures.get(f["rule"]) else ""
        out.append(f"::{'error' if f['severity'] == 'error' else 'warning'}{' ' * bool(where)}{','.join(where)}::{_escaped(f'[{f['rule']}] {f['message']}{cure}')}")
    return "\n".join(out) + ("\n" if out else "")
