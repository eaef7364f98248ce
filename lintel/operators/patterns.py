"""Rules about patterns in lines and texts."""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.patterns import gate_of, required_literal, to_java
from lintel.plans.rules import ConfigError, rule_type
from lintel.schema import NO_LINE, NO_PATH, line_at, lines_array, lines_of


def java(params: Mapping[str, Any], pattern: str) -> str:
    return to_java(pattern, params.get("syntax") == "regexp2")


def _list(x: Any) -> list:
    """A value, or a list of them, as a list."""
    return [] if x is None else list(x) if isinstance(x, (list, tuple)) else [x]


def finding(message: str | Column, line: str | Column | int = "line_no", path: str | Column = "path") -> list[Column]:
    line = F.lit(line) if isinstance(line, int) else F.col(line) if isinstance(line, str) else line
    return [(F.col(path) if isinstance(path, str) else path).alias("path"), line.cast("int").alias("line"), (F.lit(message) if isinstance(message, str) else message).alias("message")]


def found_at(message: str | Column, line: Column | int) -> Column:
    """A local finding."""
    message, line = (F.lit(x) if isinstance(x, (str, int)) else x for x in (message, line))
    return F.struct(line.cast("int").alias("line"), message.alias("message"))


def from_local(files: DataFrame, found: Column) -> DataFrame:
    # Of explode(), the optimiser would test the whole expression twice more before it makes rows.
    return files.select("path", F.explode_outer(found).alias("x")).where("x is not null").select("path", "x.line", "x.message")


def gate(params: Mapping[str, Any], pattern: str, lines: bool = True) -> Column:
    """Texts that may hold the pattern (in a line): those with a literal that every match must hold, and, for lines, a match
    anywhere. Verdicts don't depend on it."""
    literal = params.get("prefilter") or required_literal(pattern)
    test = F.col("text").contains(literal) if literal else F.lit(True)
    wide = gate_of(pattern, params.get("syntax") == "regexp2") if lines and len(literal or "") < 3 else None
    return test & F.col("text").rlike(wide) if wide else test


def matches(params: Mapping[str, Any], pattern: str):
    """Tells of a line whether the pattern matches in it."""
    regex, literal = java(params, pattern), required_literal(pattern)
    return lambda x: x.contains(literal) & x.rlike(regex) if literal else x.rlike(regex)


def gated(files: DataFrame, params: Mapping[str, Any], pattern: str) -> DataFrame:
    return files.where(gate(params, pattern, lines=False))


def places(text: Column, test: Any) -> Column:
    """Numbers, from 1, of the lines that pass a test."""
    return F.array_compact(F.transform(lines_array(text), lambda x, i: F.when(test(x), i + 1)))


def _forbidden_local(params: Mapping[str, Any]) -> Column | None:
    """Modes that look at a line, or at a text as a whole, without what surrounds it."""
    if not set(params) <= {"pattern", "multiline", "all_of", "none_of", "require_present", "denied_by", "prefilter", "syntax"}:
        return None
    if ("pattern" in params) == ("all_of" in params) or any(not isinstance(x, str) for x in _list(params.get("none_of"))):
        return None
    whole = lambda p: F.col("text").rlike(java(params, p))
    test = functools.reduce(operator.and_, (gate({}, x, lines=False) & whole(x) for x in _list(params.get("require_present"))), F.lit(True))
    if "all_of" in params:
        for x in params["all_of"]:
            test = test & gate({}, x, lines=False) & whole(x)
        for x in _list(params.get("none_of")):
            test = test & ~whole(x)
        return F.when(test, F.array(found_at("holds all of " + ", ".join(params["all_of"]), 1)))
    pattern, regex = params["pattern"], java(params, params["pattern"])
    message = f"matches forbidden pattern {pattern}"
    if params.get("multiline"):
        at = line_at(F.col("text"), F.greatest(F.regexp_instr("text", F.lit(regex)), F.lit(1)))
        return F.when(test & gate(params, pattern, lines=False) & whole(pattern), F.array(found_at(message, at)))
    denied = _denied(params, regex) if params.get("denied_by") else lambda x: F.lit(False)
    hit = matches(params, pattern)
    hits = places(F.col("text"), lambda x: hit(x) & ~denied(x))
    hits = F.slice(hits, 1, 1) if params.get("require_present") else hits
    return F.when(test & gate(params, pattern), F.transform(hits, lambda n: found_at(message, n)))


@rule_type("forbidden-pattern", "", "pattern multiline all_of none_of window require_present require_absent evidence denied_by prefilter syntax census", local=_forbidden_local)
def forbidden(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """A finding for each line that matches; or one for a text (multiline, all_of, all_of within a window of lines).

    require_present: only texts that match all of these. evidence {pattern, within}: a match counts only without evidence
    so many lines around. require_absent (none_of with all_of): evidence likewise, or credentials, whose declarations the
    engine has blanked. denied_by: markers that, right before a match, deny it. With any of these guards only the first
    finding of a file stays. census: a program decides.
    """
    if sum(x in params for x in ("pattern", "all_of", "census")) != 1:
        raise ConfigError("one of pattern, all_of and census")
    if "census" in params:
        return _census(files, params)
    if (local := _forbidden_local(params)) is not None:
        return from_local(files, local)
    for guard in _list(params.get("require_present")):
        files = files.where(F.col("text").rlike(java(params, guard)))
    evidence = _evidence(params)
    if "all_of" in params:
        return _unproven(files, _all_of(files, params), params, evidence)
    pattern, regex = params["pattern"], java(params, params["pattern"])
    message = f"matches forbidden pattern {pattern}"
    if params.get("multiline"):
        return _unproven(files, from_local(files, _forbidden_local({k: params[k] for k in ("pattern", "multiline", "prefilter", "syntax") if k in params})), params, evidence)
    denied = _denied(params, regex) if params.get("denied_by") else lambda x: F.lit(False)
    shown = F.arrays_zip(*(evidence_lines(F.col("text"), params, proof).alias(f"e{i}") for i, (proof, _) in enumerate(evidence)))
    rows = files.where(gate(params, pattern)).select("path", places(F.col("text"), lambda x: x.rlike(regex) & ~denied(x)).alias("hits"), shown.alias("shown"))
    near = lambda n: functools.reduce(operator.or_, (F.exists(F.col("shown")[f"e{i}"], lambda m: F.abs(m - n) <= within) for i, (_, within) in enumerate(evidence)), F.lit(False))
    rows = rows.select("path", F.filter("hits", lambda n: ~near(n)).alias("hits")).where(F.size("hits") > 0)
    return rows.select(*finding(message, F.col("hits")[0]))


def within_line(pattern: str) -> bool:
    """Whether it is plain to see that no match goes over the end of a line."""
    return not re.search(r"\\[^bBwd.\-/]|\[\^|\(\?[a-zA-Z]*s|\n", pattern)


def evidence_lines(text: Column, params: Mapping[str, Any], proof: str) -> Column:
    """The lines where matches in a text start; they may span lines."""
    if within_line(proof):
        return places(text, matches(params, proof))
    regex = java(params, proof)
    breaks = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    pairs = F.arrays_zip(F.split(text, regex, -1).alias("ahead"), F.regexp_extract_all(text, F.lit(regex), 0).alias("held"))
    start = F.struct(F.lit(1).alias("n"), F.array().cast("array<int>").alias("at"))
    found = F.aggregate(F.filter(pairs, lambda x: x["held"].isNotNull()), start, lambda s, x: F.struct((s["n"] + breaks(x["ahead"]) + breaks(x["held"])).alias("n"), F.array_append(s["at"], s["n"] + breaks(x["ahead"])).alias("at")))
    return found["at"]


def _evidence(params: Mapping[str, Any]) -> list[tuple[str, int]]:
    """(pattern, lines around). Entries of require_absent and none_of are {evidence, within} or {credential, holders}; the
    engine has blanked what credentials open."""
    found = [(x["pattern"], x.get("within", 0)) for x in _list(params.get("evidence"))]
    for key in ("require_absent", "none_of"):
        for x in _list(params.get(key)):
            if isinstance(x, Mapping) and set(x) <= {"evidence", "within"} and "evidence" in x:
                found.append((x["evidence"], x.get("within", 0)))
            elif key == "require_absent" and not (isinstance(x, Mapping) and set(x) == {"credential", "holders"}):
                raise ConfigError(f"{key} takes {{evidence, within}} and {{credential, holders}}")
    if bad := [n for _, n in found if not isinstance(n, int) or not 0 <= n <= 100]:
        raise ConfigError(f"within is 0 to 100, not {bad[0]}")
    return found


def _unproven(files: DataFrame, hits: DataFrame, params: Mapping[str, Any], evidence: list[tuple[str, int]]) -> DataFrame:
    """Findings (at most one a file) without evidence around their line; of all_of without a window, around the line where
    the first pattern first matches."""
    if not evidence:
        return hits
    rows = files.select("path", F.col("text"), _lines().alias("ls")).join(hits, "path")
    if "all_of" in params and "window" not in params:
        rows = rows.withColumn("at", line_at(F.col("text"), F.greatest(F.regexp_instr("text", F.lit(java(params, params["all_of"][0]))), F.lit(1))))
    else:
        rows = rows.withColumn("at", F.col("line"))
    for proof, within in evidence:
        first = F.greatest(F.lit(1), F.col("at") - within)
        rows = rows.where(~F.exists(F.slice("ls", first, F.col("at") + within - first + 1), lambda x: x.rlike(java(params, proof))))
    return rows.select("path", "line", "message")


def _census(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """The verdict of a program (the params of a command, but for cost); nothing else goes with it."""
    from lintel.operators.external import command

    if more := set(params) - {"census"}:
        raise ConfigError(f"census doesn't go with {', '.join(sorted(more))}")
    census = params["census"]
    if unknown := set(census) - {"cmd", "root", "allow", "expect", "output", "when"}:
        raise ConfigError(f"census: unknown {', '.join(sorted(unknown))}")
    return command(files, {"allow": False, "root": ".", **census})


def _denied(params: Mapping[str, Any], regex: str):
    """Tells of a line whether one of the markers, and a word of 12 characters at most, stand right before the first match."""
    markers = [x.strip() for x in _list(params["denied_by"])]
    if odd := [x for x in markers if not x or re.search(r"[.*+?()\[\]{}|^$\\]", x)]:
        raise ConfigError(f"denied_by takes literal text, not {odd[0]!r}")
    behind = rf"(?i)\b(?:{'|'.join(map(re.escape, markers))})[ \t]+(?:[0-9A-Za-z_]{{1,12}}[ \t]+)?\z"
    return lambda x: F.substring(x, F.lit(1), F.regexp_instr(x, F.lit(regex)) - 1).rlike(behind)


def _all_of(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    patterns = [java(params, p) for p in params["all_of"]]
    message = "holds all of " + ", ".join(params["all_of"])
    for p in params["all_of"]:
        files = gated(files, {}, p)
    files = files.where(functools.reduce(operator.and_, (F.col("text").rlike(p) for p in patterns)))
    for p in (x for x in _list(params.get("none_of")) if isinstance(x, str)):
        files = files.where(~F.col("text").rlike(java(params, p)))
    if "window" not in params:
        return files.select(*finding(message, 1))
    n = int(params["window"])
    window = Window.partitionBy("path").orderBy("line_no").rangeBetween(-(n - 1), 0)
    hits = lines_of(files).select("path", "line_no", *(F.col("line").rlike(p).alias(f"hit{i}") for i, p in enumerate(patterns)))
    some = functools.reduce(operator.or_, (F.col(f"hit{i}") for i in range(len(patterns))))
    spans = hits.where(some).select("path", "line_no", *(F.max(f"hit{i}").over(window).alias(f"seen{i}") for i in range(len(patterns))), F.min("line_no").over(window).alias("first"))
    spans = spans.where(functools.reduce(operator.and_, (F.col(f"seen{i}") for i in range(len(patterns)))))
    return spans.groupBy("path").agg(F.min(F.struct("line_no", "first")).alias("x")).select(*finding(message, "x.first"))


def _required(params: Mapping[str, Any]) -> tuple[Column, Column]:
    """Whether a file is one that has to match, and whether it does; without multiline, patterns match within a line."""

    def has(pattern: str) -> Column:
        if params.get("multiline"):
            return F.col("text").rlike(java(params, pattern))
        wide = gate_of(pattern, params.get("syntax") == "regexp2")
        if wide and within_line(pattern):  # then a match anywhere is one in a line, if there are lines
            return ~F.col("text").isin("", "\n") & gate(params, pattern) & F.col("text").rlike(wide)
        return gate(params, pattern) & F.exists(_lines(), matches(params, pattern))

    return functools.reduce(operator.and_, (has(p) for p in _list(params.get("when"))), F.lit(True)), has(params["pattern"])


def _required_local(params: Mapping[str, Any]) -> Column | None:
    if params.get("mode", "every-file") != "every-file":
        return None
    owed, has = _required(params)
    return F.when(owed & ~has, F.array(found_at(f"lacks required pattern {params['pattern']}", NO_LINE)))


def _required_total(params: Mapping[str, Any], held: Column):
    if params.get("mode", "every-file") != "exists":
        return None
    owed, has = _required(params)
    seen = [F.coalesce(F.max(held & owed), F.lit(False)), F.coalesce(F.max(held & owed & has), F.lit(False))]
    return seen, lambda x: F.when(x[0] & ~x[1], F.lit(f"no file matches required pattern {params['pattern']}"))


def from_total(files: DataFrame, total: tuple) -> DataFrame:
    columns, message = total
    row = files.agg(*(c.alias(f"t{i}") for i, c in enumerate(columns))).select(message([F.col(f"t{i}") for i in range(len(columns))]).alias("message"))
    return row.where("message is not null").select(*finding(F.col("message"), NO_LINE, F.lit(NO_PATH)))


@rule_type("required-pattern", "pattern", "mode when syntax multiline", whole=lambda p: p.get("mode") == "exists", local=_required_local, total=_required_total)
def required(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """every-file: a finding for each file (that matches all of `when`) without the pattern. exists: one finding if there
    are files and none matches. Without multiline patterns have to match within a line."""
    if params.get("mode", "every-file") not in ("every-file", "exists"):
        raise ConfigError(f"unknown mode {params['mode']!r}")
    if (local := _required_local(params)) is not None:
        return from_local(files, local)
    return from_total(files, _required_total(params, F.lit(True)))


def _lines() -> Column:
    return lines_array(F.col("text"))


def _count_total(params: Mapping[str, Any], held: Column):
    op, n = params["op"], int(params["n"])
    wrong = {"exactly": lambda x: x != n, "at-most": lambda x: x > n, "at-least": lambda x: x < n}
    if op not in wrong:
        raise ConfigError(f"unknown op {op!r}")
    hit = matches(params, params["pattern"])
    # A file without a match anywhere counts no line.
    each = F.when(held & gate(params, params["pattern"]), F.size(F.filter(_lines(), lambda x: hit(x)))).otherwise(0)
    message = lambda x: F.concat(F.lit(f"pattern {params['pattern']} matches "), x.cast("string"), F.lit(f" line(s), want {op} {n}"))
    return [F.coalesce(F.sum(each), F.lit(0)).cast("long")], lambda x: F.when(wrong[op](x[0]), message(x[0]))


@rule_type("pattern-count", "pattern op n", "syntax", whole=True, total=_count_total)
def pattern_count(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """One finding if the number of lines that match, in all files, is not exactly / at most / at least n."""
    return from_total(files, _count_total(params, F.lit(True)))


def _first(params: Mapping[str, Any], pattern: str) -> Column:
    hit = matches(params, pattern)
    return F.array_position(F.transform(_lines(), lambda x: hit(x)), True).cast("int")


def _ordering_local(params: Mapping[str, Any]) -> Column:
    lines = F.array(F.struct(_first(params, params["after"]).alias("a"), _first(params, params["before"]).alias("b")))
    wrong = F.filter(lines, lambda x: (x["a"] > 0) & (x["a"] < x["b"]))
    message = lambda x: F.concat(F.lit(f"{params['after']} comes before {params['before']} at line "), x["b"].cast("string"))
    both = gate(params, params["before"]) & gate(params, params["after"])
    return F.when(both, F.transform(wrong, lambda x: found_at(message(x), x["a"])))


@rule_type("ordering", "before after", "syntax", local=_ordering_local)
def ordering(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """A finding where the first line with `after` stands before the first line with `before`."""
    return from_local(files, _ordering_local(params))
