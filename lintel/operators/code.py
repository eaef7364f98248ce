"""Rules about functions, calls and declarations in Go and Dart sources.

A lexer on the executors turns files into rows (functions with their calls, units, declarations); the rules themselves are
DataFrame expressions over these rows. Braces and names are read where comments and literals are blanked.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions.lexers import CODE, QUOTE, classes
from lintel.operators.patterns import finding, java
from lintel.plans.rules import ConfigError, rule_type
from lintel.schema import NO_LINE, NO_PATH

#: Words that stand before a parenthesis without being called.
_NOT_CALLED = frozenset("if for switch func return select go defer range case chan map struct interface var const type import package else while catch assert await in is new super this".split())
_CALL = re.compile(r"([A-Za-z_]\w*(?:\s*\.\s*[A-Za-z_]\w*)*)\s*\(")
FUNCTIONS = "path string, func string, decl_line int, body_span int, calls array<struct<selector string, line int, pos int, used boolean>>"


def language_of(path: str) -> str:
    return "dart" if path.endswith(".dart") else "go"


def blanked(text: str, language: str) -> str:
    return "".join(c if k in CODE + QUOTE or c == "\n" else " " for c, k in zip(text, classes(language, text), strict=True))


def closing(code: str, at: int, pair: str = "{}") -> int:
    """Where the bracket opened at `at` is closed, or -1."""
    depth = 0
    for m in re.compile("[" + re.escape(pair) + "]").finditer(code, at):
        depth += 1 if m[0] == pair[0] else -1
        if not depth:
            return m.start()
    return -1


def functions(text: str, language: str) -> list[tuple[str, int, int, int]]:
    """(name, start of the declaration, opening brace, closing brace) of top-level functions and, in Dart, of methods."""
    code = blanked(text, language)
    head = re.compile(r"\bfunc\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)\s*(?=[\[(])") if language == "go" else re.compile(r"(?<![.\w])([A-Za-z_]\w*)\s*(?=\()")
    out, at = [], 0
    while m := head.search(code, at):
        at = m.end()
        if language == "dart" and m[1] in _NOT_CALLED:
            continue
        if code[m.end() : m.end() + 1] == "[":
            at = closing(code, m.end(), "[]") + 1
        if not code[at : at + 1] == "(" or (end := closing(code, at, "()")) < 0:
            continue
        if language == "go":
            opened = re.compile(r"[^{;\n]*(?:\binterface\s*\{\s*\}|\bstruct\s*\{\s*\}|[^{\n])*\{").match(code, end + 1)
        else:
            opened = re.compile(r"\s*(?:async\*?|sync\*)?\s*\{").match(code, end + 1)
        if not opened:
            at = end + 1 if language == "go" else at
            continue
        brace = opened.end() - 1
        close = closing(code, brace)
        if close < 0:
            raise ValueError(f"function {m[1]} isn't closed")
        out.append((m[1], m.start(), brace, close))
        at = close + 1
    return out


def calls(code: str, start: int, end: int) -> list[tuple[str, int, int, bool]]:
    """(selector, line, position, whether the result is used) of calls between two places of blanked code, in order."""
    out = []
    for m in _CALL.finditer(code, start, end):
        name = re.sub(r"\s+", "", m[1])
        if name in _NOT_CALLED:
            continue
        before = code[start : m.start()].rstrip(" \t")
        close = closing(code, m.end() - 1, "()")
        after = code[close + 1 : end].lstrip(" \t")[:1] if close >= 0 else ""
        alone = (not before or before[-1] in "{};\n") and after in ("", "\n", ";", "}")
        out.append((name, code.count("\n", 0, m.start()) + 1, m.start(), not alone))
    return out


_IMPORT = re.compile(r'(?m)^[ \t]*(?:import[ \t]+)?(?:([A-Za-z_]\w*|\.)[ \t]+)?"([^"\n]+)"[ \t]*(?:;|//|$)')


def imported(text: str) -> dict[str, str]:
    """Names under which a Go file imports packages, where they differ from the last part of the path."""
    code = blanked(text, "go")
    found = {}
    for block in re.finditer(r"(?m)^[ \t]*import\b[ \t]*(\([^)]*\)|[^\n]*)", code):
        for m in _IMPORT.finditer(text, block.start(), block.end()):
            base = m[2].rpartition("/")[2]
            if m[1] and m[1] not in (".", "_", base):
                found[m[1]] = base
    return found


def _rows(files: DataFrame, schema: str, each: Callable[[str, str], list[tuple]]) -> DataFrame:
    names = [x.split()[0] for x in re.sub(r"<[^>]*>+", "", schema).split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(p, *row) for p, t in zip(batch["path"], batch["text"], strict=True) for row in each(p, t)]
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "text").mapInPandas(run, schema)


def functions_of(files: DataFrame) -> DataFrame:
    def each(path: str, text: str) -> list[tuple]:
        language = language_of(path)
        code = blanked(text, language)
        names = imported(text) if language == "go" else {}
        full = lambda s: names.get(s.split(".")[0], s.split(".")[0]) + s[s.find(".") :] if "." in s else s
        return [(name, text.count("\n", 0, start) + 1, text.count("\n", brace, close), [{"selector": full(s), "line": n, "pos": p, "used": u} for s, n, p, u in calls(code, brace + 1, close)]) for name, start, brace, close in functions(text, language)]

    return _rows(files, FUNCTIONS, each)


def units_of(files: DataFrame) -> DataFrame:
    """(path, unit_name, line, unit): texts of functions, or of a proto file's blocks."""

    def each(path: str, text: str) -> list[tuple]:
        if path.endswith(".proto"):
            code = blanked(text, "go")
            found = [(m[2], m.start(1), closing(code, m.end() - 1)) for m in re.finditer(r"(?m)^\s*(message|service|enum|rpc)\s+(\w+)[^{;]*\{", code)]
            return [(n, text.count("\n", 0, a) + 1, text[a : b + 1]) for n, a, b in found if b >= 0]
        return [(n, text.count("\n", 0, a) + 1, text[a : b + 1]) for n, a, _, b in functions(text, language_of(path))]

    return _rows(files, "path string, unit_name string, line int, unit string", each)


def _calls_of(funcs: DataFrame) -> DataFrame:
    return funcs.select("path", "func", "decl_line", F.explode("calls").alias("c")).select("path", "func", "decl_line", "c.*")


def _named(funcs: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    return funcs.where(F.col("func").rlike(java(params, params["funcs"]))) if params.get("funcs") else funcs


def _sources(files: DataFrame, language: str) -> DataFrame:
    return files.where(F.col("path").endswith(f".{language}"))


def _dead(files: DataFrame, rows: DataFrame, test: Any, what: str) -> DataFrame:
    """A finding about the scope if it holds files, and nothing in them passes a test that a rule is anchored to."""
    seen = rows.select(test.alias("alive")).union(files.select(F.lit(False)))
    return seen.agg(F.max("alive").alias("alive")).where("alive = false").select(*finding(f"anchor matches nothing: {what}", NO_LINE, F.lit(NO_PATH)))


@rule_type("go/func-line-budget", "max_lines", "funcs", cost="range")
def func_line_budget(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Functions whose body spans more lines than max_lines."""
    found = _named(functions_of(_sources(files, "go")), params).where(F.col("body_span") > int(params["max_lines"]))
    return found.select(*finding(F.format_string(f"func %s spans %d lines, most are {params['max_lines']}", "func", "body_span"), "decl_line"))


@rule_type("go/call-confined-to-func-name", "symbol allowed_func", "", cost="range")
def call_confined(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Calls of a symbol outside functions whose name is allowed."""
    found = _calls_of(functions_of(_sources(files, "go"))).where(F.col("selector").rlike(java(params, params["symbol"])) & ~F.col("func").rlike(java(params, params["allowed_func"])))
    return found.select(*finding(F.format_string("%s is called in %s", "selector", "func"), "line"))


@rule_type("go/call-order-in-func", "sequence", "funcs", cost="range", whole=True)
def call_order(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """In each function, calls of a stage come before all calls of the next; names that match nothing are findings."""
    stages = params["sequence"]
    if len(stages) < 2:
        raise ConfigError("a sequence has two stages at least")
    files = _sources(files, "go")
    every = functions_of(files)
    funcs, rows = _named(every, params), _calls_of(every)
    hit = [F.col("selector").rlike(java(params, s)) for s in stages]
    own = _calls_of(funcs)
    by = own.groupBy("path", "func", "decl_line").agg(*(F.max(F.when(h, F.col("pos"))).alias(f"last{i}") for i, h in enumerate(hit)), *(F.min(F.when(h, F.struct("pos", "line"))).alias(f"first{i}") for i, h in enumerate(hit)))
    out = _dead(files, funcs, F.lit(True), params.get("funcs", "any function"))
    for i in range(len(stages) - 1):
        out = out.union(by.where(f"last{i} > first{i + 1}.pos").select(*finding(f"{stages[i]} is called after {stages[i + 1]}", f"first{i + 1}.line")))
    for i, s in enumerate(stages):  # in any function: a rename of functions is one finding, not one for each stage too
        out = out.union(_dead(files, rows, hit[i], s))
    return out


@rule_type("go/guard-precedes-call", "guard sink", "funcs", cost="range")
def guard_precedes(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Calls of a sink without an earlier call of the guard in the same function; a call doesn't guard itself."""
    before = Window.partitionBy("path", "func", "decl_line").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    guard, sink = (F.col("selector").rlike(java(params, params[x])) for x in ("guard", "sink"))
    rows = _calls_of(_named(functions_of(_sources(files, "go")), params)).withColumn("sink", sink).withColumn("guarded", F.coalesce(F.max(guard).over(before), F.lit(False)))
    return rows.where("sink and not guarded").select(*finding(F.format_string(f"%s without an earlier {params['guard']}", "selector"), "line"))


@rule_type("go/per-func-count-relation", "left right relation", "funcs require_symbol require_used", cost="range", whole=lambda p: bool(p.get("funcs") or p.get("require_symbol")))
def count_relation(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """In each function, the number of left calls stands in a relation (<=, ==, >=) to that of right calls; functions
    without calls count 0 and 0. require_used and require_symbol name a side (left, right, both): its calls count only if
    their results are used; it has to match some call of any function in the scope."""
    wrong = {"<=": "l > r", "==": "l <> r", ">=": "l < r"}
    if params["relation"] not in wrong:
        raise ConfigError(f"unknown relation {params['relation']!r}")
    for x in ("require_symbol", "require_used"):
        if params.get(x, "") not in ("", "left", "right", "both"):
            raise ConfigError(f"{x} is left, right or both, not {params[x]!r}")
    files = _sources(files, "go")
    every = functions_of(files)
    funcs, regex = _named(every, params), {x: java(params, params[x]) for x in ("left", "right")}
    of = lambda x, side: params.get(x) in (side, "both")
    n = lambda side: F.size(F.filter("calls", lambda c: c.selector.rlike(regex[side]) & (c.used if of("require_used", side) else F.lit(True))))
    rows = funcs.select("path", "func", "decl_line", n("left").alias("l"), n("right").alias("r"))
    out = rows.where(wrong[params["relation"]]).select(*finding(F.format_string(f"func %s: %d {params['left']}, %d {params['right']}, want {params['relation']}", "func", "l", "r"), "decl_line"))
    if params.get("funcs"):
        out = out.union(_dead(files, funcs, F.lit(True), params["funcs"]))
    for side in ("left", "right"):
        if of("require_symbol", side):
            out = out.union(_dead(files, every, F.exists("calls", lambda c: c.selector.rlike(regex[side])), params[side]))
    return out


_DECLARED = {
    "go": re.compile(r"\s*(?:(func)\s+(?:\([^)]*\)\s*)?(\w+)|(type|var|const)\s+(\w+))"),
    "dart": re.compile(r"\s*(?:(?:abstract\s+|final\s+|sealed\s+)*(class|enum|mixin|extension|typedef)\s+(\w+)|(?:(const|final|var)\s+)?(?:[\w<>?,]+\s+)?(\w+)\s*[=(;])"),
}


def _homes(files: DataFrame, params: Mapping[str, Any], language: str) -> DataFrame:
    """Declarations behind a marker are unique in the scope; the home is the first by path and line."""
    marker = params["marker"]

    def each(path: str, text: str) -> list[tuple]:
        kinds, out = classes(language, text), []
        for m in re.finditer(re.escape(marker), text):
            line = text.count("\n", 0, m.start()) + 1
            if kinds[m.start()] not in "bd":
                continue
            at = text.find("\n", m.start())
            while at >= 0 and re.match(r"\s*(//|$)", text[at + 1 : (text.find("\n", at + 1) + 1 or len(text) + 1) - 1]) and at + 1 < len(text):
                at = text.find("\n", at + 1)
            found = _DECLARED[language].match(text, at + 1) if at >= 0 else None
            names = [x for x in found.groups() if x] if found else []
            own = path if language == "dart" and names and names[-1].startswith("_") else ""
            out.append((line, " ".join([*names, own]).strip() or None))
        return out

    rows = _rows(files.where(F.col("text").contains(marker)), "path string, line int, identity string", each)
    stray = rows.where("identity is null").select(*finding("the marker stands before no declaration", "line"))
    window = Window.partitionBy("identity")
    seen = rows.where("identity is not null").withColumn("n", F.count("*").over(window)).withColumn("home", F.min(F.struct("path", "line")).over(window))
    twice = seen.where("n > 1 and not (path = home.path and line = home.line)")
    return stray.union(twice.select(*finding(F.format_string("%s has its home at %s:%d", "identity", "home.path", "home.line"), "line")))


@rule_type("go/marked-single-home", "marker", "", cost="tree", whole=True)
def go_single_home(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    return _homes(files, params, "go")


@rule_type("dart/marked-single-home", "marker", "", cost="tree", whole=True)
def dart_single_home(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    return _homes(files, params, "dart")


def _methods(files: DataFrame, pattern: str) -> DataFrame:
    """(path, name, line, code): Dart methods whose name matches, with comments and literals blanked."""

    def each(path: str, text: str) -> list[tuple]:
        code = blanked(text, "dart")
        return [(n, text.count("\n", 0, a) + 1, code[a : b + 1]) for n, a, _, b in functions(text, "dart")]

    return _rows(files, "path string, name string, line int, code string", each).where(F.col("name").rlike(pattern))


@rule_type("dart/method-delegates", "method must_call", "", cost="tree", whole=True)
def method_delegates(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Methods that don't call what they must; a method pattern that matches nothing is a finding."""
    files = _sources(files, "dart")
    rows = _methods(files, java(params, params["method"]))
    found = rows.where(~F.col("code").rlike(java(params, params["must_call"])))
    return found.select(*finding(F.format_string(f"%s doesn't call {params['must_call']}", "name"), "line")).union(_dead(files, rows, F.lit(True), params["method"]))


@rule_type("dart/ref-after-await", "method access guard", "", cost="range")
def ref_after_await(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Accesses behind an await of the same method, unless the line or the `if` line right before is guarded."""
    access, guard = java(params, params["access"]), java(params, params["guard"])
    rows = _methods(_sources(files, "dart"), java(params, params["method"])).select("path", "line", F.posexplode(F.split("code", "\n", -1)).alias("k", "text"))
    by = Window.partitionBy("path", "line").orderBy("k")
    rows = rows.withColumn("awaited", F.coalesce(F.max(F.col("text").rlike(r"\bawait\b")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))).withColumn("above", F.lag("text", 1, "").over(by))
    guarded = F.col("text").rlike(guard) | (F.col("above").rlike(r"\bif\b") & F.col("above").rlike(guard))
    return rows.where(F.col("awaited") & F.col("text").rlike(access) & ~guarded).select(*finding(f"{params['access']} after await", F.col("line") + F.col("k")))
