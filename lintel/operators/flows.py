"""Rules about where values come from: arguments of constructors and what builders read (Dart), what a comparison's two
sides were read from (Go). Each verdict needs one file only, so that files without the names in question never leave the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions.lexers import CODE, QUOTE, TEXT, classes
from lintel.operators.code import _CALL, _NOT_CALLED, _rows, blanked, closing, functions, imported
from lintel.plans.rules import ConfigError, rule_type

_FINDINGS = "path string, line int, message string"
_MADE = re.compile(r"(?<![\w$])(_?[A-Z]\w*)\s*(?:<[\w\s,<>?.]*>\s*)?\(")
_LABEL = re.compile(r"\s*([A-Za-z_]\w*)\s*:")
_REF = re.compile(r"(?<![\w.])[a-z_]\w*(?:\.\w+)*")
_GETTER = re.compile(r"\bget[ \t]+(\w+)\s*(=>|\{)")


def _arguments(code: str, opened: int) -> list[tuple[int, int]]:
    """Begin and end of each argument of the list whose parenthesis stands at `opened`."""
    close = closing(code, opened, "()")
    if close < 0:
        raise ConfigError("a list of arguments isn't closed")
    out, depth, begin = [], 0, opened + 1
    for m in re.compile(r"[()\[\]{},]").finditer(code, opened + 1, close):
        if m[0] == "," and not depth:
            out.append((begin, m.start()))
            begin = m.end()
        depth += (m[0] in "([{") - (m[0] in ")]}")
    return [(a, b) for a, b in (*out, (begin, close)) if code[a:b].strip()]


def invocations(text: str) -> Iterator[tuple[str, int, dict[str, str]]]:
    """(name, line, named arguments) of everything that looks like a constructor being called, in Dart; nested ones, too.
    Values are as written, but for comments."""
    kinds = classes("dart", text)
    code = "".join(c if k in CODE + QUOTE or c == "\n" else " " for c, k in zip(text, kinds, strict=True))
    shown = "".join(c if k in CODE + QUOTE + TEXT or c == "\n" else " " for c, k in zip(text, kinds, strict=True))
    for m in _MADE.finditer(code):
        named = {}
        for a, b in _arguments(code, m.end() - 1):
            if label := _LABEL.match(code, a, b):
                named[label[1]] = shown[label.end() : b].strip()
        yield m[1], code.count("\n", 0, m.start()) + 1, named


def is_named(value: str, source: str | None) -> bool:
    """Whether an expression refers to something declared elsewhere: no null, no function written in place, and (unless a
    pattern says otherwise) names parted by dots, each of which may be called."""
    value = " ".join(value.split())
    if value == "null" or re.search(r"\) *(?:\{|=>)", value):
        return False
    if source:
        return bool(re.search(source, value))
    while (less := re.sub(r"(?<=\w)\([^()]*\)|(?<=\W)\([^()]*\)", "", value)) != value:
        value = less
    return bool(re.fullmatch(r"[A-Za-z_]\w*(?:\??\.[A-Za-z_]\w*)*", value))


@rule_type("dart/numeric-field-validated", "numeric_value", "keyboard_arg validator_arg validator_source", cost="range")
def numeric_field_validated(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Constructors whose keyboard argument is numeric, but which take no validator that is declared elsewhere."""
    keyboard, validator = params.get("keyboard_arg", "keyboardType"), params.get("validator_arg", "validator")
    numeric, source = params["numeric_value"], params.get("validator_source")

    def each(path: str, text: str) -> list[tuple]:
        out = []
        for name, line, named in invocations(text):
            if not re.search(numeric, named.get(keyboard, "")) or keyboard not in named:
                continue
            if validator not in named:
                out.append((line, f"{name} is numeric without {validator}"))
            elif not is_named(named[validator], source):
                out.append((line, f"{name} is numeric, and its {validator} is written in place"))
        return out

    return _rows(files.where(F.col("path").rlike(r"(?i)\.dart\z") & F.col("text").contains(keyboard)), _FINDINGS, each)


def getters(code: str) -> dict[str, str]:
    """Names of getters, and what stands behind them."""
    out = {}
    for m in _GETTER.finditer(code):
        end = code.find(";", m.end()) if m[2] == "=>" else closing(code, m.end() - 1)
        if end >= 0:
            out[m[1]] = code[m.end() : end]
    return out


def reads(body: str, known: Mapping[str, str], suffixes: list[str]) -> set[str]:
    """References that stand before one of the suffixes, in a body or in the getters it leads to."""
    suffix = re.compile(r"(?<![\w.])([a-z_][\w.]*?)(?:" + "|".join(map(re.escape, suffixes)) + r")(?!\w)")
    found, seen, open_ = set(), set(), [body]
    while open_:
        at = open_.pop()
        found |= {m[1] for m in suffix.finditer(at)}
        more = {m[0] for m in re.finditer(r"(?<![\w.])\w+", at)} & known.keys() - seen
        seen |= more
        open_ += [known[x] for x in more]
    return found


@rule_type("dart/gate-reads-are-listened", "builders listen_args builder_arg read_suffixes", "ignore_readers", cost="range")
def gate_reads_are_listened(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Builders that decide from something (read in their body or through getters of the file) that they don't listen to."""
    builders, listens, suffixes, ignored = (list(params.get(x) or []) for x in ("builders", "listen_args", "read_suffixes", "ignore_readers"))
    if not (builders and listens and suffixes and params["builder_arg"]):
        raise ConfigError("builders, listen_args, builder_arg and read_suffixes can't be empty")

    def each(path: str, text: str) -> list[tuple]:
        known, out = getters(blanked(text, "dart")), []
        for name, line, named in invocations(text):
            listened = next((named[x] for x in listens if x in named), None)
            if name not in builders or listened is None or params["builder_arg"] not in named:
                continue
            missing = reads(named[params["builder_arg"]], known, suffixes) - set(_REF.findall(listened)) - set(ignored)
            if missing:
                out.append((line, f"{name} reads {', '.join(sorted(missing))}, which {listens[0]} doesn't hold"))
        return out

    some = F.lit(False)
    for x in builders:
        some = some | F.col("text").contains(x)
    return _rows(files.where(F.col("path").rlike(r"(?i)\.dart\z") & some), _FINDINGS, each)


_ASSIGNED = re.compile(r"(?:(?<=[;{}\n])|\bif\b|\bswitch\b|\bfor\b|\belse\b)[ \t]*([A-Za-z_][\w.\[\]]*(?:\s*,\s*[A-Za-z_][\w.\[\]]*)*)\s*(?::|[-+*/|&^%])?=(?!=)")
_VALUE = re.compile(r"(?<![\w.\"'`])[A-Za-z_]\w*(?!\w|\s*\(|\s*:(?!=))")


class _Trace:
    """What the local variables of one Go function come from: reads, or variables that come from nothing else."""

    def __init__(self, code: str, reader: str, loader: str | None, names: Mapping[str, str], own: set[str]) -> None:
        self.code, self.names, self.own = code, names, own
        self.reading = [re.compile(x) for x in (reader, loader) if x]
        self.vars: dict[str, set] = {}
        self.reads: dict[int, set] = {}  # by place: what a read's arguments come from

    def selector(self, name: str) -> str:
        head, dot, rest = re.sub(r"\s+", "", name).partition(".")
        return self.names.get(head, head) + dot + rest if dot else head

    def origins(self, a: int, b: int) -> set:
        """Origins of the expression between two places. A read stands for itself and hides its arguments."""
        out, at = set(), a
        for m in _CALL.finditer(self.code, a, b):
            if m.start() < at or m[1] in _NOT_CALLED or not any(r.search(self.selector(m[1])) for r in self.reading):
                continue
            end = closing(self.code, m.end() - 1, "()")
            out |= self.values(at, m.start())
            self.reads[m.start()] = self.origins(m.end(), end)
            out.add(m.start())
            at = end + 1
        return out | self.values(at, b)

    def values(self, a: int, b: int) -> set:
        return set().union(*(self.vars.get(m[0], set()) for m in _VALUE.finditer(self.code, a, b) if m[0] not in self.own))

    def assign(self, names: str, a: int, b: int) -> None:
        found = set() if re.match(r"\s*func\b", self.code[a:b]) else self.origins(a, b)
        for name in (x.strip() for x in names.split(",")):
            if re.fullmatch(r"\w+", name) and name != "_":
                self.vars[name] = found or {f"var {name}"}

    def same(self, left: set, right: set) -> bool:
        """Whether a read of one side and a read of the other are one, or have arguments from the same place."""
        return any(x == y or self.reads[x] & self.reads[y] for x in left & self.reads.keys() for y in right & self.reads.keys())


def self_comparisons(text: str, params: Mapping[str, Any]) -> list[tuple[int, str]]:
    """(line, message) of Go comparisons whose two sides were read from the same place, outside functions that say so."""
    from lintel.functions.declarations import _code, _statement_end

    code, kinds, names, out = _code("go", text), classes("go", text), imported(text), []
    compare = re.compile(params["compare"])
    for name, start, brace, close in functions(text, "go"):
        above = start
        while above and (line := text[text.rfind("\n", 0, above - 1) + 1 : above]).lstrip().startswith("//"):
            above -= len(line)
        if any(kinds[m.start()] in "db" for m in re.compile(re.escape(params["declare"])).finditer(text, above, close)):
            continue
        head = code[code.find("(", code.find(name, start)) : brace]
        own = {x for group in re.split(r"[(),]", head[: closing(head, 0, "()") + 1]) for x in re.findall(r"^\s*([A-Za-z_]\w*)", group)}
        trace = _Trace(code, params["reader"], params.get("loader"), names, own)
        events = [(m.start(), m) for m in _ASSIGNED.finditer(code, brace, close)] + [(m.start(), m) for m in _CALL.finditer(code, brace, close)]
        for at, m in sorted(events, key=lambda x: (x[0], x[1].re is _CALL)):
            if m.re is _ASSIGNED:
                if not re.match(r"\s*range\b", code[m.end() : close]):
                    trace.assign(m[1], m.end(), min(close, _statement_end(code, m.end())))
            elif m[1] not in _NOT_CALLED and compare.search(trace.selector(m[1])):
                sides = _arguments(code, m.end() - 1)
                if len(sides) > 1 and trace.same(*(trace.origins(*x) for x in sides[:2])):
                    out.append((code.count("\n", 0, at) + 1, f"func {name}: both sides of {trace.selector(m[1])} are read from the same place"))
    return out


@rule_type("go/expected-derives-from-actual", "reader compare declare", "loader", cost="range")
def expected_derives(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Comparisons of something with itself: both sides come from reads whose arguments share an origin. Parameters are no
    origins, nor is a called function's name. A comment with `declare` clears its function."""
    if not params["declare"]:
        raise ConfigError("declare names the comment that allows a comparison")
    return _rows(files.where(F.col("path").rlike(r"(?i)\.go\z")), _FINDINGS, lambda path, text: self_comparisons(text, params))
