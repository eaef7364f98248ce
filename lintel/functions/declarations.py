"""Which lines a declaration spans, and texts in which the spans are blanked.

A marker or a credential names a home: the declaration that its line opens. In Go that is a statement, in Dart and proto
what goes up to the end of its first block or to a semicolon; any other file is one declaration. Imports of a file that
holds a home belong to it.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.functions.lexers import CODE, QUOTE, classes

SPANS = "array<struct<start: int, end: int>>"
_LANGUAGES = {"go": "go", "dart": "dart", "proto": "proto"}
#: Words of Go behind which a line's end ends no statement.
_OPEN_WORDS = frozenset("case chan const default defer else for func go goto if import interface map package range select struct switch type var".split())
_TOKEN = re.compile(r"\w+|\+\+|--|\n|[^\w\s]")
_IMPORTS = {"go": re.compile(r"(?m)^[ \t]*import\b"), "dart": re.compile(r"(?m)^[ \t]*(?:import|export|part|library)[ \t]")}


def _code(language: str, text: str) -> str:
    """Text whose comments and insides of literals are blank; newlines inside literals are, too."""
    kinds = classes("go" if language == "proto" else language, text)
    return "".join(c if k in CODE + QUOTE else "\n" if c == "\n" and k in "db" else " " for c, k in zip(text, kinds, strict=True))


def _statement_end(code: str, at: int) -> int:
    """Where the Go statement from `at` ends: a semicolon, or a line's end behind something complete, outside brackets."""
    depth, last = 0, ""
    for m in _TOKEN.finditer(code, at):
        t = m[0]
        if t in "([{":
            depth += 1
        elif t in ")]}":
            depth = max(0, depth - 1)
        elif not depth and (t == ";" or t == "\n" and (last in (")", "]", "}", '"', "'", "`", "++", "--") or re.match(r"\w", last) and last not in _OPEN_WORDS)):
            return m.start()
        last = last if t == "\n" else t
    return len(code)


def _block_end(code: str, at: int) -> int:
    depth = 0
    for m in re.compile(r"[()\[\]{};]").finditer(code, at):
        depth += 1 if m[0] in "([{" else -1 if m[0] in ")]}" and depth else 0
        if not depth and m[0] in "};":
            return m.start()
    return len(code)


class Declarations:
    """The declarations of one file."""

    def __init__(self, path: str, text: str) -> None:
        self.language = _LANGUAGES.get(path.rpartition(".")[2].lower() if "." in path.rpartition("/")[2] else "")
        self.begins = [0, *(m.end() for m in re.finditer("\n", text))]
        if len(self.begins) > 1 and self.begins[-1] == len(text):
            self.begins.pop()
        self.last = len(self.begins) if text else 0
        self.code = _code(self.language, text) if self.language else text
        self.text = text

    def line(self, at: int) -> int:
        return min(self.last, self.text.count("\n", 0, at) + 1)

    def extent(self, line: int) -> tuple[int, int]:
        """First and last line of the declaration that a line opens."""
        if not 1 <= line <= self.last:
            return line, line
        if not self.language:
            return 1, self.last
        at = self.begins[line - 1]
        if self.language == "go":
            own = self.code[at : self.begins[line] - 1 if line < self.last else len(self.code)]
            if not own.strip():
                return line, line
            if re.match(r"\s*package\b", own):
                return 1, self.last
            return line, self.line(_statement_end(self.code, at))
        return line, self.line(_block_end(self.code, at))

    def imports(self) -> list[tuple[int, int]]:
        """Import directives outside brackets; in Go, those before any other declaration."""
        if self.language not in _IMPORTS:
            return []
        stop = re.search(r"(?m)^[ \t]*(?:func|type|var|const)\b", self.code) if self.language == "go" else None
        end = _statement_end if self.language == "go" else lambda code, at: (code.find(";", at) + 1 or len(code) + 1) - 1
        out = []
        for m in _IMPORTS[self.language].finditer(self.code, 0, stop.start() if stop else len(self.code)):
            before = self.code[: m.start()]
            if all(before.count(a) <= before.count(b) for a, b in ("()", "[]", "{}")):
                out.append((self.line(m.end()), self.line(end(self.code, m.end()))))
        return out


def homes(path: str, text: str, opened: Sequence[int]) -> list[tuple[int, int]]:
    """First and last lines of the declarations that these lines open, and of the file's imports."""
    file = Declarations(path, text)
    return sorted({*(file.extent(n) for n in opened), *file.imports()}) if len(opened) else []


def marked_lines(text: Column, lines: Column, markers: Sequence[str], patterns: Sequence[str]) -> Column:
    """Numbers of the lines in which a marker (a literal) stands, or that one of the (JVM) patterns matches."""
    tests = [lambda x, m=m: x.contains(m) for m in markers] + [lambda x, p=p: x.rlike(p) for p in patterns]
    some = lambda x: functools.reduce(lambda a, b: a | b, [t(x) for t in tests])
    return F.array_compact(F.transform(lines, lambda x, n: F.when(some(x), n + 1)))


def homes_of(path: Column, text: Column, opened: Column) -> Column:
    """homes() as a column. Texts without an opened line don't travel to Python."""

    @F.pandas_udf(SPANS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[{"start": a, "end": b} for a, b in homes(p, t, n)] if t is not None else [] for p, t, n in zip(*batch, strict=True)], dtype=object)

    return run(path, F.when(F.size(opened) > 0, text), opened)


def masked(text: Column, spans: Column) -> Column:
    """The text with the lines of all spans blanked; it stays on the JVM."""
    inside = lambda n: F.exists(spans, lambda s: (s["start"] <= n + 1) & (n + 1 <= s["end"]))
    blank = F.array_join(F.transform(F.split(text, "\n", -1), lambda x, n: F.when(inside(n), F.repeat(F.lit(" "), F.length(x))).otherwise(x)), "\n")
    return F.when(F.size(spans) > 0, blank).otherwise(text)
