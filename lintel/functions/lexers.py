"""Content transforms: texts in which everything but what a rule is about is blanked. Newlines and lengths stay.

A scanner gives every character a class; a transform keeps some classes and writes spaces for the others.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Classes: code, comment delimiter, comment body, quote, string interior, rune interior.
CODE, MARK, BODY, QUOTE, TEXT, RUNE = "c", "d", "b", "q", "s", "r"


@functools.lru_cache(maxsize=64)
def _stop(chars: str) -> re.Pattern[str]:
    return re.compile("[" + re.escape(chars) + "]")


class _Scan:
    def __init__(self, text: str) -> None:
        self.t, self.i, self.out = text, 0, []

    def take(self, n: int, kind: str) -> None:
        n = min(n, len(self.t) - self.i)
        self.out.append(kind * n)
        self.i += n

    def to(self, end: int, kind: str) -> None:
        self.take((end if end >= 0 else len(self.t)) - self.i, kind)

    def at(self, s: str) -> bool:
        return self.t.startswith(s, self.i)

    def plain(self, stop: str, kind: str) -> None:
        """One character, and all up to the next that may matter."""
        found = _stop(stop).search(self.t, self.i + 1)
        self.to(found.start() if found else -1, kind)

    def line_comment(self, mark: str) -> None:
        self.take(len(mark), MARK)
        self.to(self.t.find("\n", self.i), BODY)

    def block_comment(self, nested: bool) -> None:
        depth = 0
        while self.i < len(self.t):
            if self.at("/*") and (nested or not depth):
                depth += 1
                self.take(2, MARK)
            elif self.at("*/"):
                depth -= 1
                self.take(2, MARK)
                if not depth:
                    return
            else:
                self.plain("/*", BODY)

    def quoted(self, quote: str, inner: str = TEXT, escapes: bool = True, lines: bool = True, doubled: bool = False) -> None:
        """A literal up to the same quote. With lines False a newline ends it, as one that isn't closed."""
        self.take(len(quote), QUOTE)
        while self.i < len(self.t):
            if escapes and self.at("\\") and (lines or self.t[self.i + 1 : self.i + 2] != "\n"):
                self.take(2, inner)
            elif doubled and self.at(quote * 2):
                self.take(2, inner)
            elif self.at(quote):
                self.take(len(quote), QUOTE)
                return
            elif not lines and self.at("\n"):
                return
            else:
                self.plain("\\\n" + quote[0], inner)


def _go(s: _Scan) -> None:
    while s.i < len(s.t):
        if s.at("//"):
            s.line_comment("//")
        elif s.at("/*"):
            s.block_comment(False)
        elif s.at("`"):
            s.quoted("`", escapes=False)
        elif s.at('"'):
            s.quoted('"', lines=False)
        elif s.at("'"):
            s.quoted("'", RUNE, lines=False)
        else:
            s.plain('/`"\'', CODE)


def _sql(s: _Scan) -> None:
    while s.i < len(s.t):
        before = s.t[s.i - 1 : s.i] if s.i else ""
        tag = re.compile(r"\$(?:[A-Za-z_\x80-￿][\w\x80-￿]*)?\$").match(s.t, s.i) if s.at("$") and not re.match(r"[\w$]", before) else None
        if s.at("--"):
            s.line_comment("--")
        elif s.at("/*"):
            s.block_comment(True)
        elif tag:
            s.take(len(tag[0]), QUOTE)
            end = s.t.find(tag[0], s.i)
            s.to(end, TEXT)
            s.take(len(tag[0]) if end >= 0 else 0, QUOTE)
        elif s.at("'"):
            s.quoted("'", escapes=before in ("e", "E") and not re.match(r"\w", s.t[s.i - 2 : s.i - 1] if s.i > 1 else ""), doubled=True)
        elif s.at('"'):
            s.take(1, CODE)
            s.to((s.t.find('"', s.i) + 1) or -1, CODE)
        else:
            s.plain('-/$\'"', CODE)


def _dart(s: _Scan, closing: str | None = None) -> None:
    depth = 0
    while s.i < len(s.t):
        if closing and s.at("}") and not depth:
            return
        depth += s.at("{") - s.at("}")
        raw = s.at("r'") or s.at('r"')
        if s.at("//"):
            s.line_comment("//")
        elif s.at("/*"):
            s.block_comment(True)
        elif s.at("'") or s.at('"') or raw and not re.match(r"\w", s.t[s.i - 1 : s.i] if s.i else ""):
            if raw:
                s.take(1, CODE)
            mark = s.t[s.i] * (3 if s.at(s.t[s.i] * 3) else 1)
            s.take(len(mark), QUOTE)
            while s.i < len(s.t) and not s.at(mark):
                if len(mark) == 1 and s.at("\n"):
                    break
                if not raw and s.at("\\"):
                    s.take(2, TEXT)
                elif not raw and s.at("${"):
                    s.take(2, CODE)
                    _dart(s, "}")
                    s.take(1, CODE)
                else:
                    s.take(1, TEXT)
            s.take(len(mark) if s.at(mark) else 0, QUOTE)
        else:
            s.plain('/\'"{}r', CODE)


def _sh(s: _Scan) -> None:
    pending: list[tuple[str, bool]] = []
    while s.i < len(s.t):
        before = s.t[s.i - 1 : s.i] if s.i else "\n"
        doc = re.compile(r"<<(-?)[ \t]*(['\"]?)([A-Za-z_]\w*)\2").match(s.t, s.i) if s.at("<<") and not s.at("<<<") and before != "<" else None
        if s.at("#") and before in "\n \t":
            s.line_comment("#")
        elif s.at("\\"):
            s.take(2, CODE)
        elif s.at("$'"):
            s.take(1, CODE)
            s.quoted("'")
        elif s.at("'"):
            s.quoted("'", escapes=False)
        elif s.at('"'):
            s.quoted('"')
        elif s.at("$(("):
            s.to((s.t.find("))", s.i) + 2) if s.t.find("))", s.i) >= 0 else s.i + 3, CODE)
        elif doc:
            pending.append((doc[3], bool(doc[1])))
            s.take(len(doc[0]), CODE)
        elif s.at("\n") and pending:
            s.take(1, CODE)
            for word, tabs in pending:
                end = re.compile(rf"^{chr(9) + '*' if tabs else ''}{re.escape(word)}$", re.M).search(s.t, s.i)
                s.to(end.start() if end else -1, TEXT)
                s.take(len(end[0]) if end else 0, CODE)
            pending = []
        else:
            s.plain('#\\$\'"<\n', CODE)


def _awk(s: _Scan) -> None:
    value = False  # whether what stands before can be divided
    while s.i < len(s.t):
        c = s.t[s.i]
        if c == "#":
            s.line_comment("#")
        elif c == '"':
            s.quoted('"', lines=False)
            value = True
        elif c == "/" and not value:
            s.take(1, CODE)
            inside = False
            while s.i < len(s.t) and not s.at("\n"):
                if s.at("\\"):
                    s.take(2, CODE)
                    continue
                inside = s.at("[") or inside and not s.at("]")
                end = s.at("/") and not inside
                s.take(1, CODE)
                if end:
                    break
            value = True
        elif word := re.compile(r"[A-Za-z_]\w*").match(s.t, s.i):
            value = word[0] not in ("return", "print", "printf", "in", "case", "getline")
            s.take(len(word[0]), CODE)
        else:
            if c not in " \t":
                value = c.isdigit() or c in ")]$."
            s.take(1, CODE)


#: Transforms that rules can't name: what reads SQL uses them itself.
INTERNAL = frozenset({"decomment-sql"})
_SCANNERS: dict[str, Callable[[_Scan], None]] = {"go": _go, "sql": _sql, "dart": _dart, "sh": _sh, "awk": _awk}
#: Name of each transform, the language it reads and the classes it keeps.
TRANSFORMS = {
    "decomment-go": ("go", CODE + QUOTE + TEXT + RUNE),
    "strings-only-go": ("go", TEXT),
    "decomment-destring-go": ("go", CODE + QUOTE),
    "comments-only-go": ("go", BODY),
    "decomment-sh": ("sh", CODE + QUOTE + TEXT),
    "destring-sh": ("sh", CODE + QUOTE + MARK + BODY),
    "destring-decomment-sh": ("sh", CODE + QUOTE),
    "strings-only-sh": ("sh", TEXT),
    "decomment-dart": ("dart", CODE + QUOTE + TEXT),
    "code-only-dart": ("dart", CODE + QUOTE),
    "comments-only-dart": ("dart", BODY),
    "comments-only-sql": ("sql", BODY),
    "decomment-sql": ("sql", CODE + QUOTE + TEXT),
    "comments-only-awk": ("awk", BODY),
}


def classes(language: str, text: str) -> str:
    """A class for each character of text."""
    s = _Scan(text)
    _SCANNERS[language](s)
    return "".join(s.out)


def transform(name: str, text: str) -> str:
    if name == "raw":
        return text
    if name == "qualify-proto-go-alias":
        return _qualified(text)
    language, keep = TRANSFORMS[name]
    return "".join(c if k in keep or c == "\n" else " " for c, k in zip(text, classes(language, text), strict=True))


def _qualified(text: str) -> str:
    """Proto source whose messages carry the alias of its go_package: option go_package = "path;alias" or the path's end."""
    found = re.search(r'^\s*option\s+go_package\s*=\s*"([^"]+)"', text, re.M)
    alias = found[1].rpartition(";")[2].rpartition("/")[2] if found else ""
    return re.sub(r"(?m)^(\s*message\s+)(\w+)(\s*\{)", rf"\g<1>{alias}.\2\3", text) if alias else text


def transformed(text: Column, name: str) -> Column:
    """The transform as a column; batches of texts go to Python at once."""
    if name == "raw":
        return text

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda x: transform(name, x), na_action="ignore")

    return run(text)


def transformed_by(text: Column, name: Column) -> Column:
    """The transform that each row names; texts that stay raw don't go to Python."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, names in batches:
            yield pd.Series([None if t is None else transform(n, t) for t, n in zip(texts, names, strict=True)], dtype=object)

    return F.coalesce(run(F.when(name != "raw", text), name), text)
