"""SQL that Go sources hold in string constants."""

from __future__ import annotations

import re
from bisect import bisect_left
from typing import NamedTuple

from lintel.functions.lexers import CODE, QUOTE, classes
from lintel.operators.code import blanked

#: Stands in a composed text for an operand whose value isn't constant.
HOLE = "unread_expr"
#: Levels of parentheses and fmt calls that one expression is followed into; of deeper ones, each literal
#: counts on its own.
DEEPEST = 100

# Words that SQL statements open with, hold further on, or name as objects of definitions.
_LEADS = "select insert update delete with create alter drop truncate grant revoke explain"
_DEFINE = "create alter drop truncate"
_INNER = "from where join into values set returning using group order having limit on as"
_OBJECTS = (
    "table index view sequence schema database type domain function procedure trigger rule extension role user policy"
    " tablespace aggregate operator collation cast server publication subscription statistics"
)
_MODIFIERS = "or replace unique materialized temp temporary unlogged global local recursive concurrently foreign if not exists only"

_any = lambda words: "|".join(words.split())
_LEAD = re.compile(rf"(?is)\A(?:\s|\(|--[^\n]*(?:\n|\Z)|/\*.*?\*/)*({_any(_LEADS)})(?![a-z])")
_OBJECT = re.compile(rf"(?ai)\W*(?:\b(?:{_any(_MODIFIERS)})\b\W*)*\b(?:{_any(_OBJECTS)})\b")
_WITHIN = re.compile(rf"(?ai)\b(?:{_any(_INNER)})\b")

_ESCAPE = re.compile(r"\\(?:([abfnrtv\\\"'])|x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|([0-7]{3}))")
_PLAIN = dict(zip("abfnrtv\\\"'", "\a\b\f\n\r\t\v\\\"'", strict=True))
_FORMAT = re.compile(r"%(?:%|([-+# 0]*(?:\d+|\*)?(?:\.(?:\d+|\*)?)?(?:\[\d+\])?[a-zA-Z]))")
_SPRINT = re.compile(r"\bfmt\s*\.\s*(Sprintf|Sprintln|Sprint)\s*\(")
_CONST = re.compile(r"(?m)^const\b[ \t]*(\()?")
_DECLARED = re.compile(r"(?m)^[ \t]*([A-Za-z_]\w*)(?:[ \t]+string)?[ \t]*=(?!=)")


class Constant(NamedTuple):
    """A string expression: the line it starts on, its text, and whether it is an operand of one that isn't constant."""

    line: int
    text: str
    part: bool = False


def sql_shaped(text: str) -> bool:
    """A text that opens like a statement and holds a further word of one, or names an object that it defines."""
    lead = _LEAD.match(text)
    if not lead:
        return False
    rest = text[lead.end() :]
    return bool(lead[1].lower() in _DEFINE.split() and _OBJECT.match(rest) or _WITHIN.search(rest))


def _value(written: str) -> str:
    if written[:1] == "`":
        return written[1:-1].replace("\r", "")

    def one(m: re.Match[str]) -> str:
        if m[1]:
            return _PLAIN[m[1]]
        number = int(m[5], 8) if m[5] else int(m[2] or m[3] or m[4], 16)
        return chr(number) if number < 0x110000 else "�"

    return _ESCAPE.sub(one, written[1:-1])


class _Reader:
    """Expressions of one file. `code` has the text's length, with comments and the insides of literals blanked."""

    def __init__(self, text: str) -> None:
        self.code = blanked(text, "go")
        kinds, self.literals, at = classes("go", text), {}, 0
        while at < len(text):
            if kinds[at] == QUOTE and text[at] in "\"`":
                end = at + 1
                while end < len(text) and not (kinds[end] == QUOTE and text[end] == text[at]) and kinds[end] != CODE:
                    end += 1
                self.literals[at] = (end + 1, _value(text[at : end + 1]))
                at = end
            at += 1
        self.written = {end: start for start, (end, _) in self.literals.items()}
        self.shut, self.opened = {}, {}
        for pair in ("()", "[]", "{}"):
            open_: list[int] = []
            for m in re.finditer("[" + re.escape(pair) + "]", self.code):
                if m[0] == pair[0]:
                    open_.append(m.start())
                elif open_:
                    self.opened[m.start()] = open_.pop()
                    self.shut[self.opened[m.start()]] = m.start()
        self.deep, self.cut = 0, False
        self.constants: dict[str, str] = {}
        self._declared()

    def _declared(self) -> None:
        """Values of the file's constants; those that name others settle in later rounds."""
        open_ = {}
        for m in _CONST.finditer(self.code):
            end = self.shut.get(m.end() - 1, -1) if m[1] else self.code.find("\n", m.end())
            inner = self.code[m.end() : end if end >= 0 else len(self.code)]
            open_ |= {d[1]: m.end() + d.end() for d in _DECLARED.finditer(inner)}
        before = -1
        while len(self.constants) > before:
            before = len(self.constants)
            for name, at in open_.items():
                if name not in self.constants and (value := self.constant(at)) is not None:
                    self.constants[name] = value

    def _skip(self, at: int, lines: bool = True) -> int:
        blank = " \t\r\n" if lines else " \t\r"
        while at < len(self.code) and self.code[at] in blank:
            at += 1
        return at

    def _primary(self, at: int) -> int:
        """Behind a name, number or group with its selectors, calls and indices."""
        while self.code[at : at + 1] and self.code[at] in "&*!-^":
            at += 1
        end = at
        while end < len(self.code):
            c = self.code[end]
            if c in "([" or c == "{" and end > at and self.code[at : end].endswith("}"):
                if end not in self.shut:
                    return end
                end = self.shut[end] + 1
            elif end in self.literals:
                end = self.literals[end][0]
            elif c.isalnum() or c in "_.'":
                end += 1
            else:
                break
        return end

    def _operand(self, at: int) -> tuple[int, str | None, str]:
        """(end, value or None, text with holes) of the operand at `at`."""
        if at in self.literals:
            end, value = self.literals[at]
            return end, value, value
        nested = self.deep < DEEPEST
        self.cut |= not nested
        if nested and at in self.shut and self.code[at] == "(":
            end, parts = self.chain(at + 1)
            shut = self.shut[at]
            if parts and self._skip(end) == shut:
                return shut + 1, _joined(parts), "".join(x for _, _, _, x in parts)
        end = self._primary(at)
        word = self.code[at:end].strip()
        if word in self.constants:
            return end, self.constants[word], self.constants[word]
        call = _SPRINT.match(self.code, at) if nested else None
        if call and self.shut.get(call.end() - 1) == end - 1:
            found = self._sprint(call[1], call.end(), end - 1)
            if found:
                return end, *found
        return end, None, HOLE

    def chain(self, at: int) -> tuple[int, list[tuple[int, int, str | None, str]]]:
        """End and operands (start, end, value or None, text with holes) of a sum that starts at `at`."""
        parts = []
        at = self._skip(at)
        while True:
            self.deep += 1
            end, value, holes = self._operand(at)
            self.deep -= 1
            if end == at:
                return at, parts
            parts.append((at, end, value, holes))
            more = self._skip(end, lines=False)
            if self.code[more : more + 1] != "+" or self.code[more + 1 : more + 2] in ("+", "="):
                return end, parts
            at = self._skip(more + 1)

    def constant(self, at: int) -> str | None:
        return _joined(self.chain(at)[1])

    def arguments(self, start: int, end: int) -> list[tuple[int, int]]:
        out, depth, at = [], 0, start
        for i in range(start, end):
            c = self.code[i]
            depth += (c in "([{") - (c in ")]}")
            if c == "," and not depth:
                out.append((at, i))
                at = i + 1
        return [*out, (at, end)] if self.code[at:end].strip() else out

    def _sprint(self, name: str, start: int, end: int) -> tuple[str | None, str] | None:
        """(value or None, text with holes) of a fmt call whose first argument is constant."""
        values, shown = [], []
        for a, b in self.arguments(start, end):
            stop, parts = self.chain(a)
            read = bool(parts) and self._skip(stop) >= b
            values.append(_joined(parts) if read else None)
            shown.append("".join(x for _, _, _, x in parts) if read else HOLE)
        if not values or values[0] is None:
            return None
        if name != "Sprintf":
            text = (" " if name == "Sprintln" else "").join(shown) + ("\n" if name == "Sprintln" else "")
            return (None if None in values else text), text
        exact, rest = True, list(zip(values[1:], shown[1:], strict=True))

        def verb(m: re.Match[str]) -> str:
            nonlocal exact
            if m[0] == "%%":
                return "%"
            value, show = rest.pop(0) if rest else (None, HOLE)
            if m[1] in ("s", "v") and value is not None:
                return value
            exact = False
            return show if m[1] in ("s", "v") else HOLE

        text = _FORMAT.sub(verb, values[0])
        return (text if exact and not rest else None), text

    def first(self, at: int, least: int) -> int:
        """Where the sum starts that holds the operand at `at`, not before `least`."""
        levels = 0
        while True:
            before = at - 1
            while before >= least and self.code[before] in " \t\r\n":
                before -= 1
            if before < least:
                return at
            if self.code[before] == "+" and self.code[before - 1 : before] != "+":
                to = before - 1
                while to >= least and self.code[to] in " \t\r":
                    to -= 1
                start = self._back(to, least)
                if start > to:
                    return at
                at = start
            elif self.code[before] == "(" and levels < DEEPEST - 1 and not re.search(r"[\w\])]\s*\Z", self.code[max(least, before - 80) : before]):
                at, levels = before, levels + 1
            else:
                return at

    def _back(self, at: int, least: int) -> int:
        """Start of the operand whose last character is at `at`."""
        while at >= least:
            c = self.code[at]
            if c in ")]":
                if self.opened.get(at, -1) < least:
                    break
                at = self.opened[at] - 1
            elif at + 1 in self.written:
                return self.written[at + 1]
            elif c.isalnum() or c in "_.":
                at -= 1
            else:
                break
        return at + 1


def _joined(parts: list[tuple[int, int, str | None, str]]) -> str | None:
    values = [x for _, _, x, _ in parts]
    return "".join(values) if values and None not in values else None  # type: ignore[arg-type]


def composed(text: str) -> tuple[list[Constant], list[Constant]]:
    """(constants, sums and fmt calls that aren't constant) of a Go source.

    Constants are literals, sums of them, and fmt.Sprint, Sprintf (of %s and %v) and Sprintln of nothing else; a constant that
    the file declares at top level counts as its value. Of what isn't constant, the text has HOLE for each operand that
    has no value, and its constant parts are among the constants. Assignments, builders and constants of other files aren't
    followed.
    """
    reader = _Reader(text)
    starts = sorted({*reader.literals, *(m.start() for m in _SPRINT.finditer(reader.code))})
    breaks = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(breaks, at) + 1
    whole: dict[int, Constant] = {}
    partly: dict[int, Constant] = {}

    todo = [(0, len(text), False, False)]
    while todo:
        low, high, nested, part = todo.pop()
        at = low
        for start in starts[bisect_left(starts, low) : bisect_left(starts, high)]:
            if start < at:
                continue
            begin, reader.cut = reader.first(start, low), False
            end, parts = reader.chain(begin)
            if end <= start:  # what stands before it isn't an operand after all
                begin = start
                end, parts = reader.chain(begin)
            value = _joined(parts)
            if value is not None and end <= high:
                whole[begin] = Constant(line(begin), value, part)
                at = end
                continue
            holes = "".join(x for _, _, _, x in parts)
            if reader.cut:  # too deep to be read: each literal on its own
                alone = starts[bisect_left(starts, begin) : bisect_left(starts, min(end, high))]
                whole |= {x: Constant(line(x), reader.literals[x][1], True) for x in alone if x in reader.literals}
                at = max(end, start + 1)
                continue
            if parts and not nested and holes != HOLE and (len(parts) > 1 or _SPRINT.match(reader.code, parts[0][0])):
                partly[begin] = Constant(line(begin), holes)
            lead = 0
            while lead < len(parts) and parts[lead][2] is not None:
                lead += 1
            if lead > 1:
                whole[begin] = Constant(line(begin), "".join(x[2] or "" for x in parts[:lead]), True)
                parts = parts[lead:]
            for a, b, value, _ in parts:
                if value is not None:
                    if a in reader.literals or _SPRINT.match(reader.code, a):
                        whole[a] = Constant(line(a), value, True)
                else:
                    todo.append((a + 1, b, nested or holes != HOLE, bool(_SPRINT.match(reader.code, a))))
            at = max(end, start + 1)
    return [whole[at] for at in sorted(whole)], [partly[at] for at in sorted(partly)]
