"""Patterns in RE2's dialect as patterns for the JVM, literals that matches must hold, and globs."""

from __future__ import annotations

import re

_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_NO_EDGE = f"(?:(?<!{_WORD})(?!{_WORD})|(?<={_WORD})(?={_WORD}))"
_POSIX = {"alpha": "Alpha", "digit": "Digit", "alnum": "Alnum", "upper": "Upper", "lower": "Lower", "punct": "Punct", "space": "Space", "cntrl": "Cntrl", "graph": "Graph", "print": "Print", "blank": "Blank", "xdigit": "XDigit"}
_BLANK = r"\t\n\f\r "
_GENERAL = re.compile(r"(L[ultmo]?|M[nce]?|N[dlo]?|P[cdseifo]?|S[mcko]?|Z[slp]?|C[cfos]?)$")


class PatternError(ValueError):
    pass


def _class(p: str, i: int) -> tuple[str, int]:
    """A bracketed class that begins at i, and where it ends."""
    out, i = "[", i + 1
    if p[i : i + 1] == "^":
        out, i = out + "^", i + 1
    first = True
    while i < len(p):
        c = p[i]
        if c == "]" and not first:
            return out + "]", i + 1
        first = False
        if found := re.compile(r"\[:(\^?)(\w+):\]").match(p, i):
            if found[2] == "word":
                out += r"\W" if found[1] else r"\w"
            elif found[2] in _POSIX:
                out += rf"\{'P' if found[1] else 'p'}{{{_POSIX[found[2]]}}}"
            else:
                raise PatternError(f"unknown class {found[0]}")
            i = found.end()
        elif c == "\\":
            piece, i = _escape(p, i, True)
            out += piece
        else:
            out += "\\" + c if c in "[&]" else c
            i += 1
    raise PatternError("a class isn't closed")


def _escape(p: str, i: int, inside: bool) -> tuple[str, int]:
    if i + 1 >= len(p):
        raise PatternError("trailing backslash")
    c = p[i + 1]
    if c in "pP":
        found = re.compile(r"\{(\^?)(\w+)\}|(\w)").match(p, i + 2)
        if not found:
            raise PatternError("bad property")
        name, negated = found[2] or found[3], bool(found[1]) != (c == "P")
        return rf"\{'P' if negated else 'p'}{{{name if _GENERAL.match(name) else 'Is' + name}}}", found.end()
    if c == "s":
        return (_BLANK if inside else f"[{_BLANK}]"), i + 2
    if c == "S":
        return f"[^{_BLANK}]", i + 2
    if c == "b":
        return (r"\x08" if inside else _EDGE), i + 2
    if c == "B" and not inside:
        return _NO_EDGE, i + 2
    if c == "v":
        return r"\x0B", i + 2
    if c == "Q":
        end = p.find(r"\E", i + 2)
        end = len(p) if end < 0 else end
        return re.sub(r"([^\w\s]|_)", r"\\\1", p[i + 2 : end]), end + 2
    if c in "CZGkRXhHVN" or c.isdigit() and c != "0":
        raise PatternError(rf"\{c} isn't in the dialect")
    return p[i : i + 2], i + 2


def _edge(p: str, i: int) -> str:
    """A word boundary at i, as one look-around where a plain word character stands right before or behind it."""
    folded = re.search(r"\(\?[a-zA-Z]*i", p)  # then some letters outside ASCII match s and k
    plain = "0-9A-Za-jl-rt-z_A-JL-RT-Z" if folded else "0-9A-Za-z_"
    if re.compile(rf"[{plain}](?![*?{{])").match(p, i + 2):
        return f"(?<!{_WORD})"
    if re.search(rf"(?<![\\\w])[{plain}]+$|^[{plain}]+$", p[:i]):
        return f"(?!{_WORD})"
    return _EDGE


def to_java(pattern: str, backtracking: bool = False) -> str:
    """A JVM pattern with the meaning that pattern has in RE2; PatternError where RE2 takes none. With backtracking, look-around
    and back references are let through."""
    out, i, multi, stack = "(?d)", 0, False, []
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if backtracking and pattern[i + 1 : i + 2].isdigit():
                out, i = out + pattern[i : i + 2], i + 2
                continue
            edge = _edge(pattern, i) if pattern[i + 1 : i + 2] == "b" else None
            piece, i = _escape(pattern, i, False)
            out += edge or piece
        elif c == "[":
            piece, i = _class(pattern, i)
            out += piece
        elif c == "$":
            out, i = out + ("$" if multi else r"\z"), i + 1
        elif c == "(":
            stack.append(multi)
            if found := re.compile(r"\(\?P?<([A-Za-z_]\w*)>").match(pattern, i):
                out, i = out + f"(?<{found[1].replace('_', 'u')}>", found.end()
            elif re.compile(r"\(\?(=|!|<=|<!|>)").match(pattern, i):
                if not backtracking:
                    raise PatternError("look-around isn't in the dialect")
                out, i = out + "(?", i + 2
            elif found := re.compile(r"\(\?([imsU]*)(?:-([imsU]*))?([:)])").match(pattern, i):
                on, off = found[1], found[2] or ""
                if "U" in on + off:
                    raise PatternError("the flag U isn't supported")
                multi = multi and "m" not in off or "m" in on
                flags = on.replace("i", "iu") + (f"-{off}" if off else "")
                out, i = out + f"(?{flags}{found[3]}", found.end()
                if found[3] == ")":
                    stack.pop()
            elif pattern.startswith("(?", i):
                raise PatternError("unknown group")
            else:
                out, i = out + "(", i + 1
        elif c == ")":
            multi = stack.pop() if stack else multi
            out, i = out + c, i + 1
        elif c in "*+?" and pattern[i + 1 : i + 2] in ("+", "*") and not backtracking:
            raise PatternError("nested repetition")
        elif c == "{" and (times := re.compile(r"\{(\d+)(?:,(\d*))?\}").match(pattern, i)) and max(int(x) for x in times.groups() if x) > 1000:
            raise PatternError("over 1000 repetitions")
        else:
            out, i = out + c, i + 1
    return out


def required_literal(pattern: str, least: int = 1) -> str | None:
    """A string that every match holds, if one is plain to see: the longest run of literal characters outside groups. Where
    case is folded, letters don't count."""
    if "\\Q" in pattern:
        return None
    folded = re.search(r"\(\?[a-zA-Z]*i", pattern)
    runs, now, i, depth = [], "", 0, 0
    while i < len(pattern):
        c, literal, start = pattern[i], None, i
        if c == "\\":
            nxt = pattern[i + 1 : i + 2]
            literal, i = (nxt if nxt and not nxt.isalnum() else None), i + 2
            if nxt in ("p", "P", "x") and literal is None:
                found = re.compile(r"\{[^}]*\}|..?").match(pattern, i)
                i = found.end() if found and (nxt == "x" or pattern[i] == "{") else i + 1
        elif c == "[":
            try:
                _, i = _class(pattern, i)
            except PatternError:
                return None
        else:
            depth += (c == "(") - (c == ")")
            if c == "|" and not depth:
                return None
            literal, i = (c if c not in "^$.()*+?{}" else None), i + 1
        if folded and literal is not None and (literal.isalpha() or not literal.isascii()):
            literal = None
        optional = pattern[i : i + 1] in ("*", "?") or bool(re.match(r"\{0", pattern[i:]))
        repeated = pattern[i : i + 1] in ("+", "{")
        if literal is not None and depth == 0 and not optional:
            now += literal
            if repeated:
                runs.append(now)
                now = ""
        else:
            runs.append(now)
            now = ""
        if pattern[start] in "*?+":
            continue
        if pattern[i : i + 1] == "{" and (end := pattern.find("}", i)) > 0:
            i = end + 1
            runs.append(now)
            now = ""
    best = max([*runs, now], key=len)
    return best if len(best) >= least else None


def glob_to_regex(glob: str) -> str:
    """An anchored pattern for a glob: ** crosses directories, * and ? don't, {a,b} and [...] as usual."""
    out, i, braces = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out, i = out + "(?:/.*)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "{":
            out, i, braces = out + "(?:", i + 1, braces + 1
        elif c == "}" and braces:
            out, i, braces = out + ")", i + 1, braces - 1
        elif c == "," and braces:
            out, i = out + "|", i + 1
        elif c == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return rf"(?s)\A{out}\z"


def gate_of(pattern: str, backtracking: bool = False) -> str | None:
    """A JVM pattern that matches somewhere in a text if `pattern` matches one of its lines; None where none is plain to see.

    Anchors of the line become those of any line. What crosses lines makes the gate wider only; look-around could narrow it."""
    if backtracking or re.search(r"\\[Az]|\(\?[a-zA-Z]*-[a-zA-Z]*m", pattern):
        return None
    return to_java(f"(?m:{pattern})")
