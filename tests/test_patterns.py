import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lintel.functions.lexers import TRANSFORMS, transform
from lintel.functions.patterns import PatternError, gate_of, glob_to_regex, required_literal, to_java

PATTERNS = [r"a$", r"^a.b", r"[[:alpha:]]+[[:digit:]]", r"(?P<first_name>b)c", r"\bcat\b", r"a\sb", r"[\s,]x", r"(?i)stra", r"(?m)^b$", r"[^a-c\n]z", r"\Ba", r"x{2,3}", r"\.$|b\b", r"a\b.", r"\b(a|é)", r"[&[]b"]
TEXTS = ["", "a", "a\n", "a\r\n", "xa\rb", "a b", "a\x0bb", "éa", "a é cat", "cat", "scat", "ab1 b", "bc", "ſtra STRA", "c\nb\n", "dz", "xxx", ", x", "a b", "é", "&b", "[b"]


def test_patterns_mean_what_they_mean_in_re2(spark):
    con = duckdb.connect()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for p in PATTERNS:
        got = [r[0] for r in rows.select(F.col("t").rlike(to_java(p)), "i").orderBy("i").collect()]
        want = [con.execute("select regexp_matches(?, ?)", [t, p]).fetchone()[0] for t in TEXTS]
        assert got == want, p


@pytest.mark.parametrize("p", [r"(?<=a)b", r"(a)\1", r"\C", r"(?U)a*", "[a", "a\\"])
def test_what_re2_refuses_is_refused(p):
    with pytest.raises(PatternError):
        to_java(p)


def test_literals_are_in_every_match():
    assert required_literal(r"json\.Marshal\(") == "json.Marshal("
    assert required_literal("ab|cdef") is None
    assert required_literal("(?i)token") is None
    assert required_literal("colou?r") == "colo"
    assert required_literal(r"\bwith\b") == "with"
    rnd = random.Random(1)
    for _ in range(300):
        p = "".join(rnd.choice(["abc", "x?", "y*", "d+", r"\d", "[ef]", "(gh)", "(ij)?", "k{0,2}", "l{2}"]) for _ in range(4))
        literal = required_literal(p)
        for _ in range(20):
            t = "".join(rnd.choice("abcxyd1efghijkl") for _ in range(12)) + "abcdddeghll"
            if literal and re.search(p, t):
                assert literal in re.search(p, t)[0], (p, t)


def test_globs():
    fits = lambda g, p: bool(re.match(glob_to_regex(g).replace(r"\z", r"\Z"), p))
    assert fits("**/*.go", "a/b.go") and fits("**/*.go", "b.go") and fits("src/**", "src/a/b") and fits("*.{a,b}", "x.b") and fits("[!a]?", "bc")
    assert not fits("*.go", "a/b.go") and not fits("src/*", "src/a/b") and not fits("*.{a,b}", "x.c")


@pytest.mark.parametrize("name", TRANSFORMS)
def test_transforms_keep_lengths_and_newlines(name):
    rnd = random.Random(name)
    for _ in range(300):
        t = "".join(rnd.choice("ab \n\"'`/*-#$\\{}<ErE()é") for _ in range(rnd.randrange(60)))
        out = transform(name, t)
        assert len(out) == len(t) and [i for i, c in enumerate(t) if c == "\n"] == [i for i, c in enumerate(out) if c == "\n"]
        assert all(a in (b, " ") for a, b in zip(out, t, strict=True))


def test_transforms():
    assert transform("decomment-go", 'a := "x//y" // z') == 'a := "x//y"     '
    assert transform("strings-only-go", 'f("a", `b`)') == "   a    b  "
    assert transform("comments-only-sql", "select 'a--b' -- c") == "                 c"
    assert transform("code-only-dart", "x('a ${f('b')} c') // d").strip() == "x('  ${f(' ')}  ')"
    assert transform("strings-only-sh", "cat <<E # c\nhi\nE\n") == "           \nhi\n \n"
    assert "message api.Order {" in transform("qualify-proto-go-alias", 'option go_package = "x/y;api";\nmessage Order {\n}')


@pytest.mark.parametrize("pattern", ["a**", "a+*", "a{1001}", "a{2,1001}", "a{1001,}"])
def test_repetitions_that_are_refused(pattern):
    with pytest.raises(PatternError):
        to_java(pattern)


@pytest.mark.parametrize(("pattern", "literal"), [(r"(?i)\b(token|key)\s*=\s*\d", "="), (r"[\w.]+@[\w]+", "@"), ("(a|b)cde", "cde"), ("ab|cd", None), ("(?i)abc", None), (r"x{0,2}yy", "yy")])
def test_required_literal(pattern, literal):
    assert required_literal(pattern) == literal


def test_gates_are_no_narrower_than_lines():
    import re

    for pattern in ("^a$", "b$", r"^\s+c", "(^a|c$)", r"x.y"):
        gate = re.compile(gate_of(pattern).replace("(?d)", ""))
        for text in ("a", "b\na\nc", "  c\nq", "xxy\n", "ab\n"):
            if any(re.search(pattern, line) for line in text.split("\n")):
                assert gate.search(text), (pattern, text)
    assert gate_of(r"\Aa") is None and gate_of("a", True) is None
