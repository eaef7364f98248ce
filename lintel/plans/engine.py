"""Evaluation: rules over files, as one plan whose result is the findings."""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

import lintel.operators.code  # noqa: F401
import lintel.operators.external  # noqa: F401
import lintel.operators.flows  # noqa: F401
import lintel.operators.measures  # noqa: F401
import lintel.operators.patterns  # noqa: F401
import lintel.operators.relations  # noqa: F401
import lintel.operators.sqltext  # noqa: F401
from lintel.functions.declarations import homes_of, marked_lines, masked
from lintel.functions.lexers import transformed, transformed_by
from lintel.functions.patterns import glob_to_regex, to_java
from lintel.plans.rules import TYPES, ConfigError, Rule
from lintel.schema import NO_LINE, NO_PATH, lines_array, ordered
from lintel.session import ship


def any_glob(globs: Iterable[str], path: str = "path") -> Column:
    tests = [F.col(path).rlike(glob_to_regex(g)) for g in globs]
    return functools.reduce(lambda a, b: a | b, tests) if tests else F.lit(False)


def in_scope(files: DataFrame, rule: Rule, tests: Sequence[str] = ()) -> DataFrame:
    """Files that an include fits and no exclude; production rules leave out test code, whose globs the run names."""
    if [*rule.include] != ["**"]:
        files = files.where(any_glob(rule.include))
    if rule.exclude:
        files = files.where(~any_glob(rule.exclude))
    if rule.production:
        if not tests:
            raise ConfigError(f"{rule.id}: production scope needs the globs of test code")
        files = files.where(~any_glob(tests))
    return files


#: How a line of a leading comment block starts, in any of the languages.
_COMMENT = r"^\s*(?://|#|--|/\*|\*|<!--|;|$)"


def is_generated(markers: Sequence[str]) -> Column:
    """A marker stands in the lines before the first one that is neither blank nor a comment. Lines are looked at only in
    files that hold a marker at all."""
    lines = lines_array(F.col("text"))
    code = F.array_position(F.transform(lines, lambda x: ~x.rlike(_COMMENT)), True)
    lead = F.when(code > 0, F.slice(lines, F.lit(1), F.greatest(code.cast("int") - 1, F.lit(0)))).otherwise(lines)
    some = lambda x: functools.reduce(lambda a, b: a | b, [x.contains(m) for m in markers])
    return some(F.col("text")) & F.exists(lead, some) if markers else F.lit(False)


def _homes(rule: Rule) -> tuple[list[str], list[str]]:
    """Markers, and credentials as JVM patterns."""
    return [m for m, _ in rule.not_declaring], [to_java(p, rule.params.get("syntax") == "regexp2") for p, _ in rule.credentials]


def with_homes(scope: DataFrame, rule: Rule) -> DataFrame:
    """Files with the declarations (as written, before any transform) that are homes of the rule, as `homes`."""
    opened = scope.withColumn("opened", marked_lines(F.col("text"), lines_array(F.col("text")), *_homes(rule)))
    return opened.withColumn("homes", homes_of(F.col("path"), F.col("text"), F.col("opened"))).drop("opened")


def miscounted(scope: DataFrame, rule: Rule) -> DataFrame:
    """A finding for each marker or credential that other than its number of places hold. None at all is no finding."""
    markers, patterns = _homes(rule)
    places = [((F.length("text") - F.length(F.replace("text", F.lit(m), F.lit("")))) / len(m)).cast("long") for m in markers]
    matching = lambda p: F.size(F.filter(lines_array(F.col("text")), lambda x: x.rlike(p)))
    places += [matching(p) for p in patterns]
    names = [*rule.not_declaring, *rule.credentials]
    rows = scope.agg(*(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"n{i}") for i, n in enumerate(places)))
    rows = rows.select(F.explode(F.array(*(F.struct(F.lit(x).alias("name"), F.lit(h).cast("long").alias("want"), F.col(f"n{i}").alias("got")) for i, (x, h) in enumerate(names)))).alias("x")).select("x.*")
    return rows.where("got > 0 and got <> want").select(F.lit(NO_PATH).alias("path"), F.lit(NO_LINE).alias("line"), F.format_string("%s has %d holder(s), want %d", "name", "got", "want").alias("message"))


def in_scope_test(rule: Rule) -> Column:
    test = F.lit(True) if [*rule.include] == ["**"] else any_glob(rule.include)
    return test & ~any_glob(rule.exclude) if rule.exclude else test


def _held(rule: Rule, tests: Sequence[str]) -> Column:
    """The scope of a rule as a test of path and `made`, which says that a generator wrote the file."""
    held = in_scope_test(rule) if rule.generated else in_scope_test(rule) & ~F.col("made")
    if rule.production:
        if not tests:
            raise ConfigError(f"{rule.id}: production scope needs the globs of test code")
        held = held & ~any_glob(tests)
    return held


def _told(rule: Rule, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(rule.id).alias("rule"), F.lit(rule.severity).alias("severity"), x["line"].alias("line"), x["message"].alias("message")))


def _local(files: DataFrame, rules: Sequence[Rule], tests: Sequence[str]) -> DataFrame:
    """All rules that look at one file at a time, in one pass. A file takes part once for each transform that a rule whose
    scope holds it asks for."""
    kinds = sorted({r.preprocess for r in rules})
    if kinds != ["raw"]:
        wanted = [F.when(functools.reduce(operator.or_, (_held(r, tests) for r in rules if r.preprocess == k)), F.lit(k)) for k in kinds]
        files = files.withColumn("kind", F.explode(F.array_compact(F.array(*wanted)))).withColumn("text", transformed_by(F.col("text"), F.col("kind")))
    found = []
    for r in rules:
        held = _held(r, tests) if kinds == ["raw"] else _held(r, tests) & (F.col("kind") == r.preprocess)
        found.append(F.when(held, _told(r, TYPES[r.type].local(r.params))))
    # Of explode(), the optimiser would test the whole expression twice more before it makes rows.
    rows = files.select("path", F.explode_outer(F.flatten(F.array_compact(F.array(*found)))).alias("x")).where("x is not null")
    return rows.select("x.rule", "x.severity", "path", "x.line", "x.message")


def _totals(files: DataFrame, rules: Sequence[Rule], floors: Sequence[Rule], tests: Sequence[str]) -> DataFrame:
    """All rules that count over their scope, and least numbers of files, in one aggregation."""
    columns, told = [], []
    for r in rules:
        own, message = TYPES[r.type].total(r.params, _held(r, tests))
        told.append((r.id, r.severity, message([F.col(f"t{len(columns) + i}") for i in range(len(own))])))
        columns += own
    for r in floors:
        n = F.col(f"t{len(columns)}")
        columns.append(F.coalesce(F.sum(_held(r, tests).cast("long")), F.lit(0)))
        told.append((r.id, "error", F.when(n < r.min_files, F.concat(F.lit("scope has "), n.cast("string"), F.lit(f" file(s), least are {r.min_files}")))))
    row = files.agg(*(c.alias(f"t{i}") for i, c in enumerate(columns)))
    verdicts = [F.when(m.isNotNull(), F.struct(F.lit(i).alias("rule"), F.lit(s).alias("severity"), m.alias("message"))) for i, s, m in told]
    found = row.select(F.explode(F.array_compact(F.array(*verdicts))).alias("x"))
    return found.select("x.rule", "x.severity", F.lit(NO_PATH).alias("path"), F.lit(NO_LINE).alias("line"), "x.message")


def evaluate(files: DataFrame, rules: Iterable[Rule], changed: DataFrame | None = None, tests: Sequence[str] = (), sort: bool = True, generated: Sequence[str] = (), fixture: bool = False) -> DataFrame:
    """Findings (rule, severity, path, line, message) of all rules.

    Rules that one file decides share one pass over the files, those that count over their scope one aggregation; the
    others have a plan each. With changed (path), rules whose verdict a part of the files can give see only those; the
    others see all files. Files with one of the `generated` markers in their leading comments are outside rules that don't
    ask for them. In a fixture, numbers of holders and least numbers of files aren't judged.
    """
    rules = [*rules]
    if not rules:
        raise ConfigError("no rule is left to run")
    ship(files.sparkSession)
    every = files.withColumn("made", is_generated(generated))
    narrow = lambda x: x if changed is None else x.join(changed.select("path").distinct(), "path", "left_semi")
    home = {r.id for r in rules if r.not_declaring or r.credentials}
    local = [r for r in rules if r.id not in home and TYPES[r.type].local(r.params) is not None]
    total = [r for r in rules if r not in local and r.id not in home and r.preprocess == "raw" and TYPES[r.type].total(r.params, F.lit(True)) is not None]
    floors = [r for r in rules if r.min_files is not None and not fixture]
    plans = [_local(narrow(every), local, tests)] if local else []
    plans += [_totals(every, total, floors, tests)] if total or floors else []
    for r in rules:
        if r in local or r in total:
            continue
        kind = TYPES[r.type]
        scope = (every if r.whole else narrow(every)).where(_held(r, tests)).drop("made")
        if r.id in home:
            wrong = miscounted(scope, r).where(F.lit(not fixture))
            plans.append(wrong.select(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), "path", "line", "message"))
            scope = with_homes(scope, r)
        if r.preprocess != "raw":
            scope = scope.withColumn("text", transformed(F.col("text"), r.preprocess))
        if r.id in home:
            scope = scope.withColumn("text", masked(F.col("text"), F.col("homes"))).drop("homes")
        found = kind.build(scope, r.params, every) if kind.universe else kind.build(scope, r.params)
        plans.append(found.select(F.lit(r.id).alias("rule"), F.lit(r.severity).alias("severity"), "path", "line", "message"))
    while len(plans) > 1:  # a tree, so that hundreds of rules don't make a deep plan
        plans = [plans[i].unionByName(plans[i + 1]) if i + 1 < len(plans) else plans[i] for i in range(0, len(plans), 2)]
    return ordered(plans[0]) if sort else plans[0]


def idle_rules(files: DataFrame, rules: Iterable[Rule], tests: Sequence[str] = ()) -> list[str]:
    """Ids of rules whose scope holds no file: one aggregation over the paths for all rules."""
    rules = [*rules]
    got = files.select("path").agg(*(F.max(in_scope_test(r)).alias(f"r{i}") for i, r in enumerate(rules))).first()
    return [r.id for i, r in enumerate(rules) if not got[i]]


def exit_code(findings: DataFrame) -> int:
    """1 if an error was found, else 0; what can't be run raises, which callers turn into 2."""
    return int(bool(findings.where("severity = 'error'").limit(1).count()))


def classify_scope(paths: DataFrame, docs: Sequence[str], governance: Sequence[str]) -> DataFrame:
    """docs < governance < runtime: the highest class of any path; no path at all counts as runtime."""
    rank = F.when(any_glob(docs), 0).when(any_glob(governance), 1).otherwise(2)
    names = F.array(F.lit("docs"), F.lit("governance"), F.lit("runtime"))
    return paths.agg(F.coalesce(F.max(rank), F.lit(2)).alias("rank")).select(names[F.col("rank")].alias("scope"))
