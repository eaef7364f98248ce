"""Rules that relate files to each other, to sets of strings, or to what is on disk."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.lexers import transformed
from lintel.functions.patterns import glob_to_regex
from lintel.operators.patterns import _lines, _list, finding, found_at, from_local, gate, gated, java, matches, places
from lintel.plans.rules import ConfigError, rule_type
from lintel.schema import NO_LINE, NO_PATH, line_at


def extracted(files: DataFrame, params: Mapping[str, Any], pattern: str, group: int) -> Column:
    """All values that a group takes in a text's lines; a group that takes no part gives ''."""
    regex = F.lit(java(params, pattern))
    if not re.search(r"[\^$]|\\[^bwd.\-/]|\(\?[a-zA-Z]*[sm]", pattern):  # no match begins, ends or goes on at the end of a line
        return F.regexp_extract_all(F.col("text"), regex, group)
    return F.flatten(F.transform(_lines(), lambda x: F.regexp_extract_all(x, regex, group)))


def _named(path: Column) -> Column:
    """A path below the root as it is listed: without empty and `.` parts."""
    return F.array_join(F.filter(F.split(path, "/", -1), lambda x: ~x.isin("", ".")), "/")


@rule_type("doc-path-exists", "pattern", "syntax", whole=True, universe=True)
def doc_path_exists(files: DataFrame, params: Mapping[str, Any], every: DataFrame | None = None) -> DataFrame:
    """A finding for each cited path (group 1) that is neither a file of the whole tree (in the scope or not) nor one of its
    directories. Citations meet the listing in one anti-join, which is broadcast or split where a path is cited often."""
    bare = re.sub(r"\[\^?\]?(?:\\.|[^\]])*\]|\\.", "x", params["pattern"])
    if len(re.findall(r"\((?!\?)|\(\?P?<[A-Za-z_]", bare)) != 1:
        raise ConfigError("the pattern has one group, which is the path")
    regex = F.lit(java(params, params["pattern"]))
    cites = F.flatten(F.transform(_lines(), lambda x, i: F.transform(F.regexp_extract_all(x, regex, 1), lambda t: F.struct((i + 1).alias("line_no"), t.alias("token")))))
    cited = gated(files, params, params["pattern"]).select("path", F.explode_outer(cites).alias("x")).where("x is not null").select("path", "x.*").where("token <> ''")
    parts = F.split("path", "/", -1)
    listed = (files if every is None else every).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("name")).distinct()
    named = cited.withColumn("name", _named(F.col("token"))).where("name <> ''")
    found = named.join(listed, "name", "left_anti")
    return found.select(*finding(F.concat(F.lit("cited path doesn't exist: "), F.col("token"))))


def _pair(params: Mapping[str, Any]) -> tuple[str, str, str, bool, str]:
    """trigger, companion, where, whether they are counted, and the message."""
    where, obligation = params.get("where", "same-file"), params.get("obligation", "presence")
    if where not in ("same-file", "same-func", "same-dir") or obligation not in ("presence", "countable"):
        raise ConfigError(f"unknown where or obligation: {where!r}, {obligation!r}")
    if where == "same-dir" and (params.get("also_present") or obligation == "countable"):
        raise ConfigError("same-dir goes neither with also_present nor with countable: a directory has no text of its own")
    return java(params, params["trigger"]), java(params, params["requires"]), where, obligation == "countable", f"{params['trigger']} without {params['requires']}"


def _counts(params: Mapping[str, Any], trigger: str, companion: str) -> tuple[Column, Column, Column]:
    """How often trigger and companion match in a text, and the line of the first trigger."""
    if params.get("multiline"):
        t, c = (F.regexp_count("text", F.lit(x)) for x in (trigger, companion))
        return t, c, line_at(F.col("text"), F.greatest(F.regexp_instr("text", F.lit(trigger)), F.lit(1)))
    t, c = (places(F.col("text"), matches(params, params[x])) for x in ("trigger", "requires"))
    return F.size(t), F.size(c), F.get(t, F.lit(0))


def _pair_local(params: Mapping[str, Any]) -> Column | None:
    trigger, companion, where, countable, message = _pair(params)
    if where != "same-file":
        return None
    t, c, at = _counts(params, trigger, companion)
    test = gate(params, params["trigger"], lines=not params.get("multiline"))
    if also := params.get("also_present"):
        test = test & F.col("text").rlike(java(params, also))
    return F.when(test & (t > 0) & ((c < t) if countable else (c == 0)), F.array(found_at(message, at)))


@rule_type("pair-consistency", "trigger requires", "where also_present obligation syntax multiline", whole=lambda p: p.get("where") == "same-dir", local=_pair_local)
def pair_consistency(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """A trigger needs its companion in the same file, function or directory, if the file or function holds also_present.

    obligation countable: as many companions as triggers (lines that match; occurrences with multiline and in functions).
    same-dir: one finding for a directory, at its first trigger by path.
    """
    trigger, companion, where, countable, message = _pair(params)
    if where == "same-file":
        return from_local(files, _pair_local(params))
    if where == "same-func":
        from lintel.operators.code import units_of

        units = units_of(files.where(gate(params, params["trigger"], lines=False)))
        if also := params.get("also_present"):
            units = units.where(F.col("unit").rlike(java(params, also)))
        at = F.col("line") + line_at(F.col("unit"), F.greatest(F.regexp_instr("unit", F.lit(trigger)), F.lit(1))) - 1
        units = units.select("path", at.alias("at"), F.regexp_count("unit", F.lit(trigger)).alias("t"), F.regexp_count("unit", F.lit(companion)).alias("c"))
        return units.where("t > 0").where("c < t" if countable else "c = 0").select(*finding(message, "at"))
    t, c, at = _counts(params, trigger, companion)
    seen = files.select("path", "dir", t.alias("t"), c.alias("c"), at.alias("at"))
    by_dir = seen.groupBy("dir").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), F.min(F.when(F.col("t") > 0, F.struct("path", "at"))).alias("x"))
    return by_dir.where("t > 0 and c = 0").select(*finding(message, "x.at", "x.path"))


def _side(files: DataFrame, side: Mapping[str, Any]) -> DataFrame:
    scope = None
    for g in _list(side["files"]):
        hit = F.col("path").rlike(glob_to_regex(g))
        scope = hit if scope is None else scope | hit
    files = files.where(scope).select("path", transformed(F.col("text"), side.get("preprocess", "raw")).alias("text"))
    return files.select(F.explode_outer(extracted(files, {}, side["pattern"], int(side.get("group", 1)))).alias("value")).where("value is not null").distinct()


@rule_type("set-relation", "a b relation", "", whole=True)
def set_relation(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Distinct values of two sides have to be subset, equal or disjoint; one finding names all offenders, sorted, of equal
    by side. If a side has fewer values than its min_count, one finding says so of each such side, and nothing else.

    Each side is one aggregation; the sets meet in a join. The offenders are one message, hence one row."""
    a, b = (_side(files, params[x]).withColumn(x, F.lit(1)) for x in "ab")
    both = a.join(b, "value", "full").select("value", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    offends = {"subset": {"": "a = 1 and b = 0"}, "equal": {"only in a: ": "a = 1 and b = 0", "only in b: ": "a = 0 and b = 1"}, "disjoint": {"": "a = 1 and b = 1"}}
    if (relation := params["relation"]) not in offends:
        raise ConfigError(f"unknown relation {relation!r}")
    sides = offends[relation]
    names = [F.array_join(F.array_sort(F.collect_list(F.when(F.expr(test), F.col("value")))), ", ").alias(f"s{i}") for i, test in enumerate(sides.values())]
    total = both.agg(*names, *(F.coalesce(F.sum(F.expr(f"int({test})")), F.lit(0)).alias(f"k{i}") for i, test in enumerate(sides.values())), *(F.coalesce(F.sum(x), F.lit(0)).alias(f"n{x}") for x in "ab"))
    wrong = F.array_compact(F.array(*(F.when(F.col(f"k{i}") > 0, F.concat(F.lit(what), F.col(f"s{i}"))) for i, what in enumerate(sides))))
    least = {x: int(params[x].get("min_count") or 0) for x in "ab"}
    short = F.array_compact(F.array(*(F.when(F.col(f"n{x}") < n, F.concat(F.lit(f"side {x} has "), F.col(f"n{x}").cast("string"), F.lit(f" value(s), least are {n}"))) for x, n in least.items())))
    message = F.when(F.size(short) > 0, F.array_join(short, "; ")).when(F.size(wrong) > 0, F.concat(F.lit(f"not {relation}: "), F.array_join(wrong, "; ")))
    return total.select(message.alias("message")).where("message is not null").select(*finding(F.col("message"), NO_LINE, F.lit(NO_PATH)))


@rule_type("baseline", "pattern baseline", "group mode syntax", whole=True)
def baseline(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Distinct values against a tracked list (a file, or the lines themselves): a finding for each value that isn't listed,
    and, with mode exact, for each listed one that doesn't occur. A missing list is an error."""
    listed = params["baseline"]
    lines = open(listed).read().split("\n") if isinstance(listed, str) else listed  # noqa: SIM115
    known = sorted({x.strip() for x in lines if x.strip() and not x.strip().startswith("#")})
    spark = files.sparkSession
    known_rows = spark.createDataFrame([(x,) for x in known], "value string")
    group = int(params.get("group", 1))
    found = gated(files, {}, params["pattern"]).select(F.explode_outer(extracted(files, params, params["pattern"], group)).alias("value")).where("value is not null").distinct()
    added = found.join(known_rows, "value", "left_anti").select(F.concat(F.lit("not in the baseline: "), F.col("value")).alias("message"))
    if params.get("mode") == "exact":
        added = added.union(known_rows.join(found, "value", "left_anti").select(F.concat(F.lit("in the baseline only: "), F.col("value"))))
    return added.select(*finding(F.col("message"), NO_LINE, F.lit(NO_PATH)))
