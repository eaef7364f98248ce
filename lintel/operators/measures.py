"""Rules about sizes, names and bytes of files."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions.patterns import glob_to_regex, to_java
from lintel.operators.patterns import found_at, from_local
from lintel.plans.rules import ConfigError, rule_type
from lintel.schema import NO_LINE, number_of_lines


def _size_local(params: Mapping[str, Any]) -> Column:
    cap = F.lit(int(params["cap"]))
    for x in reversed(params.get("overrides", [])):
        cap = F.when(F.col("path").rlike(glob_to_regex(x["glob"])), F.lit(int(x["cap"]))).otherwise(cap)
    if hard := int(params.get("hard_cap", 0)):
        cap = F.when(cap == 0, hard).otherwise(F.least(cap, F.lit(hard)))
    n = number_of_lines(F.col("text"))
    return F.when((cap > 0) & (n > cap), F.array(found_at(F.format_string("%d lines, cap is %d", n, cap), NO_LINE)))


@rule_type("file-size", "cap", "hard_cap overrides", local=_size_local)
def file_size(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """A finding for a file with more lines than its cap: the first override whose glob fits, else cap; hard_cap limits
    both; 0 is no limit."""
    return from_local(files, _size_local(params))


def _found(checks: list[Column]) -> Column:
    """A finding for each message that isn't null."""
    return F.transform(F.array_compact(F.array(*checks)), lambda x: found_at(x, NO_LINE))


def _naming_local(params: Mapping[str, Any]) -> Column:
    checks = [F.lit(None).cast("string")]
    if params.get("forbid_ext"):
        checks.append(F.when(F.col("ext").isin(*params["forbid_ext"]), F.concat(F.lit("forbidden extension "), F.col("ext"))))
    if params.get("require_match"):
        checks.append(F.when(~F.col("path").rlike(to_java(params["require_match"])), F.lit(f"path doesn't match {params['require_match']}")))
    if params.get("reserved"):
        checks.append(F.coalesce(*(F.when(F.col("path").rlike(glob_to_regex(g)), F.lit(f"reserved name {g}")) for g in params["reserved"])))
    return _found(checks)


@rule_type("file-naming", "", "forbid_ext require_match reserved", paths_only=True, local=_naming_local)
def file_naming(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Findings for forbidden extensions, paths that don't match, and reserved names; one each."""
    return from_local(files, _naming_local(params))


def _binary_local(params: Mapping[str, Any]) -> Column:
    most = params.get("max_bytes")
    if most is None and not params.get("forbid_binary"):
        raise ConfigError("one of max_bytes and forbid_binary")
    if most is not None and int(most) < 0:
        raise ConfigError(f"max_bytes is 0 or more, not {most}")
    checks = [F.lit(None).cast("string")]
    if most is not None:
        size = F.octet_length("content")
        checks.append(F.when(size > int(most), F.concat(size.cast("string"), F.lit(f" bytes, most are {most}"))))
    if params.get("forbid_binary"):
        checks.append(F.when(F.instr(F.decode(F.substring("content", 1, 8000), "ISO-8859-1"), "\x00") > 0, F.lit("binary content")))
    return _found(checks)


@rule_type("binary-content", "", "max_bytes forbid_binary", local=_binary_local)
def binary_content(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Findings for files of more than max_bytes (0: any byte is one too many), and for files with a zero byte among the first
    8000."""
    return from_local(files, _binary_local(params))
