"""Rules that ask other programs: commands and git. They run on the driver, and only where a run allows them."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.functions.patterns import to_java
from lintel.operators.patterns import finding
from lintel.plans.rules import ConfigError, rule_type
from lintel.schema import NO_LINE, NO_PATH

_FINDING = re.compile(r"^(?P<path>[^:\n]+):(?P<line>\d+): ?(?P<message>.*)$")
#: Seconds after which a program is ended.
PATIENCE = 600


def _run(argv: Sequence[str], root: str) -> tuple[int, str]:
    try:
        done = subprocess.run([*argv], cwd=root, capture_output=True, text=True, timeout=PATIENCE)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise ConfigError(f"{argv[0]} can't be run: {e}") from None
    return done.returncode, done.stdout + done.stderr


@rule_type("command", "cmd root allow", "expect output when", cost="heavy")
def command(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """A finding if the exit code differs from expect.exit (0) or the output matches expect.output_forbid. With output
    findings-v1, lines path:line: message become findings; a path that isn't in the scope is an error. when.paths_changed:
    the command runs only if the scope holds such a path. `allow: true` has to say that programs may run."""
    from lintel.plans.engine import any_glob

    spark = files.sparkSession
    empty = spark.createDataFrame([], "path string, line int, message string")
    if params["allow"] is not True:
        raise ConfigError("the rule runs a program; `allow: true` is needed")
    if globs := (params.get("when") or {}).get("paths_changed"):
        if files.where(any_glob(globs)).limit(1).count() == 0:
            return empty
    expect = params.get("expect") or {}
    code, output = _run(params["cmd"], params["root"])
    if params.get("output") == "findings-v1":
        rows = [(m["path"], int(m["line"]), m["message"]) for x in output.split("\n") if (m := _FINDING.match(x))]
        if rows or code == expect.get("exit", 0):
            found = spark.createDataFrame(rows, "path string, line int, message string")
            if strange := found.join(files.select("path"), "path", "left_anti").first():
                raise ConfigError(f"{params['cmd'][0]} names {strange['path']}, which the scope doesn't hold")
            return found
    wrong = []
    if code != expect.get("exit", 0):
        wrong.append(f"exit code {code}, want {expect.get('exit', 0)}")
    if expect.get("output_forbid") and re.search(expect["output_forbid"], output):
        wrong.append(f"output matches {expect['output_forbid']}")
    return spark.createDataFrame([(NO_PATH, NO_LINE, x) for x in wrong], "path string, line int, message string")


def diff_lines(files: DataFrame, diff: str) -> DataFrame:
    """(sign, line) of the added and removed lines of a unified diff, without its headers."""
    rows = [(x[0], x[1:]) for x in diff.split("\n") if x[:1] in ("+", "-") and not x.startswith(("+++", "---"))]
    return files.sparkSession.createDataFrame(rows, "sign string, line string")


@rule_type("git-diff", "root range", "forbid_added forbid_removed", cost="range")
def git_diff(files: DataFrame, params: Mapping[str, Any]) -> DataFrame:
    """Findings for added or removed lines of a git range that match."""
    code, diff = _run(["git", "diff", "--no-color", *params["range"].split(), "--"], params["root"])
    if code:
        raise ConfigError(f"git diff ended with {code}")
    rows = diff_lines(files, diff)
    out = rows.where("false").select(*finding("", NO_LINE, F.lit(NO_PATH)))
    for sign, name, key in (("+", "added", "forbid_added"), ("-", "removed", "forbid_removed")):
        if params.get(key):
            hit = rows.where((F.col("sign") == sign) & F.col("line").rlike(to_java(params[key])))
            out = out.union(hit.select(*finding(F.concat(F.lit(f"{name} line matches {params[key]}: "), F.trim("line")), NO_LINE, F.lit(NO_PATH))))
    return out
