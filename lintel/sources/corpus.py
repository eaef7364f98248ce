"""Where files come from: trees on disk, JSON lines, memory, tables, and git."""

from __future__ import annotations

import json
import os
import subprocess
import unicodedata
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions.patterns import glob_to_regex
from lintel.plans.rules import ConfigError
from lintel.schema import files_of, with_parts

#: Directories that a walk never enters.
SKIPPED = (".git",)
_PRUNED = "path string, is_dir boolean, channel string, glob string, reason string"


def memory(spark: SparkSession, files: Iterable[tuple[str, str | bytes]]) -> DataFrame:
    rows = [(p, c.encode() if isinstance(c, str) else c) for p, c in files]
    return _decoded(spark.createDataFrame(rows, "path string, content binary"))


def _decoded(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("string")
    def decode(contents: pd.Series) -> pd.Series:
        return contents.map(lambda b: (b or b"").decode("utf-8", "replace"))

    return with_parts(rows.withColumn("text", decode("content"))).select("path", "dir", "ext", "content", "text")


def walk(root: str, ignore: Mapping[str, str] | None = None) -> tuple[list[str], list[tuple]]:
    """Paths under root, sorted, and what was pruned. ignore maps globs to reasons; the first that fits prunes a directory
    without entering it. A link to a directory outside the tree is an error; other links are recorded and left out."""
    import re

    root = os.path.realpath(root)
    globs = [(g, re.compile(glob_to_regex(g).replace(r"\z", r"\Z")), reason) for g, reason in (ignore or {}).items()]
    if bad := [g for g, _, reason in globs if not reason]:
        raise ConfigError(f"ignored without a reason: {', '.join(bad)}")
    found, pruned, open_ = [], [], [""]
    while open_:
        at = open_.pop()
        for entry in os.scandir(os.path.join(root, at)):
            path = f"{at}/{entry.name}".lstrip("/")
            if entry.is_dir(follow_symlinks=False) and entry.name in SKIPPED:
                continue
            hit = next(((g, reason) for g, test, reason in globs if test.match(path)), None)
            if hit:
                pruned.append((path, entry.is_dir(follow_symlinks=False), "ignore", *hit))
            elif entry.is_symlink():
                target = os.path.realpath(entry.path)
                if os.path.isdir(target) and os.path.commonpath([root, target]) != root:
                    raise ConfigError(f"{path} links to a directory outside the tree")
                pruned.append((path, False, "symlink", "", ""))
            elif entry.is_dir():
                open_.append(path)
            else:
                found.append(path)
    return sorted(found), sorted(pruned)


def tree(spark: SparkSession, root: str, ignore: Mapping[str, str] | None = None, paths: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files, pruned) of a tree that driver and executors share; contents are read by the executors. Hidden and empty
    files count. A file that can't be read fails the run."""
    found, pruned = walk(root, ignore)
    found = found if paths is None else [x for x in found if x in set(paths)]
    base = os.path.realpath(root)

    def read(rows: Iterator) -> Iterator:
        for batch in rows:
            for at in range(0, len(batch), 64):
                some = batch["path"].iloc[at : at + 64]
                contents = []
                for p in some:
                    with open(os.path.join(base, p), "rb") as f:
                        contents.append(f.read())
                yield pd.DataFrame({"path": some, "content": contents})

    listing = spark.createDataFrame([(x,) for x in found], "path string")
    return _decoded(listing.repartitionByRange(max(1, -(-len(found) // 256)), "path").mapInPandas(read, "path string, content binary")), spark.createDataFrame(pruned, _PRUNED)


def json_lines(spark: SparkSession, text: str) -> DataFrame:
    return memory(spark, records(text))


def records(text: str) -> list[tuple[str, str]]:
    """A batch of {"path", "content"} lines; blank lines, other fields and an empty batch are errors."""
    rows = []
    for i, line in enumerate(text.removesuffix("\n").split("\n"), 1):
        try:
            body = json.loads(line)
        except ValueError:
            raise ConfigError(f"line {i} isn't JSON") from None
        if not isinstance(body, dict) or set(body) != {"path", "content"} or not all(isinstance(x, str) for x in body.values()):
            raise ConfigError(f"line {i}: want path and content only")
        rows.append((body["path"], body["content"]))
    return rows


def table(spark: SparkSession, path: str, key: str, text: str, prefix: str = "") -> DataFrame:
    """Files from any Parquet table."""
    rows = spark.read.parquet(path)
    return files_of(rows, F.concat(F.lit(prefix), F.col(key).cast("string")), F.col(text))


def _git(root: str, *args: str) -> list[str]:
    done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)
    if done.returncode:
        raise ConfigError(f"git {args[0]}: {done.stderr.strip()}")
    return [x for x in done.stdout.split("\0") if x]


def staged(root: str) -> list[str]:
    return _git(root, "diff", "--cached", "--name-only", "-z", "--diff-filter=ACMR")


def in_range(root: str, spec: str, any_status: bool = False) -> list[str]:
    import shlex

    return _git(root, "diff", "--name-only", "-z", *(["--no-renames"] if any_status else ["--diff-filter=ACMR"]), *shlex.split(spec))


def tracked(root: str) -> list[str]:
    return _git(root, "ls-files", "-z")


def ignored(root: str) -> list[str]:
    """What git ignores, directories as a whole; nothing where git can't tell."""
    try:
        found = _git(root, "ls-files", "-z", "--others", "--ignored", "--exclude-standard", "--directory")
    except (ConfigError, OSError):
        return []
    return [x.rstrip("/") for x in found]


def prune(files: DataFrame, paths: Iterable[str]) -> DataFrame:
    """Files neither at one of the paths nor below one; every leading part of a file's path is looked up."""
    gone = files.sparkSession.createDataFrame([(x,) for x in sorted(set(paths))], "gone string")
    parts = F.split("path", "/")
    above = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("gone"))
    return files.join(above.join(gone, "gone", "left_semi").select("path").distinct(), "path", "left_anti")


def restrict(files: DataFrame, changed: Iterable[str]) -> DataFrame:
    """Files in a set of paths, composed and decomposed spellings alike; a path that no file has is an error."""
    names = sorted({unicodedata.normalize("NFC", x) for x in changed})
    fold = F.udf(lambda x: unicodedata.normalize("NFC", x), "string")
    wanted = files.sparkSession.createDataFrame([(x,) for x in names], "name string")
    own = files.withColumn("name", F.when(F.col("path").rlike(r"\A[\x00-\x7f]*\z"), F.col("path")).otherwise(fold("path")))
    if missing := wanted.join(own.select("name"), "name", "left_anti").first():
        raise ConfigError(f"{missing['name']} changed, but the scan doesn't hold it")
    return own.join(wanted, "name", "left_semi").drop("name")
