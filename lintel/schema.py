"""The fixed relations of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILES = "path string, dir string, ext string, content binary, text string"
FINDINGS = "rule string, severity string, path string, line int, message string"
#: Of a finding about the whole scope, and of one that isn't anchored to a line.
NO_PATH, NO_LINE = "", 0


def files_of(rows: DataFrame, path: str | Column = "path", text: str | Column = "text") -> DataFrame:
    """files from any table that has a path and a text; a null text is an empty file."""
    path, text = (F.col(x) if isinstance(x, str) else x for x in (path, text))
    out = rows.select(path.cast("string").alias("path"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    return with_parts(out.withColumn("content", F.encode("text", "UTF-8"))).select("path", "dir", "ext", "content", "text")


def with_parts(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)).withColumn("ext", F.regexp_extract(name, r"(\.[^.]*)$", 1))


def lines_array(text: Column) -> Column:
    """Lines of a text: one newline at the end is dropped, then newlines part it; nothing left means no lines."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def number_of_lines(text: Column) -> Column:
    """How many lines lines_array() gives, without making them."""
    ends = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text.isin("", "\n"), 0).otherwise(ends + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)).cast("int")


def lines_of(files: DataFrame, *more: str) -> DataFrame:
    """(path, line_no, line), with further columns of files."""
    return files.select("path", *more, F.posexplode(lines_array(F.col("text"))).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def line_at(text: Column, place: Column) -> Column:
    """The line of a 1-based place in a text."""
    before = F.substring(text, F.lit(1), place - 1)
    return (1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))).cast("int")


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy("rule", "path", "line", "message")
