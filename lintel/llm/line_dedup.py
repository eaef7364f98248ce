"""Removal of lines that many sites share. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import stored

#: Distinct sites from which a line is boilerplate.
SITES = 5
#: log2 of a sketch's registers, and how far from SITES, as a part of it, an estimate is not trusted.
LG_K, MARGIN = 12, 0.1
#: Percent of a document's characters that may go before the pipeline's stage asks whether it is a copy.
MOST_LOST = 50
#: Words of a shingle, and percent of shared ones, from which the stage takes a text for a copy: those of the pipeline's join.
WORDS, ALIKE = 5, 80


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def boilerplate(docs: DataFrame, text: str = "text", site: str = "source", sites: int = SITES) -> DataFrame:
    """(a, b): hashes of lines that `sites` sites or more share.

    Per line hash, sketches of the sites are merged by aggregation, on the map side first, so that a hot line or site
    sends one sketch a task. Lines whose estimate is near the threshold are counted exactly.
    """
    lines = _hashed(docs.select(F.col(text).alias("text"), F.col(site).cast("string").alias("site")))
    rough = lines.groupBy("a", "b").agg(F.hll_sketch_agg("site", F.lit(LG_K)).alias("sketch"))
    rough = stored(rough.select("a", "b", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - MARGIN)), "spread")
    near = rough.where(F.col("estimate") <= sites * (1 + MARGIN)).select("a", "b")
    exact = lines.join(near, ["a", "b"], "left_semi").groupBy("a", "b", "site").agg(F.count("*")).where("site is not null").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= sites)
    return rough.where(F.col("estimate") > sites * (1 + MARGIN)).select("a", "b").union(exact.select("a", "b"))


def _hashed(docs: DataFrame, *more: Column) -> DataFrame:
    found = docs.select(*(x for x in docs.columns if x != "text"), F.posexplode(_lines(F.coalesce("text", F.lit("")))).alias("at", "line"))
    found = found.select(*(x for x in found.columns if x != "line"), *more, F.trim("line").alias("line"))
    return found.where("line <> ''").select(*(x for x in found.columns if x not in ("at", "line")), "at", F.xxhash64("line").alias("a"), F.xxhash64(F.lit(1), "line").alias("b"))


def _copied(docs: DataFrame, over: DataFrame, text: str) -> DataFrame:
    """(_k): digests of those texts of over (_i, _k, rows, tokens) that are copies: in several rows, or alike another one.

    Each text is compared with two pivots of each of its boilerplate lines and two of all of them together, so that pairs
    are linear in the lines. A near copy whose lines are all common among unlike texts can be missed.
    """
    each = stored(over.groupBy("_k").agg(F.min("_i").alias("_i"), F.sum("rows").alias("rows"), F.first("tokens").alias("tokens")), "over")
    words = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    shingles = F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - WORDS, F.lit(0))), lambda i: F.xxhash64(F.array_join(F.slice("words", i + 1, WORDS), " "))))
    texts = docs.join(each.select("_i", "_k"), (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_k")), "left_semi").select("_h", F.col(text).alias("text")).dropDuplicates(["_h"])
    sets = stored(texts.withColumn("words", words).select("_h", shingles.alias("set")), "sets")
    tokens = each.select("_k", F.explode(F.array_union("tokens", F.array(F.xxhash64(F.array_sort("tokens"))))).alias("token"))
    pivots = tokens.groupBy("token").agg(F.array(F.min("_k"), F.max("_k")).alias("p"), F.count("*").alias("times")).where("times > 1").select("token", F.explode("p").alias("p"))
    pairs = tokens.join(pivots, "token").where("_k <> p").select("_k", "p").distinct()
    both = pairs.join(sets.select(F.col("_h").alias("_k"), F.col("set").alias("x")), "_k").join(sets.select(F.col("_h").alias("p"), F.col("set").alias("y")), "p")
    shared = F.size(F.array_intersect("x", "y"))
    alike = both.where(100 * shared >= ALIKE * (F.size("x") + F.size("y") - shared)).select(F.explode(F.array("_k", "p")).alias("_k"))
    return each.where("rows > 1").select("_k").union(alike).distinct()


def line_dedup(docs: DataFrame, sites: int = SITES, key: str = "doc_id", text: str = "text", site: str = "source", spare_copies: bool = False) -> DataFrame:
    """All columns of docs, `text` without its boilerplate lines, and n_lines, n_removed, lost_chars.

    A line (between newlines, spaces trimmed, not empty) is boilerplate if rows of `sites` distinct sites or more hold it;
    a null site counts for none. It is removed wherever it stands, repeats included, whatever share of a text that is. With
    spare_copies, a text that would lose over MOST_LOST percent of its characters stays whole if it is found to be a copy,
    as then its lines are shared for that reason. A null text stays null (n_lines 0); very long texts are read whole; no
    ties arise. Rows with the same or a null key are told apart by their text; repeated rows are treated alike. Columns of
    docs named like the ones added are replaced. An empty table gives no rows.
    """
    added = ("n_lines", "n_removed", "lost_chars")
    docs = docs.drop(*added)
    row = [F.coalesce(F.col(key).cast("long"), F.lit(-(2**62))).alias("_id"), F.xxhash64(text).alias("_h")]
    shared = stored(boilerplate(docs, text, site, sites), "boilerplate")
    if spare_copies:
        sized = _hashed(docs.select(*row, F.length(text).alias("_n"), F.size(_lines(F.col(text))).alias("_m"), F.col(text).alias("text")), F.length("line").alias("chars")).withColumnsRenamed({"_id": "_i", "_h": "_k"})
        bad = sized.join(shared, ["a", "b"]).groupBy("_i", "_k").agg(F.collect_set(F.struct("at", "chars", "a")).alias("s"), F.count("*").alias("rows"), F.max("_n").alias("_n"), F.max("_m").alias("_m"))
        # A line goes with its newline; a text of nothing else has one newline less than lines.
        lost = F.aggregate("s", F.lit(0), lambda x, y: x + y["chars"] + 1) - F.when(F.size("s") == F.col("_m"), 1).otherwise(0)
        over = (100 * lost > MOST_LOST * F.col("_n")).alias("over")
        bad = stored(bad.select("_i", "_k", F.col("s.at").alias("_bad"), F.array_distinct("s.a").alias("tokens"), (F.col("rows") / F.size("s")).cast("long").alias("rows"), over), "bad")
        copied = _copied(docs.select(*row, text), bad.where("over"), text)
        bad = bad.join(copied.withColumn("_copy", F.lit(True)), "_k", "left").where(~(F.col("over") & F.coalesce("_copy", F.lit(False)))).select("_i", "_k", "_bad")
    else:
        lines = _hashed(docs.select(*row, F.col(text).alias("text"))).withColumnsRenamed({"_id": "_i", "_h": "_k"})
        bad = lines.join(shared, ["a", "b"]).groupBy("_i", "_k").agg(F.collect_set("at").alias("_bad"))
    both = docs.select("*", *row).join(bad, (F.col("_id") == F.col("_i")) & (F.col("_h") == F.col("_k")), "left")
    both = both.withColumn("_bad", F.coalesce("_bad", F.array().cast("array<int>"))).withColumn("_lines", _lines(F.col(text)))
    # A set difference takes time linear in the lines, as a search of each line among the bad ones would not.
    left = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_bad")))
    kept_lines = F.array_join(F.transform(left, lambda i: F.col("_lines")[i]), "\n")
    both = both.withColumn("_kept", F.when(F.size("_bad") == 0, F.col(text)).otherwise(kept_lines))
    kept = {
        text: F.col("_kept"),
        "n_lines": F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long"),
        "n_removed": F.size("_bad").cast("long"),
        "lost_chars": F.coalesce(F.length(text) - F.length("_kept"), F.lit(0)).cast("long"),
    }
    return both.select(*(kept[c].alias(c) if c in kept else F.col(c) for c in docs.columns), *(kept[c].alias(c) for c in added))


def apply_line_dedup(docs: DataFrame) -> DataFrame:
    """The pipeline stage: the columns of docs, with texts and their sizes as line_dedup leaves them, but for copies that
    their own lines would make boilerplate of: the document-level join decides about these. No row goes; null and empty
    texts, repeated rows, rows without an id and an empty table are as line_dedup says."""
    found = line_dedup(docs, spare_copies=True)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast("long"))
    return found.select(docs.columns)
