"""Jaccard join of documents on word shingles, by a grouped prefix join, down to the components of its links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import components, rows_of, stored
from lintel.llm.words import columns, parts, shingles, texts, word_hashes

#: Cells in which shingles are counted to order them, rare ones first. The table is broadcast: 4 bytes a cell, always.
CELLS = 1 << 20
_BLOCKS = 64
#: Partial tables that one task adds up.
FAN = 64


def _set_of(raw: bytes, k: int) -> np.ndarray:
    return np.unique(shingles(word_hashes(raw.lower()), k))


def rarity(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents' shingles fall into each cell, counted over all documents. Only the order of shingles depends on
    it, hence speed but no result. Tables are added up in a tree, so that no task reads more than FAN of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cells = np.zeros(CELLS, np.uint32)
        for batch in batches:
            for raw in texts(batch):
                np.add.at(cells, _set_of(raw, k) & np.uint64(CELLS - 1), 1)
        yield _blocks(TaskContext.get().partitionId(), cells.reshape(_BLOCKS, -1))

    def _blocks(part: int, cells: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part] * _BLOCKS, pa.int64()), pa.array(range(_BLOCKS), pa.int32()), pa.array([x.tobytes() for x in cells], pa.binary())], ["part", "block", "counts"])

    def add(tables: pa.Table) -> pa.Table:
        parts_, blocks, counts = columns(tables, "part", "block", "counts")
        total = sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in counts)
        out = np.minimum(total, np.uint64(2**32 - 1)).astype(np.uint32)
        return pa.table([pa.array([parts_[0] // FAN], pa.int64()), pa.array(blocks[:1], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "block", "counts"])

    kind = "part long, block int, counts binary"
    found, n = docs.mapInArrow(count, kind), docs.rdd.getNumPartitions()
    while True:
        found, n = found.groupBy((F.col("part") / FAN).cast("long").alias("of"), "block").applyInArrow(add, kind), -(-n // FAN)
        if n <= 1:
            break
    rows = {r["block"]: r["counts"] for r in found.collect()}  # CELLS * 4 bytes
    return np.concatenate([np.frombuffer(rows[i], np.uint32) for i in range(_BLOCKS)]) if rows else np.zeros(CELLS, np.uint32)


def prefixes(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, digest, shape, prefix): the set's size and digest, its rarest shingles, and a digest of both."""
    order = docs.sparkSession.sparkContext.broadcast(rarity(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = order.value
        for batch in parts(batches):
            out = []
            for doc, raw in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
                found = _set_of(raw, k)
                n = len(found)
                size = n - -(-percent * n // 100) + 1 if n else 0
                first = found[np.lexsort((found, cells[found & np.uint64(CELLS - 1)]))[:size]]
                out.append((doc, n, xxhash.xxh3_128_digest(found.tobytes()), xxhash.xxh3_64_intdigest(first.tobytes(), n) - 2**63, first.view(np.int64)))
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "n", "digest", "shape", "prefix"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, shape long, prefix array<long>")


def verified(pairs: DataFrame, needed: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of pairs (a, b) whose sets are as similar as asked for; texts (needed: doc_id, text) come by joins on the id."""
    both = pairs.join(needed.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(needed.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            last, kept = None, []
            a, b, left, right = *columns(batch, "a", "b"), texts(batch, "text_a"), texts(batch, "text_b")
            for i in range(len(a)):
                if (b[i], right[i]) != last:  # rows come sorted by b from the join
                    last, mine = (b[i], right[i]), _set_of(right[i], k)
                other = _set_of(left[i], k)
                low, high = sorted((len(mine), len(other)))
                if 100 * low < percent * high:
                    continue
                shared = len(mine) + len(other) - len(np.union1d(mine, other))
                if 100 * shared >= percent * (len(mine) + len(other) - shared):
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return both.mapInArrow(run, "a long, b long")


def _may_link(percent: int, n: str, m: str, i: str, j: str):
    """Sizes n and m, and the places i and j of the first shared shingle, leave room for enough shared ones."""
    n, m, i, j = map(F.col, (n, m, i, j))
    least = F.ceil(percent * (n + m) / F.lit(float(100 + percent)) - 1e-9)
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (F.least(n - i, m - j) >= least)


def ngram_components(docs: DataFrame, k: int = 3, percent: int = 90, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    A set is the distinct shingles of k words (A-Z lower-cased) of the whole text; with fewer words the whole sequence is
    one shingle. Two rows link when 100 * shared >= percent * united. component_id is the smallest doc_id reachable by
    links, the row's own included. A null or empty text has an empty set and links with nothing. Rows that share a doc_id
    are one node; a null doc_id links only through its exact copies. Ties need no rule: links don't depend on any order.
    RuntimeError if components still change after 60 rounds, which grow with the logarithm of the longest chain of links.

    Equal sets are one class, and a class is handled once. Classes with the same prefix (the rarest shingles) and size
    form a group, and groups meet on prefix shingles. First each group meets one pivot of each of its shingles, and each
    class one of its group: a linear number of pairs, which joins most near copies into components. Then, of shingles
    whose groups are still in different components, pairs of groups that sizes and places allow are expanded to classes in
    different components and verified. Every link is either verified or lies inside a component.
    """
    docs = rows_of(docs, key, text)
    sets = stored(prefixes(docs, k, percent), "prefixes")
    classes = stored(sets.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep")), "classes")
    reps = sets.join(classes.where("rep is not null").withColumnRenamed("rep", "doc_id"), ["doc_id", "digest", "n"], "left_semi").dropDuplicates(["doc_id", "digest"])
    reps = stored(reps.select("doc_id", "n", "shape", "prefix"), "reps")
    groups = stored(reps.groupBy("shape", "n").agg(F.min("doc_id").alias("g"), F.count("*").alias("members"), F.first("prefix").alias("prefix")), "groups")
    many = groups.where("members > 1").select("shape", "n", "g")
    inside = reps.select("doc_id", "shape", "n").join(many, ["shape", "n"]).where("doc_id <> g").select(F.col("doc_id").alias("a"), F.col("g").alias("b"))
    bin_of = F.floor(F.log("n") / -np.log(percent / 100)) if percent < 100 else F.col("n")
    tokens = groups.select("g", "n", "shape", bin_of.cast("int").alias("bin"), F.posexplode("prefix").alias("i", "token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1").select("token")
    tokens = stored(tokens.join(shared, "token"), "tokens")  # of shingles that several groups have; most are in one
    pivots = tokens.groupBy("token", "bin").agg(F.min(F.struct("i", "g", "n")).alias("p"), F.count("*").alias("times")).where("times > 1")
    pivots = pivots.select("token", "bin", F.col("p.i").alias("j"), F.col("p.g").alias("h"), F.col("p.n").alias("m"))
    stars = tokens.join(pivots, ["token", "bin"]).where("g <> h").where(_may_link(percent, "n", "m", "i", "j")).select(F.greatest("g", "h").alias("a"), F.least("g", "h").alias("b"))
    # Texts move once, for all that may be compared; the ids grow with the data, so they are never broadcast.
    ids = tokens.select("g", "shape", "n").distinct().join(reps.select("shape", "n", "doc_id"), ["shape", "n"]).select("doc_id").union(inside.select("a")).union(inside.select("b")).distinct()
    needed = stored(docs.hint("merge").join(ids.hint("merge"), "doc_id", "left_semi"), "needed")
    tried = stored(inside.union(stars).distinct(), "tried")
    links = stored(verified(tried, needed, k, percent), "links")
    first = components(links)

    label = lambda df, c: df.join(first.select(F.col("node").alias(c), "component"), c, "left").withColumn("component", F.coalesce("component", c))
    members = stored(label(reps.select("doc_id", "shape", "n").join(groups.select("shape", "n", "g"), ["shape", "n"]), "doc_id").select("doc_id", "g", "shape", "component"), "members")
    spread = members.groupBy("g", "shape").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    rest = tokens.join(spread, ["g", "shape"])
    open_ = rest.groupBy("token").agg(F.min("low").alias("x"), F.max("high").alias("y")).where("x <> y").select("token")
    rest = stored(rest.join(open_, "token").select("token", "g", "shape", "n", "i", "low", "high"), "rest")
    other = rest.select("token", F.col("g").alias("h"), F.col("shape").alias("other_shape"), F.col("n").alias("m"), F.col("i").alias("j"), F.col("low").alias("other_low"), F.col("high").alias("other_high"))
    met = rest.join(other, "token").where("(g < h or (g = h and shape < other_shape)) and not (low = high and other_low = other_high and low = other_low)").where(_may_link(percent, "n", "m", "i", "j"))
    met = met.select("g", "shape", "h", "other_shape").distinct()
    mine = members.select("g", "shape", F.col("doc_id").alias("x"), F.col("component").alias("cx"))
    theirs = members.select(F.col("g").alias("h"), F.col("shape").alias("other_shape"), F.col("doc_id").alias("y"), F.col("component").alias("cy"))
    across = met.join(mine, ["g", "shape"]).join(theirs, ["h", "other_shape"]).where("cx <> cy")
    split = spread.where("low <> high").select("g", "shape")
    within = split.join(mine, ["g", "shape"]).join(theirs.withColumnsRenamed({"h": "g", "other_shape": "shape"}), ["g", "shape"]).where("cx <> cy and x < y")
    left = across.select("x", "y").union(within.select("x", "y")).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
    more = verified(stored(left, "left"), needed, k, percent)
    final = components(links.union(more))

    of_class = classes.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.col("n").alias("size"), F.coalesce("component", "rep").alias("component"))
    found = sets.select("doc_id", "n", "digest").join(of_class.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("n") == F.col("size")), "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The pipeline stage: of each component of near copies one row stays, the one with the smallest doc_id; of rows that
    share it, that with the smallest digest, once.

    Rows with a null doc_id are nodes by their text, behind all ids: they link like others, and one stays only if no row
    of the component has an id. Those without words link with nothing and stay, as texts without words of other ids do.
    """
    rows, text = docs.columns, F.coalesce("text", F.lit(""))
    node = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**62) + F.xxhash64(text).bitwiseAND(F.lit(2**62 - 1)))
    docs = docs.withColumn("_node", node)
    gone = ngram_components(docs, k, percent, key="_node").where("doc_id <> component_id").select(F.col("doc_id").alias("_node")).distinct()
    left = docs.join(gone, "_node", "left_anti")
    free = F.col("doc_id").isNull() & ~text.rlike(r"[^\x20\x09-\x0D]")
    again = stored(docs.where(~free).groupBy("_node").agg(F.count("*").alias("n")).where("n > 1").select("_node"), "again")
    if again.first() is None:
        return left.select(rows)
    one = left.where(~free).join(again, "_node", "left_semi").groupBy("_node").agg(F.min_by(F.struct(*rows), F.sha2(F.to_json(F.struct(*rows)), 256)).alias("row"))
    return left.where(free).select(rows).union(left.where(~free).join(again, "_node", "left_anti").select(rows)).union(one.select("row.*"))
