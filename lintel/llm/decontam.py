"""Benchmark items in documents: SimHash of item-sized windows, Hamming blocks, then exact weighted shingles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import stored
from lintel.llm.words import columns, mix, parts, shingles, word_hashes

#: Words of a shingle, and the similarity from which a window is a copy.
WORDS, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, how many may differ from the item's, and bits of a block. Copies with a similarity of 0.8 differ in
#: 26 bits on average (deviation 4.5), unlike texts in 64.
BITS, RADIUS, BLOCK = 128, 40, 16
_BLOCKS = BITS // BLOCK
#: Fingerprints within RADIUS differ in some block by so many bits at most.
NEAR = RADIUS // _BLOCKS
#: Bytes of items (shingles and weights) that one pass over the documents compares, and so the most that is broadcast at once.
ITEM_BYTES = 1 << 25
#: Blocks' neighbours that a worker keeps, and windows that get fingerprints at once.
_CACHED, _AT_ONCE = 1 << 16, 4096
_MARKS = bytes(32 if 33 <= i < 48 or 58 <= i < 65 or 91 <= i < 97 or 123 <= i < 127 else i for i in range(256))
_POP = np.bitwise_count(np.arange(1 << BLOCK, dtype=np.uint32)).astype(np.uint8)
_GATE = (1 << 20) - 1


def hashes_of(text: str) -> np.ndarray:
    return word_hashes(text.lower().encode().translate(_MARKS))


def fingerprints(found: np.ndarray, weights: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """SimHash of the `width` shingles from each start, as blocks: a bit is set where the weights of shingles whose hash has
    it outweigh the others. Running sums make each window cost the same whatever its width."""
    both = np.ascontiguousarray(np.stack((found, mix(found ^ np.uint64(0x5851F42D4C957F2D))), axis=1))
    signs = np.unpackbits(both.view(np.uint8), axis=1).astype(np.float64) * 2 - 1
    total = np.concatenate((np.zeros((1, BITS)), np.cumsum(signs * weights[:, None], axis=0)))
    # Sums of equal windows differ by rounding alone, which must not decide a bit that is even.
    bits = total[np.minimum(starts + width, len(found))] - total[starts] > 1e-6
    return np.packbits(bits, axis=1).view(f">u{BLOCK // 8}").astype(np.uint32)


class Items:
    """Some items of a benchmark and their indexes: by shingle, and by the blocks of their fingerprints."""

    def __init__(self, rows: list[tuple[int | None, int, list[int], list[float]]], rare: float) -> None:
        """rows: (id, words, shingles in order, their weights); rare: the weight of a shingle that no item of the benchmark has."""
        self.ids, self.rare = [x[0] for x in rows], rare
        self.cache: dict[tuple[int, int, int], np.ndarray] = {}
        self.keys, self.weights, by_size, by_k = [], [], {}, {}
        for i, (_, m, found, weights) in enumerate(rows):
            found, weights = np.asarray(found, np.int64).view(np.uint64), np.asarray(weights, float)
            keys, first = np.unique(found, return_index=True)
            self.keys.append(keys)
            self.weights.append(weights[first])
            by_size.setdefault(m, []).append((i, fingerprints(found, weights, np.zeros(1, int), len(found))[0]))
            by_k.setdefault(min(m, WORDS), []).append((keys, np.full(len(keys), m), weights[first]))
        self.total = [x.sum() for x in self.weights]
        #: For each size: its items, and their fingerprints' blocks.
        self.of_size = {m: (np.asarray([i for i, _ in x]), np.stack([p for _, p in x])) for m, x in by_size.items()}
        #: For each length of shingles: a gate, the shingles with the sizes of items that hold them, in order, and their weights.
        self.by_k = {}
        for k, x in by_k.items():
            keys, sizes, weights = (np.concatenate(y) for y in zip(*x, strict=True))
            order = np.lexsort((sizes, keys))
            keys, sizes, weights = keys[order], sizes[order], weights[order]
            new = np.append(True, (keys[1:] != keys[:-1]) | (sizes[1:] != sizes[:-1]))
            gate = np.zeros(_GATE + 1, bool)
            gate[keys & np.uint64(_GATE)] = True
            self.by_k[k] = gate, keys[new], sizes[new], weights[new]

    def near(self, m: int, block: int, value: int) -> np.ndarray:
        """Places of items of size m whose fingerprint's block differs from a value by NEAR bits at most."""
        found = self.cache.get((m, block, value))
        if found is None:
            if len(self.cache) >= _CACHED:
                self.cache.clear()
            found = self.cache[m, block, value] = np.flatnonzero(_POP[self.of_size[m][1][:, block] ^ np.uint32(value)] <= NEAR)
        return found

    def alike(self, m: int, mine: np.ndarray) -> list[int]:
        """Items of size m whose fingerprint is within RADIUS: only those that a block finds are compared."""
        hit = np.unique(np.concatenate([self.near(m, b, v) for b, v in enumerate(mine.tolist())]))
        items, prints = self.of_size[m]
        return items[hit[_POP[prints[hit] ^ mine].sum(axis=1, dtype=int) <= RADIUS]].tolist()

    def search(self, hashes: np.ndarray) -> dict[int, tuple[float, int]]:
        """Items found in a text of these words: the best similarity and the word where that window first starts.

        Every window of as many words as some item has gets a fingerprint, but for those that share no shingle with any item
        of that size: their similarity is 0."""
        best: dict[int, tuple[float, int]] = {}
        for k, (gate, keys, sizes, weights) in self.by_k.items():
            found = shingles(hashes, k) if len(hashes) >= k else hashes[:0]
            hit = np.flatnonzero(gate[found & np.uint64(_GATE)])
            low, high = (np.searchsorted(keys, found[hit], x) for x in ("left", "right"))
            hit, low, high = (x[high > low] for x in (hit, low, high))
            if not len(hit):
                continue
            own = np.full(len(found), self.rare)
            own[hit] = weights[low]
            places, of = np.repeat(hit, high - low), sizes[np.concatenate([np.arange(i, j) for i, j in zip(low, high, strict=True)])]
            for m in np.unique(of).tolist():
                if 2 * len(hashes) >= m:
                    self._windows(m, m - k + 1, found, own, places[of == m], best)
        return best

    def _windows(self, m: int, width: int, found: np.ndarray, own: np.ndarray, places: np.ndarray, best: dict[int, tuple[float, int]]) -> None:
        level = np.zeros(len(found) + 1, np.int64)
        np.add.at(level, np.maximum(places - width + 1, 0), 1)
        np.add.at(level, places + 1, -1)
        starts = np.unique(np.minimum(np.flatnonzero(np.cumsum(level) > 0), max(0, len(found) - width)))
        cuts = np.flatnonzero((np.diff(starts) > width) | (np.diff(starts // _AT_ONCE) > 0)) + 1
        for some in np.split(starts, cuts):
            low, high = int(some[0]), int(some[-1]) + width
            prints = fingerprints(found[low:high], own[low:high], some - low, width)
            kinds, of = np.unique(prints, axis=0, return_inverse=True)
            alike = [self.alike(m, x) for x in kinds]
            for start, kind in zip(some.tolist(), of.ravel().tolist(), strict=True):
                for i in alike[kind]:
                    same = self.weights[i][np.isin(self.keys[i], found[start : start + width])].sum() / self.total[i]
                    if same >= SIMILARITY - 1e-12 and same > best.get(i, (0, 0))[0]:
                        best[i] = min(float(same), 1.0), start


def weighed(benchmark: DataFrame, key: str, text: str) -> tuple[DataFrame, float]:
    """(item, size, found, weights) for each item with a word, and the weight of shingles that no item has.

    A shingle weighs log(1 + items / items that hold it), counted over the whole benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            out = []
            for item, raw in zip(*columns(batch, "item", "text"), strict=True):
                if len(words := hashes_of(raw)):
                    out.append((item, len(words), shingles(words, WORDS).view(np.int64)))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)], ["item", "size", "found"])

    rows = benchmark.select(F.col(key).cast("long").alias("item"), F.col(text).alias("text")).where("text is not null")
    rows = stored(rows.mapInArrow(run, "item long, size int, found array<long>").withColumn("row", F.monotonically_increasing_id()), "items")
    n = rows.count()
    each = rows.select("row", F.posexplode("found").alias("at", "shingle"))
    held = each.groupBy("shingle", "row").agg(F.count("*")).groupBy("shingle").agg(F.count("*").alias("n"))
    weights = each.join(held, "shingle").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", F.log(1 + n / F.col("n")).alias("w")))).alias("x"))
    return rows.join(weights.select("row", F.col("x.w").alias("weights")), "row"), float(np.log(1 + max(n, 1)))


_built: dict[str, Items] = {}


def _items_of(name: str, held) -> Items:
    """The index over what a broadcast holds: made once in a worker, and gone when the next one comes."""
    if name not in _built:
        _built.clear()
        _built[name] = Items(*held.value)
    return _built[name]


def mark(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text", into: str = "items") -> DataFrame:
    """docs with another column: an array of (item_id, similarity, start word). One pass for each ITEM_BYTES of items, without
    a shuffle of docs."""
    docs = docs.withColumn(into, F.array().cast("array<struct<item_id:long,similarity:double,start:long>>"))
    rows, rare = weighed(benchmark, item_key, item_text)
    rows = stored(rows, "weighed")
    total = rows.agg(F.sum(F.size("found") * 16 + 64)).first()[0] or 0
    passes = -(-int(total) // ITEM_BYTES)
    for i in range(passes):
        if i:
            docs = stored(docs, "marked")  # else each pass would have a Python worker of its own, all at once
        some = rows.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == i)
        listed = [(r["item"], r["size"], r["found"], r["weights"]) for r in some.orderBy("item", "row").toLocalIterator()]
        held, name = docs.sparkSession.sparkContext.broadcast((listed, rare)), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], held=held, name=name) -> Iterator[pa.RecordBatch]:
            items = _items_of(name, held)
            for batch in parts(batches):
                at, kind = batch.schema.get_field_index(into), batch.schema.field(into).type
                found = []
                for raw, old in zip(*columns(batch, text, into), strict=True):
                    best = items.search(hashes_of(raw)) if raw else {}
                    found.append([*old, *({"item_id": items.ids[i], "similarity": s, "start": p} for i, (s, p) in sorted(best.items()))])
                yield batch.set_column(at, batch.schema.field(into), pa.array(found, kind))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, contaminated, item_ids, best_similarity) for each row of docs.

    Words are lower-cased and parted at white space and ASCII punctuation. A window of as many words as an item (the whole
    text, if that has fewer, but half as many at least) is a copy if its fingerprint is within RADIUS of the item's and the
    item's 5-word shingles that it holds weigh SIMILARITY of the item's (rare ones weigh more; shorter items are one
    shingle). Of equal windows the first counts. A null or empty text holds nothing; an item without words is in nothing;
    of a null item_id only `contaminated` tells. item_ids are distinct and sorted. Repeated rows are judged each, very long
    texts whole, _AT_ONCE windows at a time. An empty table gives no rows, an empty benchmark marks nothing. Columns of docs
    other than the two named stay out, whatever their names.
    """
    found = mark(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), benchmark)
    ids = F.array_sort(F.array_distinct(F.filter(F.transform("items", lambda x: x.item_id), lambda x: x.isNotNull())))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), ids.alias("item_ids"), F.coalesce(F.array_max(F.transform("items", lambda x: x.similarity)), F.lit(0.0)).alias("best_similarity"))


def apply_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline stage: documents that hold a benchmark item go. The others keep all their columns; rows
    without a text stay, repeated rows are judged each, an empty table stays empty."""
    return mark(docs, benchmark, into="_benchmark_items").where(F.size("_benchmark_items") == 0).select(docs.columns)
