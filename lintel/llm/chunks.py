"""Removal of repeated chunks whose bounds depend on content only, found with a gear rolling hash."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import stored
from lintel.llm.spans import cut, keyed
from lintel.llm.words import columns, mix, parts, texts

#: Bounds on a chunk's bytes, and how many bytes beyond the least it has on average.
LEAST, MEAN, MOST = 16, 40, 160
#: Bytes from which a run of repeated chunks is a passage; shorter ones are phrases and single lines.
LEAST_RUN = 128
_WINDOW = 32
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)


def gear(raw: bytes) -> np.ndarray:
    """At each byte, the hash h = 2 * h + gear[byte] in 32 bits, so that only the last 32 bytes matter."""
    h, reach = _GEAR[np.frombuffer(raw, np.uint8)], 1
    while reach < _WINDOW:
        h[reach:] += h[:-reach] << np.uint32(reach)  # the right side is made whole before it is added
        reach *= 2
    return h


def bounds(raw: bytes, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of raw's chunks: after a byte whose hash is low, least to most bytes from the last end."""
    if not raw:
        return []
    ends, at, n = [], 0, len(raw)
    for e in (np.flatnonzero(gear(raw) < np.uint32(2**32 // mean)) + 1).tolist():
        while e - at > most:
            at += most
            ends.append(at)
        if e - at >= least:
            at = e
            ends.append(at)
    while n - at > most:
        at += most
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def units(raw: bytes) -> list[tuple[int, int]]:
    """[start, end) of what is compared: each two neighbouring chunks, so that chunks alike by chance don't join up to a
    run that stands nowhere else; the only chunk of a short text."""
    ends = bounds(raw)
    begin = [0, *ends[:-1]][: len(ends)]
    return [*zip(begin[:-1], ends[1:], strict=True)] if len(ends) > 1 else [*zip(begin, ends, strict=True)]


def dedupe_chunks(docs: DataFrame, least_run: int = LEAST_RUN, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row of docs without passages that an earlier document holds: doc_id, n_bytes, n_removed, n_spans, kept_sha256,
    n_shared (bytes in passages that other documents hold, earlier or later), kept.

    Pairs of neighbouring chunks are compared by 128-bit digests over all rows. Where several documents hold a pair, it
    stays in the one with the smallest doc_id (rows without one come first, by a hash of their text), every time it occurs
    there, and goes from the others, in runs of least_run bytes or more. What repeats within one document only stays. All
    rows with the same doc_id are one document. A null or empty text has no chunk. Very long texts are cut whole;
    insertions move bounds only near themselves. An empty table gives no rows.
    """
    docs = keyed(docs, key, text)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "h", "start", "size", "d1", "d2"]
        for batch in parts(batches):
            ids, hs, starts, sizes, digests = [], [], [], [], []
            for name, h, raw in zip(*columns(batch, "id", "h"), texts(batch), strict=True):
                found = units(raw)
                ids += [name] * len(found)
                hs += [h] * len(found)
                starts += [b for b, _ in found]
                sizes += [e - b for b, e in found]
                digests += [xxhash.xxh3_128_digest(raw[b:e]) for b, e in found]
            two = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            arrays = [pa.array(x, t) for x, t in ((ids, pa.int64()), (hs, pa.int64()), (starts, pa.int32()), (sizes, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(two[:, 0]), pa.array(two[:, 1])], names)

    found = stored(docs.select("id", "h", "text").mapInArrow(split, "id long, h long, start int, size int, d1 long, d2 long"), "chunks")
    many = found.groupBy("d1", "d2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("d1", "d2", "first")
    held = found.join(stored(many, "repeated"), ["d1", "d2"]).select("id", "h", F.struct("start", (F.col("start") + F.col("size")).alias("end"), (F.col("id") > F.col("first")).alias("later")).alias("x"))
    spans = held.groupBy("id", "h").agg(F.collect_set("x").alias("all"))  # a repeated row comes once
    later = F.filter("all", lambda x: x["later"])
    longs = lambda x, name: F.transform(x, lambda y: y[name].cast("long"))
    spans = spans.select("id", "h", longs(later, "start").alias("starts"), longs(later, "end").alias("ends"), longs(F.col("all"), "start").alias("all_starts"), longs(F.col("all"), "end").alias("all_ends"))
    return cut(docs, spans, least_run)
