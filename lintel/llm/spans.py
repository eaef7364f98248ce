"""Rows keyed by id and text, and cutting spans out of them."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import rows_of
from lintel.llm.words import columns, parts, texts


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, id, h): id and h together name the row's content; they are never null, and differ unless the row repeats.

    Rows without a doc_id get an id by their text, below all others."""
    rows = rows_of(docs, key, text)
    own = F.lit(-(2**62)) - F.xxhash64("text").bitwiseAND(F.lit(2**62 - 1))
    return rows.withColumn("id", F.coalesce("doc_id", own)).withColumn("h", F.xxhash64("text", "doc_id"))


def runs(flags: np.ndarray) -> np.ndarray:
    """[start, end) of each run of true flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def covered(size: int, starts: list[int] | None, ends: list[int] | None, least: int) -> np.ndarray:
    """[start, end) of each run of bytes under the spans, if it has `least` bytes or more."""
    if not starts:
        return np.empty((0, 2), int)
    level = np.zeros(size + 1, np.int32)
    np.add.at(level, starts, 1)
    np.add.at(level, ends, -1)
    found = runs(np.cumsum(level)[:-1] > 0)
    return found[found[:, 1] - found[:, 0] >= least]


#: What cut() says of a row.
CUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_shared long, kept binary"
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())


def cut(docs: DataFrame, spans: DataFrame, least: int = 1) -> DataFrame:
    """docs (keyed) without the bytes under spans (id, h, starts array<long>, ends array<long>), but for runs shorter than
    least: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, kept (binary: the remaining bytes, which need not be
    whole characters). n_shared: bytes in such runs of all_starts and all_ends, where spans has them."""
    more = [x for x in ("all_starts", "all_ends") if x in spans.columns]

    def row(raw: bytes, starts: list[int] | None, ends: list[int] | None, *every: list[int] | None) -> tuple:
        found = covered(len(raw), starts, ends, least)
        begin, end = [0, *found[:, 1].tolist()], [*found[:, 0].tolist(), len(raw)]
        kept = b"".join(raw[i:j] for i, j in zip(begin, end, strict=True))
        shared = covered(len(raw), *every, least) if every else found
        return len(raw), len(raw) - len(kept), len(found), hashlib.sha256(kept).hexdigest(), int((shared[:, 1] - shared[:, 0]).sum()), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in CUT.split(", ")]
        for batch in parts(batches):
            out = [row(*x) for x in zip(texts(batch), *columns(batch, "starts", "ends", *more), strict=True)]
            arrays = [pa.array(list(x), kind) for x, kind in zip(zip(*out, strict=True), _KINDS, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *arrays], names)

    both = docs.join(spans, ["id", "h"], "left").select("doc_id", "text", "starts", "ends", *more)
    return both.mapInArrow(run, CUT)
