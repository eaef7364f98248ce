"""Removal of long repeated byte strings, found with suffix arrays sorted in two stages."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import stored
from lintel.llm.spans import cut, keyed, runs
from lintel.llm.words import columns, mix, parts, texts

LENGTH = 400
#: Bytes of the strings by which another document holds a passage: 51 words are rarely shorter.
PASSAGE = 256
#: Bytes of the strings whose least hash says which segments may share a window.
ANCHOR = 32
#: Bytes of segments with the same anchor that one suffix array takes; more are compared by window digests instead.
MOST_BYTES = 1 << 20
#: Bytes that a suffix array holds on average.
SHARD_BYTES = 1 << 18
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def suffix_array(data: bytes, depth: int = LENGTH) -> np.ndarray:
    """Starts of all suffixes in the order of their first `depth` bytes at least.

    Stage one sorts, by comparison, only suffixes that are smaller than the suffix one byte further on. Stage two scans
    the buckets of first bytes upwards: the suffix before each one found, if it is the larger, goes to the next free
    place in front of its own bucket. A bucket is scanned as a whole; only runs of one byte need several rounds.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    t = np.frombuffer(data, np.uint8).astype(np.int16)
    step = np.append(np.sign(np.diff(t)), -1)  # the last suffix is larger than the empty one
    at = np.where(step != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = step[at] > 0
    direct = np.flatnonzero(small)
    keys = [data[i : i + depth] for i in direct.tolist()]
    direct = direct[np.asarray(sorted(range(len(keys)), key=keys.__getitem__), np.int64)] if len(keys) else direct
    del keys
    edges = np.searchsorted(t[direct], np.arange(257))
    front: dict[int, list[np.ndarray]] = defaultdict(list)
    front[int(t[-1])].append(np.asarray([n - 1]))

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        before = found[found > 0] - 1
        before = before[~small[before] & (t[before] >= c)]
        first = t[before]
        order = np.argsort(first, kind="stable")
        bounds = np.searchsorted(first[order], np.arange(c, 257))
        for i in range(1, 256 - c):
            if bounds[i] < bounds[i + 1]:
                front[c + i].append(before[order[bounds[i] : bounds[i + 1]]])
        return before[order[: bounds[1]]]

    out = []
    for c in range(256):
        wave = np.concatenate(front.pop(c)) if c in front else np.empty(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = induce(wave, c)
        if edges[c] < edges[c + 1]:
            out.append(direct[edges[c] : edges[c + 1]])
            induce(out[-1], c)
    return np.concatenate(out)


def common_prefixes(data: bytes, order: np.ndarray, most: int) -> np.ndarray:
    """For each two neighbours in order (all with most bytes left), how many leading bytes they share, up to most."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    words = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    a, b, out = order[:-1], order[1:], np.full(max(0, len(order) - 1), most)
    live = np.arange(len(out))
    for at in range(0, most, 8):
        differ = words[a[live] + at] ^ words[b[live] + at]
        bad = differ != 0
        low = differ[bad] & (~differ[bad] + np.uint64(1))
        out[live[bad]] = np.minimum(most, at + (np.log2(low.astype(np.float64)).astype(int) // 8))
        live = live[~bad]
        if not len(live):
            break
    return out


def repeated(
    fragments: list[bytes], windows: list[int], docs: list[tuple[int, int]], passage: int = PASSAGE, length: int = LENGTH
) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each fragment, which of its first so many starts have an equal string of `length` bytes at another place among them
    all, and which have one of `passage` bytes in another document. docs: the least and the largest document that hold the
    fragment. Each start has `passage` bytes left in its fragment; where fewer than `length` are left, no such string starts."""
    data, sizes, number = b"".join(fragments), np.asarray([len(x) for x in fragments]), np.asarray(windows)
    ends = np.cumsum(sizes)
    order = suffix_array(data, length)
    of = np.searchsorted(ends, order, "right")
    mine = order < (ends - sizes + number)[of]
    order, of = order[mine], of[mine]
    whole = ends[of] - order >= length
    low, high = np.asarray(docs).T[:, of]
    same = common_prefixes(data + bytes(length), order, length)
    flags = np.zeros((2, len(data)), bool)
    first = np.flatnonzero(np.concatenate(([True], same < length)))
    flags[0, order[whole & np.repeat(np.add.reduceat(whole.astype(int), first) > 1, np.diff(np.append(first, len(order))))]] = True
    first = np.flatnonzero(np.concatenate(([True], same < passage)))
    several = np.minimum.reduceat(low, first) < np.maximum.reduceat(high, first)
    flags[1, order[np.repeat(several, np.diff(np.append(first, len(order))))]] = True
    begins = zip((ends - sizes).tolist(), windows, strict=True)
    both = [(flags[0, b : b + n], flags[1, b : b + n]) for b, n in begins]
    return [x for x, _ in both], [x for _, x in both]


def met(anchor: list[int], twice: list[bool], at: list[int], pieces: list[bytes], passage: int = PASSAGE) -> list[int]:
    """Which fragments can share a string of `passage` bytes with another one. Where no fragment holds its anchor twice, equal
    strings have it at the same place, so that half of their bytes at least are equal right before it or from it on."""
    loose, half = {a for a, x in zip(anchor, twice, strict=True) if x}, passage // 2
    sides = []
    for a, p, piece in zip(anchor, at, pieces, strict=True):
        sides.append(((a, piece[p - half : p]) if p >= half else None, (a, None, piece[p : p + half])))
    seen = Counter(x for two in sides for x in two)
    return [i for i, (a, (x, y)) in enumerate(zip(anchor, sides, strict=True)) if a in loose or (x and seen[x] > 1) or seen[y] > 1]


def anchors(raw: bytes, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Segments of raw: (start, number of windows, least hash, where from the start it first occurs, whether it occurs twice in
    the segment). A segment is a run of windows of `length` bytes whose least hash of `anchor` bytes is the same; equal windows
    have equal ones."""
    if len(raw) < length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool))
    h, reach = _TABLE[np.frombuffer(raw, np.uint8)], 1
    while reach < anchor:
        h = mix(h[:-reach] * np.uint64(0xD6E8FEB86659FD93) + h[reach:])
        reach *= 2
    want = length - anchor + 1

    def slide(x: np.ndarray, f: np.ufunc) -> np.ndarray:
        reach = 1
        while 2 * reach <= want:
            x = f(x[:-reach], x[reach:])
            reach *= 2
        return f(x[: len(x) - (want - reach)], x[want - reach :]) if reach < want else x

    least = slide(h, np.minimum)
    start = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    number = np.diff(np.append(start, len(least)))
    value = least[start]
    last = start + number + want - 1  # end of the segment's hashes
    edge = np.zeros(want - 1, np.uint64)
    places = np.flatnonzero(slide(np.concatenate((edge, least, edge)), np.maximum) == h)  # least of a window that holds them
    names, rank = np.unique(value, return_inverse=True)
    spot = np.searchsorted(names, h[places]) * len(h) + places
    spot.sort()
    low = np.searchsorted(spot, rank * len(h) + start)
    high = np.searchsorted(spot, rank * len(h) + last - 1, "right")
    return start, number, value, spot[low] - rank * len(h) - start, high - low > 1


def repeats(docs: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text", passage: int = PASSAGE) -> DataFrame:
    """Each row of docs without the bytes that any string of `length` bytes covers which also starts anywhere else (in any
    row, overlapping ones included): doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared, kept. n_shared: bytes that
    strings of `passage` bytes (length at most) cover which another document holds too; what repeats within one document only
    does not count. Nothing is removed for it.

    Texts are UTF-8 bytes; a null text is empty. Strings never cross rows and are judged on the input. Repeated rows are
    copies of each other and lose everything if long enough. Rows may share a doc_id (one document, for n_shared) or have
    none. No ties arise.

    Windows of `passage` bytes are dealt out by their least anchor hash, in segments, so that equal windows meet; each start
    takes the `length` bytes from it along, as far as its text goes. Equal segments collapse by digest in an aggregation and
    repeat wholly. Only where segments with the same anchor differ, or one holds its anchor twice, is text fetched and a
    suffix array built, over many anchors at once and at most MOST_BYTES of one anchor; both lengths are read from it.
    Anchors with more differing bytes than that (a passage that very many documents frame differently) are settled by an
    aggregation over digests of their windows, which splits by digest and takes any number of them.
    """
    docs = keyed(docs, key, text)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "h", "start", "windows", "anchor", "at", "twice", "size", "digest"]
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
        for batch in parts(batches):
            out: list[list] = [[] for _ in names]
            for name, h, raw in zip(*columns(batch, "id", "h"), texts(batch), strict=True):
                start, number, value, at, many = anchors(raw, passage)
                end = np.minimum(start + number + length - 1, len(raw))
                out[0] += [name] * len(start)
                out[1] += [h] * len(start)
                for to, x in zip(out[2:8], (start, number, value.view(np.int64), at, many, end - start), strict=True):
                    to += x.tolist()
                out[8] += [xxhash.xxh3_128_digest(raw[s:e]) for s, e in zip(start.tolist(), end.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    shape = "id long, h long, start int, windows int, anchor long, at int, twice boolean, size int, digest binary"
    segments = stored(docs.select("id", "h", "text").mapInArrow(split, shape), "segments")
    many = segments.groupBy("anchor").agg(F.count("*").alias("n"), F.max("twice").alias("twice")).where("n > 1 or twice").select("anchor")
    segments = stored(segments.join(many, "anchor").select(*segments.columns), "met")
    one = F.min(F.struct("id", "h", "start", "windows", "at", "twice", "size")).alias("one")
    kinds = stored(segments.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.max("id").alias("last"), one), "kinds")
    none = F.array().cast("array<long>")
    zero, whole = F.array(F.lit(0).cast("long")), F.least("one.windows", F.col("one.size") - (length - 1)).cast("long")
    several = F.col("last") > F.col("one.id")
    full = kinds.where("n > 1").select(
        "anchor",
        "digest",
        F.when(whole > 0, zero).otherwise(none).alias("starts"),
        F.when(whole > 0, F.array(whole)).otherwise(none).alias("ends"),
        F.when(several, zero).otherwise(none).alias("all_starts"),
        F.when(several, F.array(F.col("one.windows").cast("long"))).otherwise(none).alias("all_ends"),
    )
    by_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("k"), F.sum(F.col("one.size").cast("long")).alias("bytes"), F.max("one.twice").alias("twice"))
    wanted = kinds.join(by_anchor.where("k > 1 or twice").select("anchor", "bytes"), "anchor").select("anchor", "digest", "bytes", "last", "one.*")
    asked = ("anchor", "digest", "bytes", "last", "start", "windows", "at", "twice", "size")
    wanted = wanted.groupBy("id", "h").agg(F.collect_list(F.struct(*asked)).alias("want"))
    piece = "anchor long, digest binary, bytes long, first long, last long, windows int, at int, twice boolean, piece binary"
    names_ = [x.split()[0] for x in piece.split(", ")]

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds_ = (pa.int64(), pa.binary(), *(pa.int64(),) * 3, pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        for batch in parts(batches, 64):
            out = [
                (w["anchor"], w["digest"], w["bytes"], name, w["last"], w["windows"], w["at"], w["twice"], raw[w["start"] : w["start"] + w["size"]])
                for name, raw, want in zip(*columns(batch, "id"), texts(batch), *columns(batch, "want"), strict=True)
                for w in want
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds_, strict=True)], names_)

    fetched = docs.join(wanted, ["id", "h"]).select("id", "text", "want").mapInArrow(fetch, piece)
    fragments = stored(fetched, "fragments")
    total = fragments.where(f"bytes <= {MOST_BYTES}").agg(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_BYTES))
    marks = "anchor long, digest binary, starts array<long>, ends array<long>, all_starts array<long>, all_ends array<long>"

    def search(rows: pa.Table) -> pa.Table:
        found = {(a, d): x for a, d, *x in zip(*columns(rows, "anchor", "digest", "first", "last", "windows", "at", "twice", "piece"), strict=True)}
        keys, values = [*found], [*found.values()]  # a repeated row was fetched twice
        stay = met([a for a, _ in keys], [x[4] for x in values], [x[3] for x in values], [x[5] for x in values], passage) if keys else []
        hit = []
        if stay:
            chosen = [values[i] for i in stay]
            flags = repeated([x[5] for x in chosen], [x[2] for x in chosen], [(x[0], x[1]) for x in chosen], passage, length)
            for i, one, two in zip(stay, *flags, strict=True):
                if two.any() or one.any():
                    one, two = runs(one), runs(two)
                    hit.append((*keys[i], one[:, 0].tolist(), one[:, 1].tolist(), two[:, 0].tolist(), two[:, 1].tolist()))
        kinds_ = (pa.int64(), pa.binary(), *(pa.list_(pa.int64()),) * 4)
        lists = zip(*hit, strict=True) if hit else [[]] * 6
        return pa.table([pa.array(list(x), t) for x, t in zip(lists, kinds_, strict=True)], [x.split()[0] for x in marks.split(", ")])

    few = fragments.where(f"bytes <= {MOST_BYTES}").drop("bytes").withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
    parts_of = [full, few.groupBy("shard").applyInArrow(search, marks)]

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "digest", "at", "first", "last", "whole", "window"]
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        for batch in parts(batches, 16):
            out: list[list] = [[] for _ in names]
            for anchor, digest, first, last, n, piece in zip(*columns(batch, "anchor", "digest", "first", "last", "windows", "piece"), strict=True):
                for is_whole, size in ((True, length), (False, passage)):
                    m = min(n, len(piece) - size + 1)
                    for to, x in zip(out, (anchor, digest), strict=False):
                        to += [x] * m
                    out[2] += range(m)
                    for to, x in zip(out[3:6], (first, last, is_whole), strict=True):
                        to += [x] * m
                    out[6] += [xxhash.xxh3_128_digest(piece[i : i + size]) for i in range(m)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, types, strict=True)], names)

    hot = fragments.where(f"bytes > {MOST_BYTES}")
    if hot.first() is not None:
        once = hot.dropDuplicates(["anchor", "digest"]).repartition("anchor", "digest")
        each = stored(once.mapInArrow(windows, "anchor long, digest binary, at long, first long, last long, whole boolean, window binary"), "windows")
        more = each.groupBy("whole", "window").agg(F.count("*").alias("n"), F.min("first").alias("low"), F.max("last").alias("high"))
        more = stored(more.where("if(whole, n > 1, low < high)").select("whole", "window"), "repeated")  # so that a skewed join splits
        at = each.join(more, ["whole", "window"], "left_semi").groupBy("anchor", "digest")
        at = at.agg(*(F.collect_list(F.when(F.col("whole") == x, F.col("at"))).alias(name) for x, name in ((True, "starts"), (False, "all_starts"))))
        after = lambda name: F.transform(name, lambda x: x + 1)
        parts_of.append(at.select("anchor", "digest", "starts", after("starts").alias("ends"), "all_starts", after("all_starts").alias("all_ends")))
    found = parts_of[0]
    for x in parts_of[1:]:
        found = found.union(x)
    placed = segments.select("id", "h", "start", "anchor", "digest").join(stored(found, "marks"), ["anchor", "digest"])
    reach = {"starts": 0, "ends": length - 1, "all_starts": 0, "all_ends": passage - 1}
    move = lambda name, more: F.transform(name, lambda x: x + F.col("start") + more).alias(name)
    moved = [move(*x) for x in reach.items()]
    spans = placed.select("id", "h", *moved).groupBy("id", "h").agg(*(F.flatten(F.collect_list(name)).alias(name) for name in reach))
    return cut(docs, spans)
