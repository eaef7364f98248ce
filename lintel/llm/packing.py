"""Packing documents into sequences of a fixed number of tokens, by linear grouping and best fit.

Everything that is decided centrally is decided on the histogram of piece lengths, which has at most `size` bins however
large the corpus is. The outcome is a table of runs: "pieces of length L with ranks a..b go to sequences s.. at offset o".
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm.shared import rows_of, stored
from lintel.llm.words import columns, parts

SIZE = 2048
#: Token id that ends each document.
END = 0
#: Lengths over SIZE / LARGE_FROM are large; groups of large pieces with equal numbers of pieces.
LARGE_FROM, GROUPS = 3, 256
#: Chunks of text, and as many words, whose ids a worker keeps; and flags for chunks seen once, which aren't kept yet.
CACHED_CHUNKS, SEEN_ONCE = 300_000, 1 << 22
_STRANGE = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Letters whose lower case depends on their place, or is more than one letter.
_UNEVEN = re.compile("[\u0130\u03a3]")


class ChunkIds(dict):
    """Ids, as little-endian 32-bit integers, of chunks between white space. The tokenizer drops white space and never
    joins what it parts, so that a text's ids are those of its chunks."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path)
        self.encode, self.model, self.words = found.encode, found.model, {}
        self.once, self.words_once = bytearray(SEEN_ONCE), bytearray(SEEN_ONCE)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level vocabularies write other bytes as 256, 257, ...
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: 256 + i for i, b in enumerate(hidden)}
        self.plain = '"ByteLevel"' in found.to_str()

    def whole(self, text: str) -> bytes:
        return np.asarray(self.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, letters: str) -> bytes:
        """Of letters only, in composed form: they are lower-cased and go to the model as one word."""
        key = letters.lower()
        if (found := self.words.get(key)) is None:
            written = key.encode().decode("latin-1").translate(self.letters)
            found = np.asarray([x.id for x in self.model.tokenize(written)], "<u4").tobytes()
            self.keep(self.words, self.words_once, key, found)
        return found

    def keep(self, cache: dict[str, bytes], once: bytearray, key: str, found: bytes) -> None:
        """From the second time on: most of what comes once never comes again."""
        flag = hash(key) % SEEN_ONCE
        if once[flag]:
            if len(cache) >= CACHED_CHUNKS:
                cache.clear()
            cache[key] = found
        once[flag] = 1

    def __missing__(self, chunk: str) -> bytes:
        letters, mark = (chunk[:-1], chunk[-1]) if chunk[-1] in ".,!?;:" else (chunk, "")
        if self.plain and letters.isalpha() and not _UNEVEN.search(letters) and is_normalized("NFC", letters):
            found = self.word(letters) + (self[mark] if mark and letters else b"")
        else:
            found = self.whole(chunk)
        self.keep(self, self.once, chunk, found)
        return found

    def of(self, text: str) -> bytes:
        # Python's split() also parts at 0x1C to 0x1F, and special tokens are found before white space is: whole there.
        return self.whole(text) if any(x in text for x in _STRANGE) else b"".join(map(self.__getitem__, text.split()))


_tokenizers: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One for each worker process, so that later tasks find the words of earlier ones."""
    if path not in _tokenizers:
        _tokenizers[path] = ChunkIds(path)
    return _tokenizers[path]


#: Rows of a table of pieces; `local` is the place among the pieces of the same length in the same partition.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, local long"


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, local, part) for every piece: a document's ids and END, cut at multiples of
    size. One Python worker does it all for a task, so that no more of them hold a tokenizer than tasks run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = chunk_ids(vocabulary), np.asarray([END], "<u4").tobytes()
        seen = np.zeros(size + 1, np.int64)
        for batch in batches:
            for rows in parts([batch]):
                out = []
                for doc, value in zip(*columns(rows, "doc_id", "text"), strict=True):
                    whole = ids.of(value) + end
                    for at in range(0, len(whole), 4 * size):
                        part = whole[at : at + 4 * size]
                        length = len(part) // 4
                        out.append((doc, at // (4 * size), at // 4, length, zlib.crc32(part), int(seen[length])))
                        seen[length] += 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    return rows_of(docs, key, text).mapInArrow(run, PIECES).withColumn("part", F.spark_partition_id())


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """Patterns of few sizes and how often each is used in the relaxed optimum (columns made as they are needed)."""
    m = len(sizes)
    base = np.diag([float(capacity // s) for s in sizes])
    want, used = np.asarray(demand, float), None
    for _ in range(400):
        used = np.linalg.solve(base, want)
        duals = np.linalg.solve(base.T, np.ones(m))
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for i, s in enumerate(sizes):  # unbounded knapsack over the room; sizes are large, so few fit
            for at in range(s, capacity + 1, s):
                part = slice(at, min(at + s, capacity + 1))
                more = best[at - s : part.stop - s] + duals[i]
                better = more > best[part] + 1e-12
                best[part][better], pick[part][better] = more[better], i
        room = int(best.argmax())
        if best[room] <= 1 + 1e-6:
            break
        column = np.zeros(m)
        while room > 0 and pick[room] >= 0:
            column[pick[room]] += 1
            room -= sizes[pick[room]]
        direction = np.linalg.solve(base, column)
        ratio = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1), np.inf)
        base[:, int(ratio.argmin())] = column
    return [([int(round(x)) for x in base[:, j]], max(0.0, float(used[j]))) for j in range(m)]


class _Bins:
    """Classes of sequences alike: how many there are, and the lengths that each holds."""

    def __init__(self, size: int) -> None:
        self.size, self.rooms, self.classes = size, [], defaultdict(list)

    def add(self, n: int, held: tuple[int, ...]) -> None:
        room = self.size - sum(held)
        if not self.classes[room]:
            insort(self.rooms, room)
        self.classes[room].append((n, held))

    def best_fit(self, length: int, left: int) -> None:
        """Puts `left` pieces of a length where the least room remains; new sequences are filled with it."""
        while left:
            i = bisect_left(self.rooms, length)
            if i == len(self.rooms):
                each = self.size // length
                for n, k in ((left // each, each), (1, left % each)):
                    if n and k:
                        self.add(n, (length,) * k)
                return
            room = self.rooms[i]
            n, held = self.classes[room].pop()
            if not self.classes[room]:
                self.rooms.pop(i)
            fit = min(n, left)
            self.add(fit, (*held, length))
            if fit < n:
                self.add(n - fit, held)
            left -= fit

    def all(self) -> list[tuple[int, tuple[int, ...]]]:
        return [x for room in self.rooms for x in self.classes[room]]

    def number(self) -> int:
        return sum(n for n, _ in self.all())


def _packed(size: int, kept: list[tuple[int, tuple[int, ...]]], counts: dict[int, int]) -> _Bins:
    out = _Bins(size)
    for n, held in kept:
        out.add(n, held)
    for length in sorted(counts, reverse=True):
        out.best_fit(length, counts[length])
    return out


def _grouped(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Sequences of large pieces by the grouping scheme; takes the pieces out of counts."""
    large = [x for x in sorted(counts, reverse=True) if size // LARGE_FROM < x < size and counts[x]]
    total, seen, groups = sum(counts[x] for x in large), 0, []
    for x in large:
        if not groups or seen >= len(groups) * total / GROUPS:
            groups.append([])
        groups[-1].append(x)
        seen += counts[x]
    if not groups:
        return []
    sizes, demand = [g[0] for g in groups], [sum(counts[x] for x in g) for g in groups]
    out = []
    for column, times in configurations(sizes, demand, size):
        times = min([int(times + 1e-6), *(sum(counts[x] for x in groups[g]) // k for g, k in enumerate(column) if k)])
        alike = [(times, ())] if times > 0 else []
        for g in (g for g, k in enumerate(column) for _ in range(k)):
            after = []
            for n, held in alike:
                while n:
                    while not counts[groups[g][0]]:
                        groups[g].pop(0)
                    x = groups[g][0]
                    fit = min(n, counts[x])
                    counts[x] -= fit
                    after.append((fit, (*held, x)))
                    n -= fit
            alike = after
        out += alike
    return out


def plan(counts: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, number, first sequence, offset) for a histogram of lengths, and the number of sequences.

    Large lengths are dealt into groups with equal numbers of pieces and rounded up to their group's largest; the best
    mix of configurations of these few sizes is found, each whole time it is used opens a sequence, and the group's
    actual pieces take the places, largest first. Pieces left over by rounding down, and small ones, go by best fit,
    largest first, where the room is what actual lengths leave. Last, sequences that rounding has left with more room
    than some tolerance are dissolved and their pieces packed anew; of the tolerances tried, the best outcome counts.
    """
    left = {x: n for x, n in counts.items() if n}
    kept = _grouped(left, size)
    best = _packed(size, kept, left)
    for tolerance in (size // 32, size // 64, size // 128, size // 256, size // 512, 1, 0):
        tight = [(n, held) for n, held in best.all() if size - sum(held) <= tolerance]
        loose: dict[int, int] = defaultdict(int)
        for n, held in best.all():
            if size - sum(held) > tolerance:
                for x in held:
                    loose[x] += n
        again = _packed(size, tight, loose)
        best = again if again.number() < best.number() else best
    runs, ranks, sequence = [], defaultdict(int), 0
    for n, held in best.all():
        offset = 0
        for x in held:
            runs.append((x, ranks[x], n, sequence, offset))
            ranks[x] += n
            offset += x
        sequence += n
    return runs, sequence


def place(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """cut (stored; any table with `length`) with sequence_id and offset for each row.

    Ranks within a length need no shuffle: each file partition counts its lengths, and a prefix sum over those counts,
    laid out by length, gives every partition the first rank of each length. cut must be a stored table, as it is read
    three times; the partition's number travels in the table as `part`.
    """
    spark = cut.sparkSession
    by_part = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    runs, _ = plan(counts, size)
    by_length: dict[int, list] = defaultdict(list)
    for length, rank, n, first, offset in runs:
        by_length[length].append((rank, first, offset))
    table = {k: tuple(np.asarray(x, np.int64) for x in zip(*sorted(v), strict=True)) for k, v in by_length.items()}
    known = spark.sparkContext.broadcast(table)  # its size depends on `size` and GROUPS only, not on the corpus
    from pyspark.sql import Window

    begins = by_part.withColumn("base", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    begins = begins.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "base"))).alias("bases"))
    fields = [f.name for f in cut.schema if f.name != "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(x))) for x in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for x in np.unique(length):
                ranks, firsts, offsets = known.value[int(x)]
                at = length == x
                i = np.searchsorted(ranks, rank[at], "right") - 1
                sequence[at], offset[at] = firsts[i] + rank[at] - ranks[i], offsets[i]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(x)) for x in fields), pa.array(sequence), pa.array(offset)], [*fields, "sequence_id", "offset"])

    ranked = cut.join(begins, "part").withColumn("rank", F.col("bases")[F.col("length")] + F.col("local")).drop("bases", "part", "local")
    fields = [x for x in fields if x != "local"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name in fields)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every row of docs with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece that holds END alone. Rows with the same key are packed each; a null key stays null.
    Only documents of over size tokens are cut, however long they are. Which of several pieces of the same length goes
    where is open. Other columns of docs, whatever their names, stay out. An empty table gives no rows.
    """
    return place(stored(pieces(docs, vocabulary, size, key, text), "pieces"), size)
