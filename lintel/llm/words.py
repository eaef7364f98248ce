"""Words and their hashes on the executors. A word is a run of bytes other than space and 0x09 to 0x0D."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_C1, _C2, _C3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))

def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values (a bijection)."""
    x = (x ^ (x >> np.uint64(30))) * _C2
    x = (x ^ (x >> np.uint64(27))) * _C3
    return x ^ (x >> np.uint64(31))


_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * _C1)
_BASE = 0xD1342543DE82EF95
#: Bytes that are hashed at once; longer texts are cut at white space.
_AT_ONCE = 1 << 20
_SPACES = np.zeros(256, bool)
_SPACES[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers, and their inverses modulo 2 ** 64, up to n at least; made once in a process."""
    if not _powers or len(_powers[0]) < n:
        n = max(n, 1 << 16)
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, np.uint64(x), np.uint64)))) for x in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash for each word of raw, in order, the same in every process.

    The hash of a word is a polynomial in its bytes' random values modulo 2 ** 64, scrambled with its length; it is taken
    from running sums over the whole text, so that no word is handled on its own.
    """
    out = []
    while raw:
        end = len(raw)
        if end > _AT_ONCE:
            cuts = np.flatnonzero(_SPACES[np.frombuffer(raw, np.uint8, offset=_AT_ONCE)])
            end = _AT_ONCE + int(cuts[0]) if len(cuts) else end
        b = np.frombuffer(raw, np.uint8, end)
        inside = np.concatenate(([False], ~_SPACES[b], [False]))
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        power, inverse = _powers_to(end)
        total = np.zeros(end + 1, np.uint64)
        np.cumsum(_LETTERS[b] * power[:end], out=total[1:])
        out.append(mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)))
        raw = raw[end:]
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each k words in a row; with fewer, one for the whole sequence; none without words."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * _C1 + hashes[i : n - k + 1 + i]
    return mix(out)


def columns(batch: pa.RecordBatch, *names: str) -> tuple[list, ...]:
    return tuple(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def parts(batches: Iterator[pa.RecordBatch], most_rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, most_rows):
            yield batch.slice(at, most_rows)
