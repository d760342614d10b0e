"""Words, windows and hashes of whole Arrow batches of text, as numpy arrays.

Texts are cut at row borders into chunks of about ``CHUNK`` bytes, so memory follows the chunk, or the one
text that is longer.  All hashes are fixed by the bytes alone: every task and every rerun finds the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of a splittable generator)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def members(keep: str) -> np.ndarray:
    """Table over byte values.  ``text``: all but white space; ``alnum``: digits, a-z and everything from 0x80."""
    table = np.zeros(256, dtype=bool)
    if keep == "text":
        table[:] = True
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[0x30:0x3A] = table[0x61:0x7B] = table[0x80:] = True
    return table


TEXT, ALNUM = members("text"), members("alnum")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * CHUNK)
            up, down = np.full(size, self.base, dtype=np.uint64), np.full(size, self.inverse, dtype=np.uint64)
            up[0] = down[0] = 1
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
            if size > 4 * CHUNK:  # for one very long text only
                return up, down
            self.up, self.down = up, down
        return self.up, self.down


BYTES, WORDS = Powers(_BASE), Powers(_WORD_BASE)


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of consecutive rows with about ``CHUNK`` bytes of text; a null text is empty."""
    data = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_binary())
    off = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset:data.offset + len(data) + 1]
    raw = data.buffers()[2]
    buf = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    start = 0
    while start < len(data):
        end = max(start + 1, int(np.searchsorted(off, off[start] + CHUNK, side="right")) - 1)
        yield batch.slice(start, end - start), buf[off[start]:off[end]], off[start:end + 1] - off[start]
        start = end


def spans(buf: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and each text's range among them.  No word crosses a text's border."""
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(off), dtype=np.int64)
    inside = member[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads, tails = off[:-1][off[:-1] < len(buf)], off[1:][off[1:] > 0] - 1
    first[heads], last[tails] = inside[heads], inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def prefix_sums(buf: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any byte range by one subtraction."""
    up, _ = BYTES.get(len(buf) + 1)
    out = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[:len(buf)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges: equal for equal bytes wherever they stand."""
    _, down = BYTES.get(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hash(words: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hashes of every ``n`` consecutive values; the caller drops those across texts."""
    if len(words) < n:
        return np.zeros(0, dtype=np.uint64)
    up, down = WORDS.get(len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:len(words)], out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down[:len(words) - n + 1] + np.uint64(n))


def inside(ranges: np.ndarray, n: int) -> np.ndarray:
    """For each position, does a window of ``n`` from there stay in its text?  ``ranges``: the texts' borders."""
    out = np.zeros(int(ranges[-1]) + 1, dtype=np.int64)
    counts = np.diff(ranges)
    full = counts >= n
    np.add.at(out, ranges[:-1][full], 1)
    np.add.at(out, ranges[1:][full] - n + 1, -1)
    return np.cumsum(out[:-1]) > 0


def leftmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of every ``width`` consecutive hashes, the leftmost of equal ones (by 33 bits)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    low = (values & np.uint64(0xFFFFFFFF80000000)) | np.arange(len(values), dtype=np.uint64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[width - span:width - span + n])
    return (low & np.uint64(0x7FFFFFFF)).astype(np.int64)


def runs(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every run of equal (owner, value)."""
    if not len(value):
        none = np.zeros(0, dtype=np.int64)
        return none, none
    edge = np.flatnonzero((owner[1:] != owner[:-1]) | (value[1:] != value[:-1])) + 1
    first = np.concatenate(([0], edge))
    return first, np.diff(np.concatenate((first, [len(value)])))


def unfold(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the range, value) for every value of the ranges [first, first + count)."""
    owner = np.repeat(np.arange(len(first)), count)
    base = np.repeat(np.cumsum(count) - count, count)
    return owner, np.repeat(first, count) + np.arange(len(owner)) - base


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in any of the ranges."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's long."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
