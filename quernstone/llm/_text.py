"""Vectorised text kernels that work straight on Arrow string buffers.

A batch of texts is viewed as one ``uint8`` array plus offsets, so that word
splitting and hashing are a few numpy passes for thousands of documents
instead of a Python loop over words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_TABLES = {int(BASE): np.ones(1, np.uint64), int(INVERSE): np.ones(1, np.uint64)}
SLAB = 1 << 17

#: The six ASCII blanks: space and \t \n \v \f \r.
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _table(base: np.uint64, n: int) -> np.ndarray:
    if len(_TABLES[int(base)]) < n:
        p = np.full(max(n, 2 * len(_TABLES[int(base)]), 1024), base, np.uint64)
        p[0] = 1
        _TABLES[int(base)] = np.multiply.accumulate(p)
    return _TABLES[int(base)][:n]


def powers(n: int) -> np.ndarray:
    """BASE**0 .. BASE**(n-1) modulo 2**64 (kept between calls)."""
    return _table(BASE, n)


def inverse_powers(n: int) -> np.ndarray:
    """The same of the number that BASE times gives 1."""
    return _table(INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64, elementwise."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and the n+1 offsets; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if data is None:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the words before each document (n+1 offsets)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~SEPARATOR[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of some disjoint ascending spans, from running sums over slabs of bytes."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(starts, base + SLAB)))
        s, e = starts[i:j] - base, ends[i:j] - base
        codes = data[base : base + int(e[-1])].astype(np.uint64)
        codes += np.uint64(1)
        codes *= powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes, out=sums[1:])
        out[i:j] = (sums[e] - sums[s]) * inverse_powers(int(s[-1]) + 1)[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``width`` words, and the runs before each document.

    A document with fewer words has its whole sequence as its one run, one
    without words has none.  ``counts`` are the n+1 word offsets.
    """
    n = np.diff(counts)
    runs = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    before = np.concatenate(([0], np.cumsum(runs)))
    at = np.repeat(counts[:-1] - before[:-1], runs) + np.arange(before[-1])
    stop = np.repeat(counts[1:], runs)
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        here = at + k
        word = words[np.minimum(here, len(words) - 1)] if len(words) else h
        h = np.where(here < stop, mix(h * np.uint64(3) + word + np.uint64(k + 1)), h)
    return h, before


def batches(it, max_bytes: int = 4 << 20, column: str = "text"):
    """Cut Arrow batches so that none holds much more text than ``max_bytes``."""
    for b in it:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(column)).cast(pa.large_binary())
        size = np.diff(np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8))
        group = np.cumsum(size) // max_bytes
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), b.num_rows]
        for i, j in zip(cuts, cuts[1:]):
            if j > i:
                yield b.slice(i, j - i)


def runs(it, key: str):
    """Cut sorted Arrow batches into tables of whole runs of ``key``: (table, run offsets)."""
    held: list[pa.Table] = []

    def cut(table):
        k = table.column(key).to_numpy()
        return table, np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]))

    for b in it:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        k = t.column(key).to_numpy()
        change = np.flatnonzero(k[1:] != k[:-1]) + 1
        last = held and held[-1].column(key)[-1].as_py()
        if held and last != k[0]:
            yield cut(pa.concat_tables(held))
            held = []
        if len(change):
            end = int(change[-1])
            yield cut(pa.concat_tables([*held, t.slice(0, end)]))
            held, t = [], t.slice(end)
        held.append(t)
    if held:
        yield cut(pa.concat_tables(held))


def binaries(values: list[np.ndarray]) -> pa.Array:
    """Arrays as one Arrow column of their bytes."""
    return pa.array([v.tobytes() for v in values], pa.binary())
