"""Hashes of words and of runs of words, by whole Arrow batches.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Hashes are polynomials modulo 2**64 over random values (of bytes, then
of words), made from prefix sums, so that every window of a text costs the same few operations (Rabin-Karp).
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at a time; arrays of eight bytes each are made for these.
REGION = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: What operators keep in a worker from one task to the next.
KEEPING: list[dict] = []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def numbers(seed: int, n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def base(seed: int) -> int:
    """An odd number, 5 modulo 8, so its powers repeat late."""
    return int(numbers(seed, 1)[0]) & ~7 | 5


def powers(b: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """b**0 to b**(n-1), and their inverses."""
    if b not in _POWERS or len(_POWERS[b][0]) < n:
        size = max(n, 1 << 16)
        both = []
        for x in (b, pow(b, -1, 1 << 64)):
            p = np.full(size, np.uint64(x), np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        _POWERS[b] = both[0], both[1]
    p, q = _POWERS[b]
    return p[:n], q[:n]


def prefix_sums(values: np.ndarray, b: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(b, len(values))[0], out=out[1:])
    return out


class Words:
    """The words of a batch of texts: ``first[i]:first[i + 1]`` are those of text i, ``starts`` and ``ends`` their bytes."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8) if n else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(texts.buffers()[2], np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
        self.offsets = offsets - lo
        word = ~_SPACE[self.data]
        begins, stops = word.copy(), word.copy()
        begins[1:] &= ~word[:-1]
        stops[:-1] &= ~word[1:]
        inner = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[inner] = word[inner]
        stops[inner[1:] - 1] = word[inner[1:] - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self):
        return len(self.starts)

    def hashes(self, seed: int) -> np.ndarray:
        """One 64-bit hash for each word."""
        table, b = numbers(seed, 256), base(seed)
        out = np.empty(len(self), np.uint64)
        at = 0
        while at < len(self):
            until = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + REGION, "right")))
            low, high = self.starts[at], self.ends[until - 1]
            s, e = self.starts[at:until] - low, self.ends[at:until] - low
            sums = prefix_sums(table[self.data[low:high]], b)
            out[at:until] = mix64((sums[e] - sums[s]) * powers(b, high - low)[1][s] + (e - s).astype(np.uint64))
            at = until
        return out

    def lengths(self) -> np.ndarray:
        return np.diff(self.first)


def windows(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """The hash of words i to i + k - 1 for each i; those that pass the end of a text are for the caller to leave out."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    b = base(seed)
    sums = prefix_sums(hashes, b)
    n = len(hashes) - k + 1
    return mix64((sums[k:] - sums[:-k]) * powers(b, n)[1])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values i to i + width - 1 for each i."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (width - done)], values[width - done :]) if done < width else values


def lists(values: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def let_go(but: dict | None = None) -> None:
    """Drop what operators keep in this worker, ``but`` that of one, and hand freed memory back: workers outlive operators, and
    their memory adds up with that of what runs next."""
    if held := [k for k in KEEPING if k is not but and k]:
        for k in held:
            k.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def pieces(batches, limit: int = 4 << 20, column: str = "text", keep: dict | None = None):
    """Record batches cut so that the texts of each hold ``limit`` bytes or so; a longer text comes alone. What other operators
    than that of ``keep`` left in the worker goes."""
    let_go(keep)
    yield from _cut(batches, limit, column)
    let_go(keep)


def _cut(batches, limit: int, column: str):
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        sums = np.cumsum(sizes)
        at, done = 0, 0
        while at < batch.num_rows:
            until = max(at + 1, int(np.searchsorted(sums, done + limit, "right")))
            yield batch.slice(at, until - at)
            done, at = int(sums[until - 1]), until
