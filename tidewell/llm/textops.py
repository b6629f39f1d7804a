"""Words, shingles and their hashes for whole Arrow batches of texts, in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def frugal(run):
    """run, for mapInArrow and its kin; the worker, which lives on after a task, gives freed memory back.

    Arrays of over 4 MB are mapped one by one, so they go as soon as they are freed; the rest goes at the task's end."""

    @wraps(run)
    def one(batches):
        with suppress(Exception):
            ctypes.CDLL(None).mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD
        yield from run(batches)
        give_back()

    return one


def give_back() -> None:
    with suppress(Exception):
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> U(31))
    h = h * U(0x7FB5D329728EA185)
    h ^= h >> U(27)
    h *= U(0x81DADEF4BC2DD44D)
    return h ^ (h >> U(33))


@lru_cache(4)
def _byte_values(fold: bool) -> np.ndarray:
    v = mix(np.arange(1, 257, dtype=U) * U(0xD6E8FEB86659FD93))
    if fold:
        v[65:91] = v[97:123]
    return v


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and base ** -i modulo 2 ** 64, for i < n."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.ones(n, U)
        done, step = 1, b
        while done < n:
            m = min(done, n - done)
            p[done : done + m] = p[:m] * U(step)
            done, step = done + m, step * step & _MASK
        out.append(p)
    return out[0], out[1]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(21, (n + 1).bit_length()))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of at most limit bytes of text; a longer text comes alone."""
    if batch.num_rows:
        sizes = np.diff(utf8(batch.column(column))[1])
        at = 0
        total = np.cumsum(sizes)
        while at < len(sizes):
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if a.null_count:
        a = a.fill_null(b"" if pa.types.is_binary(a.type) or pa.types.is_large_binary(a.type) else "")
    kind = np.int64 if pa.types.is_large_string(a.type) or pa.types.is_large_binary(a.type) else np.int32
    if not len(a):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(a.buffers()[1], kind)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = a.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def separators(*extra: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[9, 10, 11, 12, 13, 32]] = True
    for x in extra:
        t[list(x.encode())] = True
    return t


SPACES = separators()


def words(data: np.ndarray, offs: np.ndarray, seps: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the number of the text that each is in. Words never cross texts."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~seps[data]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    s = np.flatnonzero(first)
    e = np.flatnonzero(last) + 1
    return s, e, np.searchsorted(offs, s, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """64-bit hashes of the byte spans; with fold, A-Z count as a-z."""
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(_byte_values(fold)[data] * up[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(U) * U(0xA0761D6478BD642F))


def shingles(hashes: np.ndarray, doc: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and their texts. With short, a text of fewer words gives its whole sequence."""
    n = len(hashes)
    m = max(0, n - k + 1)
    within = doc[:m] == doc[n - m :] if m else np.zeros(0, bool)
    h = np.zeros(m, U)
    for j in range(k):
        h = h * U(0xC2B2AE3D27D4EB4F) + hashes[j : j + m]
        h ^= h >> U(29)
    out, of = mix(h[within] + U(k)), doc[:m][within]
    if short and n:
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        count = np.diff(np.r_[first, n])
        few = count < k
        extra = []
        for a, c in zip(first[few], count[few], strict=True):
            x = 0
            for v in hashes[a : a + c].tolist():
                x = (x * 0xC2B2AE3D27D4EB4F + v) & _MASK
                x ^= x >> 29
            extra.append((x + int(c)) & _MASK)
        if extra:
            out = np.concatenate([out, mix(np.array(extra, U))])
            of = np.concatenate([of, doc[first[few]]])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    return out, of


def distinct_per_doc(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes of each text in ascending order, their texts and counts."""
    if not len(hashes):
        return hashes, doc, np.zeros(0, np.int64)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    first = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]
    at = np.flatnonzero(first)
    return h[at], d[at], np.diff(np.r_[at, len(h)])
