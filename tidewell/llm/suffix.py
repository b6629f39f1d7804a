"""Suffix sorting in numpy: difference-cover sample ranks, then one bucket of suffixes at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cmp_to_key, lru_cache

import numpy as np

PERIOD = 64
BUCKET = 1 << 17
U = np.uint64


@lru_cache(4)
def cover(period: int) -> tuple[np.ndarray, np.ndarray]:
    """A difference cover of the period (0 to r - 1 and the multiples of r), and for each difference d an a with a and a + d in it."""
    r = next(i for i in range(1, period + 1) if i * i >= period)
    d = np.unique(np.r_[np.arange(r), np.arange(0, period + r - 1, r) % period])
    first = np.full(period, -1)
    inside = set(d.tolist())
    for a in d.tolist():
        for b in inside:
            first[(b - a) % period] = a
    assert (first >= 0).all()
    return d, first


def octets(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number; zeros follow the end."""
    n = len(text)
    padded = np.zeros(n + 16, np.uint8)
    padded[:n] = text
    out = np.empty(n + 8, U)
    for o in range(8):
        part = padded[o : o + (n + 8 - o + 7) // 8 * 8]
        part = part[: len(part) // 8 * 8].view(">u8")
        out[o::8] = part[: len(out[o::8])]
    return out


def _words(o: np.ndarray, at: np.ndarray, period: int) -> list[np.ndarray]:
    last = len(o) - 1
    return [o[np.minimum(at + k, last)] for k in range(0, period, 8)]


def _ranks(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order by the keys, first the most significant, and each item's rank (equal ones share it).

    Each key orders only what the keys before leave equal."""
    n = len(keys[0])
    order = np.argsort(keys[0])
    x = keys[0][order]
    new = np.ones(n, bool)
    new[1:] = x[1:] != x[:-1]
    for k in keys[1:]:
        group = np.cumsum(new) - 1
        tied = np.flatnonzero(~new | ~np.r_[new[1:], True])
        if not len(tied):
            break
        who, group = order[tied], group[tied]
        x = k[who]
        first = np.argsort(x)
        level = np.empty(len(x), np.int64)
        y = x[first]
        level[first] = np.cumsum(np.r_[False, y[1:] != y[:-1]])
        both = group << 32 | level if n < 1 << 31 else group * (level.max() + 1) + level
        by = np.argsort(both)
        order[tied] = who[by]
        z = both[by]
        new[tied[1:]] = (z[1:] != z[:-1]) | new[tied[1:]]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank


class Sample:
    """Ranks among all suffixes that begin at a cover position. Memory: some 9 numbers a sampled position."""

    def __init__(self, text: np.ndarray, o: np.ndarray, period: int):
        self.n, self.period = len(text), period
        d, _ = cover(period)
        at = (np.arange(0, self.n + period, period)[:, None] + d).ravel()
        at = at[at < self.n]
        self.place = np.full(self.n + 1, -1, np.int32)
        self.place[at] = np.arange(len(at))
        # A suffix that ends within the first period is told from its zero-padded like by its length.
        left = np.minimum(self.n - at, period)
        order, rank = _ranks([*_words(o, at, period), left])
        step = period
        while len(at) and int(rank.max()) + 1 < len(at):
            later = at + step
            on = later < self.n
            follow = np.full(len(at), -1)
            follow[on] = rank[self.place[later[on]]]
            order, rank = _ranks([rank, follow])
            step *= 2
        self.rank, self.at, self.order = rank, at, order

    def ranks(self, positions: np.ndarray) -> np.ndarray:
        return np.where(positions < self.n, self.rank[self.place[np.minimum(positions, self.n)]], -1)

    def of(self, position: int) -> int:
        return -1 if position >= self.n else int(self.rank[self.place[position]])


def sorted_buckets(text: np.ndarray, among: np.ndarray | None = None, period: int = PERIOD, bucket: int = BUCKET) -> Iterator[np.ndarray]:
    """The suffixes at the positions among (all by default) in order, a bucket at a time.

    Bucket bounds are first words of evenly spaced suffixes of the sorted sample. In a bucket,
    suffixes are sorted by their first period bytes; those still equal are told apart by the ranks
    of the two sampled suffixes that follow both at the same distance."""
    among = np.arange(len(text)) if among is None else among
    if not len(among):
        return
    o = octets(text)
    sample = Sample(text, o, period)
    _, first = cover(period)
    key = o[among]
    n_parts = -(-len(among) // bucket)
    evenly = sample.at[sample.order[np.linspace(0, len(sample.order), n_parts + 1)[1:-1].astype(np.int64)]] if n_parts > 1 else np.zeros(0, np.int64)
    splits = np.unique(o[evenly])
    part = np.searchsorted(splits, key, "right")

    def compare(i: int, j: int) -> int:
        shift = int(first[(j - i) % period] - i) % period
        return sample.of(i + shift) - sample.of(j + shift)

    for p in range(len(splits) + 1):
        own = among[part == p] if n_parts > 1 else among
        if not len(own):
            continue
        order, rank = _ranks([*_words(o, own, period), np.minimum(len(text) - own, period)])
        own, rank = own[order], rank[order]
        tied = np.flatnonzero(np.r_[False, rank[1:] == rank[:-1]])
        if len(tied):
            begins = tied[np.r_[True, np.diff(tied) > 1]] - 1
            ends = tied[np.r_[np.diff(tied) > 1, True]] + 1
            # Most runs are pairs: all of them are compared at once.
            pair = ends - begins == 2
            left = begins[pair]
            i, j = own[left], own[left + 1]
            shift = (first[(j - i) % period] - i) % period
            turn = sample.ranks(i + shift) > sample.ranks(j + shift)
            own[left[turn]], own[left[turn] + 1] = j[turn], i[turn]
            for a, b in zip(begins[~pair].tolist(), ends[~pair].tolist(), strict=True):
                run = own[a:b]
                if len(np.unique(run % period)) == 1:  # one distance serves all
                    shift = int(first[0] - run[0]) % period
                    later = run + shift
                    own[a:b] = run[np.argsort(sample.ranks(later), kind="stable")]
                else:
                    own[a:b] = sorted(run.tolist(), key=cmp_to_key(compare))
        yield own


def shares(o: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the suffixes at a and b agree in their first length bytes (both have as many)."""
    same = np.ones(len(a), bool)
    for k in range(0, length, 8):
        x, y = o[a + k], o[b + k]
        if length - k < 8:
            cut = U(64 - 8 * (length - k))
            x, y = x >> cut, y >> cut
        same &= x == y
    return same
