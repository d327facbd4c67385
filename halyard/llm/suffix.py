"""Suffix arrays by two-stage sorting, and adjacent common prefixes, up to a given depth.

Stage one sorts directly only the suffixes that are smaller than their successors (type S).  Stage two induces
all others (type L) by one scan over the symbol buckets: when the scan meets suffix j and j - 1 is of type L, it
is the next of its bucket.  Order is by the first ``depth`` symbols at least, which is all that asking for
common prefixes of ``depth`` needs.
"""

from __future__ import annotations

import numpy as np


class Ranks:
    """Ranks of the substrings of some widths at each place, each from two of half its width."""

    def __init__(self, symbols: np.ndarray, depth: int):
        n = len(symbols)
        bits = max(1, int(symbols.max() + 1 if n else 1).bit_length())
        width = max(1, min(depth, 62 // bits))
        key = np.zeros(n, np.int64)
        for k in range(width):
            key = key << bits
            key[: max(0, n - k)] += symbols[k:] + 1
        self.n, self.widths, self.ranks = n, [width], [self._dense(key)]
        while self.widths[-1] * 2 <= depth:
            self.widths.append(self.widths[-1] * 2)
            self.ranks.append(self._dense(self.pair(self.ranks[-1], self.widths[-2])))

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        ordered = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])]) + 1 if len(key) else []
        return out

    def pair(self, rank: np.ndarray, by: int) -> np.ndarray:
        key = rank << 31
        key[: max(0, self.n - by)] += rank[by:]
        return key

    def key(self, depth: int) -> np.ndarray:
        """A number per place that orders and tells apart its first ``depth`` symbols; the widest rank is over half of it."""
        return self.pair(self.ranks[-1], depth - self.widths[-1]) if depth > self.widths[-1] else self.ranks[-1]


def types(symbols: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last is not."""
    n = len(symbols)
    out = np.zeros(n, bool)
    if n > 1:
        step = np.diff(symbols)
        place = np.where(step != 0, np.arange(n - 1), n - 1)
        nearest = np.minimum.accumulate(place[::-1])[::-1]
        out[:-1] = np.append(step, -1)[nearest] > 0
    return out


def suffix_array(symbols: np.ndarray, depth: int, ranks: Ranks | None = None) -> np.ndarray:
    """Places of all suffixes in order of their first ``depth`` symbols (at least)."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    ranks = ranks or Ranks(symbols, depth)
    small = types(symbols)
    own = np.flatnonzero(small)
    own = own[np.argsort(ranks.key(depth)[own])]
    # symbols are small numbers from 0 on
    sym = symbols
    size = np.bincount(sym)
    ends = np.cumsum(size)
    sa = np.full(n, -1, np.int64)
    of = sym[own]
    count = np.bincount(of, minlength=len(size))
    sa[np.arange(len(own)) - (np.cumsum(count) - count)[of] + (ends - count)[of]] = own
    head, where, large, order = (ends - size).tolist(), sym.tolist(), (~small).tolist(), sa.tolist()
    # the empty suffix comes first of all and induces the last one
    c = where[n - 1]
    order[head[c]] = n - 1
    head[c] += 1
    for j in order:
        j -= 1
        if j >= 0 and large[j]:
            c = where[j]
            order[head[c]] = j
            head[c] += 1
    return np.asarray(order, np.int64)


def adjacent_prefixes(sa: np.ndarray, symbols: np.ndarray, ranks: Ranks, depth: int, least: int = 0) -> np.ndarray:
    """Common prefix of each suffix with the one before it in ``sa``, counted up to ``depth``; 0 for the first.

    Prefixes that differ within the widest rank are only counted if ``least`` is within it too; else they are 0.
    """
    n = len(sa)
    out = np.zeros(n, np.int64)
    pick = np.arange(1, n)
    if least > ranks.widths[-1]:
        pick = pick[ranks.ranks[-1][sa[1:]] == ranks.ranks[-1][sa[:-1]]]
    a, b = sa[pick - 1].copy(), sa[pick].copy()
    for width, rank in [*zip(ranks.widths, ranks.ranks, strict=True)][::-1]:
        for _ in range(2 if width == ranks.widths[-1] else 1):
            ok = (np.maximum(a, b) + width <= n) & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            out[pick] += width * ok
            a, b = a + width * ok, b + width * ok
    for _ in range(ranks.widths[0] - 1):
        ok = (np.maximum(a, b) < n) & (symbols[np.minimum(a, n - 1)] == symbols[np.minimum(b, n - 1)])
        if not ok.any():
            break
        out[pick] += ok
        a, b = a + ok, b + ok
    return np.minimum(out, depth)


def _runs(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix array, for each of its entries the run of suffixes that share their first ``depth`` symbols, and which places
    have that many symbols before the next 0."""
    n = len(symbols)
    ranks = Ranks(symbols, depth)
    sa = suffix_array(symbols, depth, ranks)
    stops = np.append(np.flatnonzero(symbols == 0), n)
    whole = stops[np.searchsorted(stops, np.arange(n))] - np.arange(n) >= depth
    joined = np.concatenate([adjacent_prefixes(sa, symbols, ranks, depth, depth)[1:] >= depth, [False]])
    return sa, np.concatenate([[0], np.cumsum(~joined[:-1])]), whole


def repeated(symbols: np.ndarray, depth: int) -> np.ndarray:
    """True where the next ``depth`` symbols also start at another place.

    Symbol 0 separates texts: what would run over one is never repeated.
    """
    out = np.zeros(len(symbols), bool)
    if len(symbols) >= depth:
        sa, run, whole = _runs(symbols, depth)
        out[sa] = np.bincount(run)[run] > 1
        out &= whole
    return out


def owners(symbols: np.ndarray, depth: int, owner: np.ndarray) -> np.ndarray:
    """For each place the number of different owners of places where its next ``depth`` symbols start; 0 where a 0 is among them."""
    out = np.zeros(len(symbols), np.int64)
    if len(symbols) >= depth:
        sa, run, whole = _runs(symbols, depth)
        each = np.unique(run * (int(owner.max()) + 1) + owner[sa])
        out[sa] = np.bincount(each // (int(owner.max()) + 1))[run]
        out[~whole] = 0
    return out
