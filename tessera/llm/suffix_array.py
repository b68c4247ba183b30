"""Suffix arrays by induced sorting, and common prefixes in text order, on numpy arrays."""

from __future__ import annotations

import numpy as np


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix is larger than the empty one after it."""
    n = len(t)
    here = np.zeros(n, np.int8)
    here[:-1] = np.sign(t[1:].astype(np.int64) - t[:-1])
    known = np.where(here != 0, np.arange(n), n)
    known[-1] = n - 1
    following = np.minimum.accumulate(known[::-1])[::-1]  # next place where a neighbour differs, or the end
    return here[following] > 0


def _induce(t: np.ndarray, small: np.ndarray, starts: np.ndarray, larger: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Places all suffixes, given the order of the leftmost smaller ones.  starts: first place of each symbol's bucket;
    larger: how many suffixes of each symbol are larger than the next."""
    n, symbols = len(t), len(starts) - 1
    sa = np.full(n, -1, np.int64)
    head = starts[:-1].copy()
    of = np.split(lms, np.searchsorted(t[lms], np.arange(1, symbols))) if symbols > 1 else [lms]

    def put(p: np.ndarray) -> None:
        """Larger suffixes p, in this order, at the fronts of their buckets."""
        c = t[p]
        by = np.argsort(c, kind="stable")
        p, c = p[by], c[by]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        counts = np.diff(np.append(first, len(c)))
        sa[np.repeat(head[c[first]] - first, counts) + np.arange(len(c))] = p
        head[c[first]] += counts

    put(np.array([n - 1]))
    for c in range(symbols):
        at = starts[c]
        while at < head[c]:
            some, at = sa[at : head[c]], head[c]
            p = some[some > 0] - 1
            p = p[~small[p]]
            if len(p):
                put(p)
        if len(of[c]):
            p = of[c][of[c] > 0] - 1
            p = p[~small[p]]
            if len(p):
                put(p)

    tail = starts[1:].copy()

    def put_back(p: np.ndarray) -> None:
        c = t[p]
        by = np.argsort(c, kind="stable")
        p, c = p[by], c[by]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        counts = np.diff(np.append(first, len(c)))
        sa[np.repeat(tail[c[first]] - 1 + first, counts) - np.arange(len(c))] = p
        tail[c[first]] -= counts

    for c in range(symbols - 1, -1, -1):
        at = starts[c + 1]
        while at > tail[c]:
            some, at = sa[tail[c] : at][::-1], tail[c]
            p = some[some > 0] - 1
            p = p[small[p]]
            if len(p):
                put_back(p)
        some = sa[starts[c] : starts[c] + larger[c]][::-1]
        p = some[some > 0] - 1
        p = p[small[p]]
        if len(p):
            put_back(p)
    return sa


def _before(t: np.ndarray, chosen: np.ndarray) -> list[int]:
    """For each place the symbol before it if that one is chosen, else -1; the last entry stands for an empty slot."""
    out = np.full(len(t) + 1, -1, np.int64)
    out[1:-1] = np.where(chosen[:-1], t[:-1], -1)
    return out.tolist()


def _induce_wide(t: list[int], before_larger: list[int], before_small: list[int], starts: list[int], lms: list[int]) -> list[int]:
    """The same for alphabets as wide as the text, where whole-array steps don't pay.

    The loops walk the array while they fill it ahead of themselves; ``before_larger`` and ``before_small`` say at one look
    whether the suffix before is induced, and into which bucket.
    """
    n = len(t)
    sa = [-1] * n
    tail = starts[1:]
    for p in reversed(lms):
        c = t[p]
        tail[c] -= 1
        sa[tail[c]] = p
    head = starts[:-1]
    c = t[n - 1]
    sa[head[c]] = n - 1
    head[c] += 1
    for p in sa:
        c = before_larger[p]
        if c >= 0:
            k = head[c]
            sa[k] = p - 1
            head[c] = k + 1
    tail = starts[1:]
    for p in reversed(sa):
        c = before_small[p]
        if c >= 0:
            k = tail[c] - 1
            sa[k] = p - 1
            tail[c] = k
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of t (non-negative integers) in ascending order; a suffix stands before longer ones that it begins."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t.astype(np.int64)
    used = np.zeros(int(t.max()) + 1, np.int64)
    used[t] = 1
    t = (np.cumsum(used) - 1)[t]  # symbols without gaps
    small = _types(t)
    counts = np.bincount(t)
    starts = np.concatenate([[0], np.cumsum(counts)])
    larger = np.bincount(t[~small], minlength=len(counts))
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    wide = len(counts) > max(300, n // 500)
    if wide:
        listed, before_larger, before_small, buckets = t.tolist(), _before(t, ~small), _before(t, small), starts.tolist()

    def induced(order: np.ndarray) -> np.ndarray:
        if wide:
            return np.array(_induce_wide(listed, before_larger, before_small, buckets, order.tolist()))
        return _induce(t, small, starts, larger, order)

    if len(lms) > 1:
        rough = induced(lms[np.argsort(t[lms], kind="stable")])
        chosen = np.zeros(n, bool)
        chosen[lms] = True
        order = rough[chosen[rough]]
        length = np.full(n, n, np.int64)  # of the substring from one leftmost smaller suffix to the next; the last ends the text
        length[lms[:-1]] = np.diff(lms) + 1
        length[lms[-1]] = n - lms[-1] + 1
        a, b = order[:-1], order[1:]
        same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
        live, k = np.flatnonzero(same), 0
        while len(live):
            live = live[length[a[live]] > k]
            differ = t[a[live] + k] != t[b[live] + k]
            same[live[differ]] = False
            live, k = live[~differ], k + 1
        name = np.zeros(n, np.int64)
        name[order] = np.concatenate([[0], np.cumsum(~same)])
        if name[order[-1]] + 1 < len(lms):
            order = lms[suffix_array(name[lms])]
        lms = order
    return induced(lms)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each suffix in text order, the symbols that it shares with its predecessor in the suffix array.

    Where the symbols before both suffixes agree, the value is the one before less one; only the other places are compared.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    place = np.arange(n)
    own = np.ones(n, bool)
    has = (place > 0) & (before > 0)
    own[has] = t[place[has] - 1] != t[before[has] - 1]
    own[before < 0] = True
    here = np.flatnonzero(own & (before >= 0))
    shared = np.zeros(n, np.int64)
    live, k = here, 0
    while len(live):
        i, j = live + k, before[live] + k
        inside = (i < n) & (j < n)
        live = live[inside]
        live = live[t[i[inside]] == t[j[inside]]]
        shared[live] += 1
        k += 1
    last = np.maximum.accumulate(np.where(own, place, 0))
    return np.where(own, shared, shared[last] - (place - last))
