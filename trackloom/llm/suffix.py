"""Suffix arrays by induced sorting, in whole-array steps.

The induced-sorting scans go bucket by bucket; buckets that induce nothing in one another are taken
together. A batch first completes its runs of one symbol, then sends what it induces to later
buckets in one stable sort, so the work is linear in the text but for these small sorts.
"""

from __future__ import annotations

import numpy as np


def classify(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last (the sentinel) is."""
    n = len(s)
    rise = np.ones(n, bool)
    rise[:-1] = s[:-1] < s[1:]
    differs = np.ones(n, bool)
    differs[:-1] = s[:-1] != s[1:]
    at = np.where(differs, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]]


def _batches(source: np.ndarray, target: np.ndarray, buckets: int) -> list[tuple[int, int]]:
    """Ranges of buckets, ascending, in which no bucket induces into another."""
    latest = np.full(buckets, -1)
    np.maximum.at(latest, target, source)
    out, first = [], 0
    for b, x in enumerate(latest.tolist()):
        if x >= first:
            out.append((first, b))
            first = b
    out.append((first, buckets))
    return out


def _place(sa: np.ndarray, head: np.ndarray, j: np.ndarray, bucket: np.ndarray, step: int) -> None:
    order = np.argsort(bucket.astype(np.uint16) if len(head) <= 1 << 16 else bucket, kind="stable")
    j, bucket = j[order], bucket[order]
    new = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    count = np.diff(np.concatenate([new, [len(j)]]))
    own = bucket[new]
    sa[np.repeat(head[own] - step * new, count) + step * np.arange(len(j))] = j
    head[own] += step * count


def _induce(sa: np.ndarray, s: np.ndarray, small: np.ndarray, start: np.ndarray, up: bool) -> None:
    """Fills in the larger-type suffixes from below (up), or the smaller-type ones from above."""
    n, buckets = len(s), len(start) - 1
    kind = ~small if up else small
    (j,) = np.nonzero(kind[:-1])
    source, target = s[j + 1], s[j]
    apart = source != target
    flip = (lambda b: b) if up else (lambda b: buckets - 1 - b)
    groups = _batches(flip(source[apart]), flip(target[apart]), buckets)
    chain = np.zeros(n, bool)  # position whose predecessor has the type and the same symbol
    chain[j[~apart] + 1] = True
    leads = np.zeros(n, bool)  # the same with another symbol
    leads[j[apart] + 1] = True
    step = 1 if up else -1
    head = start[:-1].copy() if up else start[1:] - 1
    for a, b in groups:
        lo, hi = (start[a], start[b]) if up else (start[buckets - b], start[buckets - a])
        own = sa[lo:hi]
        own = own[own >= 0]
        if not up:
            own = own[::-1]
        chained = own[chain[own]] - 1
        while len(chained):
            _place(sa, head, chained, s[chained], step)
            chained = chained[chain[chained]] - 1
        own = sa[lo:hi]
        own = own[own >= 0]
        if not up:
            own = own[::-1]
        sent = own[leads[own]] - 1
        if len(sent):
            _place(sa, head, sent, s[sent], step)


def _induced(s: np.ndarray, small: np.ndarray, start: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes, from leftmost-smaller suffixes in the given order."""
    sa = np.full(len(s), -1, np.int64)
    tail = start[1:] - 1
    _place(sa, tail.copy(), lms[::-1], s[lms[::-1]], -1)
    _induce(sa, s, small, start, True)
    seen = sa >= 0
    seen[seen] = small[sa[seen]]
    sa[seen] = -1
    sa[0] = len(s) - 1
    _induce(sa, s, small, start, False)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffixes of s in order. The last symbol is 0 and stands nowhere else; symbols are not negative."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    s = s.astype(np.int64)
    start = np.concatenate([[0], np.cumsum(np.bincount(s))])
    small = classify(s)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    (lms,) = np.nonzero(is_lms)
    order = _induced(s, small, start, lms)
    order = order[is_lms[order]]
    rank = np.full(n, -1, np.int64)
    rank[lms] = np.arange(len(lms))
    length = np.diff(np.concatenate([lms, [n - 1]])) + 1
    length[-1] = 1
    size = length[rank[order]]
    new = np.ones(len(order), bool)
    (like,) = np.nonzero(size[1:] == size[:-1])
    if len(like):
        m = size[like + 1]
        at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        unlike = s[np.repeat(order[like + 1], m) + at] != s[np.repeat(order[like], m) + at]
        new[like + 1] = np.logical_or.reduceat(unlike, np.cumsum(m) - m)
    name = np.cumsum(new) - 1
    if name[-1] + 1 < len(order):
        reduced = np.empty(len(lms), np.int64)
        reduced[rank[order]] = name
        order = lms[suffix_array(reduced)]
    return _induced(s, small, start, order)


def permuted_prefixes(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the common prefix with the suffix before it in sa. text: bytes, 0 at its end alone.

    Where the bytes before both suffixes are equal, the value is that of the position before, less
    one; only the others are compared, eight bytes at a time.
    """
    n = len(text)
    before = np.empty(n, np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    at = np.arange(n)
    reducible = (before > 0) & (at > 0)
    reducible[reducible] = text[at[reducible] - 1] == text[before[reducible] - 1]
    (i,) = np.nonzero(~reducible & (before >= 0))
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    word = np.lib.stride_tricks.as_strided(padded, (n, 8), (1, 1))
    length = np.zeros(n, np.int64)
    a, b = i, before[i]
    live = np.arange(len(i))
    own = np.zeros(len(i), np.int64)
    while len(live):
        differ = word[a] != word[b]
        first = np.where(differ.any(1), differ.argmax(1), 8)
        own[live] += first
        go = first == 8
        live, a, b = live[go], a[go] + 8, b[go] + 8
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
    length[i] = own
    anchor = np.maximum.accumulate(np.where(~reducible, at, 0))
    return np.maximum(length[anchor] - (at - anchor), 0)
