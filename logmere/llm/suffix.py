"""Suffix arrays by induced sorting, and permuted common prefixes, over numpy arrays.

Scans proceed in blocks: a block ends before the first slot that one of its own entries fills, so all
entries of a block can induce their left neighbours at once, in order.
"""

from __future__ import annotations

import numpy as np


def narrow(s: np.ndarray) -> np.ndarray:
    """The same symbols in the smallest type: narrow ones sort and gather fastest."""
    most = int(s.max(initial=0))
    return s.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int32 if most < 1 << 31 else np.int64, copy=False)


def suffix_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix is larger than the empty one."""
    n = len(s)
    small = np.zeros(n, bool)
    if n > 1:
        less, differ = np.zeros(n, bool), np.ones(n, bool)
        less[:-1], differ[:-1] = s[:-1] < s[1:], s[:-1] != s[1:]
        at = np.where(differ, np.arange(n), n - 1)
        small = less[np.minimum.accumulate(at[::-1])[::-1]]
    return small


def _scan(s: np.ndarray, sa: np.ndarray, small: np.ndarray, heads: np.ndarray, want: bool) -> None:
    """Walk sa once; put each entry's left neighbour, where its type is `want`, at the head of its bucket."""
    n, p, step = len(s), 0, 1024
    while p < n:
        q = min(n, p + step)
        block = sa[p:q]
        at = np.flatnonzero(block > 0)
        left = block[at] - 1
        fits = small[left] == want
        at, left = at[fits], left[fits]
        done = q - p
        if len(at):
            to = s[left]
            reach = np.minimum.accumulate(heads[to] - p)
            late = np.flatnonzero(reach < np.append(at[1:], q - p))
            if len(late):
                done = int(reach[late[0]])
                k = int(np.searchsorted(at, done))
                left, to = left[:k], to[:k]
            order = np.argsort(to, kind="stable")
            to, left = to[order], left[order]
            first = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            size = np.diff(np.append(first, len(to)))
            sa[heads[to] + np.arange(len(to)) - np.repeat(first, size)] = left
            heads[to[first]] += size
        step = min(1 << 18, step * 2) if done == q - p else max(256, 2 * done)
        p += done


def _induce(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """seeds: leftmost-smaller positions ordered by their first symbol at least."""
    n = len(s)
    sa = np.full(n, -1, np.int32 if n < 1 << 31 else np.int64)
    c = s[seeds]
    first = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(c)))
    if len(c):
        sa[np.repeat(ends[c[first]] - size, size) + np.arange(len(c)) - np.repeat(first, size)] = seeds
    heads = starts.copy()
    sa[heads[s[n - 1]]] = n - 1  # the empty suffix induces the last one
    heads[s[n - 1]] += 1
    _scan(s, sa, small, heads, False)
    sa[(sa >= 0) & small[sa]] = -1
    _scan(s, sa[::-1], small, n - ends, True)
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of s (non-negative integers) in order; a prefix comes before what it begins."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = narrow(s)
    small = suffix_types(s)
    counts = np.bincount(s)
    ends = np.cumsum(counts)
    starts = ends - counts
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) > 1:
        sa = _induce(s, small, lms[np.argsort(s[lms], kind="stable")], ends, starts)
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        by_string = sa[is_lms[sa]]
        length = np.zeros(n, np.int64)
        length[lms] = np.append(np.diff(lms) + 1, n - lms[-1] + 1)
        a, b = by_string[:-1], by_string[1:]
        same = (length[a] == length[b]) & (b != lms[-1]) & (a != lms[-1])
        live, off = np.flatnonzero(same), 0
        while len(live):
            ok = s[a[live] + off] == s[b[live] + off]
            same[live[~ok]] = False
            off += 1
            live = live[ok]
            live = live[length[a[live]] > off]
        names = np.append(0, np.cumsum(~same))
        if names[-1] + 1 == len(lms):
            seeds = by_string
        else:
            of = np.zeros(n, np.int64)
            of[by_string] = names
            seeds = lms[suffix_array(of[lms])]
    else:
        seeds = lms
    return _induce(s, small, seeds, ends, starts)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each text position, the length of the common prefix with the suffix just before it in sa."""
    n = len(s)
    if not n:
        return np.zeros(0, np.int64)
    s = narrow(s)
    before = np.empty(n, np.int32 if n < 1 << 31 else np.int64)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    own = np.ones(n, bool)  # else one less than the left neighbour's
    at = np.flatnonzero(before > 0)
    at = at[at > 0]
    own[at] = s[at - 1] != s[before[at] - 1]
    prefix = np.zeros(n, np.int64)
    live, off = np.flatnonzero(own & (before >= 0)), 0
    while len(live):
        live = live[np.maximum(live, before[live]) + off < n]
        live = live[s[live + off] == s[before[live] + off]]
        off += 1
        prefix[live] = off
    last = np.maximum.accumulate(np.where(own, np.arange(n), 0))
    return prefix[last] - (np.arange(n) - last)
