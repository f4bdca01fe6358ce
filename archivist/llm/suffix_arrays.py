"""Suffix arrays by induced sorting, in numpy, with permuted common prefixes.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S
suffixes of each run (LMS) are sorted by their substrings, named, and sorted as a shorter string by
recursion; from them L suffixes are induced left to right and S suffixes right to left. Within one
first character everything that is known so far is induced in one step, so the work is linear and runs
in numpy. Common prefixes are found in text order for each suffix and the one before it in the array."""

from __future__ import annotations

import numpy as np

#: A step for each symbol is no longer worth it beyond so many; the shorter string is then sorted by doubling.
MANY = 2000


def _starts(t: np.ndarray, top: int) -> np.ndarray:
    """Where each symbol's suffixes begin in the array, and its end."""
    return np.concatenate([[0], np.cumsum(np.bincount(t, minlength=top + 1))])


def _induce(t: np.ndarray, is_l: np.ndarray, starts: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The array of all suffixes that the seeds (LMS suffixes, sorted by first character) induce."""
    n, top = len(t), len(starts) - 2
    sa = np.full(n, -1, np.int64)
    head, tail = starts[:-1].copy(), starts[1:].copy()
    seed_start = np.searchsorted(t[seeds], np.arange(top + 2, dtype=np.int64))
    used = np.flatnonzero(starts[1:] > starts[:-1]).tolist()

    def put(j: np.ndarray, forward: bool) -> None:
        """Append suffixes to the heads (or tails, in falling order) of their buckets."""
        c = t[j]
        order = np.argsort(c, kind="stable")
        c, j = c[order], j[order]
        sizes = np.bincount(c, minlength=top + 1)
        before = np.cumsum(sizes) - sizes
        if forward:
            sa[(head - before)[c] + np.arange(len(c))] = j
            np.add(head, sizes, out=head)
        else:
            sa[(tail + before - 1)[c] - np.arange(len(c))] = j
            np.subtract(tail, sizes, out=tail)

    if is_l[n - 1]:  # the last suffix follows the end of the text
        put(np.array([n - 1]), True)
    for c in used:
        done = starts[c]
        while done < head[c]:  # L suffixes of this character, and what they add to the same bucket
            at, done = sa[done : head[c]], head[c]
            j = at[at > 0] - 1
            j = j[is_l[j]]
            if len(j):
                put(j, True)
        at = seeds[seed_start[c] : seed_start[c + 1]]
        j = at[at > 0] - 1
        j = j[is_l[j]]
        if len(j):
            put(j, True)
    for c in reversed(used):
        done = starts[c + 1]
        while done > tail[c]:  # S suffixes of this character
            at, done = sa[tail[c] : done][::-1], tail[c]
            j = at[at > 0] - 1
            j = j[~is_l[j]]
            if len(j):
                put(j, False)
        at = sa[starts[c] : head[c]][::-1]
        j = at[at > 0] - 1
        j = j[~is_l[j]]
        if len(j):
            put(j, False)
    return sa


def _doubled(t: np.ndarray) -> np.ndarray:
    """The same for a string of many symbols, most of them rare: ranks by ever longer prefixes, of suffixes still tied only."""
    n = len(t)
    rank = _starts(t, int(t.max()))[t]
    order = np.argsort(rank)
    r = rank[order]
    tied = np.zeros(n, bool)
    tied[1:] = r[1:] == r[:-1]
    tied[:-1] |= tied[1:]
    on, k = order[tied], 1
    while len(on):
        after = np.where(on + k < n, rank[np.minimum(on + k, n - 1)], -1)
        o = np.argsort(rank[on] * (n + 1) + after)
        on, after = on[o], after[o]
        r = rank[on]
        group = np.r_[True, r[1:] != r[:-1]]
        part = group | np.r_[True, after[1:] != after[:-1]]
        at = np.arange(len(on))
        group_start = np.maximum.accumulate(np.where(group, at, 0))
        part_start = np.maximum.accumulate(np.where(part, at, 0))
        rank[on] = r + part_start - group_start
        alone = part & np.r_[part[1:], True]
        on = on[~alone]
        k *= 2
    sa = np.empty(n, np.int64)
    sa[rank] = np.arange(n)
    return sa


def suffix_array(t: np.ndarray, top: int = 255) -> np.ndarray:
    """The starts of all suffixes of t (integers from 0 to top) in order."""
    n = len(t)
    if n <= 1:
        return np.arange(n)
    t = t.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.int64)
    # a suffix is L if the next different character is smaller, or the text ends before one comes
    change = np.flatnonzero(t[1:] != t[:-1])
    is_l = np.repeat(np.append(t[change] > t[change + 1], True), np.diff(np.concatenate([[-1], change, [n - 1]])))
    lms = np.flatnonzero(~is_l[1:] & is_l[:-1]) + 1
    starts = _starts(t, top)
    if not len(lms):
        return _induce(t, is_l, starts, lms)
    sa = _induce(t, is_l, starts, lms[np.argsort(t[lms], kind="stable")])
    mark = np.zeros(n, bool)
    mark[lms] = True
    # LMS suffixes whose substrings are sorted: the S suffixes at LMS places, as induced
    ranked = sa[(sa >= 0)]
    ranked = ranked[mark[ranked]]
    index = np.empty(n, np.int64)
    index[lms] = np.arange(len(lms))
    sizes = np.diff(np.r_[lms, n - 1]) + 1
    k = index[ranked]
    same = np.zeros(len(ranked), bool)
    same[1:] = sizes[k[1:]] == sizes[k[:-1]]
    same[1:] &= (k[1:] != len(lms) - 1) & (k[:-1] != len(lms) - 1)  # the last one ends with the text
    on, d = np.flatnonzero(same), 0
    while len(on):
        differ = (t[ranked[on] + d] != t[ranked[on - 1] + d]) | (is_l[ranked[on] + d] != is_l[ranked[on - 1] + d])
        same[on[differ]] = False
        d += 1
        on = on[~differ]
        on = on[sizes[index[ranked[on]]] > d]
    names = np.cumsum(~same) - 1
    if names[-1] + 1 < len(lms):
        short = np.empty(len(lms), np.int64)
        short[k] = names
        ranked = lms[suffix_array(short, int(names[-1])) if names[-1] < MANY else _doubled(short)]
    return _induce(t, is_l, starts, ranked)


def permuted_common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """In text order: (common prefix, up to `most`, of each suffix of the bytes t and the one before it in the array; that one's start or -1).
    An array of some of the suffixes will do; the others have a prefix of 0 and no start. Eight bytes are compared at a time."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    padded = np.zeros(n + most + 8, np.uint8)
    padded[:n] = t
    words = np.ndarray(n + most + 1, "<u8", padded, strides=(1,))
    lcp = np.zeros(n, np.int64)
    on = np.flatnonzero(before >= 0)
    for d in range(0, most, 8):
        differ = words[on + d] ^ words[before[on] + d]
        low = differ & (~differ + np.uint64(1))  # the lowest bit that differs
        lcp[on] = d + np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        on = on[differ == 0]
    np.minimum(lcp, most, out=lcp)
    return np.where(before >= 0, np.minimum(lcp, n - np.maximum(np.arange(n), before)), 0), before
