"""Suffix arrays by induced sorting, and permuted common prefixes, in numpy.

Suffixes are S (smaller than the next) or L. The leftmost S of each run starts a substring; these are sorted and named a few characters at
a time, and the string of names is sorted in turn by the same function, until no name repeats; then one induction from left to right and one from
right to left give the array. Induction moves whole buckets (first character) where the alphabet is small, as with bytes; with as many
names as the levels below have, it goes suffix by suffix. Both put the same suffixes into the same places.
"""

from __future__ import annotations

import numpy as np

#: A step over a bucket costs about as much as steps over this many suffixes.
BUCKET_COST = 60


def induced_suffix_array(t: np.ndarray, deep: int | None = None) -> np.ndarray:
    """Positions of the suffixes of t in order. t ends with a 0 that is smaller than all else; `deep` may end the order at a
    depth of so many characters, below which ties are left open."""
    n, k = len(t), int(t.max()) + 1
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.append(np.sign(t[:-1].astype(np.int64) - t[1:]), -1)
    at = np.where(step != 0, np.arange(n), n)
    is_s = step[np.minimum.accumulate(at[::-1])[::-1]] < 0
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    ends = np.cumsum(np.bincount(t, minlength=k))
    names = _names(t, is_s, lms)
    if names.max() + 1 == len(names):
        order = np.argsort(names)
    elif deep is not None and deep <= 0:
        order = np.argsort(names, kind="stable")  # the order is asked for to a depth that the names already reach
    else:
        least = int(np.diff(lms).min()) if len(lms) > 1 else 1  # each name stands for this many characters or more
        order = induced_suffix_array(np.append(names + 1, 0), None if deep is None else -(-deep // max(1, least)) - 1)[1:]
    return _induce(t, is_s, ends, lms[order])


def _names(t: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Rank of each substring from one leftmost S to the next; equal substrings have equal ranks.

    Characters compare together with their type. Substrings that agree so far then also end together, so none is a beginning of another.
    """
    sym = (2 * t.astype(np.int64) + is_s) + 1
    length = np.diff(np.append(lms, len(t) - 1)) + 1
    bits = int(sym.max()).bit_length()
    per = max(1, (62 - len(lms).bit_length()) // bits)  # characters in one key
    rank, live, done = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0  # a rank is the place of a group's first
    while len(live):
        key = rank[live]
        for j in range(done, done + per):
            key = key << bits | np.where(j < length[live], sym[np.minimum(lms[live] + j, len(t) - 1)], 0)
        order = np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        at = np.flatnonzero(new)
        group = key[at] >> bits * per
        head = at[np.concatenate(([True], group[1:] != group[:-1]))]
        first = head[np.searchsorted(head, at, "right") - 1]
        size = np.diff(np.append(at, len(live)))
        rank[live] = np.repeat(group + at - first, size)
        done += per
        live = live[np.repeat(size > 1, size) & (done < length[live])]
    return np.unique(rank, return_inverse=True)[1]


def _induce(t: np.ndarray, is_s: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Suffix array from suffixes `lms` in order."""
    starts = np.concatenate(([0], ends[:-1]))
    if len(ends) * BUCKET_COST > len(t):
        return _induce_singly(t, is_s, starts, ends, lms)
    sa = np.full(len(t), -1, np.int64)
    used = np.flatnonzero(ends > starts)
    by_char = np.argsort(t[lms], kind="stable")
    seeds = lms[by_char]
    cuts = np.searchsorted(t[seeds], np.arange(len(ends) + 1))
    head = starts.copy()
    for c in used:
        fresh = sa[starts[c]:head[c]]
        while len(fresh):
            p = fresh[fresh > 0] - 1
            fresh = p[(t[p] == c) & ~is_s[p]]
            sa[head[c]:head[c] + len(fresh)] = fresh
            head[c] += len(fresh)
        p = np.concatenate((sa[starts[c]:head[c]], seeds[cuts[c]:cuts[c + 1]]))
        p = p[p > 0] - 1
        p = p[t[p] > c]
        if len(p):
            d = t[p]
            order = np.argsort(d, kind="stable")
            p, d = p[order], d[order]
            n = np.bincount(d, minlength=len(ends))
            sa[head[d] + np.arange(len(d)) - (np.cumsum(n) - n)[d]] = p
            head += n
    tail = ends.copy()
    for c in used[::-1]:
        fresh = sa[tail[c]:ends[c]][::-1]
        while len(fresh):
            p = fresh[fresh > 0] - 1
            fresh = p[(t[p] == c) & is_s[p]]
            sa[tail[c] - len(fresh):tail[c]] = fresh[::-1]
            tail[c] -= len(fresh)
        p = np.concatenate((sa[tail[c]:ends[c]][::-1], sa[starts[c]:head[c]][::-1]))
        p = p[p > 0] - 1
        p = p[t[p] < c]
        if len(p):
            d = t[p]
            order = np.argsort(d, kind="stable")
            p, d = p[order], d[order]
            n = np.bincount(d, minlength=len(ends))
            sa[tail[d] - 1 - np.arange(len(d)) + (np.cumsum(n) - n)[d]] = p
            tail -= n
    sa[0] = len(t) - 1  # the closing 0 is smallest and has nothing to induce it
    return sa


def _induce_singly(t: np.ndarray, is_s: np.ndarray, starts: np.ndarray, ends: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same, one suffix after another."""
    n, head, tail = len(t), starts.tolist(), ends.tolist()
    l_to = np.full(n + 1, -1, np.int64)  # the bucket of the suffix before, if it is L; none before the first
    l_to[1:n] = np.where(is_s[:-1], -1, t[:-1])
    s_to = np.full(n + 1, -1, np.int64)
    s_to[1:n] = np.where(is_s[:-1], t[:-1], -1)
    sa = np.full(n, n, np.int64)  # n marks an empty place
    by_char = np.argsort(t[lms], kind="stable")
    seeds = lms[by_char]
    c = t[seeds]
    size = np.bincount(c, minlength=len(ends))
    sa[ends[c] - size[c] + np.arange(len(c)) - (np.cumsum(size) - size)[c]] = seeds
    order, to = sa.tolist(), l_to.tolist()
    for p in order:  # which grows ahead of the loop
        c = to[p]
        if c >= 0:
            h = head[c]
            order[h] = p - 1
            head[c] = h + 1
    to = s_to.tolist()
    for p in reversed(order):
        c = to[p]
        if c >= 0:
            h = tail[c] - 1
            order[h] = p - 1
            tail[c] = h
    order[0] = n - 1
    return np.array(order, np.int64)


def common_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """By position: how many characters a suffix shares with the one before it in the array, up to `most`."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    wide = np.concatenate((t.astype(np.uint64), np.zeros(most + 8, np.uint64)))
    word = wide.copy()
    for shift, bits in ((1, 8), (2, 16), (4, 32)):
        word[:-shift] |= word[shift:] << np.uint64(bits)
    out = np.zeros(n, np.int64)
    live, done = np.flatnonzero(before >= 0), 0
    while len(live) and done < most:
        differ = word[live + done] ^ word[before[live] + done]
        ended = differ != 0
        low = differ[ended]
        out[live[ended]] = done + sum((low & np.uint64((1 << 8 * b) - 1)) == 0 for b in range(1, 8))
        live, done = live[~ended], done + 8
    out[live] = most
    return np.minimum(out, most)
