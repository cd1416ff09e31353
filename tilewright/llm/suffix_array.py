"""Suffix arrays of byte shards by induced sorting, in numpy, and permuted common prefixes.

The linear scans of induced sorting go bucket by bucket: all entries that a bucket holds at one time induce their predecessors at
once, in order, and what falls into the same bucket is taken in a next turn, as a scan from left to right would. Strings of names, whose
alphabets are large, are scanned entry by entry.
"""

from __future__ import annotations

import numpy as np

SEPARATOR = 0xFF  # occurs in no UTF-8 text
#: Alphabets beyond this are scanned entry by entry, as a turn per bucket would serve few.
MOST_TURNS = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its successor; the last symbol is a unique smallest one."""
    n = len(s)
    rising = np.append(s[:-1] < s[1:], True)
    change = np.append(s[:-1] != s[1:], True)
    at = np.where(change, np.arange(n, dtype=np.int32), n - 1)
    return rising[np.minimum.accumulate(at[::-1])[::-1]]


def _ranks(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stable grouping: order, rank within its group in that order, distinct targets and their counts."""
    order = np.argsort(targets, kind="stable")
    t = targets[order]
    first = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    count = np.diff(np.append(first, len(t)))
    return order, np.arange(len(t)) - np.repeat(first, count), t[first], count


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix array that follows from the order of the leftmost-smaller suffixes `lms`: larger ones left to right, then smaller ones."""
    n, ends = len(s), np.cumsum(size)
    starts = ends - size
    sa = np.full(n, -1, np.int32)
    order, rank, seen, count = _ranks(s[lms])
    sa[np.repeat(ends[seen] - count, count) + rank] = lms[order]
    seeds = np.zeros(len(size), np.int64)
    seeds[seen] = count
    head, tail = starts.copy(), ends.copy()
    used = np.flatnonzero(size).tolist()

    def place(at: np.ndarray, forward: bool) -> None:
        before = at[at > 0] - 1
        before = before[small[before] != forward]
        if len(before) == 0:
            return
        order, rank, seen, count = _ranks(s[before])
        if forward:
            sa[np.repeat(head[seen], count) + rank] = before[order]
            head[seen] += count
        else:
            sa[np.repeat(tail[seen], count) - 1 - rank] = before[order]
            tail[seen] -= count

    for c in used:
        at = starts[c]
        while at < head[c]:
            at, part = head[c], sa[at : head[c]]
            place(part, True)
        if seeds[c]:
            place(sa[ends[c] - seeds[c] : ends[c]], True)
    for c in reversed(used):
        at = ends[c]
        while at > tail[c]:
            at, part = tail[c], sa[tail[c] : at][::-1]
            place(part, False)
        if head[c] > starts[c]:
            place(sa[starts[c] : head[c]][::-1], False)
    sa[0] = n - 1  # the sentinel
    return sa


def _induce_names(s: np.ndarray, small: np.ndarray, lms: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same for alphabets of which most buckets hold few suffixes: a scan entry by entry."""
    n, ends = len(s), np.cumsum(size)
    text, head, tail = s.tolist(), (ends - size).tolist(), ends.tolist()
    # The bucket of each larger (smaller) suffix, -1 for the others and for the sentinel, which place -1 means: 0 stands where nothing is known.
    larger, smaller = np.where(small, -1, s), np.where(small, s, -1)
    smaller[-1] = -1
    larger, smaller = larger.tolist(), smaller.tolist()
    sa = [0] * n
    for p in lms[::-1].tolist():
        c = text[p]
        tail[c] = at = tail[c] - 1
        sa[at] = p
    for p in sa:  # sees what it puts further on
        c = larger[p - 1]
        if c >= 0:
            at = head[c]
            head[c] = at + 1
            sa[at] = p - 1
    tail = ends.tolist()
    for p in reversed(sa):
        c = smaller[p - 1]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            sa[at] = p - 1
    sa[0] = n - 1  # the sentinel
    return np.array(sa, np.int32)


def induced_order(s: np.ndarray, buckets: int) -> np.ndarray:
    """Suffix array of `s`, whose last symbol is a unique smallest one.

    Leftmost-smaller substrings are sorted by one induction and named; if names repeat, the string of the names is sorted in the same way.
    """
    small = _types(s)
    size = np.bincount(s, minlength=buckets)
    lms = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    induce = _induce if buckets <= MOST_TURNS else _induce_names
    if len(lms) > 1:
        sa = induce(s, small, lms, size)
        is_lms = np.zeros(len(s), bool)
        is_lms[lms] = True
        ordered = sa[is_lms[sa]]
        # Names: equal for equal substrings from one leftmost-smaller place to the next.
        number = np.zeros(len(s), np.int32)
        number[lms] = np.arange(len(lms))
        length = np.diff(np.append(lms, len(s) - 1)) + 1
        length[-1] = 1
        a, b = ordered[:-1], ordered[1:]
        la, lb = length[number[a]], length[number[b]]
        same = la == lb
        at = np.flatnonzero(same)
        step = 0
        while len(at):
            at = at[step < la[at]]
            keep = s[a[at] + step] == s[b[at] + step]
            same[at[~keep]] = False
            at = at[keep]
            step += 1
        names = np.zeros(len(lms), np.int64)
        names[number[ordered]] = np.concatenate(([0], np.cumsum(~same)))
        top = int(names.max()) + 1
        lms = ordered if top == len(lms) else lms[induced_order(names, top)]
    return induce(s, small, lms, size)


def permuted_prefixes(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place, the length of the prefix it shares with its predecessor in `sa`, in the order of the places.

    A place whose left neighbours agree has one less than the place before it; only the others are compared, eight bytes at a time.
    Lengths are exact up to `most`.
    """
    n = len(data)
    before = np.empty(n, np.int32)
    before[sa[1:]] = sa[:-1]
    before[sa[0]] = -1
    left = np.concatenate(([0], data)).astype(np.int16)
    fresh = (before < 0) | (left[:-1][np.arange(n)] != left[before]) | (np.arange(n) == 0) | (before == 0)
    at = np.flatnonzero(fresh & (before >= 0))
    words = np.zeros(n + most + 16, np.uint64)
    wide = np.concatenate((data, np.zeros(most + 24, np.uint8))).astype(np.uint64)
    for k in range(8):
        words |= wide[k : k + len(words)] << np.uint64(56 - 8 * k)
    shared = np.zeros(n, np.int32)
    other, step = before[at], 0
    while len(at) and step < most:
        x = words[at + step] ^ words[other + step]
        equal = x == 0
        done = ~equal
        if done.any():
            v = x[done]
            zeros = np.zeros(len(v), np.int32)
            for shift in (8, 16, 24, 32, 40, 48, 56):
                zeros += v < np.uint64(1) << np.uint64(64 - shift)
            shared[at[done]] = step + zeros
        at, other = at[equal], other[equal]
        step += 8
    shared[at] = most
    source = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    out = shared[source] - (np.arange(n) - source)
    return np.maximum(out, 0).astype(np.int32)


def repeated_starts(pieces: list[bytes], own: list[int], length: int) -> list[list[tuple[int, int]]]:
    """For each piece, runs (from, to) among its first `own` places whose strings of `length` bytes also start at another own place."""
    size = np.array([len(p) + 1 for p in pieces])
    begin = np.cumsum(size) - size
    data = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]), np.uint8)
    symbols = np.append(data.astype(np.int16) + 1, 0)
    sa = induced_order(symbols, 257)[1:]
    shared = permuted_prefixes(data, sa, 2 * max(length, int(size.max())))
    owned = np.zeros(len(data) + 1, np.int8)
    np.add.at(owned, begin, 1)
    np.add.at(owned, begin + np.array(own), -1)
    owned = np.cumsum(owned[:-1]) > 0
    ranks = np.flatnonzero(owned[sa])
    repeated = np.zeros(len(data) + 1, bool)
    if len(ranks) > 1:
        along = np.append(shared[sa][1:], 0)
        least = np.minimum.reduceat(along, ranks)[:-1] >= length
        places = sa[ranks]
        repeated[places[1:][least]] = True
        repeated[places[:-1][least]] = True
    edge = np.diff(repeated.astype(np.int8), prepend=np.int8(0))
    # A run may go on from one piece into the next: cut it at each piece's begin.
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out: list[list[tuple[int, int]]] = [[] for _ in pieces]
    for a, b in zip(first.tolist(), last.tolist(), strict=True):
        k = int(np.searchsorted(begin, a, side="right")) - 1
        out[k].append((a - int(begin[k]), b - int(begin[k])))
    return out
