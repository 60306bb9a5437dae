"""Suffix arrays by induced sorting, in whole-array steps.

Suffixes are classified as smaller (S) or larger (L) than their successor. The leftmost-smaller ones are ranked by
their substrings, recursively on the string of these ranks as long as some are equal, and all others are induced from
them, at every depth and for every alphabet.

Induction works on runs: an L suffix is r times its letter c and then a suffix that begins with a smaller letter, so
within the bucket of c it is ordered by r and by the place of that suffix, which lies in an earlier bucket. Buckets are
taken in order, as many at once as do not depend on each other. S suffixes go the other way round, from the last
bucket to the first, longer runs first. The first pass starts from ties, and its ranks are those of substrings.
"""

from __future__ import annotations

import numpy as np


def types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the next one; the last, the sentinel, is."""
    n = len(s)
    up = np.append(s[:-1] < s[1:], True)
    same = np.append(s[:-1] == s[1:], False)
    at = np.where(same, n, np.arange(n))
    return up[np.minimum.accumulate(at[::-1])[::-1]]


def run_ends(s: np.ndarray) -> np.ndarray:
    """Of each place: where the run of its letter ends."""
    n = len(s)
    at = np.where(np.append(s[:-1] == s[1:], False), n, np.arange(1, n + 1))
    return np.minimum.accumulate(at[::-1])[::-1]


def _sides(s: np.ndarray, k: int, items: np.ndarray, after: np.ndarray, waits: np.ndarray, down: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(items, their letters) of buckets that can be ranked together, in the order of ranking.

    waits: items whose successor is ranked in the same pass; their bucket comes after the successor's.
    """
    order = np.argsort(s[items], kind="stable")
    items = items[order]
    chars = s[items]
    begin = np.searchsorted(chars, np.arange(k + 1))
    held = waits[items]
    mine, theirs = chars[held].astype(np.int64), s[after[items[held]]].astype(np.int64)
    cuts = []
    if down:
        most = np.full(k, -1)
        np.maximum.at(most, theirs, mine)
        most = np.maximum.accumulate(most).tolist()  # the highest bucket that waits for one of 0 .. c
        c = k - 1
        while c >= 0:
            low = most[c]
            cuts.append((low + 1, c + 1))
            c = low
    else:
        least = np.full(k, k)
        np.minimum.at(least, theirs, mine)
        least = np.minimum.accumulate(least[::-1])[::-1].tolist()
        c = 0
        while c < k:
            high = least[c]
            cuts.append((c, high))
            c = high
    return [(items[begin[a] : begin[b]], chars[begin[a] : begin[b]]) for a, b in cuts if begin[a] < begin[b]]


def _place(rank: np.ndarray, items: np.ndarray, chars: np.ndarray, runs: np.ndarray, follow: np.ndarray, first: np.ndarray) -> None:
    """Ranks the items of some buckets, given by letter, by run and by the rank of what follows; equal keys get one rank."""
    m, low = len(items), int(runs.min())
    width, size = int(follow.max()).bit_length(), (int(runs.max()) - low).bit_length()
    letters = chars[0] != chars[-1]
    if width + size + (int(chars[-1]) - int(chars[0])).bit_length() < 63:
        key = follow.astype(np.int64)
        if size:
            key |= (runs - low).astype(np.int64) << width
        if letters:
            key |= (chars - chars[0]).astype(np.int64) << (width + size)
        order = np.argsort(key)
        key = key[order]
        new = key[1:] != key[:-1]
    else:
        order = np.lexsort((follow, runs, chars))
        new = (chars[order][1:] != chars[order][:-1]) | (runs[order][1:] != runs[order][:-1]) | (follow[order][1:] != follow[order][:-1])
    at = np.arange(m, dtype=rank.dtype)
    head = at.copy() if new.all() else np.maximum.accumulate(np.where(np.append(True, new), at, 0))
    if letters:
        head -= np.maximum.accumulate(np.where(np.append(True, chars[1:] != chars[:-1]), at, 0))
    rank[items[order]] = first[chars] + head


def induce(s: np.ndarray, k: int, smaller: np.ndarray, ends: np.ndarray, lms: np.ndarray, tied: bool) -> np.ndarray:
    """The rank of every suffix from the leftmost-smaller ones in order; if those of a letter are tied, ties come out."""
    n = len(s)
    counts = np.bincount(s, minlength=k)
    start = np.cumsum(counts) - counts
    first_small = start + counts - np.bincount(s[smaller], minlength=k)
    rank = np.zeros(n, np.int64 if n >> 31 else np.int32)
    start, first_small = start.astype(rank.dtype), first_small.astype(rank.dtype)
    # they stand behind the larger suffixes of their bucket, in their order
    by = lms[np.argsort(s[lms], kind="stable")]
    chars = s[by]
    at = np.arange(len(by), dtype=rank.dtype)
    rank[by] = first_small[chars] + (0 if tied else at - np.maximum.accumulate(np.where(np.append(True, chars[1:] != chars[:-1]), at, 0)))
    after = np.minimum(ends, n - 1)  # where the run of each place is over
    inner = np.arange(n - 1)
    waits = ~smaller[after]
    for items, chars in _sides(s, k, inner[~smaller[:-1]], after, waits, False):
        nxt = after[items]
        _place(rank, items, chars, nxt - items, rank[nxt], start)
    np.logical_not(waits, out=waits)
    for items, chars in _sides(s, k, inner[smaller[:-1]], after, waits, True):
        nxt = after[items]
        _place(rank, items, chars, items - nxt, rank[nxt], first_small)
    rank[n - 1] = 0
    return rank


def suffix_array(s: np.ndarray, k: int, depth: list[int] | None = None) -> np.ndarray:
    """s: values below k; the last is 0 and smaller than all others. depth collects the lengths of the strings sorted."""
    n = len(s)
    if depth is not None:
        depth.append(n)
    if n == 1:
        return np.zeros(1, np.int64)
    s = s.astype(np.uint16 if k <= 1 << 16 else np.int64, copy=False)  # short letters are dealt to buckets in linear time
    smaller, ends = types(s), run_ends(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if len(lms) > 1:
        place = induce(s, k, smaller, ends, lms, True)[lms]
        met = np.zeros(n, bool)
        met[place] = True
        names = np.cumsum(met)[place] - 1
        if int(names.max()) + 1 < len(lms):
            lms = lms[suffix_array(names, int(names.max()) + 1, depth)]
        else:
            lms = lms[np.argsort(names)]
    rank = induce(s, k, smaller, ends, lms, False)
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Of each suffix in text order: the common prefix with its predecessor in the array.

    Prefixes are compared only where the letters before differ; their sum is at most 2 n log n. Everywhere else the
    prefix is that of the place before, less one.
    """
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    both = np.arange(n)
    own = (both == 0) | (before <= 0)
    own[1:] |= s[both[1:] - 1] != s[np.maximum(before[1:], 1) - 1]
    padded = np.append(s.astype(np.uint16) if int(s.max()) < 1 << 16 else s, np.zeros(4, np.uint16))
    out = np.zeros(n, np.int64)
    at = np.flatnonzero(own & (before >= 0))
    k = 0
    if padded.dtype == np.uint16:
        words = np.lib.stride_tricks.as_strided(padded.astype("<u2").view(np.uint8), (n + 1, 8), (2, 1))
        eight = np.ascontiguousarray(words).view("<u8").ravel()  # four symbols from each place
        while len(at):
            x = eight[np.minimum(at + k, n)] ^ eight[np.minimum(before[at] + k, n)]
            full = x == 0
            part = x[~full]
            low = (part & np.uint64(0xFFFF) == 0).astype(np.int64)
            low += part & np.uint64(0xFFFFFFFF) == 0
            low += part & np.uint64(0xFFFFFFFFFFFF) == 0
            out[at[~full]] = k + low
            at = at[full]
            k += 4
    else:
        while len(at):
            same = padded[np.minimum(at + k, n)] == padded[np.minimum(before[at] + k, n)]
            out[at[~same]] = k
            at = at[same]
            k += 1
    last = np.maximum.accumulate(np.where(own, both, 0))
    return np.maximum(out[last] - (both - last), 0)
