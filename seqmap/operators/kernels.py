"""Greedy searches over one read's keys; each is order-dependent and so runs read by read.

A read has, for each strand, keys in order of their place with their sorted posting lists. A search narrows candidate
positions by intersecting posting lists within a band, and gives the candidates of both strands.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

MOST = 256


@dataclass
class Key:
    rpos: int
    positions: list[int]
    #: The size of a key that is too frequent for its positions to be at hand.
    over: int = 0

    @property
    def size(self) -> int:
        return self.over or len(self.positions)


Spot = tuple[int, int]  # genome position, read position


@dataclass
class Read:
    length: int
    k: int
    strands: tuple[list[Key], list[Key]] = field(default_factory=lambda: ([], []))


@dataclass
class Found:
    strand: int
    gpos: int
    rpos: int
    votes: int = 0


def meet(a: Key, b: Key, width: int, left: bool = False, most: int = MOST) -> list[Spot]:
    """Merges two posting lists one to one: a pair within the width gives the lower position (or always a's, if left).

    More than `most` pairs give none.
    """
    out: list[Spot] = []
    i = j = 0
    x, y = a.positions, b.positions
    while i < len(x) and j < len(y):
        low = x[i] <= y[j]
        if abs(x[i] - y[j]) <= width:
            out.append((x[i], a.rpos) if low or left else (y[j], b.rpos))
            i, j = i + 1, j + 1
        elif low:
            i += 1
        else:
            j += 1
    return [] if len(out) > most else out


def refine(spots: list[Spot], key: Key, width: int) -> list[Spot]:
    """Candidates near a posting of another key; of both positions the lower stays."""
    out: list[Spot] = []
    i = j = 0
    x = key.positions
    while i < len(x) and j < len(spots):
        g, r = spots[j]
        near = abs(x[i] - g) <= width
        if near:
            out.append((x[i], key.rpos) if x[i] <= g else (g, r))
            i, j = i + 1, j + 1
        elif x[i] <= g:
            i += 1
        else:
            j += 1
    return out


def narrowed(spots: list[Spot], key: Key, width: int) -> tuple[list[Spot], bool]:
    """Refined, or as before if nothing would be left; and whether that was so."""
    got = refine(spots, key, width)
    return (got, False) if got else (spots, True)


def _gap(a: Key, b: Key) -> int:
    return b.rpos - a.rpos


def _both(read: Read, one: Callable[[list[Key]], list[Spot]]) -> list[Found]:
    return [Found(s, g, r) for s in (0, 1) for g, r in one(read.strands[s])]


def _from_ends(read: Read, limit: int, inward: bool) -> list[Found]:
    def one(keys: list[Key]) -> list[Spot]:
        half = len(keys) // 2
        rights = range(len(keys) - 1, half - 1, -1)
        spots: list[Spot] = []
        for i in range(half):
            if keys[i].size >= limit:
                continue
            spots, fails = [], 0
            for j in rights if inward else range(half + i, len(keys)):
                if keys[j].size >= limit:
                    continue
                width = _gap(keys[i], keys[j]) + 3
                if not spots:
                    spots = meet(keys[i], keys[j], width)
                    bad = not 0 < len(spots) <= 10
                    if bad:
                        spots = []
                else:
                    spots, bad = narrowed(spots, keys[j], width)
                fails += bad
                if bad and fails > 3 or 0 < len(spots) < 3:
                    break
            if 0 < len(spots) < 3:
                return spots
        return spots

    return _both(read, one)


def extremes(read: Read, limit: int) -> list[Found]:
    """Keys of the first half with those of the second from the right end inward, until one or two candidates stay."""
    return _from_ends(read, limit, True)


def half_apart(read: Read, limit: int) -> list[Found]:
    """Keys of the first half with those half a read on."""
    return _from_ends(read, limit, False)


def two_smallest(read: Read, limit: int) -> list[Found]:
    """The two smallest keys at least half a key apart, then the next smallest, until one candidate stays."""

    def one(keys: list[Key]) -> list[Spot]:
        active = {i for i, key in enumerate(keys) if 0 < key.size < limit}
        idle = len(keys) - len(active)
        spots: list[Spot] = []
        while len(active) + idle > 1 and active:
            order = sorted(active, key=lambda i: (keys[i].size, i))
            if spots:
                i = order[0]
                spots, _ = narrowed(spots, keys[i], read.length)
                active.discard(i)
            else:
                pair = next(((order[0], j) for j in order[1:] if abs(keys[j].rpos - keys[order[0]].rpos) >= read.k // 2), None)
                if pair is None:
                    break
                a, b = sorted(pair)
                spots = meet(keys[a], keys[b], _gap(keys[a], keys[b]) + 3)
                active.discard(a if keys[a].size < keys[b].size else b)
            if len(spots) == 1:
                break
        return spots

    return _both(read, one)


def leftmost(read: Read, limit: int) -> list[Found]:
    """The first pair from the left, ten letters apart, that meets; then further keys while more than five stay."""

    def one(keys: list[Key]) -> list[Spot]:
        for a in range(len(keys) - 1):
            if keys[a].size > limit:
                continue
            b = next((j for j in range(a + 1, len(keys)) if _gap(keys[a], keys[j]) >= 10 and keys[j].size <= limit), None)
            if b is None:
                return []
            spots = meet(keys[a], keys[b], _gap(keys[a], keys[b]) + 3)
            if spots:
                for c in range(b + 1, len(keys)):
                    if len(spots) <= 5:
                        break
                    if keys[c].size <= limit:
                        spots, _ = narrowed(spots, keys[c], _gap(keys[a], keys[c]) + 2)
                return spots
        return []

    return _both(read, one)


def nested(read: Read, limit: int) -> list[Found]:
    """From each key the next but one, then all that follow; the begin that leaves the fewest wins, both strands if even."""
    best: list[list[Spot]] = []
    for keys in read.strands:
        mine: list[Spot] = []
        for i in range(len(keys) - 1):
            if keys[i].size >= limit:
                continue
            j = min(i + 2, len(keys) - 1)
            spots, fails = meet(keys[i], keys[j], _gap(keys[i], keys[j]) + 3), 0
            for n in range(j + 1, len(keys)):
                if len(spots) <= 1 or fails >= 2:
                    break
                if keys[n].size < limit:
                    spots, bad = narrowed(spots, keys[n], _gap(keys[i], keys[n]) + 3)
                    fails += bad
            if spots and (not mine or len(spots) < len(mine)):
                mine = spots
            if len(spots) == 1:
                break
        best.append(mine)
    least = min((len(b) for b in best if b), default=0)
    return [Found(s, g, r) for s in (0, 1) if best[s] and len(best[s]) == least for g, r in best[s]]


def min_apart(read: Read, limit: int = 200) -> list[Found]:
    """The smallest key of each half, then the next smallest of each, until one to four stay."""

    def strand(s: int) -> list[Spot]:
        keys = read.strands[s]
        half = len(keys) // 2
        halves = [[i for i in part if 0 < keys[i].size < limit] for part in (range(half), range(half, len(keys)))]
        width = 1000 if s == 0 else read.length
        spots: list[Spot] = []
        while any(halves):
            picks = [min(h, key=lambda i: (keys[i].size, i)) if h else None for h in halves]
            if not spots:
                if None in picks:
                    break
                a, b = picks
                spots = meet(keys[a], keys[b], _gap(keys[a], keys[b]) + 3)
                gone = picks if spots else [a if keys[a].size < keys[b].size else b]
            else:
                gone = [i for i in picks if i is not None]
                for i in gone:
                    spots, _ = narrowed(spots, keys[i], width)
            halves = [[i for i in h if i not in gone] for h in halves]
            if 0 < len(spots) < 5:
                break
        return spots

    return [Found(s, g, r) for s in (0, 1) for g, r in strand(s)]


def moving_window(read: Read, limit: int, steps: int, dynamic: bool = False) -> list[Found]:
    """From start keys through all later ones; the longest stretch of the read that stays together gives one position."""
    best = None
    for s in (0, 1):
        keys, i = read.strands[s], 0
        while i < len(keys) - 1:
            jump = 0
            if keys[i].size < limit:
                spots: list[Spot] = []
                for j in range(i + 1, len(keys)):
                    if keys[j].size >= limit:
                        continue
                    width = _gap(keys[i], keys[j]) + 5
                    if spots:
                        spots, bad = narrowed(spots, keys[j], width)
                    else:
                        spots = meet(keys[i], keys[j], width)
                        bad = not spots
                    if bad:
                        jump = jump or j
                    reach = _gap(keys[i], keys[j])
                    if spots and (best is None or reach > best[0]):
                        best = (reach, Found(s, spots[0][0] - keys[i].rpos, 0, len(spots)))
            i = jump if dynamic and jump else i + steps
    return [best[1]] if best and best[1].gpos >= 0 else []


def diagonal_clusters(read: Read, limit: int | None, near: int = 10, enough: float = 0.74) -> list[Found]:
    """Votes for diagonals, a diagonal joining a cluster whose first one is less than `near` away; keys by size."""
    keys = sorted(((key.size, s, key.rpos, key) for s in (0, 1) for key in read.strands[s] if key.size and (limit is None or key.size < limit)), key=lambda x: x[:3])
    centres: dict[tuple[int, int], list[tuple[int, Found]]] = {}
    votes: dict[tuple[int, int], Found] = {}
    used = 0
    top: list[Found] = []
    for _, s, rpos, key in keys:
        used += 1
        touched = set()
        for g in key.positions:
            d = g - rpos
            if d < 0:
                continue
            block = d // near
            home = next((c for b in (block - 1, block, block + 1) for c in centres.get((s, b), ()) if abs(c[0] - d) < near), None)
            if home is None:
                home = (d, Found(s, g, rpos))
                centres.setdefault((s, block), []).append(home)
                votes[s, d] = home[1]
            if (s, home[0]) not in touched:
                touched.add((s, home[0]))
                home[1].votes += 1
        most = max((f.votes for f in votes.values()), default=0)
        top = [f for f in votes.values() if f.votes == most]
        if used > 3 and len(top) == 1 and most / used >= enough:
            break
    ties = len(top) - 1
    if not top or ties > 128 or (top[0].votes < 4 and ties > 16):
        return []
    return top


def tree_votes(read: Read, limit: int = 100, near: int = 10) -> list[Found]:
    """Votes of all smaller lists for the positions of the largest list below the limit, within `near` letters."""

    def one(keys: list[Key]) -> list[Found]:
        some = [key for key in keys if 0 < key.size < limit]
        if not some:
            return []
        base = max(some, key=lambda key: key.size)
        nodes = [[g - base.rpos, Found(0, g, base.rpos, 1)] for g in base.positions]
        for key in some:
            if key is base:
                continue
            for g in key.positions:
                node = min(nodes, key=lambda n: abs(n[0] - (g - key.rpos)))
                if abs(node[0] - (g - key.rpos)) <= near:
                    node[1].votes += 1
            if max(n[1].votes for n in nodes) > 2:
                break
        order = sorted((n[1] for n in nodes), key=lambda f: (-f.votes, f.gpos))
        out = order[:1]
        if len(order) > 1 and order[1].votes * 2 > order[0].votes and order[1].votes > 4:
            out.append(order[1])
        return out

    return [Found(s, f.gpos, f.rpos, f.votes) for s in (0, 1) for f in one(read.strands[s]) if f.gpos >= f.rpos]


def sweep(read: Read, limit: int, lists: int = 100) -> list[Found]:
    """Moves over the genome positions of up to `lists` posting lists; where most lists have one within two reads' length."""
    out: list[Found] = []
    for s in (0, 1):
        some = [key for key in read.strands[s] if 0 < key.size <= limit][:lists]
        events = sorted((g, n) for n, key in enumerate(some) for g in key.positions)
        best = 1
        mine: list[Found] = []
        hi, count, inside = 0, {}, 0
        for lo, (g, n) in enumerate(events):
            while hi < len(events) and events[hi][0] <= g + 2 * read.length:
                m = events[hi][1]
                inside += not count.get(m)
                count[m] = count.get(m, 0) + 1
                hi += 1
            if inside > best:
                best, mine = inside, []
            if inside == best and best > 1:
                mine.append(Found(s, g, some[n].rpos, inside * 100 // max(1, len(some))))
            count[n] -= 1
            inside -= not count[n]
        out += [(best, f) for f in mine]
    top = max((b for b, _ in out), default=0)
    return [f for b, f in out if b == top and f.gpos >= f.rpos]


def mates_meet(one: Read, two: Read, limit: int | None, insert: int = 1500) -> list[tuple[Found, Found]]:
    """Positions of a mate's keys within the insert size of the other mate's on the opposite strand; the fewest pairs win."""
    best: list[tuple[Found, Found]] = []
    for s in (0, 1):
        for a in one.strands[s]:
            for b in two.strands[1 - s]:
                if not a.size or not b.size or limit is not None and (a.size >= limit or b.size >= limit):
                    continue
                spots = meet(a, b, insert, left=True)
                if spots and (not best or len(spots) < len(best)):
                    best = [(Found(s, g, a.rpos), Found(1 - s, min(b.positions, key=lambda p: (abs(p - g), p)), b.rpos)) for g, _ in spots]
    return best
