"""Key encodings: what a window of k letters is hashed to.

Each encoding has a bulk form (all windows of a sequence at once, in numpy) and, where SQL can say it, an expression
over one window as its twin. A window with a letter that an encoding cannot use has no key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BITS = 31
_AT = np.full(256, 2, np.uint8)
_PLAIN = np.full(256, 4, np.uint8)
for _c, _at, _two in (("A", 1, 0), ("C", 0, 1), ("G", 0, 2), ("T", 1, 3), ("U", 1, 3)):
    for _x in (_c, _c.lower()):
        _AT[ord(_x)], _PLAIN[ord(_x)] = _at, _two


@dataclass(frozen=True)
class Encoding:
    name: str
    bits: Callable[[int], int]
    bulk: Callable[[np.ndarray, int], np.ndarray]  # letters, k -> a key for each start, -1 for none
    column: Callable[[Column, int], Column] | None = None
    keys: Callable[[int], int] | None = None
    local: bool = True  # whether a window's key depends on its own letters alone

    def total_keys(self, k: int) -> int:
        return self.keys(k) if self.keys else 1 << self.bits(k)


def _gather(codes: np.ndarray, bad: int, k: int, places: list[int], width: int) -> np.ndarray:
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    key, ok = np.zeros(n, np.int64), np.ones(n, bool)
    for i in places:
        x = codes[i : i + n]
        key = key << width | x
        ok &= x != bad
    return np.where(ok, key, -1)


def _windows(codes: np.ndarray, bad: int, k: int, width: int) -> np.ndarray:
    """Keys of whole windows: those of twice the length are put together from two, so it takes log k steps."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    wrong = np.append(0, np.cumsum(codes == bad))
    power, size = np.where(codes == bad, 0, codes).astype(np.int64), 1
    key, used = None, 0
    while True:
        if k & size:  # powers of two that make up k, the least first
            part = power[k - used - size :][:n]
            key = part.copy() if key is None else key | part << (used * width)
            used += size
        if 2 * size > k:
            break
        power = power[:-size] << (size * width) | power[size:]
        size *= 2
    return np.where(wrong[k:] - wrong[:-k] == 0, key, -1)


def gapped_parts(k: int) -> tuple[int, int]:
    """Letters used at each end, and those skipped between."""
    side = (2 * k // 3) // 2
    return side, k - 2 * side


def _gapped_places(k: int) -> list[int]:
    side, gap = gapped_parts(k)
    return [*range(side), *range(side + gap, k)]


def _window_ok(win: Column) -> Column:
    return win.rlike("^[ACGTUacgtu]+$")


def _at_bits(win: Column) -> Column:
    return F.when(_window_ok(win), F.conv(F.translate(F.upper(win), "ATUGC", "11100"), 2, 10).cast("long"))


def _plain(win: Column, k: int) -> Column:
    return F.when(_window_ok(win), F.conv(F.translate(F.upper(win), "ACGTU", "01233"), 4, 10).cast("long"))


def _gapped(win: Column, k: int) -> Column:
    side, gap = gapped_parts(k)
    return _at_bits(F.concat(F.substring(win, 1, side), F.substring(win, side + gap + 1, side)))


def _swap(win: Column, k: int) -> Column:
    return _at_bits(F.array_join(F.filter(F.split(F.substring(win, 1, k // 2 * 2), ""), lambda _, i: i % 2 == 0), ""))


#: Factor of a step from one letter to another: the third and fourth letter besides it, in order A C G T.
_FACTOR = np.ones((4, 4), np.int64)
for _i in range(4):
    _others = [j for j in range(4) if j != _i]
    _FACTOR[_i, _others] = (1, 2, 3)


def hpc_bulk(letters: np.ndarray, k: int) -> np.ndarray:
    """Keys of runs: a start's key is its first letter's code times the factors of the next k - 1 changes of letter.

    It multiplies and so collides a great deal (a first A gives 0); kept as defined so that keys are comparable.
    """
    n = len(letters)
    out = np.full(n, -1, np.int64)
    codes = _PLAIN[letters]
    heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if n else np.zeros(0, np.int64)
    run = codes[heads]
    if len(run) < k:
        return out
    m = len(run) - k + 1
    ok = np.ones(m, bool)
    key = run[:m].astype(np.int64)
    for i in range(k):
        ok &= run[i : i + m] != 4
        if i:
            key = key * _FACTOR[np.minimum(run[i - 1 : i - 1 + m], 3), np.minimum(run[i : i + m], 3)] & 0xFFFFFFFF
    key = np.where(ok, key, -1)
    of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, n)))
    inside = of < m
    out[inside] = key[of[inside]]
    return out


ENCODINGS: dict[str, Encoding] = {}


def register_encoding(e: Encoding) -> Encoding:
    ENCODINGS[e.name] = e
    return e


BITWISE = register_encoding(Encoding("bitwise", lambda k: k, lambda s, k: _windows(_AT[s], 2, k, 1), lambda w, k: _at_bits(w)))
PLAIN = register_encoding(Encoding("plain", lambda k: 2 * k, lambda s, k: _windows(_PLAIN[s], 4, k, 2), _plain))
GAPPED = register_encoding(Encoding("gapped", lambda k: 2 * gapped_parts(k)[0], lambda s, k: _gather(_AT[s], 2, k, _gapped_places(k), 1), _gapped))
SWAP = register_encoding(Encoding("swap", lambda k: k // 2, lambda s, k: _gather(_AT[s], 2, k, list(range(0, k // 2 * 2, 2)), 1), _swap))
HPC = register_encoding(Encoding("hpc", lambda k: 2 * k, hpc_bulk, None, lambda k: 4 * 3 ** (k - 1), False))


def encoding(name: str, k: int) -> Encoding:
    """The registered encoding, if its keys fit."""
    e = ENCODINGS[name]
    if not 0 < e.bits(k) <= MAX_BITS:
        raise ValueError(f"{name} keys of {k} letters have {e.bits(k)} bits; 1 to {MAX_BITS} are possible")
    return e


def letters_of(seq: str) -> np.ndarray:
    return np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
