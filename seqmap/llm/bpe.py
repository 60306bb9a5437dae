"""Byte-level BPE as a lazily determinised finite-state transducer, and a streaming decoder.

The merges are never run over a text. A state of the transducer is (last emitted token, bytes not yet emitted); the
next byte leads to the state that holds what can still change and emits the tokens that no continuation can change.
The token that ends the encoding of every prefix is found by compatibility of neighbours: t can follow s if and only
if the pair encodes to itself. States and transitions are made when first met and kept in a bounded table.

Decoding maps ids to bytes and drives an incremental UTF-8 state machine, so that a character split between tokens
is completed by later ones.

Nulls are empty texts with no ids; ids are exactly those of the rank file's merges for each match of the pattern.
Repeated rows repeat their results, an empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqmap.llm.common import plain, text_of

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long"
#: Entries that the tables of transitions and pairs, and of pieces, hold before they are begun anew.
TABLE_LIMIT, PIECES = 1 << 19, 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The definition: the adjacent pair of lowest rank is joined, leftmost first, until none is left."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
        if parts[best] + parts[best + 1] not in ranks:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts


class Transducer:
    """States and transitions over the bytes of a piece; output is the little-endian ids of the emitted tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.code = {t: i.to_bytes(4, "little") for t, i in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        self.edges: tuple[dict[bytes, list[tuple[bytes, int]]], ...] = ({}, {})
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.clear()

    def clear(self) -> None:
        if len(self.pairs) > TABLE_LIMIT:
            self.pairs.clear()
        self.ids: dict[tuple[bytes, bytes], int] = {}
        self.states: list[tuple] = []
        self.ends: list[bytes | None] = []
        self.next: dict[int, tuple[int, bytes]] = {}
        self.start = self.state(b"", b"", (), ())

    def state(self, last: bytes, held: bytes, tails: tuple, live: tuple[int, ...]) -> int:
        key = (last, held)
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append((last, held, tails, live))
            self.ends.append(None)
        return found

    def edge(self, token: bytes, right: bool) -> list[tuple[bytes, int]]:
        """The tokens that stand at an edge of a token while it is merged, each with the rank that ends it."""
        table = self.edges[right]
        if token not in table:
            if token not in self.halves:
                self.halves[token] = self.half(token)
            h = self.halves[token]
            under = [] if h is None else self.edge(h[right], right)
            table[token] = [(t, self.ranks[token] if e is None else e) for t, e in under] + [(token, None)]
        return table[token]

    def half(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The last pair that merges into a token."""
        if len(token) == 1:
            return None
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            k = min(range(len(parts) - 1), key=lambda i: (self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts[0], parts[1]

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether b can stand after a: no merge over their border comes before the merges on both its sides.

        A merge on the left at the same rank comes first, one on the right later.
        """
        if not a:
            return True
        key = (a, b)
        found = self.pairs.get(key)
        if found is None:
            rank, right = self.ranks.get, self.edge(b, False)
            found = True
            for x, x_end in self.edge(a, True):
                for y, y_end in right:
                    q = rank(x + y)
                    if q is not None and (x_end is None or q < x_end) and (y_end is None or q <= y_end):
                        found = False
                        break
                if not found:
                    break
            self.pairs[key] = found
        return found

    def step(self, s: int, byte: int) -> tuple[int, bytes]:
        """Builds a transition.

        tails[i] is the token that ends the encoding of the first i + 1 held bytes; live are the places where a token
        may have begun that is not complete. What all live places and the end have in common is emitted.
        """
        last, held, tails, live = self.states[s]
        n = len(held)
        held += bytes((byte,))
        tail, begun = None, []
        for j in (*live, n):
            seg = held[j:]
            if tail is None and seg in self.ranks and self.fits(tails[j - 1] if j else last, seg):
                tail = seg
            if seg in self.prefixes:
                begun.append(j)
        tails += (tail,)
        if begun and begun[0] == 0:
            return self.state(last, held, tails, tuple(begun)), b""
        # each end leads back over its last token to an earlier one; the ends are led back until they meet
        ends = [*begun, n + 1]
        keep = set(ends)
        while len(ends) > 1:
            e = ends.pop()
            back = e - len(tails[e - 1])
            if not back:
                return self.state(last, held, tails, tuple(begun)), b""
            if back not in keep:
                keep.add(back)
                insort(ends, back)
        cut = e = ends[0]
        done = []
        while e > 0:
            done.append(self.code[tails[e - 1]])
            e -= len(tails[e - 1])
        rest = tuple([tails[e - 1] if e in keep else None for e in range(cut + 1, n + 2)])
        return self.state(tails[cut - 1], held[cut:], rest, tuple([j - cut for j in begun])), b"".join(done[::-1])

    def end(self, s: int) -> bytes:
        """What a state still holds when the piece ends."""
        _, held, tails, _ = self.states[s]
        end, out = len(held), []
        while end > 0:
            out.append(self.code[tails[end - 1]])
            end -= len(tails[end - 1])
        found = self.ends[s] = b"".join(out[::-1])
        return found

    def encode(self, piece: bytes) -> bytes:
        s, out, table = self.start, b"", self.next
        for byte in piece:
            key = s << 8 | byte
            found = table.get(key)
            if found is None:
                found = table[key] = self.step(s, byte)
            s = found[0]
            if found[1]:
                out += found[1]
        rest = self.ends[s]
        out += self.end(s) if rest is None else rest
        if len(table) > TABLE_LIMIT:
            self.clear()
        return out


class Pieces(dict):
    """Little-endian ids of pieces met before; a piece that is a token is that token."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks, self.fst = ranks, Transducer(ranks)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        out = self.fst.code.get(raw) or self.fst.encode(raw)
        if len(self) >= PIECES:
            self.clear()
        if len(raw) <= 256:
            self[piece] = out
        return out


_PIECES: dict[str, Pieces] = {}


def pieces_of(path: str) -> Pieces:
    """A worker's table is kept for its later tasks."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(read_ranks(path))
    return _PIECES[path]


class Utf8:
    """Incremental UTF-8: counts characters over chunks and keeps what a chunk's end leaves open."""

    def __init__(self) -> None:
        self.need = self.chars = self.bad = 0

    def feed(self, chunk: np.ndarray) -> None:
        lead = np.where(chunk < 0x80, 0, np.where(chunk < 0xC0, -1, np.where(chunk < 0xE0, 1, np.where(chunk < 0xF0, 2, 3))))
        starts = np.flatnonzero(lead >= 0)
        head = int(starts[0]) if len(starts) else len(chunk)
        self.bad += head != self.need if len(starts) else head > self.need
        self.need = 0 if len(starts) else max(0, self.need - head)
        if len(starts):
            have = np.diff(np.append(starts, len(chunk))) - 1
            want = lead[starts]
            self.bad += int((have[:-1] != want[:-1]).sum()) + int(have[-1] > want[-1])
            self.need = max(0, int(want[-1] - have[-1]))
            self.chars += len(starts)


class Decoder:
    def __init__(self, ranks: dict[bytes, int]):
        words = [b""] * (max(ranks.values()) + 1)
        for t, i in ranks.items():
            words[i] = t
        self.size = np.array([len(w) for w in words], np.int64)
        self.at = np.append(0, np.cumsum(self.size))[:-1]
        self.bytes = np.frombuffer(b"".join(words), np.uint8)

    def __call__(self, ids: np.ndarray, chunk: int = 1 << 18) -> tuple[bytes, Utf8]:
        out, state = [], Utf8()
        for i in range(0, len(ids), chunk):
            part = ids[i : i + chunk]
            n = self.size[part]
            ends = np.cumsum(n)
            where = np.arange(int(ends[-1])) + np.repeat(self.at[part] - (ends - n), n)
            got = self.bytes[where]
            state.feed(got)
            out.append(got.tobytes())
        return b"".join(out), state


def encode_decode(docs: DataFrame, path: str, pattern: str, keep: bool = False) -> DataFrame:
    """documents(doc_id, text) -> digests of the ids and of what they decode to; with keep, also `ids` and `decoded`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gc

        import regex

        gc.set_threshold(500_000, 50, 100)  # the tables are large and have no cycles
        pieces = pieces_of(path)
        find, decode = regex.compile(pattern).findall, Decoder(pieces.ranks)
        get = pieces.__getitem__
        for b in batches:
            cols: list[list] = [[] for _ in range(6 if keep else 4)]
            for text in text_of(b.column(1)):
                raw = b"".join(map(get, find(text.as_py())))
                ids = np.frombuffer(raw, "<u4")
                back, state = decode(ids) if len(ids) else (b"", Utf8())
                for c, v in zip(cols, (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest(), state.chars, ids.astype(np.int64) if keep else None, back if keep else None)):
                    c.append(v)
            arrays = [b.column(0).cast(pa.int64()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars_decoded"]
            if keep:
                arrays += [pa.array(cols[4], pa.list_(pa.int64())), pa.array(cols[5], pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return plain(docs, "doc_id", "text").mapInArrow(run, SCHEMA + (", ids array<long>, decoded binary" if keep else ""))
