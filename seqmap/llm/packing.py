"""Hierarchical multi-length packing of tokenised documents.

Tiers are context sizes (powers of two, longest first). A document fills as many whole windows of the longest
tier as it can; its rest is routed to the shortest tier that holds it. Each tier is packed best-fit with its own
rests, and the gaps that are left in the longer windows take rests of the shorter tiers, the last gap the front of
one. Only the last window of a block is padded. Windows are then dealt to step groups of equal token counts.

Work is done in blocks of bounded size inside each input partition, so nothing is shuffled, no task holds more
than a block, and a task that is run again gives the same rows.

Nulls are empty texts. Every document, also an empty one, has at least its end token. Repeated rows are packed
as often as they occur. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqmap.llm.common import plain, text_of, tidy

TIERS = (2048, 1024, 512, 256)
#: Tokens packed together; bounds the memory of a task.
BLOCK_TOKENS = 1 << 22
STEP_TOKENS = 1 << 16
#: White space that the tokenizers library takes; texts on which both ways must agree.
LONG_BLANK = re.compile(r"\s{2000}")
PROBES = ("", "a", " It's the 3rd  one,\n\n\tisn't it?  ", "r\u00e9sum\u00e9 \u65e5\u672c\u8a9e \U0001f389\u200d x\u0301 \u00a0\u3000y", "0123456789 +-*/ 'LL 're _a_b_ \r\n\r\n", "z" * 700 + " " * 40 + "=" * 300)
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


class Ids:
    """Ids of texts by the vocabulary file, as the tokenizers library gives them.

    The rank file of the same vocabulary encodes several times faster with equal ids. The tokenizers library itself
    encodes what the fast way cannot take: texts with the string of an added token, texts with a long run of white
    space (the fast way's pattern runs out of stack there), and any text at which it panics. Both ways are held
    against each other on PROBES when a task begins; if they differ, only the tokenizers library is used.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str, end: int = 1):
        import os

        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(path)
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.end, self.fast = end, None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                by = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=by, special_tokens={})
            if all(fast.encode_ordinary(x) == self.by_library(x) for x in PROBES):
                self.fast = fast

    def by_library(self, text: str) -> list[int]:
        return self.slow.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> list[int]:
        if self.fast is None or any(a in text for a in self.added) or LONG_BLANK.search(text):
            return self.by_library(text)
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # a panic of the library is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return self.by_library(text)

    def __call__(self, text: str) -> np.ndarray:
        return np.array([*self.ids(text), self.end], "<u4")


def route(rest: int, tiers: tuple[int, ...] = TIERS) -> int:
    """The index of the shortest tier that holds `rest` tokens."""
    return max(i for i, t in enumerate(tiers) if t >= rest)


def pack_block(sizes: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of one block: (tier, [(document, start, length)]). All but the last are full."""
    top = tiers[0]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    rests: list[list[tuple[int, int, int]]] = [[] for _ in tiers]
    for doc, n in enumerate(sizes):
        whole = n // top * top
        windows += [(top, [(doc, s, top)]) for s in range(0, whole, top)]
        if n > whole:
            rests[route(n - whole, tiers)].append((n - whole, doc, whole))
    pool = sorted(x for tier in rests for x in tier)  # by length, so tier after tier
    while pool:
        n, doc, start = pool.pop()
        tier = tiers[route(n, tiers)]
        row, gap = [(doc, start, n)], tier - n
        while gap and pool:  # gaps take the longest shorter rest that fits, then the front of the shortest rest
            k = max(bisect.bisect_right(pool, (gap, 1 << 62, 0)) - 1, 0)
            m, d, s = pool.pop(k)
            row.append((d, s, min(m, gap)))
            if m > gap:
                bisect.insort(pool, (m - gap, d, s + gap))
            gap -= min(m, gap)
        if not gap:
            windows.append((tier, row))
            continue
        # the block's last window: closed at the tiers it fills, so that less than the shortest tier is padded
        left, i, used = tier - gap, 0, 0
        while left:
            tier = next((t for t in tiers if t <= left), tiers[-1])
            part, gap = [], tier
            while gap and i < len(row):
                d, s, m = row[i]
                take = min(gap, m - used)
                part.append((d, s + used, take))
                gap, used, left = gap - take, used + take, left - take
                if used == m:
                    i, used = i + 1, 0
            windows.append((tier, part))
    return windows


def step_groups(fill: list[int], step_tokens: int = STEP_TOKENS) -> list[int]:
    """A group for each window: the windows, longest first, go to the group with the fewest tokens so far."""
    import heapq

    n = max(1, -(-sum(fill) // step_tokens))
    heap, out = [(0, g) for g in range(n)], [0] * len(fill)
    for k in sorted(range(len(fill)), key=lambda k: (-fill[k], k)):
        t, g = heapq.heappop(heap)
        out[k] = g
        heapq.heappush(heap, (t + fill[k], g))
    return out


def pack(docs: DataFrame, path: str, ranks: str | None = None, pattern: str = "", end: int = 1, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece of documents(doc_id, text); sequence ids are unique, offsets gapless from 0.

    A sequence is padded to the longest tier, but one as long as a tier needs no padding.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = Ids(path, ranks, pattern, end)
        next_id = TaskContext.get().partitionId() << 36
        groups = next_id

        def flush(ids: list[int], tokens: list[np.ndarray]) -> pa.RecordBatch:
            nonlocal next_id, groups
            windows = pack_block([len(t) for t in tokens], tiers)
            fill = [sum(p[2] for p in row) for _, row in windows]
            step = step_groups(fill)
            cols: list[list[int]] = [[] for _ in range(9)]
            for k, (_, row) in enumerate(windows):
                at = 0
                for doc, start, n in row:
                    crc = zlib.crc32(tokens[doc][start : start + n].tobytes())
                    tier = tiers[0] if fill[k] not in tiers else fill[k]
                    for c, v in zip(cols, (ids[doc], start, n, crc, len(tokens[doc]), next_id + k, at, tier, groups + step[k])):
                        c.append(v)
                    at += n
            next_id += len(windows)
            groups += max(step, default=-1) + 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[f.split()[0] for f in SCHEMA.split(", ")])

        ids, tokens, held = [], [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), text_of(b.column(1))):
                ids.append(doc)
                tokens.append(encode(text.as_py()))
                held += len(tokens[-1])
                if held >= block_tokens:
                    yield flush(ids, tokens)
                    ids, tokens, held = [], [], 0
        if ids:
            yield flush(ids, tokens)

    return plain(docs, "doc_id", "text").mapInArrow(tidy(run), SCHEMA)
