"""Removal of repeated 100-byte strings with suffix arrays of shards.

Shards are made by content. Every 100-byte string picks one of its 24-byte grams, the leftmost of least hash, as its
anchor, so equal strings pick equal anchors at equal places. An anchor's context is the part of its document that
strings with this anchor can cover. Contexts of equal anchors are compared, no others need be:

* Contexts that are equal as a whole are repeats of the earliest one. This is found by hash, first within each task
  and then over all, so large groups of copies are thinned out before they are shuffled.
  An anchor of very many contexts is dealt by its contexts as well, so that it fills no single task.
* What remains are the earliest ones of different contexts of one anchor, where copies begin, end or differ. They are
  dealt to shards by anchor; in each block of a shard a suffix array is built by induced sorting, with permuted common
  prefixes, and in each run of suffixes with a common prefix of 100 bytes all but the earliest are repeats.
* An anchor with more than HOT different contexts (a common line in many documents) would overfill a block. Its
  contexts are compared string by string instead, dealt by the string's hash.

Marked strings are united to intervals for each document and cut out of it; they are judged on the input alone. A long
text is read in overlapping windows.

Null texts are empty; texts of under 100 bytes keep all. A repeat is a string that starts earlier, at a smaller doc_id
or earlier in the same document. Null ids come first. Rows of one id are one document if their texts are equal, and
otherwise documents in the order of their texts' hashes. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmap.llm.common import STEP_BYTES, Scratch, bytes_of, distinct_ids, free, mix, own_ids, plain, steps, tidy
from seqmap.llm.simjoin import packed_texts
from seqmap.llm.suffix import permuted_lcp, suffix_array

LENGTH, GRAM = 100, 24
WINDOW = LENGTH - GRAM + 1
#: Contexts of one anchor that still go to one block.
HOT = 1 << 12
#: Contexts from which on an anchor is dealt by its contexts, at least; at most 1 in SALTED_SHARE of all are its share.
#: A task only reports anchors that it holds REPORTED times or more.
SALTED, SALTED_SHARE, REPORTED, SALTS = 1 << 11, 1 << 16, 4, 61
BLOCK_BYTES = 1 << 21
#: Lengths by which contexts are first compared left and right of their anchor.
LEVELS = (9, 19, 28, 38, 47, 57, 66, WINDOW - 1)
#: Anchors that a task holds before it sends them on.
HELD = 1 << 21
FOUND = "kind int, h long, ctx long, doc_id long, at long"
MARK, ANCHOR, CAND, HOT_CAND, OFTEN, SALTED_CAND = 0, 1, 2, 3, 4, 5
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0xA5A5A5A5))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(STEP_BYTES + 64, 1 << (n - 1).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        _POWERS[size] = tuple(np.append(np.uint64(1), np.cumprod(np.full(size, b, np.uint64))) for b in (np.uint64(_BASE), np.uint64(_INVERSE)))
    return _POWERS[size]


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    return np.append(np.uint64(0), np.cumsum(_BYTE[raw] * _powers(len(raw))[0][: len(raw)]))


def spans_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix((sums[end] - sums[start]) * _powers(len(sums))[1][start] + (end - start).astype(np.uint64) * np.uint64(_BASE))


def least_in_windows(v: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w values in a row."""
    n = len(v) - w + 1
    x = np.append(v, np.full(-len(v) % w, v[-1], v.dtype)).reshape(-1, w)
    ahead = np.minimum.accumulate(x, 1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, anchor's hash, context's hash, packed context in the row) of a step of rows.

    A row longer than a step is read in windows that overlap by all that an anchor's choice and its context need.
    """
    size = int(offsets[-1] - offsets[0])
    if len(offsets) > 2 or size <= STEP_BYTES:
        return _anchors(data[offsets[0] : offsets[-1]], offsets - offsets[0], 0, size)
    parts = []
    for a in range(0, size, STEP_BYTES):
        lo, hi = max(0, a - WINDOW), min(size, a + STEP_BYTES + 2 * LENGTH)
        row, h, ctx, at = _anchors(data[offsets[0] + lo : offsets[0] + hi], np.array([0, hi - lo]), a - lo, a - lo + STEP_BYTES)
        parts.append((row, h, ctx, at + (lo << 24)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _anchors(raw: np.ndarray, at: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, ...]:
    """The anchors that strings with a start in [lo, hi) pick."""
    none = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return none, none, none, none
    sums = prefix_sums(raw)
    g = np.arange(len(raw) - GRAM + 1)
    h = spans_hash(sums, g, g + GRAM)
    low = np.uint64((1 << 30) - 1)
    least = least_in_windows((h & ~low) | g.astype(np.uint64), WINDOW)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    s = np.arange(len(least))
    ok = s + LENGTH <= at[1:][row[: len(least)]]
    ok[:lo] = False
    ok[hi:] = False
    picked = np.unique((least[ok] & low).astype(np.int64))
    of = row[picked]
    start = np.maximum(at[of], picked - (WINDOW - 1))
    end = np.minimum(at[of + 1], picked + LENGTH)
    ctx = mix(spans_hash(sums, start, end) + (picked - start).astype(np.uint64))
    return of, h[picked].view(np.int64), ctx.view(np.int64), pack_at(start - at[of], end - at[of], picked - start)


def _batch(kind: int | np.ndarray, h: np.ndarray, ctx: np.ndarray, doc: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    kind = np.full(len(h), kind, np.int32) if isinstance(kind, int) else kind
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (kind, h, ctx, doc, at)], names=["kind", "h", "ctx", "doc_id", "at"])


def pack_at(start: np.ndarray, end: np.ndarray, left: np.ndarray | int = 0) -> np.ndarray:
    """A context's or an interval's start, its anchor's place and its length in one number, in order of starts."""
    return start << 24 | left << 16 | (end - start)


def unpack_at(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = at >> 24
    return start, start + (at & 0xFFFF)


def found_anchors(docs: DataFrame) -> DataFrame:
    """Anchors with their contexts; of equal contexts in a task the earliest, the others are marked at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, ctx, doc, at = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((at, doc, ctx, h))
            h, ctx, doc, at = h[order], ctx[order], doc[order], at[order]
            new = np.append(True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            same_place = (doc == doc[first]) & (at == at[first])
            dup = ~new & ~same_place
            yield _batch(MARK, h[dup] * 0, h[dup] * 0, doc[dup], at[dup])
            h, ctx, doc, at = h[new], ctx[new], doc[new], at[new]
            yield _batch(ANCHOR, h, ctx, doc, at)
            heads = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.append(heads, len(h)))
            heads, n = heads[n >= REPORTED], n[n >= REPORTED]
            yield _batch(OFTEN, h[heads], n, n * 0, n * 0)

        for b in batches:
            data, offsets = bytes_of(b.column(1))
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for i, j in steps(offsets):
                of, h, ctx, at = anchors_of(data, offsets[i : j + 1])
                held.append((h, ctx, ids[i:j][of].astype(np.int64), at))
                size += len(h)
                if size >= HELD:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    own = plain(docs, "doc_id", "text").where("octet_length(text) >= 100")
    return own.mapInArrow(tidy(run), FOUND)


def compared(anchors: DataFrame) -> DataFrame:
    """Marks of contexts seen before, and the earliest ones of an anchor's different contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_h, kind, kept = None, CAND, []  # the open anchor's first contexts so far
        last_ctx, first_place = None, (None, None)  # of the open context

        def close() -> Iterator[pa.RecordBatch]:
            if kept and (kind != CAND or len(kept) > 1):
                yield _batch(kind, np.full(len(kept), open_h), np.zeros(len(kept), np.int64), np.array([k[0] for k in kept], np.int64), np.array([k[1] for k in kept], np.int64))

        for b in batches:
            h, ctx, doc, at = (c.to_numpy(zero_copy_only=False) for c in b.columns[:4])
            salted = b.column(4).to_numpy(zero_copy_only=False)
            n = len(h)
            if not n:
                continue
            new_h = np.append(h[0] != open_h, h[1:] != h[:-1])
            new = new_h | np.append(ctx[0] != last_ctx, ctx[1:] != ctx[:-1])
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            first_doc, first_at = (np.where(first < 0, -1 if p is None else p, c[first]) for p, c in zip(first_place, (doc, at)))
            dup = ~new & ~((doc == first_doc) & (at == first_at))
            last_ctx, first_place = ctx[-1], (int(first_doc[-1]), int(first_at[-1]))
            yield _batch(MARK, h[dup] * 0, h[dup] * 0, doc[dup], at[dup])
            # whole anchors inside the batch at once, those that touch its ends one by one
            firsts = np.flatnonzero(new)
            group = np.cumsum(new_h[firsts])  # 0: the open anchor goes on
            sizes = np.bincount(group, minlength=int(group[-1]) + 1 if len(group) else 1)
            going = firsts[group == 0]
            kept += list(zip(doc[going].tolist(), at[going].tolist()))
            if kind == CAND and len(kept) > HOT:
                kind = HOT_CAND
            if kind != CAND:
                yield from close()
                kept = []
            if len(group) and group[-1] > 0:
                yield from close()
                inner = firsts[(group > 0) & (group < group[-1]) & ((sizes[group] > 1) | salted[firsts])]
                if len(inner):
                    size = sizes[group][np.searchsorted(firsts, inner)]
                    kinds = np.where(salted[inner], SALTED_CAND, np.where(size > HOT, HOT_CAND, CAND)).astype(np.int32)
                    yield _batch(kinds, h[inner], h[inner] * 0, doc[inner], at[inner])
                tail = firsts[group == group[-1]]
                open_h, kind, kept = h[tail[0]], SALTED_CAND if salted[tail[0]] else CAND, list(zip(doc[tail].tolist(), at[tail].tolist()))
        yield from close()

    own = anchors.where(F.col("kind") == ANCHOR).select("h", "ctx", "doc_id", "at")
    often = anchors.where(F.col("kind") == OFTEN).groupBy("h").agg(F.sum("ctx").alias("n"))
    total = own.count()
    # at most SALTED_SHARE anchors have so large a share of all
    often = often.where(F.col("n") >= max(SALTED, total // SALTED_SHARE)).select("h", F.lit(True).alias("salted"))
    own = own.join(F.broadcast(often), "h", "left").withColumn("salted", F.coalesce("salted", F.lit(False)))
    salt = F.when(F.col("salted"), F.pmod("ctx", F.lit(SALTS))).otherwise(F.lit(0))
    dealt = own.repartition(F.col("h"), salt).sortWithinPartitions("h", "ctx", "doc_id", "at")
    return dealt.mapInArrow(tidy(run), FOUND)


def candidates(found: DataFrame) -> DataFrame:
    """(h, hot, doc_id, at) of the contexts to compare; of a salted anchor all parts are counted together."""
    whole = found.where(F.col("kind").isin(CAND, HOT_CAND)).select("h", (F.col("kind") == HOT_CAND).alias("hot"), "doc_id", "at")
    salted = found.where(F.col("kind") == SALTED_CAND).select("h", "doc_id", "at")
    sizes = salted.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")  # at most SALTED_SHARE anchors
    return whole.union(salted.join(F.broadcast(sizes), "h").select("h", F.col("n") > HOT, "doc_id", "at"))


CONTEXT = "h long, hot boolean, doc_id long, start long, left int, bytes binary"


def contexts(docs: DataFrame, cands: DataFrame) -> DataFrame:
    """The bytes of candidates; those of a document are cut out of its text together."""
    wanted = cands.groupBy("doc_id").agg(F.collect_list(F.struct("h", "hot", "at")).alias("cuts"))  # bounded by the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for doc, z, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = unpack(z)
                for c in cuts:
                    start = c["at"] >> 24
                    rows.append((c["h"], c["hot"], doc, start, c["at"] >> 16 & 0xFF, raw[start : start + (c["at"] & 0xFFFF)]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["h", "hot", "doc_id", "start", "left", "bytes"])

    return packed_texts(docs).join(wanted, "doc_id").mapInArrow(tidy(run), CONTEXT)


def trimmed(hs: list[int], lefts: list[int], texts: list[bytes]) -> list[tuple[int, int, int]]:
    """(context, first and last byte) of what another context of the same anchor can share.

    A shared string has the anchor, and left and right of it together WINDOW - 1 bytes more. So contexts are compared
    by hash at some lengths on each side; where both sides together fall short of that, nothing is shared.
    """
    h, left = np.array(hs, np.int64).view(np.uint64), np.array(lefts, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    at = np.cumsum(size) - size + left
    sums = prefix_sums(np.frombuffer(b"".join(texts), np.uint8))
    most = []
    for room, side in ((left, -1), (size - left - GRAM, 1)):
        bound = np.minimum(room, LEVELS[0] - 1)
        for k, e in enumerate(LEVELS):
            may = np.flatnonzero(room >= e)
            lo, hi = (at[may] - e, at[may]) if side < 0 else (at[may] + GRAM, at[may] + GRAM + e)
            key = mix(spans_hash(sums, lo, hi) ^ h[may])
            _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            shared = may[counts[inverse] > 1]
            bound[shared] = np.minimum(room[shared], LEVELS[k + 1] - 1 if k + 1 < len(LEVELS) else e)
        most.append(bound)
    keep = np.flatnonzero(most[0] + most[1] >= WINDOW - 1)
    return list(zip(keep.tolist(), (left - most[0])[keep].tolist(), (left + GRAM + most[1])[keep].tolist()))


def repeats_in_block(texts: list[bytes], docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc_id, packed interval) of the strings in contexts that start earlier in another one."""
    sizes = np.array([len(t) for t in texts], np.int64)
    s = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = s.astype(np.int64) + len(texts) + 1
    symbols[ends] = np.arange(1, len(texts) + 1)  # each end is a letter of its own, so no common prefix goes over it
    symbols = np.append(symbols, 0)
    sa = suffix_array(symbols, len(texts) + 257)
    plcp = permuted_lcp(symbols, sa)
    begin = ends - sizes
    of = np.repeat(np.arange(len(texts)), sizes + 1)
    whole = np.append(np.arange(len(s)) + LENGTH <= ends[of], False)
    rank = np.unique(docs, return_inverse=True)[1]
    key = (rank[of] << 40) + starts[of] + np.arange(len(s)) - begin[of]
    order = sa[whole[sa]]
    if not len(order):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # suffixes between two whole ones share what those share, so a run ends where any prefix since is shorter
    short = np.cumsum(plcp[sa] < LENGTH)[whole[sa]]
    heads = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
    k = key[order]
    least = np.repeat(np.minimum.reduceat(k, heads), np.diff(np.append(heads, len(k))))
    flag = np.zeros(len(s) + 1, bool)
    flag[order[k > least]] = True
    edge = np.flatnonzero(np.diff(np.append(False, flag).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    c = of[first]
    lo = starts[c] + first - begin[c]
    return docs[c], pack_at(lo, lo + (last - first) + LENGTH - 1)


def sharded(found: DataFrame) -> DataFrame:
    """Marks by suffix arrays over blocks of whole anchor groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        hs: list[int] = []
        docs: list[int] = []
        starts: list[int] = []
        lefts: list[int] = []
        size = 0

        def flush() -> pa.RecordBatch:
            parts = trimmed(hs, lefts, texts)
            doc, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if parts:
                doc, at = repeats_in_block([texts[i][a:b] for i, a, b in parts], np.array([docs[i] for i, _, _ in parts], np.int64), np.array([starts[i] + a for i, a, _ in parts], np.int64))
            for x in (texts, hs, docs, starts, lefts):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at)], names=["doc_id", "at"])

        for b in batches:
            for h, doc, start, left, raw in zip(*(c.to_pylist() for c in b.columns)):
                if size >= BLOCK_BYTES and h != hs[-1]:
                    yield flush()
                    size = 0
                hs.append(h)
                docs.append(doc)
                starts.append(start)
                lefts.append(left)
                texts.append(raw)
                size += len(raw) + 1
        if texts:
            yield flush()

    dealt = found.where("not hot").select("h", "doc_id", "start", "left", "bytes").repartition(F.col("h")).sortWithinPartitions("h")
    return dealt.mapInArrow(tidy(run), "doc_id long, at long")


def by_string(found: DataFrame) -> DataFrame:
    """Marks of hot anchors' strings: equal ones meet by hash, thinned out within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            sizes = np.array([len(t) for t in texts], np.int64)
            ends = np.cumsum(sizes)
            sums = prefix_sums(np.frombuffer(b"".join(texts), np.uint8))
            n = np.maximum(sizes - LENGTH + 1, 0)
            of = np.repeat(np.arange(len(texts)), n)
            s = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            begin = (ends - sizes)[of] + s
            key = spans_hash(sums, begin, begin + LENGTH).view(np.int64)
            doc, at = b.column(0).to_numpy()[of], b.column(1).to_numpy()[of] + s
            order = np.lexsort((at, doc, key))
            key, doc, at = key[order], doc[order], at[order]
            new = np.append(True, key[1:] != key[:-1])[: len(key)]
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
            later = (doc != doc[first]) | (at != at[first])
            keep = new | later
            yield pa.RecordBatch.from_arrays([pa.array(later[keep]), pa.array(key[keep]), pa.array(doc[keep]), pa.array(at[keep])], names=["later", "key", "doc_id", "start"])

    each = found.where("hot").select("doc_id", "start", "bytes").mapInArrow(tidy(run), "later boolean, key long, doc_id long, start long")
    place = F.struct("doc_id", "start")
    # what a task has thinned out is marked whatever the others hold; a key has no more rows left than there are batches
    kept = each.where("not later").groupBy("key").agg(F.min(place).alias("first"), F.collect_set(place).alias("all")).where("size(all) > 1")
    later = kept.select(F.explode("all").alias("p"), "first").where("p > first").select("p.doc_id", "p.start")
    return each.where("later").select("doc_id", "start").union(later).select("doc_id", F.expr(f"shiftleft(start, 24) | {LENGTH}L").alias("at"))


def repeats(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, cuts): the packed intervals to be removed of each document that has some."""
    near = scratch.save(found_anchors(docs), "anchors")
    found = scratch.save(compared(near), "compared")
    free(docs.sparkSession)
    cut = scratch.save(contexts(docs, candidates(found)), "contexts")
    free(docs.sparkSession)
    marks = near.union(found).where(F.col("kind") == MARK).select("doc_id", "at").union(sharded(cut)).union(by_string(cut))
    marks = scratch.save(marks.groupBy("doc_id").agg(F.collect_list("at").alias("cuts")), "marks")  # bounded by the document
    scratch.drop("anchors", "compared", "contexts")
    del near, found, cut
    free(docs.sparkSession)
    return marks


def cut_out(raw: bytes, cuts: list[int] | None) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, runs removed)."""
    if not cuts:
        return raw, 0, 0
    start, end = unpack_at(np.array(cuts, np.int64))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > end[:-1])
    lo, hi = start[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    left, at = [], 0
    for a, b in zip(lo.tolist(), hi.tolist()):
        left.append(raw[at:a])
        at = b
    left.append(raw[at:])
    return b"".join(left), int((hi - lo).sum()), len(lo)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """Digests of what is left of each document."""
    scratch = scratch or Scratch(docs.sparkSession, "dedup")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for doc, z, cuts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                raw = unpack(z)
                left, n, k = cut_out(raw, cuts)
                rows.append((doc, len(raw), n, k, hashlib.sha256(left).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    own, back = distinct_ids(plain(docs, "doc_id", "text"), scratch)
    marks = repeats(own, scratch)
    return own_ids(packed_texts(own).join(marks, "doc_id", "left").mapInArrow(tidy(run), RESULT), back)


def dedup_docs(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The documents with repeats cut out of their texts; the bytes of characters that a cut splits go, too."""
    scratch = scratch or Scratch(docs.sparkSession, "dedup")
    own, back = distinct_ids(plain(docs, "doc_id", "text", "lang", "source", "n_chars"), scratch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, sizes = [], []
            for text, n, cuts in zip(b.column(1).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
                if cuts:
                    text = cut_out(text.encode(), cuts)[0].decode(errors="ignore")
                    n = len(text)
                texts.append(text)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), b.column(2), b.column(3), pa.array(sizes, pa.int64())], names=["doc_id", "text", "lang", "source", "n_chars"])

    marks = repeats(own, scratch)
    kept = own.join(marks, "doc_id", "left").select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long"), "cuts")
    return own_ids(kept.mapInArrow(tidy(run), "doc_id long, text string, lang string, source string, n_chars long"), back)
