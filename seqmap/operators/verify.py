"""Verification of candidates: Hamming distance, acceptance classes, gapped alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqmap.operators.cigar import from_moves, parse, reduce_ops, render
from seqmap.session import cut

MISMATCH, OPEN, EXTEND, OPEN_LONG, EXTEND_LONG = 6, 4, 2, 12, 1
#: Letters of a block; windows, and blocks, that tasks are told to cut at most.
BLOCK, FILTER_WINDOWS, FILTER_BLOCKS = 1 << 14, 1 << 20, 1 << 20
#: N and all other letters are packed as A.
_PACKED = np.full(256, ord("A"), np.uint8)
for _c, _p in (("C", "C"), ("G", "G"), ("T", "T"), ("U", "T")):
    _PACKED[[ord(_c), ord(_c.lower())]] = ord(_p)


def hamming(a: str, b: str) -> int:
    return int(hamming_of(pa.array([a]), pa.array([b]))[0])


def hamming_of(a: pa.Array, b: pa.Array) -> np.ndarray:
    """The distances of two columns of sequences, all letters at once; letters beyond the shorter one differ."""
    parts = []
    for x in (a, b):
        raw = x.cast(pa.large_string()).fill_null("")
        raw = pa.concat_arrays([raw])  # offsets from 0
        at, data = raw.buffers()[1:]
        ends = np.frombuffer(at, np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
        parts.append((np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)))
    (da, sa, na), (db, sb, nb) = parts
    n = np.minimum(na, nb)
    row = np.repeat(np.arange(len(n)), n)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    differ = _PACKED[da[sa[row] + inner]] != _PACKED[db[sb[row] + inner]] if len(row) else np.zeros(0, bool)
    out = np.bincount(row[differ], minlength=len(n)) + np.abs(na - nb)
    return np.where(np.maximum(na, nb) >= 4, out, 0)


def genome_blocks(contigs: DataFrame, reach: int, width: int = BLOCK, only: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(contig_id, block, text): overlapping pieces, so that a read's place is cut from one of them, however long a contig is.

    only: contig_id and block of those that are wanted, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c, s in zip(b.column(0).to_pylist(), b.column(1)):
                own = None
                if only is not None:
                    own = only[1][slice(*np.searchsorted(only[0], [c, c + 1]))].tolist() if c is not None else []
                    if not own:
                        continue
                s = s.as_py() or ""
                n = len(range(0, max(1, len(s)), width))
                at = range(n) if own is None else [i for i in own if 0 <= i < n]
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array([s[i * width : (i + 1) * width + reach] for i in at], pa.string())], names=["contig_id", "block", "text"])

    return contigs.select(F.col("contig_id").cast("long"), "seq").mapInArrow(run, "contig_id long, block long, text string")


def genome_windows(contigs: DataFrame, only: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(contig_id, _s, _n, ref): the letters of wanted windows (contig_id, start, length, in order) that end on their contig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for c, s in zip(b.column(0).to_pylist(), b.column(1)):
                at = slice(*np.searchsorted(only[0], [c, c + 1])) if c is not None else slice(0)
                if at.start == at.stop:
                    continue
                s = s.as_py() or ""
                for a, n in zip(only[1][at].tolist(), only[2][at].tolist()):
                    if a + n <= len(s):
                        for x, v in zip(out, (c, a, n, s[a : a + n])):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], names=["contig_id", "_s", "_n", "ref"])

    return contigs.select(F.col("contig_id").cast("long"), "seq").mapInArrow(run, "contig_id long, _s long, _n long, ref string")


def _few(wanted: DataFrame, most: int) -> tuple[np.ndarray, ...] | None:
    """The distinct rows of a table of numbers in order, or None if there are more than `most`."""
    got = wanted.where("contig_id is not null").distinct().limit(most + 1).toArrow()  # 24 MB at most
    return tuple(x.to_numpy() for x in got.sort_by([(n, "ascending") for n in got.column_names]).columns) if len(got) <= most else None


def with_reference(candidates: DataFrame, contigs: DataFrame, reach: int, start: Column, length: Column, width: int = BLOCK) -> DataFrame:
    """Adds `ref`, the contig's letters at [start, start + length); candidates over a contig's end go.

    Candidates are written, and up to FILTER_WINDOWS of their windows travel to the tasks, so that no other letters are
    dealt out. Beyond that up to FILTER_BLOCKS of the blocks that they are in do, and beyond that all blocks are dealt.
    """
    c = cut(candidates.withColumn("_s", start).where("_s >= 0").withColumns({"_n": length.cast("long"), "block": F.floor(F.col("_s") / width)}))
    long = lambda *names: c.select(*[F.col(n).cast("long").alias(n) for n in names])
    windows = _few(long("contig_id", "_s", "_n"), FILTER_WINDOWS)
    if windows is not None:
        return c.join(genome_windows(contigs, windows), ["contig_id", "_s", "_n"]).drop("_s", "_n", "block")
    c = c.join(genome_blocks(contigs, reach, width, _few(long("contig_id", "block"), FILTER_BLOCKS)), ["contig_id", "block"])
    c = c.withColumn("ref", F.substring("text", (F.col("_s") - F.col("block") * width + 1).cast("int"), F.col("_n").cast("int")))
    return c.where(F.length("ref") == F.col("_n")).drop("_s", "_n", "block", "text")


def with_mismatches(df: DataFrame, seq: str = "seq", ref: str = "ref", out: str = "err") -> DataFrame:
    """Adds the Hamming distance, a batch of rows at a time."""
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, r = (b.column(b.schema.get_field_index(c)) for c in (seq, ref))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hamming_of(a, r).astype(np.int64))], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def accept_class(err: Column, length: Column) -> Column:
    """A by Hamming, G for gapped alignment, 2 and 3 for later cycles, g rejected."""
    return F.when(err <= F.shiftright(length, 4), "A").when(err <= F.shiftright(length, 3), "G").when(err <= F.shiftright(length, 2), "2").when(err <= F.shiftright(length, 1), "3").otherwise("g")


def hamming_score(err: Column, length: Column) -> Column:
    return F.floor((length - err) * 100 / length).cast("long")


def _gap(n: np.ndarray | int) -> np.ndarray | int:
    return np.minimum(OPEN + EXTEND * n, OPEN_LONG + EXTEND_LONG * n)


def align(ref: str, read: str) -> tuple[int, str]:
    """(cost, moves) of the cheapest end-to-end alignment with two-piece affine gaps; I takes a read letter, D one of the reference.

    Rows are computed at once: a gap along the row is the least of earlier cells plus what its length costs, which is
    a running minimum for each of the two pieces.
    """
    a, b = (_PACKED[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)] for s in (read, ref))
    n, m = len(a), len(b)
    j = np.arange(m + 1)
    cost = np.zeros((n + 1, m + 1), np.int64)
    cost[0] = np.where(j > 0, _gap(j), 0)
    far = 1 << 40
    up1, up2 = np.full(m + 1, far), np.full(m + 1, far)
    for i in range(1, n + 1):
        up1 = np.minimum(up1, cost[i - 1] + OPEN) + EXTEND
        up2 = np.minimum(up2, cost[i - 1] + OPEN_LONG) + EXTEND_LONG
        row = np.minimum(up1, up2)
        row[1:] = np.minimum(row[1:], cost[i - 1][:-1] + np.where(a[i - 1] == b, 0, MISMATCH))
        for o, e in ((OPEN, EXTEND), (OPEN_LONG, EXTEND_LONG)):
            before = np.minimum.accumulate(row - e * j)
            row[1:] = np.minimum(row[1:], before[:-1] + e * j[1:] + o)
        cost[i] = row
    moves, i, k = [], n, m
    while i or k:
        now = cost[i, k]
        if i and k and now == cost[i - 1, k - 1] + (0 if a[i - 1] == b[k - 1] else MISMATCH):
            moves.append("M" if a[i - 1] == b[k - 1] else "X")
            i, k = i - 1, k - 1
            continue
        s = np.arange(1, i + 1)
        hit = np.flatnonzero(cost[i - s, k] + _gap(s) == now) if i else []
        if len(hit):
            moves.append("I" * int(s[hit[0]]))
            i -= int(s[hit[0]])
            continue
        s = np.arange(1, k + 1)
        d = int(s[np.flatnonzero(cost[i, k - s] + _gap(s) == now)[0]])
        moves.append("D" * d)
        k -= d
    return int(cost[n, m]), "".join(x[::-1] for x in reversed(moves))


def gapped(df: DataFrame, seq: str = "seq", ref: str = "ref", pos: str = "cpos") -> DataFrame:
    """Adds cost, cigar0 (as aligned), cigar (reduced), score and left (the moved start); only for rows that need it."""
    added = [T.StructField("cost", T.LongType()), T.StructField("cigar0", T.StringType()), T.StructField("cigar", T.StringType()), T.StructField("score", T.LongType()), T.StructField("left", T.LongType())]
    schema = T.StructType([*df.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in added]
            for read, r, at in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in (seq, ref, pos))):
                cost, moves = align(r, read)
                ops = from_moves(moves)
                new = reduce_ops(ops, at, at + len(r))
                for c, v in zip(cols, (cost, render(ops), render(new.ops), moves.count("M") * 100 // max(1, len(read)), new.left)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, pa.string() if f.name.startswith("cigar") else pa.int64()) for c, f in zip(cols, added))], names=[*b.schema.names, *(f.name for f in added)])

    return df.mapInArrow(run, schema)


def accepted(candidates: DataFrame, aligner: bool = True) -> DataFrame:
    """Classified candidates (seq, ref, err, len, cpos, read_num, mate) -> accepted ones with status, score and cigar.

    Gapped alignment is run on rows of the first cycle that Hamming does not decide, and on later cycles' rows only
    for reads of which nothing was accepted before. Candidates are compared once and written, then read for each cycle.
    """
    c = cut(candidates.withColumn("status", accept_class(F.col("err"), F.col("len"))).where("status <> 'g'"))
    plain = c.where("status = 'A'").withColumns({"score": hamming_score(F.col("err"), F.col("len")), "cigar": F.concat(F.col("len").cast("string"), F.lit("M")), "left": F.col("cpos")})
    cols = [*c.columns, "score", "cigar", "left"]
    out = plain.select(*cols)
    if not aligner:
        return out
    out = cut(out.unionByName(gapped(c.where("status = 'G'")).select(*cols)))
    for cycle in ("2", "3"):
        rest = c.where(F.col("status") == cycle).join(out.select("read_num", "mate").distinct(), ["read_num", "mate"], "left_anti")
        late = gapped(rest).where(F.col("len") - F.floor(F.col("score") * F.col("len") / 100) <= F.shiftright("len", 1))
        out = out.unionByName(late.withColumn("status", F.lit("G")).select(*cols))
    return out


def best(accepted_rows: DataFrame) -> DataFrame:
    """Of each read the rows of greatest score, numbered; `ties` is how many more there are."""
    by = W.partitionBy("read_num", "mate")
    top = accepted_rows.withColumn("_m", F.max("score").over(by)).where("score = _m").drop("_m")
    order = by.orderBy("strand", "contig_id", "cpos")
    return top.withColumn("ties", F.count(F.lit(1)).over(by) - 1).withColumn("choice", F.row_number().over(order))


__all__ = ["accept_class", "accepted", "align", "best", "gapped", "genome_blocks", "genome_windows", "hamming", "hamming_score", "parse", "with_mismatches", "with_reference"]
