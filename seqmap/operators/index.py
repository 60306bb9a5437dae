"""The inverted index: contigs are sampled at guides, hashed to keys, and kept as postings."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmap.functions.encodings import ENCODINGS, encoding, letters_of
from seqmap.functions.guides import GUIDES
from seqmap.session import cut, stored

KEYS = "id long, pos long, key long, over boolean"
POSTINGS = "key long, gpos long, contig_id long, cpos long"
#: Letters encoded at once; keys, and places of contigs, that are sent to all tasks at most.
PIECE, FILTER_KEYS, PLACES = 1 << 20, 1 << 20, 1 << 20
#: Bits of keys that a task counts in one array (64 MB), and of those that are sent as one row of counts.
DENSE_BITS, ROW_BITS = 24, 14
#: Cut points of the distribution of posting sizes: 0 to 99 by one, then each decade to a million in nine steps.
CUTS = [*range(100), *(d * m for d in (100, 1000, 10000, 100000) for m in range(1, 10)), 1000000]
RANGE = 1 << 20


@dataclass(frozen=True)
class IndexMeta:
    k: int
    encoding: str
    guide: str
    genome_size: int
    mean_log10: float
    sd_log10: float
    q95: int

    def limits(self) -> tuple[int, int]:
        return key_limits(self.mean_log10, self.sd_log10, self.q95)


def key_limits(mean_log10: float, sd_log10: float, q95: int) -> tuple[int, int]:
    """Low and high key-count limits: the mean plus four deviations of the sizes' logarithm, and the 95 % cut."""
    spread = int(10 ** (mean_log10 + 4 * sd_log10))
    return min(spread, q95), max(spread, q95)


def spread(df: DataFrame, id_col: str) -> DataFrame:
    """Deals out the rows of a table that is read in fewer tasks than would keep the cluster busy; a large one stays as it is read."""
    want = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want, id_col)


def with_offsets(contigs: DataFrame) -> DataFrame:
    """Adds size and the half-open [start, end) on the concatenation of all contigs in order of contig_id.

    Places are made from ids and sizes alone, once: id ranges are summed first, and only the ranges' sums meet in one
    task. Up to PLACES of them travel to the tasks, so that no letters are dealt out; more are joined by id.
    """
    sizes = contigs.select("contig_id", F.length("seq").cast("long").alias("size")).withColumn("_r", F.floor(F.col("contig_id") / 1024))
    ranges = sizes.groupBy("_r").agg(F.sum("size").alias("_n"))
    before = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_r").orderBy("contig_id").rowsBetween(W.unboundedPreceding, -1)
    places = sizes.join(ranges, "_r").withColumn("start", F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    places = cut(places.select("contig_id", "size", "start", (F.col("start") + F.col("size")).alias("end")))
    return contigs.join(F.broadcast(places) if places.count() <= PLACES else places, "contig_id")


def _encoded(batches: Iterator[pa.RecordBatch], k: int, encoding_name: str, guide: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row in its batch's columns as ids and starts, places, keys, whether by length) of sequences, a bounded piece at a time."""
    enc, scan = encoding(encoding_name, k), GUIDES[guide]
    for b in batches:
        starts = b.column(2).to_pylist() if b.num_columns > 2 else [0] * b.num_rows
        for i, s, start in zip(b.column(0).to_pylist(), b.column(1), starts):
            s = s.as_py()
            if not s or len(s) < k:
                continue
            letters = letters_of(s.upper())
            del s
            n = max(0, len(letters) - k - 1)
            whole = not enc.local
            if guide != "default":
                g = [x for x in scan(letters.tobytes().decode("latin-1"), k) if x[0] + k <= len(letters)]
                at, over = np.array([x[0] for x in g], np.int64), np.array([x[1] for x in g], bool)
            for a in range(0, len(letters) - k + 1, len(letters) if whole else PIECE):
                e = len(letters) if whole else a + PIECE
                key = enc.bulk(letters if whole else letters[a : e + k - 1], k)
                if guide == "default":
                    p, o = np.arange(a, min(e, n)), None
                else:
                    here = (at >= a) & (at < e)
                    p, o = at[here], over[here]
                key = key[p - (0 if whole else a)]
                ok = key >= 0
                yield i, start, p[ok], key[ok], np.zeros(int(ok.sum()), bool) if o is None else o[ok]


def keys_of(df: DataFrame, id_col: str, seq_col: str, k: int, encoding_name: str = "bitwise", guide: str = "default") -> DataFrame:
    """(id, pos, key, over) of each guide of each sequence that has a key; encoded in bulk, a piece of a sequence at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for i, _, p, key, over in _encoded(batches, k, encoding_name, guide):
            held.append((np.full(len(p), i, np.int64), p, key, over))
            size += len(p)
            if size >= PIECE:
                yield _batch(held, KEYS)
                held, size = [], 0
        if held:
            yield _batch(held, KEYS)

    return df.select(F.col(id_col).cast("long"), F.col(seq_col)).mapInArrow(run, KEYS)


def _batch(held: list[tuple[np.ndarray, ...]], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held)], names=[f.split()[0] for f in schema.split(", ")])


def guides_of(df: DataFrame, id_col: str, seq_col: str, k: int, guide: str) -> DataFrame:
    """(id, pos, over) of each guide, with or without a key."""
    scan = GUIDES[guide]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                g = scan((s or "").upper(), k)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(g), pa.int64()), pa.array([x[0] for x in g], pa.int64()), pa.array([x[1] for x in g], pa.bool_())], names=["id", "pos", "over"])

    return df.select(F.col(id_col).cast("long"), F.col(seq_col)).mapInArrow(run, "id long, pos long, over boolean")


def few_keys(only: DataFrame) -> np.ndarray | None:
    """The keys of a table in order, or None if there are more than FILTER_KEYS."""
    keys = only.select("key").distinct().limit(FILTER_KEYS + 1).toArrow().column(0)  # 8 MB at most
    return np.sort(keys.to_numpy()) if len(keys) <= FILTER_KEYS else None


def among(key: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted array."""
    return some[np.minimum(np.searchsorted(some, key), len(some) - 1)] == key if len(some) else np.zeros(len(key), bool)


def picker(some: np.ndarray, bits: int) -> Callable[[np.ndarray], np.ndarray]:
    """Which keys are in a sorted array; short keys are looked up in a table (16 MB) instead of searched."""
    if bits > DENSE_BITS:
        return lambda key: among(key, some)
    held = np.zeros(1 << bits, bool)
    held[some[(some >= 0) & (some < 1 << bits)]] = True
    return lambda key: held[key]


def of_keys(df: DataFrame, only: DataFrame, col: str = "key") -> DataFrame:
    """Rows with one of the keys (or other values) of a table; up to FILTER_KEYS of them travel to the tasks."""
    keys = cut(only.select(col).distinct())
    return df.join(F.broadcast(keys) if keys.count() <= FILTER_KEYS else keys, col, "left_semi")


def postings(contigs: DataFrame, k: int, encoding_name: str = "bitwise", guide: str = "default", only: DataFrame | None = None) -> DataFrame:
    """(key, gpos, contig_id, cpos); contigs need contig_id, seq and start.

    only: a table of keys; others are left out. If it has at most FILTER_KEYS keys they travel to the tasks, so that
    other postings are never made; a larger table is joined.
    """
    some, bits = None if only is None else few_keys(only), encoding(encoding_name, k).bits(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        wanted = None if some is None else picker(some, bits)
        for i, start, p, key, _ in _encoded(batches, k, encoding_name, guide):
            if wanted is not None:
                ok = wanted(key)
                p, key = p[ok], key[ok]
            held.append((key, p + start, np.full(len(p), i, np.int64), p))
            size += len(p)
            if size >= PIECE:
                yield _batch(held, POSTINGS)
                held, size = [], 0
        if held:
            yield _batch(held, POSTINGS)

    out = contigs.select(F.col("contig_id").cast("long"), "seq", F.col("start").cast("long")).mapInArrow(run, POSTINGS)
    return out if only is None or some is not None else out.join(only.select("key").distinct(), "key", "left_semi")


def last_places(contigs: DataFrame, k: int, encoding_name: str, guide: str, only: DataFrame) -> DataFrame:
    """(key, gpos) of the last posting of each key of a table.

    Up to FILTER_KEYS keys travel to the tasks, which keep one place for each, so that no postings are made.
    """
    some, bits = few_keys(only), encoding(encoding_name, k).bits(k)
    if some is None:
        return postings(contigs, k, encoding_name, guide, only).groupBy("key").agg(F.max("gpos").alias("gpos"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, last = picker(some, bits), np.full(len(some), -1, np.int64)
        for _, start, p, key, _ in _encoded(batches, k, encoding_name, guide):
            ok = wanted(key)
            np.maximum.at(last, np.searchsorted(some, key[ok]), p[ok] + start)
        each = np.flatnonzero(last >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(some[each]), pa.array(last[each])], names=["key", "gpos"])

    each = contigs.select(F.col("contig_id").cast("long"), "seq", F.col("start").cast("long")).mapInArrow(run, "key long, gpos long")
    return each.groupBy("key").agg(F.max("gpos").alias("gpos"))


def sizes_of(contigs: DataFrame, k: int, encoding_name: str = "bitwise", guide: str = "default", only: DataFrame | None = None) -> DataFrame:
    """(key, size) of all keys of contigs(contig_id, seq), without making postings: tasks count before anything is dealt out.

    only: a table of keys; others are left out.
    """
    bits = encoding(encoding_name, k).bits(k)
    if only is None and bits <= DENSE_BITS:
        return _dense_sizes(contigs, k, encoding_name, guide, bits)
    some = None if only is None else few_keys(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            each, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(each), pa.array(n)], names=["key", "n"])

        for _, _, _, key, _ in _encoded(batches, k, encoding_name, guide):
            held.append(key)
            size += len(key)
            if size >= 4 * PIECE:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    def run_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, total = picker(some, bits), np.zeros(len(some), np.int64)
        held, size = [], 0
        for _, _, _, key, _ in _encoded(batches, k, encoding_name, guide):
            held.append(key[wanted(key)])
            size += len(held[-1])
            if size >= PIECE:
                total += np.bincount(np.searchsorted(some, np.concatenate(held)), minlength=len(some))
                held, size = [], 0
        if size:
            total += np.bincount(np.searchsorted(some, np.concatenate(held)), minlength=len(some))
        each = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some[each]), pa.array(total[each])], names=["key", "n"])

    counts = contigs.select(F.col("contig_id").cast("long"), "seq").mapInArrow(run if some is None else run_some, "key long, n long")
    out = counts.groupBy("key").agg(F.sum("n").alias("size"))
    return out if only is None or some is not None else of_keys(out, only)


def _dense_sizes(contigs: DataFrame, k: int, encoding_name: str, guide: str, bits: int) -> DataFrame:
    """Sizes of short keys: each task counts all that it reads, and sends a row of packed counts for each range of keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = None, [], 0
        for _, _, _, key, _ in _encoded(batches, k, encoding_name, guide):
            held.append(key)
            size += len(key)
            if size >= 4 * PIECE:
                counts = np.zeros(1 << bits, np.uint32) if counts is None else counts
                for x in held:
                    np.add.at(counts, x, 1)
                held, size = [], 0
        if counts is not None:
            for x in held:
                np.add.at(counts, x, 1)
            each = np.flatnonzero(counts)
            n = counts[each]
        elif held:
            each, n = np.unique(np.concatenate(held), return_counts=True)
        else:
            return
        ends = [0, *(np.flatnonzero(np.diff(each >> ROW_BITS)) + 1).tolist(), len(each)]
        at, low, num = [], [], []
        for a, e in zip(ends, ends[1:]):
            if a == e:
                continue
            at.append(int(each[a] >> ROW_BITS))
            low.append((each[a:e] & ((1 << ROW_BITS) - 1)).astype("<u2").tobytes())
            num.append(n[a:e].astype("<u1" if n[a:e].max() < 1 << 8 else "<u2" if n[a:e].max() < 1 << 16 else "<u4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(low, pa.binary()), pa.array(num, pa.binary())], names=["at", "low", "n"])

    def summed(t: pa.Table) -> pa.Table:
        total = np.zeros(1 << ROW_BITS, np.int64)
        for low, n in zip(t.column("low"), t.column("n")):
            where, n = np.frombuffer(low.as_py(), "<u2"), n.as_py()
            total[where] += np.frombuffer(n, f"<u{len(n) // len(where)}")
        each = np.flatnonzero(total)
        return pa.table({"key": pa.array((t.column("at")[0].as_py() << ROW_BITS) + each, pa.int64()), "size": pa.array(total[each], pa.int64())})

    parts = contigs.select(F.col("contig_id").cast("long"), "seq").mapInArrow(run, "at long, low binary, n binary")
    return parts.groupBy("at").applyInArrow(summed, "key long, size long")


def key_sizes(post: DataFrame) -> DataFrame:
    return post.groupBy("key").agg(F.count(F.lit(1)).alias("size"))


def prefix_offsets(sizes: DataFrame) -> DataFrame:
    """Where a key's postings begin in key order: ranges of keys are summed first."""
    s = sizes.withColumn("_r", F.floor(F.col("key") / RANGE))
    ranges = s.groupBy("_r").agg(F.sum("size").alias("_n"))
    ranges = ranges.select("_r", F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = W.partitionBy("_r").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    return s.join(ranges, "_r").select("key", "size", (F.col("_base") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("offset"))


def size_dump(sizes: DataFrame, total_keys: int) -> DataFrame:
    """(key, size) of every key that there can be, 0 for those without postings."""
    every = sizes.sparkSession.range(total_keys).withColumnRenamed("id", "key")
    return every.join(sizes, "key", "left").select("key", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def drop_heavy_keys(sizes: DataFrame, limit: int) -> DataFrame:
    return sizes.where(F.col("size") < limit)


def cut_of(size: Column) -> Column:
    """The least cut point that is not below a size; null above the last."""
    return F.when(size < 100, size).when(size <= CUTS[-1], F.expr(f"array_min(filter(array({','.join(f'{c}L' for c in CUTS[100:])}), c -> c >= size))"))


def size_histogram(sizes: DataFrame, total_keys: int) -> DataFrame:
    """(cut, keys) over the whole key space; keys without postings are at 0."""
    held = sizes.groupBy(cut_of(F.col("size")).cast("long").alias("cut")).agg(F.count(F.lit(1)).alias("keys"))
    empty = sizes.agg((F.lit(total_keys) - F.count(F.lit(1))).cast("long").alias("keys")).select(F.lit(0).cast("long").alias("cut"), "keys")
    return held.unionByName(empty).groupBy("cut").agg(F.sum("keys").alias("keys"))


def key_stats(sizes: DataFrame) -> DataFrame:
    """Mean and sample deviation of log10(size); the deviation of one key is 0."""
    return sizes.where("size > 0").agg(F.count(F.lit(1)).alias("keys"), F.avg(F.log10("size")).alias("mean_log10"), F.coalesce(F.when(F.count(F.lit(1)) > 1, F.stddev_samp(F.log10("size"))), F.lit(0.0)).alias("sd_log10"))


def q95(sizes: DataFrame, default: int = 200) -> DataFrame:
    """The first cut at which the keys with postings so far reach 95 % (rounded down) of all."""
    hist = sizes.where("size > 0").groupBy(F.coalesce(cut_of(F.col("size")).cast("long"), F.lit(1 << 40)).alias("cut")).agg(F.count(F.lit(1)).alias("n"))
    run = W.orderBy("cut").rowsBetween(W.unboundedPreceding, 0)  # as many rows as there are cut points
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cum = hist.select("cut", F.sum("n").over(run).alias("so_far"), F.sum("n").over(every).alias("total"))
    return cum.where(F.col("so_far") >= F.floor(F.col("total") * 95 / 100)).agg(F.coalesce(F.min("cut"), F.lit(default).cast("long")).alias("q95"))


def meta_of(contigs: DataFrame, sizes: DataFrame, k: int, encoding_name: str, guide: str) -> IndexMeta:
    """The header; reads three one-row aggregates to the driver."""
    s, q = key_stats(sizes).first(), q95(sizes).first()
    size = contigs.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    return IndexMeta(k, encoding_name, guide, int(size), float(s.mean_log10 or 0.0), float(s.sd_log10 or 0.0), int(q.q95))


def locate_contig(positions: DataFrame, contigs: DataFrame, gpos: str = "gpos", width: int = 1 << 20) -> DataFrame:
    """Adds contig_id and cpos of global positions: contigs are listed in the blocks that they touch, so it is an equi-join."""
    blocks = contigs.where("end > start").select("contig_id", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_b"))
    out = positions.withColumn("_b", F.floor(F.col(gpos) / width)).join(blocks, "_b")
    return out.where((F.col(gpos) >= F.col("start")) & (F.col(gpos) < F.col("end"))).withColumn("cpos", F.col(gpos) - F.col("start")).drop("_b", "start", "end")


def exon_postings(post: DataFrame, exons: DataFrame, k: int, width: int = 4096) -> DataFrame:
    """Postings of a pseudo-genome with the exon that holds the key: a range join by blocks.

    contig_id is the gene; exons(exon_id, gene_id, phy_start, phy_end) with inclusive ends.
    """
    blocks = exons.select("exon_id", F.col("gene_id").alias("contig_id"), "phy_start", "phy_end", F.explode(F.sequence(F.floor(F.col("phy_start") / width), F.floor(F.col("phy_end") / width))).alias("_b"))
    out = post.withColumn("_b", F.floor(F.col("cpos") / width)).join(blocks, ["contig_id", "_b"])
    return out.where("cpos between phy_start and phy_end").drop("_b", "phy_start", "phy_end")


@dataclass
class Index:
    meta: IndexMeta
    contigs: DataFrame
    postings: DataFrame
    sizes: DataFrame
    #: Makes, or reads, the postings of some keys on some contigs; None if they are taken from `postings`.
    make: Callable[[DataFrame, DataFrame], DataFrame] | None = None
    #: Gives (key, gpos) of the last posting of some keys without making the others; None if it is found among postings.
    ends: Callable[[DataFrame], DataFrame] | None = None

    def of(self, keys: DataFrame, contigs: DataFrame | None = None) -> DataFrame:
        """The postings of some keys, on some contigs (contig_id) or on all; if the index is not stored, others are never made."""
        if self.make:
            return self.make(keys, self.contigs if contigs is None else of_keys(self.contigs, contigs, "contig_id"))
        return of_keys(self.postings if contigs is None else of_keys(self.postings, contigs, "contig_id"), keys)

    def last(self, keys: DataFrame) -> DataFrame:
        """(key, gpos) of the last posting of each of some keys that has any."""
        return self.ends(keys) if self.ends else self.of(keys).groupBy("key").agg(F.max("gpos").alias("gpos"))

    def without_heavy_keys(self, limit: int) -> Index:
        sizes = drop_heavy_keys(self.sizes, limit)
        return Index(self.meta, self.contigs, self.postings.join(sizes.select("key"), "key", "left_semi"), sizes, lambda keys, own: self.of(keys.join(sizes.select("key"), "key", "left_semi"), own))


def build_index(contigs: DataFrame, k: int, encoding_name: str = "bitwise", guide: str = "default") -> Index:
    own = contigs if "start" in contigs.columns else with_offsets(contigs)
    post = postings(own, k, encoding_name, guide)
    sizes = stored(sizes_of(own, k, encoding_name, guide), "sizes")  # the header reads them too
    return Index(meta_of(own, sizes, k, encoding_name, guide), own, post, sizes, lambda keys, some: postings(some, k, encoding_name, guide, keys), lambda keys: last_places(own, k, encoding_name, guide, keys))


def save_index(index: Index, path: str) -> None:
    """Parquet tables, postings (key and place on the genome) in order, and a header; sizes are derived once."""
    put = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
    put(index.contigs, "contigs")
    put(index.postings.select("key", "gpos").repartitionByRange(F.col("key")).sortWithinPartitions("key", "gpos"), "postings")
    put(index.sizes, "sizes")
    spark = index.contigs.sparkSession
    spark.range(1).select(F.lit(json.dumps(asdict(index.meta))).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str, k: int | None = None) -> Index:
    """The header's key size holds; another one that is asked for is ignored with a warning."""
    meta = IndexMeta(**json.loads(spark.read.text(f"{path}/meta").first().value))
    if k is not None and k != meta.k:
        import warnings

        warnings.warn(f"the index has keys of {meta.k} letters; {k} is ignored", stacklevel=2)
    own, post, sizes = (spark.read.parquet(f"{path}/{t}") for t in ("contigs", "postings", "sizes"))

    def make(keys: DataFrame, some: DataFrame) -> DataFrame:
        return locate_contig(of_keys(post, keys), some).select("key", "gpos", "contig_id", "cpos")

    return Index(meta, own, locate_contig(post, own).select("key", "gpos", "contig_id", "cpos"), sizes, make)


def total_keys(encoding_name: str, k: int) -> int:
    return ENCODINGS[encoding_name].total_keys(k)
