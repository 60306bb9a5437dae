"""Mapping strategies: what turns a read's hits into candidate places, by one letter each.

Those that are set operations are DataFrame code; greedy ones run a kernel on the hits of one read at a time, in
Arrow groups bounded by the key-count limits. All give (read_num, mate, strand, contig_id, gpos, rpos, diag, votes).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmap.operators import kernels
from seqmap.operators.probe import read_keys
from seqmap.operators.verify import with_mismatches, with_reference

CANDIDATE = ["read_num", "mate", "strand", "contig_id", "gpos", "rpos", "diag", "votes"]
#: Ties that are acceptable, and that are too many.
FEW, MANY = 16, 128
FOUND = "read_num long, mate int, strand int, gpos long, rpos long, votes long"


@dataclass(frozen=True)
class MapParams:
    """Options of the mapper; the last four decide how reads are counted for genes."""

    k: int = 24
    low: int = 53
    high: int = 79
    insert: int = 1500
    max_key_distance: int = 3
    min_matches: int = 50
    min_key_counts: int = 4
    min_score_count: int = 10
    break_tie: bool = True
    limit_hits: int | None = None


@dataclass(frozen=True)
class Strategy:
    letter: str
    what: str
    run: Callable[[Probe], DataFrame]
    paired: bool = False
    #: The size above which it uses no key's positions; None if it may use all.
    most: Callable[[MapParams], int | None] = lambda p: None


@dataclass
class Probe:
    """What a strategy may use: hits (with size, key_idx, len), the reads and the contigs.

    A key above every limit of the strategies may be a single hit without a place.
    """

    hits: DataFrame
    reads: DataFrame
    contigs: DataFrame
    params: MapParams = field(default_factory=MapParams)
    longest: int | None = None
    keys: DataFrame | None = None

    def all_keys(self) -> DataFrame:
        """(read_num, mate, strand, …) of all keys of the reads, also of those without postings."""
        return self.keys if self.keys is not None else read_keys(self.reads, self.params.k)


STRATEGIES: dict[str, Strategy] = {}


def register_strategy(letter: str, what: str, run: Callable[[Probe], DataFrame], paired: bool = False, most: Callable[[MapParams], int | None] = lambda p: None) -> Strategy:
    STRATEGIES[letter] = Strategy(letter, what, run, paired, most)
    return STRATEGIES[letter]


def schedule(letters: str) -> list[Strategy]:
    unknown = [x for x in letters if x not in STRATEGIES]
    if unknown:
        raise ValueError(f"no strategy {''.join(unknown)}; there are {''.join(sorted(STRATEGIES))}")
    return [STRATEGIES[x] for x in letters]


def most_of(letters: str, p: MapParams) -> int | None:
    """The size above which no strategy of a schedule uses a key's positions."""
    each = [s.most(p) for s in schedule(letters)]
    return None if None in each else max(each, default=None)


def limits(p: MapParams) -> dict[str, int | None]:
    return {"half_low": p.low // 2, "low": p.low, "high": p.high, "ten": 10 * p.high, "all": None}


def below(hits: DataFrame, limit: int | None, least: int = 0) -> DataFrame:
    out = hits if limit is None else hits.where(F.col("size") < limit)
    return out.where(F.col("size") >= least) if least else out


# ---- relational strategies


def blast_like(p: Probe, limit: int | None, enough: int, least: int = 0) -> DataFrame:
    """Keys of both strands from the least frequent on; whole reads are compared at each hit, and the best distance stays.

    Keys end after the first whose hits reach `enough` per cent. A distance counts up to an eighth of the read and one.
    """
    h = below(p.hits, limit, least)
    order = W.partitionBy("read_num", "mate").orderBy("size", "strand", "rpos")
    keys = h.select("read_num", "mate", "strand", "key_idx", "rpos", "size").distinct().withColumn("key_rank", F.row_number().over(order))
    h = h.join(keys.select("read_num", "mate", "strand", "key_idx", "key_rank"), ["read_num", "mate", "strand", "key_idx"])
    place = W.partitionBy("read_num", "mate", "strand", "diag").orderBy("key_rank")
    first = h.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")  # a place is compared once
    c = compared(first, p)
    c = c.where(F.col("err") <= F.shiftright("len", 3) + 1)
    by = W.partitionBy("read_num", "mate")
    good = F.floor((F.col("len") - F.col("err")) * 100 / F.col("len")) >= enough
    c = c.withColumn("_stop", F.min(F.when(good, F.col("key_rank"))).over(by)).where("_stop is null or key_rank <= _stop")
    c = c.withColumn("_best", F.min("err").over(by)).where("err = _best")
    return c.withColumn("votes", (F.col("len") - F.col("err")).cast("long")).select(*CANDIDATE)


def compared(candidates: DataFrame, p: Probe) -> DataFrame:
    """Candidates with seq of their strand, len, ref and err; those beyond a contig's ends go."""
    r = p.reads.select("read_num", "mate", "seq", "rseq", "len")
    c = candidates.join(r, ["read_num", "mate"]) if "seq" not in candidates.columns else candidates
    c = c.withColumn("seq", F.when(F.col("strand") == 1, F.col("rseq")).otherwise(F.col("seq"))).drop("rseq")
    if "cstart" not in c.columns:
        c = c.withColumn("cstart", F.col("cpos") - F.col("rpos"))
    return with_mismatches(with_reference(c, p.contigs, reach(p), F.col("cstart"), F.col("len")))


def reach(p: Probe) -> int:
    """A bound of read lengths for cutting the genome; longer reads would be cut, so it is read from the reads."""
    return p.longest if p.longest is not None else int(p.reads.agg(F.coalesce(F.max("len"), F.lit(0))).first()[0])


def diag_votes(p: Probe, limit: int | None) -> DataFrame:
    """Exact votes for diagonals, for each strand by itself: the most frequent ones, unless there are too many ties.

    All keys of a strand below the limit are used, also those without postings. The score is 80 for the share of votes
    (of five keys at least) and 20 for the share of keys that are used.
    """
    h = below(p.hits, limit)
    strand = ["read_num", "mate", "strand"]
    votes = h.groupBy(*strand, "contig_id", "diag").agg(F.count(F.lit(1)).alias("votes"), F.min_by(F.struct("gpos", "rpos"), F.struct("rpos", "gpos")).alias("at"))
    possible = p.all_keys().groupBy(*strand).agg(F.count(F.lit(1)).alias("possible"))
    over = p.hits.where(F.lit(False) if limit is None else F.col("size") >= limit).groupBy(*strand).agg(F.countDistinct("key_idx").alias("over"))
    keys = possible.join(over, strand, "left").select(*strand, "possible", (F.col("possible") - F.coalesce("over", F.lit(0))).alias("used"))
    by = W.partitionBy(*strand)
    v = votes.join(keys, strand).withColumn("_best", F.max("votes").over(by)).where("votes = _best")
    v = v.withColumn("ties", F.count(F.lit(1)).over(by) - 1)
    score = F.floor(F.col("votes") * 80 / F.greatest(F.col("used"), F.lit(5))) + F.floor(F.col("used") * 20 / F.col("possible"))
    v = v.withColumn("score", score).where(f"used > 1 or ties <= {FEW}")
    v = v.where(f"not (ties > {MANY} and score < 50)").where(f"not (votes < 4 and ties > {FEW})").where("not (ties > 0 and votes < 3 and used >= 6)")
    return v.select(*strand, "contig_id", F.col("at.gpos").alias("gpos"), F.col("at.rpos").alias("rpos"), "diag", "votes")


def tolerant_votes(hits: DataFrame, near: int = 9) -> DataFrame:
    """Votes of each diagonal and of those up to `near` away."""
    by = ["read_num", "mate", "strand"]
    exact = hits.groupBy(*by, "diag").agg(F.count(F.lit(1)).alias("votes"))
    w = W.partitionBy(*by).orderBy("diag").rangeBetween(-near, near)
    return exact.withColumn("near_votes", F.sum("votes").over(w))


def sweep_votes(hits: DataFrame, reads: DataFrame) -> DataFrame:
    """At each hit, how many keys have a posting from there to two reads' lengths on."""
    by = ["read_num", "mate", "strand"]
    a = hits.join(reads.select("read_num", "mate", "len"), ["read_num", "mate"])
    b = hits.select(*by, F.col("gpos").alias("g2"), F.col("key_idx").alias("k2"))
    step = 4096
    left = a.select(*by, "gpos", "len").distinct().withColumn("_b", F.explode(F.sequence(F.floor(F.col("gpos") / step), F.floor((F.col("gpos") + 2 * F.col("len")) / step))))
    right = b.withColumn("_b", F.floor(F.col("g2") / step))
    near = left.join(right, [*by, "_b"]).where("g2 >= gpos and g2 <= gpos + 2 * len")
    return near.groupBy(*by, "gpos").agg(F.countDistinct("k2").alias("keys"))


# ---- strategies by kernels


def by_kernel(p: Probe, kernel: Callable[[kernels.Read], list[kernels.Found]], limit: int | None = None) -> DataFrame:
    """Runs a kernel on each read's hits; keys at or above the limit keep their place without postings, as they count for order."""
    k = p.params.k
    h = p.hits.join(p.reads.select("read_num", "mate", "len"), ["read_num", "mate"]) if "len" not in p.hits.columns else p.hits
    own = h.select("read_num", F.col("mate").cast("int").alias("mate"), F.col("strand").cast("int").alias("strand"), "key_idx", "rpos", "size", "gpos", F.col("len").cast("long").alias("len"))

    def run(t: pa.Table) -> pa.Table:
        d = t.to_pydict()
        read = kernels.Read(d["len"][0], k)
        keys: dict[tuple[int, int], kernels.Key] = {}
        for s, i, r, g, n in sorted((s, i, r, -1 if g is None else g, n) for s, i, r, g, n in zip(d["strand"], d["key_idx"], d["rpos"], d["gpos"], d["size"])):
            if (s, i) not in keys:
                keys[s, i] = kernels.Key(r, [], n if g < 0 else 0)
                read.strands[s].append(keys[s, i])
            if g >= 0:
                keys[s, i].positions.append(g)
        found = [f for f in kernel(read) if f.gpos >= f.rpos]
        n = len(found)
        return pa.table({"read_num": pa.array(d["read_num"][:1] * n, pa.int64()), "mate": pa.array(d["mate"][:1] * n, pa.int32()), "strand": pa.array([f.strand for f in found], pa.int32()), "gpos": pa.array([f.gpos for f in found], pa.int64()), "rpos": pa.array([f.rpos for f in found], pa.int64()), "votes": pa.array([f.votes for f in found], pa.int64())})

    out = own.groupBy("read_num", "mate").applyInArrow(run, FOUND)
    places = p.hits.select("gpos", "contig_id").distinct()
    # a kernel may give a position that is no posting (moved by a read offset): those are located on the contigs
    known = out.join(places, "gpos")
    from seqmap.operators.index import locate_contig

    other = locate_contig(out.join(places, "gpos", "left_anti"), p.contigs).select(*out.columns, "contig_id")
    c = known.select(*out.columns, "contig_id").unionByName(other).withColumn("diag", F.col("gpos") - F.col("rpos"))
    first = W.partitionBy("read_num", "mate", "strand", "diag").orderBy("rpos", "gpos")
    c = c.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return c.select(*[F.col(x).cast("tinyint").alias(x) if x in ("mate", "strand") else F.col(x) for x in CANDIDATE])


def _register() -> None:
    for letter, which, enough in (("x", "half_low", 98), ("X", "low", 99), ("O", "all", 100)):
        register_strategy(letter, f"least frequent keys, whole reads, below {which}", lambda p, w=which, e=enough: blast_like(p, limits(p.params)[w], e), most=lambda p, w=which: limits(p)[w])
    register_strategy("o", "least frequent keys, whole reads, from low to high", lambda p: blast_like(p, p.params.high, 100, p.params.low), most=lambda p: p.high)
    families = [
        ("456", ("low", "high", "ten"), "keys from both ends", kernels.extremes),
        ("123", ("low", "high", "ten"), "keys half a read apart", kernels.half_apart),
        ("sSZ", ("low", "high", "ten"), "the two smallest keys", kernels.two_smallest),
        ("lLY", ("low", "high", "ten"), "the leftmost keys", kernels.leftmost),
        ("nN", ("low", "high"), "nested intersection", kernels.nested),
    ]
    for letters, which, what, kernel in families:
        for letter, w in zip(letters, which):
            # nested intersection also meets keys above its limit
            most = (lambda p: None) if kernel is kernels.nested else lambda p, w=w: limits(p)[w]
            register_strategy(letter, f"{what}, {w}", lambda p, w=w, kernel=kernel: by_kernel(p, lambda r, n=limits(p.params)[w]: kernel(r, n)), most=most)
    register_strategy("a", "smallest keys of both halves", lambda p: by_kernel(p, kernels.min_apart), most=lambda p: 200)
    for letter, w in (("h", "low"), ("H", "high"), ("J", "ten"), ("j", "all")):
        register_strategy(letter, f"diagonal clusters, {w}", lambda p, w=w: by_kernel(p, lambda r, n=limits(p.params)[w]: kernels.diagonal_clusters(r, n)), most=lambda p, w=w: limits(p)[w])
    for letter, w in (("b", "low"), ("B", "high"), ("V", "ten"), ("v", "all"), ("P", "all"), ("d", "low"), ("D", "high"), ("E", "ten")):
        register_strategy(letter, f"diagonal votes, {w}", lambda p, w=w: diag_votes(p, limits(p.params)[w]), most=lambda p, w=w: limits(p)[w])
    register_strategy("i", "votes for the largest list", lambda p: by_kernel(p, kernels.tree_votes), most=lambda p: 100)
    for letter, steps, w, dynamic in (("m", 2, "low", False), ("M", 5, "high", False), ("w", 3, "low", False), ("W", 5, "ten", True)):
        register_strategy(letter, f"moving window, {w}", lambda p, w=w, s=steps, d=dynamic: by_kernel(p, lambda r, n=limits(p.params)[w]: kernels.moving_window(r, n, s, d)), most=lambda p, w=w: limits(p)[w])
    for letter, limit in (("q", lambda p: 1 + p.low // 4), ("Q", lambda p: p.low), ("G", lambda p: p.high)):
        register_strategy(letter, "sweep over the genome", lambda p, f=limit: by_kernel(p, lambda r, n=f(p.params): kernels.sweep(r, n)), most=limit)
    for letter, w in (("u", "low"), ("U", "high"), ("c", "ten"), ("C", "all")):
        register_strategy(letter, f"keys of both mates, {w}", lambda p, w=w: mates(p, limits(p.params)[w]), paired=True, most=lambda p, w=w: limits(p)[w])


def mates(p: Probe, limit: int | None) -> DataFrame:
    """Hits of a mate with hits of the other on the opposite strand within the insert size; a band join over mates."""
    from seqmap.operators.candidates import band_join

    if p.reads.where("mate = 2").isEmpty():
        raise ValueError("this strategy needs paired reads")
    h = below(p.hits, limit)
    a = h.where("mate = 1")
    b = h.where("mate = 2").select("read_num", "contig_id", (1 - F.col("strand")).alias("strand"), F.col("gpos").alias("gpos2"), F.col("rpos").alias("rpos2"))
    pairs = band_join(a, b, ["read_num", "contig_id", "strand"], p.params.insert)
    one = pairs.select("read_num", F.lit(1).cast("tinyint").alias("mate"), "strand", "contig_id", "gpos", "rpos", "cpos")
    two = pairs.select("read_num", F.lit(2).cast("tinyint").alias("mate"), (1 - F.col("strand")).cast("tinyint").alias("strand"), "contig_id", F.col("gpos2").alias("gpos"), F.col("rpos2").alias("rpos"), (F.col("cpos") + F.col("gpos2") - F.col("gpos")).alias("cpos"))
    both = one.unionByName(two).withColumn("diag", F.col("gpos") - F.col("rpos")).where("diag >= 0").dropDuplicates(["read_num", "mate", "strand", "diag"])
    c = compared(both, p)
    by = W.partitionBy("read_num", "mate")
    c = c.withColumn("_best", F.min("err").over(by)).where("err = _best and err < len / 2")
    return c.withColumn("votes", (F.col("len") - F.col("err")).cast("long")).select(*CANDIDATE)


_register()

