"""Mates: pair search within the insert size, classes of pairs, and the rows that are written for each class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmap.operators.candidates import band_join
from seqmap.operators.verify import with_mismatches, with_reference

INSERT = 1500
#: Bits of a row's flag.
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY = (1 << i for i in range(9))


def within_insert(one: DataFrame, two: DataFrame, insert: int = INSERT) -> DataFrame:
    """Pairs of placed mates (read_num, contig_id, strand, start, len, score) on opposite strands with an outer span of at most `insert`.

    Pairs are joined by blocks of the insert size. The composite score is the mean of both; the best pairs of a read
    stay, with the number of ties.
    """
    a = one.select("read_num", "contig_id", *[F.col(x).alias(f"a_{x}") for x in ("strand", "start", "len", "score")])
    b = two.select("read_num", "contig_id", *[F.col(x).alias(f"b_{x}") for x in ("strand", "start", "len", "score")])
    pairs = band_join(a, b, ["read_num", "contig_id"], insert, "a_start", "b_start").where("a_strand <> b_strand")
    span = F.greatest(F.col("a_start") + F.col("a_len"), F.col("b_start") + F.col("b_len")) - F.least("a_start", "b_start")
    pairs = pairs.withColumn("span", span).where(F.col("span") <= insert).withColumn("pair_score", F.floor((F.col("a_score") + F.col("b_score")) / 2))
    by = W.partitionBy("read_num")
    best = pairs.withColumn("_m", F.max("pair_score").over(by)).where("pair_score = _m").drop("_m")
    return best.withColumn("ties", F.count(F.lit(1)).over(by) - 1)


def mate_search(anchors: DataFrame, mate_hits: DataFrame, reads: DataFrame, contigs: DataFrame, reach: int, insert: int = INSERT) -> DataFrame:
    """Places of the unplaced mate near an anchor: its hits on the other strand within the insert, compared as a whole.

    anchors: (read_num, mate, contig_id, strand, start, len, score). A place is accepted below half of the letters
    mismatching; the score adds ten for each supporting key over the mate's keys.
    """
    h = mate_hits.select("read_num", "mate", F.col("strand").alias("m_strand"), "contig_id", "key_idx", (F.col("cpos") - F.col("rpos")).alias("m_start"))
    a = anchors.select("read_num", F.col("mate").alias("a_mate"), "contig_id", *[F.col(x).alias(f"a_{x}") for x in ("strand", "start", "len", "score")])
    near = band_join(a, h, ["read_num", "contig_id"], insert, "a_start", "m_start").where("a_mate <> mate and a_strand <> m_strand")
    keys = near.groupBy("read_num", "mate", "contig_id", "m_strand", "m_start", "a_mate", "a_strand", "a_start", "a_len", "a_score").agg(F.countDistinct("key_idx").alias("keys"))
    n_keys = mate_hits.groupBy("read_num", "mate").agg(F.countDistinct("strand", "key_idx").alias("n_keys"))
    r = reads.select("read_num", "mate", "len", F.col("seq").alias("fseq"), "rseq")
    c = keys.join(r, ["read_num", "mate"]).join(n_keys, ["read_num", "mate"]).withColumn("seq", F.when(F.col("m_strand") == 1, F.col("rseq")).otherwise(F.col("fseq")))
    c = c.withColumn("span", F.greatest(F.col("a_start") + F.col("a_len"), F.col("m_start") + F.col("len")) - F.least("a_start", "m_start")).where(F.col("span") <= insert)
    c = with_mismatches(with_reference(c.drop("fseq", "rseq"), contigs, reach, F.col("m_start"), F.col("len"))).where("err < len / 2")
    local = F.floor((F.col("len") - F.col("err")) * 100 / F.col("len"))
    c = c.withColumn("m_score", local).withColumn("pair_score", F.floor((F.col("a_score") + local) / 2) + F.floor(F.col("keys") * 10 / F.col("n_keys")))
    by = W.partitionBy("read_num")
    c = c.withColumn("_m", F.max("pair_score").over(by)).where("pair_score = _m").drop("_m", "seq", "ref")
    return c.withColumn("ties", F.count(F.lit(1)).over(by) - 1).withColumn("status", F.when(F.col("ties") > 0, "p").otherwise("P"))


def pair_class(placed1: Column, placed2: Column, proper: Column, anchor1: Column) -> Column:
    """How a pair came out, of which mate the search began from."""
    return (
        F.when(proper & anchor1, "R1R2")
        .when(proper, "R2R1")
        .when(placed1 & placed2, "Trans")
        .when(placed1, "R1")
        .when(placed2, "R2")
        .otherwise("Unmapped")
    )


def classes(reads: DataFrame, best: DataFrame, pairs: DataFrame) -> DataFrame:
    """(read_num, class) of every pair: by placed mates and whether a pair within the insert was found."""
    m = best.select("read_num", "mate").distinct().groupBy("read_num").agg(F.max(F.col("mate") == 1).alias("p1"), F.max(F.col("mate") == 2).alias("p2"))
    p = pairs.groupBy("read_num").agg(F.max(F.coalesce(F.col("a_mate"), F.lit(1)) == 1).alias("anchor1") if "a_mate" in pairs.columns else F.lit(True).alias("anchor1")).withColumn("proper", F.lit(True))
    out = reads.select("read_num").distinct().join(m, "read_num", "left").join(p, "read_num", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select("read_num", pair_class(no("p1"), no("p2"), no("proper"), no("anchor1")).alias("class"))


def summary(classed: DataFrame) -> DataFrame:
    """Reads of each class and their share in per cent."""
    n = classed.groupBy("class").agg(F.count(F.lit(1)).alias("reads"))
    return n.withColumn("percent", F.round(F.col("reads") * 100.0 / F.sum("reads").over(W.partitionBy()), 4))


def strategy_summary(reads: DataFrame, placed: DataFrame, letters: str) -> DataFrame:
    """(func, calls, hits, percent_hit, percent_fail) of each letter of a cascade that stops: a letter gets the reads that those before it left.

    reads: (read_num, mate) of usable reads; placed: map_reads' rows. Only counts by letter meet in one task.
    """
    hits = placed.groupBy("func").agg(F.countDistinct("read_num", "mate").alias("hits"))
    order = reads.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(letters))), "_i int, func string")
    total = reads.agg(F.count(F.lit(1)).alias("_all"))  # one row
    out = order.join(hits, "func", "left").withColumn("hits", F.coalesce("hits", F.lit(0)).cast("long")).crossJoin(F.broadcast(total))
    before = F.coalesce(F.sum("hits").over(W.orderBy("_i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = out.withColumn("calls", F.col("_all") - before)
    hit = F.col("hits") * 100.0 / F.when(F.col("calls") > 0, F.col("calls"))
    return out.select("func", "calls", "hits", F.round(hit, 3).alias("percent_hit"), F.round(100 - hit, 3).alias("percent_fail"))


def flag(paired: Column, mapped: Column, mate_mapped: Column, strand: Column, mate_strand: Column, mate: Column, strict: bool = False, proper: Column | None = None) -> Column:
    """The flag of a row. By default a mapped row counts as properly paired, also of single reads and far mates; strict keeps to the format's meaning."""
    bit = lambda c, b: F.when(c, b).otherwise(0)
    good = mapped if not strict else (proper if proper is not None else F.lit(False)) & mapped
    first = (mate == 1) if not strict else (mate == 1) & paired
    return (
        bit(paired, PAIRED)
        + bit(good, PROPER)
        + bit(~mapped, UNMAPPED)
        + bit(paired & ~mate_mapped, MATE_UNMAPPED)
        + bit(mapped & (strand == 1), REVERSE)
        + bit(paired & mate_mapped & (mate_strand == 1), MATE_REVERSE)
        + bit(first, READ1)
        + bit(mate == 2, READ2)
    ).cast("int")


def sam_rows(reads: DataFrame, best: DataFrame, contigs: DataFrame, strict: bool = False, read_group: str | None = None) -> DataFrame:
    """A row for each read and mate in the alignment format, and secondary rows for further places of the same score.

    reads: (read_num, mate, name, seq, rseq, qual?, rqual?, len); best: (read_num, mate, strand, contig_id, cstart,
    cigar, score, func, choice, …). The mapping quality is the score; positions are 1-based.
    """
    names = contigs.select("contig_id", F.col("name").alias("rname"))
    cols = ["strand", "contig_id", "start", "cigar", "cigar0", "score", "func", "choice"]
    b = best.select("read_num", "mate", *cols).join(names, "contig_id", "left")
    r = reads if "qual" in reads.columns else reads.withColumns({"qual": F.lit("*"), "rqual": F.lit("*")})
    r = r.select("read_num", "mate", "name", "seq", "rseq", "qual", "rqual", "len")
    mine = r.join(b, ["read_num", "mate"], "left").withColumn("mapped", F.col("cigar").isNotNull())
    first = b.where("choice = 1")
    other = r.select("read_num", (3 - F.col("mate")).cast("tinyint").alias("mate"), F.lit(True).alias("paired")).join(
        first.select("read_num", (3 - F.col("mate")).cast("tinyint").alias("mate"), *[F.col(c).alias(f"o_{c}") for c in ("strand", "contig_id", "start", "rname")]), ["read_num", "mate"], "left"
    )
    x = mine.join(other, ["read_num", "mate"], "left").withColumns({"paired": F.coalesce("paired", F.lit(False)), "o_mapped": F.col("o_start").isNotNull(), "second": F.coalesce(F.col("choice") > 1, F.lit(False))})
    same = F.col("contig_id") == F.col("o_contig_id")
    near = same & (F.abs(F.col("start") - F.col("o_start")) <= INSERT) & (F.col("strand") != F.col("o_strand"))
    flags = flag(F.col("paired"), F.col("mapped"), F.col("o_mapped"), F.col("strand"), F.col("o_strand"), F.col("mate"), strict, F.coalesce(near, F.lit(False)))
    reverse = F.col("strand") == 1
    text = lambda plain, turned: F.when(F.col("second"), "*").when(reverse, F.col(turned)).otherwise(F.col(plain))
    span = F.when(F.col("mapped") & F.col("o_mapped") & same, F.when(F.col("start") <= F.col("o_start"), F.col("len")).otherwise(-F.col("len"))).otherwise(0)
    out = x.select(
        F.col("name").alias("qname"),
        (flags + F.when(F.col("second"), SECONDARY).otherwise(0)).cast("int").alias("flag"),
        F.coalesce("rname", F.when(F.col("o_mapped"), F.col("o_rname")), F.lit("*")).alias("rname"),
        F.coalesce(F.col("start") + 1, F.when(F.col("o_mapped"), F.col("o_start") + 1), F.lit(0)).cast("long").alias("pos"),
        F.coalesce("score", F.lit(0)).cast("int").alias("mapq"),
        F.coalesce("cigar", F.lit("*")).alias("cigar"),
        F.when(~F.col("o_mapped"), "*").when(same | ~F.col("mapped"), "=").otherwise(F.col("o_rname")).alias("rnext"),
        F.coalesce(F.when(F.col("o_mapped"), F.col("o_start") + 1), F.lit(0)).cast("long").alias("pnext"),
        span.cast("long").alias("tlen"),
        text("seq", "rseq").alias("seq"),
        text("qual", "rqual").alias("qual"),
        (F.col("read_num") + 1).alias("rn"),
        F.coalesce("func", F.lit("-")).alias("af"),
        F.coalesce("cigar0", "cigar", F.lit("*")).alias("cr"),
    )
    if read_group is not None:
        kind = "i" if read_group.isdigit() else "Z"
        out = out.withColumn("rg", F.lit(f"RG:{kind}:{read_group}"))
    return out


def route_unmapped(rows: DataFrame, mode: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows for the file of unmapped reads) by how many mates are unmapped.

    0: all stay; 1: pairs with an unmapped mate go aside; 2: those with both; 3: the first kind is dropped; 4: the second.
    """
    self_out, mate_out = F.col("flag").bitwiseAND(UNMAPPED) > 0, F.col("flag").bitwiseAND(MATE_UNMAPPED) > 0
    single = F.col("flag").bitwiseAND(PAIRED) == 0
    any_, both = self_out | mate_out, self_out & (mate_out | single)
    gone = {0: F.lit(False), 1: any_, 2: both, 3: any_, 4: both}[mode]
    aside = rows.where(gone) if mode in (1, 2) else rows.where(F.lit(False))
    return rows.where(~gone), aside
