"""Reads, their keys on both strands, and the probe of the index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmap.functions.sequences import n_count, revcomp, usable
from seqmap.operators.index import keys_of

READ = ("read_num", "mate")


def read_window(reads: DataFrame, start: int = 0, most: int | None = None) -> DataFrame:
    """Rows by number; skipped rows count for `most`."""
    out = reads.where(F.col("read_num") >= start)
    return out if most is None else out.where(F.col("read_num") < most)


def prepared(reads: DataFrame, k: int, upper: bool = False) -> DataFrame:
    """Reads with length, N count, reverse complement and reversed qualities; `usable` is false for those with too few letters."""
    r = reads if "mate" in reads.columns else reads.withColumn("mate", F.lit(1).cast("tinyint"))
    if upper:
        r = r.withColumn("seq", F.upper("seq"))
    s = F.col("seq")
    r = r.withColumns({"len": F.length(s), "n_count": n_count(s), "rseq": revcomp(s), "usable": usable(s, k)})
    return r.withColumn("rqual", F.reverse("qual")) if "qual" in r.columns else r


def zip_mates(first: DataFrame, second: DataFrame, strict: bool = False) -> DataFrame:
    """Both files' reads by number as mates 1 and 2; with `warn` where names differ, or without those pairs if strict."""
    base = F.regexp_replace("name", "/[12]$", "")
    names = first.select("read_num", base.alias("_a")).join(second.select("read_num", base.alias("_b")), "read_num")
    names = names.select("read_num", (F.col("_a") != F.col("_b")).alias("warn"))
    if strict:
        names = names.where("not warn")
    both = first.withColumn("mate", F.lit(1).cast("tinyint")).unionByName(second.withColumn("mate", F.lit(2).cast("tinyint")))
    return both.join(names, "read_num")


def read_keys(reads: DataFrame, k: int, encoding_name: str = "bitwise", guide: str = "default") -> DataFrame:
    """(read_num, mate, strand, key_idx, rpos, key) of usable reads; strand 1 is the reverse complement."""
    r = prepared(reads, k).where("usable")
    both = r.select((F.col("read_num") * 4 + F.col("mate") * 2 - 2).alias("id"), "seq").union(r.select((F.col("read_num") * 4 + F.col("mate") * 2 - 1).alias("id"), F.col("rseq")))
    keys = keys_of(both, "id", "seq", k, encoding_name, guide)
    rank = F.row_number().over(W.partitionBy("id").orderBy("pos")) - 1
    return keys.select(
        F.floor(F.col("id") / 4).alias("read_num"),
        (F.floor(F.col("id") / 2) % 2 + 1).cast("tinyint").alias("mate"),
        (F.col("id") % 2).cast("tinyint").alias("strand"),
        rank.alias("key_idx"),
        F.col("pos").alias("rpos"),
        "key",
    )


def sized(keys: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds the posting size of each key, 0 if it has none, and its rank by size in the read and strand."""
    out = keys.join(sizes, "key", "left").withColumn("size", F.coalesce("size", F.lit(0)).cast("long"))
    w = W.partitionBy("read_num", "mate", "strand").orderBy("size", "rpos")
    return out.withColumn("size_rank", F.row_number().over(w))


def hits(keys: DataFrame, post: DataFrame, sizes: DataFrame | None = None, below: int | None = None) -> DataFrame:
    """Keys joined with their postings: (…, size, gpos, contig_id, cpos, diag). Frequent keys go before the join, not after it.

    Spark broadcasts the reads' side when it is small by its own measure; otherwise both sides are dealt by key.
    """
    if sizes is not None:
        s = sizes if below is None else sizes.where(F.col("size") < below)
        keys = keys.join(s, "key")
    return keys.join(post, "key").withColumn("diag", F.col("gpos") - F.col("rpos")).where("diag >= 0")


def nearest_posting(targets: DataFrame, post: DataFrame, most: int, target: str = "target") -> DataFrame:
    """For (id, key, target): the posting of the key nearest to the target within `most`; of two equally near the lower.

    Positions are joined by blocks of `most`, so a frequent key's list is not gathered.
    """
    b = F.floor(F.col(target) / most)
    t = targets.withColumn("_b", F.explode(F.array(b - 1, b, b + 1)))
    p = post.select("key", "gpos", F.floor(F.col("gpos") / most).alias("_b"))
    near = t.join(p, ["key", "_b"]).where(F.abs(F.col("gpos") - F.col(target)) <= most)
    best = F.min_by("gpos", F.struct(F.abs(F.col("gpos") - F.col(target)), "gpos"))
    return near.groupBy("id", "key", target).agg(best.alias("gpos"))
