"""Set algebra on candidate positions, relational: band joins, refinement, distinct diagonals, best with ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def band_join(a: DataFrame, b: DataFrame, on: list[str], width: int, a_pos: str = "gpos", b_pos: str = "gpos2") -> DataFrame:
    """Rows of a and b with equal `on` whose positions differ by at most `width`; dealt by blocks of the width."""
    step = max(1, width)
    at = F.floor(F.col(b_pos) / step)
    left = a.withColumn("_b", F.floor(F.col(a_pos) / step))
    right = b.withColumn("_b", F.explode(F.array(at - 1, at, at + 1)))
    return left.join(right, [*on, "_b"]).where(F.abs(F.col(a_pos) - F.col(b_pos)) <= width).drop("_b")


def band_refine(candidates: DataFrame, post: DataFrame, on: list[str], width: int, pos: str = "gpos") -> DataFrame:
    """Candidates that have a position of `post` within the width; a group whose candidates would all go keeps them."""
    other = post.select(*on, F.col(pos).alias("_p")).distinct()
    near = band_join(candidates.withColumnRenamed(pos, "_c"), other, on, width, "_c", "_p").drop("_p").distinct().withColumnRenamed("_c", pos)
    kept = near.select(*on).distinct()
    return near.select(*candidates.columns).unionByName(candidates.join(kept, on, "left_anti"))


def distinct_diagonals(candidates: DataFrame, order: list[Column] | None = None) -> DataFrame:
    """The first candidate of each (read, mate, strand, diagonal)."""
    w = W.partitionBy("read_num", "mate", "strand", "diag").orderBy(*(order or ["rpos", "gpos"]))
    return candidates.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def best_with_ties(scored: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """(by, best, ties): the greatest score and how many more rows have it, by two pre-aggregated passes in one."""
    return scored.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.max(F.struct(score, "_n")).alias("_m")).select(*by, F.col(f"_m.{score}").alias("best"), (F.col("_m._n") - 1).alias("ties"))


def unmapped(reads: DataFrame, mapped: DataFrame) -> DataFrame:
    """Reads for the next stage of a cascade."""
    return reads.join(mapped.select("read_num", "mate").distinct(), ["read_num", "mate"], "left_anti")
