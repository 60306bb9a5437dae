"""GTF and GFF annotation, and files of guides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmap.functions.guides import StateGuide, TupleGuide

GTF = "seqname string, source string, feature string, start long, end long, score string, strand string, frame string, attributes string"


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """Rows with gene_id and transcript_id, which may be quoted or not."""
    t = spark.read.csv(path, sep="\t", comment="#", schema=GTF, quote="")
    value = lambda key: F.regexp_extract("attributes", rf'(?:^|[;\s]){key} "?([^";]+)"?', 1)
    return t.withColumns({"gene_id": value("gene_id"), "transcript_id": value("transcript_id")})


def by_order(gtf: DataFrame, contigs: DataFrame) -> DataFrame:
    """Renames sequences to contigs in order of appearance, for annotations that use other names."""
    from pyspark.sql import Window as W

    rows = gtf.withColumn("_n", F.monotonically_increasing_id())
    names = rows.groupBy("seqname").agg(F.min("_n").alias("_n")).withColumn("_k", F.row_number().over(W.orderBy("_n")))  # a row for each contig
    own = contigs.select("contig_id", F.col("name").alias("_name")).withColumn("_k", F.row_number().over(W.orderBy("contig_id"))).select("_k", "_name")
    return rows.join(names.join(own, "_k").select("seqname", "_name"), "seqname").withColumn("seqname", F.col("_name")).drop("_name", "_n")


def _rows(text: str) -> list[list[str]]:
    return [x.split() for x in text.splitlines() if x.strip() and not x.startswith("#")]


def parse_tuple_guide(text: str) -> TupleGuide:
    """Name, longest stretch without guide, symmetry and tuple size, one a line; then tuple, whether a guide, advance."""
    rows = _rows(text)
    name, longest, _, size = (r[0] for r in rows[:4])
    body = [r for r in rows[4:] if len(r) >= 3]
    return TupleGuide(name, int(size), frozenset(r[0].upper() for r in body if r[1] == "1"), int(longest), {r[0].upper(): int(r[2]) for r in body})


def parse_state_guide(text: str) -> StateGuide:
    """The same header; then state and its next states for A, C, G, T, N and others."""
    rows = _rows(text)
    name, longest, _, size = (r[0] for r in rows[:4])
    return StateGuide(name, {int(r[0]): tuple(map(int, r[1:7])) for r in rows[4:]}, int(size), int(longest))
