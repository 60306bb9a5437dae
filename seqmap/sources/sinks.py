"""Outputs: alignment text with header, sequences, count tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COLUMNS = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")


def sam_line(rows: DataFrame) -> Column:
    tags = [F.concat(F.lit("rn:i:"), F.col("rn").cast("string")), F.concat(F.lit("af:A:"), F.col("af")), F.concat(F.lit("cr:Z:"), F.col("cr"))]
    lead = [F.col("rg")] if "rg" in rows.columns else []
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in COLUMNS], *lead, *tags, F.lit(""))


def sam_header(contigs: DataFrame, guide: str, encoding: str, source: str, read_group: str | None = None, command: str = "seqmap") -> list[str]:
    """A line for each contig, then comments; as many rows as there are contigs are read to the driver."""
    out = [f"@SQ\tSN:{r.name}\tLN:{r.n}" for r in contigs.select("name", F.length("seq").alias("n"), "contig_id").orderBy("contig_id").toLocalIterator()]
    out += [f"@CO\tguide:{guide}", f"@CO\tencoding:{encoding}", f"@CO\tsource:{source}"]
    if read_group:
        out.append("@RG\tID:" + read_group.encode().decode("unicode_escape"))
    return [*out, f"@PG\tID:seqmap\tPN:seqmap\tCL:{command}"]


def write_sam(rows: DataFrame, path: str, header: list[str] | None = None, gz: bool = False) -> None:
    """Text parts under path/rows and the header under path/header."""
    out = rows.select(sam_line(rows).alias("value")).write.mode("overwrite")
    (out.option("compression", "gzip") if gz else out).text(f"{path}/rows")
    if header is not None:
        rows.sparkSession.createDataFrame([(x,) for x in header], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")


def unmapped_fastq(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat_ws("\n", F.concat(F.lit("@"), F.col("qname")), "seq", F.lit("+"), "qual").alias("value"))


def fasta(seqs: DataFrame, name: str = "name", seq: str = "seq", width: int = 80) -> DataFrame:
    """Records as text, a sequence in lines of `width` letters."""
    body = F.array_join(F.regexp_extract_all(seq, F.lit(f"(.{{1,{width}}})"), F.lit(1)), "\n")
    return seqs.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), body).alias("value"))


def write_counts(counts: DataFrame, path: str) -> None:
    """A table with tabs and a header; rates with four decimals."""
    c = counts.withColumn("tpm", F.format_string("%.4f", "tpm")) if "tpm" in counts.columns else counts
    c.write.mode("overwrite").csv(path, sep="\t", header=True)


def base_name(path: str) -> str:
    """A file's path without the usual endings."""
    return re.sub(r"(\.(fasta|fastq|fa|fq|fna|gtf|gff3?|txt|gz))+$", "", path, flags=re.I)
