"""Genes and exons: distinct exons, layout of a pseudo-genome, voting of reads for genes, and counts."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqmap.functions.sequences import COMPLEMENTS, LETTERS, revcomp
from seqmap.operators.index import prefix_offsets

GAP = 3


def distinct_exons(gtf: DataFrame) -> DataFrame:
    """Exon rows of an annotation, once for each place of a gene."""
    return gtf.where("feature = 'exon'").select(F.col("seqname").alias("chr"), "start", "end", "strand", "gene_id").distinct()


def genes(gtf: DataFrame) -> DataFrame:
    """Extent, strand of the first row, and numbers of exons and transcripts of each gene."""
    e = gtf.where("feature = 'exon'")
    return e.groupBy(F.col("seqname").alias("chr"), "gene_id").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.min_by("strand", F.struct("start", "end", "strand")).alias("strand"),
        F.countDistinct("start", "end", "strand").alias("n_exons"),
        F.countDistinct("transcript_id").alias("n_transcripts"),
    )


def transcripts(gtf: DataFrame) -> DataFrame:
    return gtf.where("feature = 'exon'").groupBy("gene_id", "transcript_id").agg(F.countDistinct("start", "end", "strand").alias("n_exons"))


def layout(exons: DataFrame) -> DataFrame:
    """Places of exons in their pseudo-gene: in order of start, end and strand, GAP letters between; and whether one overlaps the last.

    exons: (gene_id, chr, start, end, strand), ends inclusive. phy_start and phy_end are 0-based and inclusive.
    """
    by = W.partitionBy("gene_id").orderBy("start", "end", "strand")
    size = F.col("end") - F.col("start") + 1
    before = F.coalesce(F.sum(size + GAP).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = exons.withColumn("exon_no", F.row_number().over(by)).withColumn("phy_start", before)
    out = out.withColumn("phy_end", F.col("phy_start") + size - 1)
    return out.withColumn("overlaps_prev", F.coalesce(F.col("start") < F.lag("end").over(by), F.lit(False)))


def pseudo_genes(placed: DataFrame, contigs: DataFrame) -> DataFrame:
    """(gene_id, seq): the exons' letters in layout order, NNN between; exons of the minus strand are reverse complements.

    A contig meets all its exons in one row, so its letters are not copied for each; the exons of genes on several
    contigs are cut one by one and gathered.
    """
    c = contigs.select(F.col("name").alias("chr"), F.col("seq").alias("_s"))
    of = W.partitionBy("gene_id")
    placed = placed.withColumn("_one", F.min("chr").over(of) == F.max("chr").over(of))
    far = placed.where("not _one")
    here = placed.where("_one").groupBy("chr").agg(F.sort_array(F.collect_list(F.struct("gene_id", "exon_no", "start", "end", "strand"))).alias("e")).join(c, "chr")
    schema = T.StructType([placed.schema["gene_id"], T.StructField("seq", T.StringType())])
    turned = str.maketrans(LETTERS, COMPLEMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for e, s in zip(b.column(0), b.column(1)):
                s, cols, genes, seqs = s.as_py(), e.values, [], []
                rows = zip(*(cols.field(n).to_pylist() for n in ("gene_id", "start", "end", "strand")))
                for gene, own in groupby(rows, lambda r: r[0]):
                    parts = []
                    for _, start, end, strand in own:
                        part = (s or "")[max(start - 1, 0) : max(start - 1, 0) + end - start + 1]
                        parts.append(part[::-1].translate(turned) if strand == "-" else part)
                    genes.append(gene)
                    seqs.append("" if s is None else ("N" * GAP).join(parts))
                yield pa.RecordBatch.from_arrays([pa.array(genes, cols.field("gene_id").type), pa.array(seqs, pa.string())], names=["gene_id", "seq"])

    near = here.select("e", "_s").mapInArrow(run, schema)
    return near if far.isEmpty() else near.unionByName(_gathered(far, c))


def _gathered(placed: DataFrame, c: DataFrame) -> DataFrame:
    part = F.substring("_s", F.col("start").cast("int"), (F.col("end") - F.col("start") + 1).cast("int"))
    e = placed.join(c, "chr").select("gene_id", "exon_no", F.when(F.col("strand") == "-", revcomp(part)).otherwise(part).alias("part"))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("exon_no", "part"))), lambda x: x["part"])  # bounded by the gene
    return e.groupBy("gene_id").agg(F.array_join(parts, "N" * GAP).alias("seq"))


def exon_table(placed: DataFrame) -> DataFrame:
    """The exons of a layout with exon_id, their number over all genes from 0 in order of gene and exon."""
    n = placed.groupBy(F.col("gene_id").alias("key")).agg(F.count(F.lit(1)).alias("size"))
    first = prefix_offsets(n).select(F.col("key").alias("gene_id"), F.col("offset").alias("_first"))
    return placed.join(first, "gene_id").withColumn("exon_id", F.col("_first") + F.col("exon_no") - 1).drop("_first")


def save_exons(exons: DataFrame, transcripts: DataFrame, path: str) -> None:
    """Tables of exons, in order of exon_id, and of transcripts."""
    exons.repartitionByRange("exon_id").sortWithinPartitions("exon_id").write.mode("overwrite").parquet(f"{path}/exons")
    transcripts.write.mode("overwrite").parquet(f"{path}/transcripts")


def load_exons(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exons, transcripts, first exon and number of exons of each gene)."""
    exons, own = (spark.read.parquet(f"{path}/{t}") for t in ("exons", "transcripts"))
    return exons, own, exons.groupBy("gene_id").agg(F.min("exon_id").alias("first_exon"), F.count(F.lit(1)).alias("exons"))


def effective_size(exons: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Places of a gene that an exon covers: islands of overlapping intervals, then their lengths."""
    by = W.partitionBy("gene_id").orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    isle = exons.withColumn("_new", F.when(reach.isNull() | (F.col(start) > reach), 1).otherwise(0)).withColumn("_isle", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    runs = isle.groupBy("gene_id", "_isle").agg((F.max(end) - F.min(start) + 1).alias("n"))
    return runs.groupBy("gene_id").agg(F.sum("n").alias("eff_size"))


def gene_votes(hits: DataFrame, keys: DataFrame, limit: int | None = None, min_keys: int = 4, min_score: int = 10, break_tie: bool = True) -> DataFrame:
    """(read_num, gene_id, votes, orientation, score) of reads that one gene wins.

    hits: (read_num, mate, strand, key_idx, size, gene_id, …); keys: all keys of the reads with their sizes. Mate 1
    forward goes with mate 2 reverse. A key votes once for each gene that it hits. Of two genes with the most votes,
    reads of odd number take the last to reach them, the others the first; of more none wins, nor if both orientations
    are equal.
    """
    h = hits if limit is None else hits.where(F.col("size") < limit)
    turn = ((F.col("strand") + F.col("mate") - 1) % 2).cast("int").alias("orientation")
    one = h.select("read_num", turn, "mate", "key_idx", "gene_id").distinct()
    gene = ["read_num", "orientation", "gene_id"]
    # the place, in order of mates and keys, of a gene's last vote is where it reached its count
    v = one.groupBy(*gene).agg(F.count(F.lit(1)).alias("votes"), F.max(F.struct("mate", "key_idx")).alias("reached"))
    top = v.groupBy("read_num", "orientation", "votes").agg(F.count(F.lit(1)).alias("n"), F.min_by("gene_id", F.struct("reached", "gene_id")).alias("first"), F.max_by("gene_id", F.struct("reached", "gene_id")).alias("last"))
    top = top.groupBy("read_num", "orientation").agg(F.max(F.struct("votes", "n", "first", "last")).alias("t")).select("read_num", "orientation", "t.*")
    odd = F.col("read_num") % 2 == 1
    pick = F.when(F.col("n") == 1, F.col("first")).when((F.col("n") == 2) & F.lit(break_tie), F.when(odd, F.col("last")).otherwise(F.col("first")))
    best = top.withColumn("gene_id", pick).groupBy("read_num").agg(F.max(F.struct("votes", "orientation", "gene_id")).alias("b"), F.count(F.lit(1)).alias("both"), F.min("votes").alias("less"))
    best = best.where("both = 1 or b.votes > less").select("read_num", "b.*").where("gene_id is not null")
    k = keys if limit is None else keys.where((F.col("size") > 0) & (F.col("size") < limit))
    valid = k.where("size > 0").select("read_num", turn, "mate", "key_idx").distinct().groupBy("read_num", "orientation").agg(F.count(F.lit(1)).alias("valid"))
    out = best.join(valid, ["read_num", "orientation"]).withColumn("score", F.floor(F.col("votes") * 100 / F.col("valid")))
    return out.where((F.col("votes") >= min_keys) & (F.col("score") >= min_score)).select("read_num", "gene_id", "votes", "orientation", "score")


def gene_counts(won: DataFrame) -> DataFrame:
    return won.groupBy("gene_id").agg(F.count(F.lit(1)).alias("reads"))


def exon_counts(won: DataFrame, hits: DataFrame) -> DataFrame:
    """Reads of each exon of their gene that any key of the winning orientation hits."""
    turn = ((F.col("strand") + F.col("mate") - 1) % 2).cast("int").alias("orientation")
    h = hits.select("read_num", turn, "gene_id", "exon_id").distinct()
    return h.join(won.select("read_num", "orientation", "gene_id"), ["read_num", "orientation", "gene_id"], "left_semi").groupBy("gene_id", "exon_id").agg(F.count(F.lit(1)).alias("reads"))


def gene_tpm(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Reads per place of each gene, scaled to a million over all; no reads at all give null."""
    g = sizes.join(counts, "gene_id", "left").withColumn("reads", F.coalesce("reads", F.lit(0)).cast("long"))
    total = g.agg(F.sum(F.col("reads") / F.col("eff_size")).alias("_all"))
    return g.crossJoin(F.broadcast(total)).withColumn("tpm", F.when(F.col("_all") > 0, F.col("reads") / F.col("eff_size") * 1e6 / F.col("_all"))).drop("_all")


def exon_tpm(exons: DataFrame) -> DataFrame:
    """exons(gene_id, exon_no, size, reads, overlaps_prev): of a run of overlapping exons only the densest counts in the total."""
    run = F.sum(F.when(F.col("overlaps_prev"), 0).otherwise(1)).over(W.partitionBy("gene_id").orderBy("exon_no").rowsBetween(W.unboundedPreceding, 0))
    e = exons.withColumn("_run", run).withColumn("_d", F.col("reads") / F.col("size"))
    total = e.groupBy("gene_id", "_run").agg(F.max("_d").alias("_d")).agg(F.sum("_d").alias("_all"))
    return e.crossJoin(F.broadcast(total)).withColumn("tpm", F.when(F.col("_all") > 0, F.col("_d") * 1e6 / F.col("_all"))).drop("_run", "_d", "_all")


def count_rows(won: DataFrame, reads: DataFrame) -> DataFrame:
    """Counted reads as alignment rows: the gene at place 0 with all letters matching."""
    r = reads.join(won, "read_num").withColumn("rev", (F.col("orientation") + F.col("mate") - 1) % 2 == 1)
    return r.select(F.col("name").alias("qname"), (F.lit(2) + F.when(F.col("rev"), 16).otherwise(0) + F.when(F.col("mate") == 2, 128).otherwise(64)).cast("int").alias("flag"), F.col("gene_id").alias("rname"), F.lit(0).cast("long").alias("pos"), F.col("score").cast("int").alias("mapq"), F.concat(F.col("len").cast("string"), F.lit("M")).alias("cigar"))
