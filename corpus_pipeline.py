"""The corpus pipeline: quality, near duplicates, repeated strings, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents. The stages define what happens to nulls, empty texts and repeated rows in their modules; rows
that repeat a doc_id are one document from the second stage on.
"""

from __future__ import annotations

import public_tokenizers as tok
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmap.llm.common import Scratch, plain, table
from seqmap.llm.dedup import dedup_docs
from seqmap.llm.packing import pack
from seqmap.llm.quality import filter_docs
from seqmap.llm.secrets import find, redact
from seqmap.llm.simjoin import near_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifiers call poor or toxic."""
    return filter_docs(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each component of near duplicates; documents of null id all stay.

    Of rows with one id the least stays, by text and then the other columns, so a stage that is run again keeps the same.
    """
    keep = near_components(docs).where("doc_id = component_id").select("doc_id")
    own = plain(docs, *COLUMNS)
    known = own.where("doc_id is not null").join(keep, "doc_id", "left_semi")
    least = F.min(F.struct(*[F.col(c) for c in COLUMNS[1:]])).alias("least")
    return known.groupBy("doc_id").agg(least).select("doc_id", "least.*").union(own.where("doc_id is null"))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out what an earlier document, or earlier text of the same, has already."""
    return dedup_docs(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets; the documents stay."""
    found = redact(find(plain(docs, *COLUMNS)))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 2048 tokens."""
    return pack(docs, tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("secret_scan", secret_scan),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
