"""Reads as a stream of files: each batch is mapped by itself, as mapping a read needs no state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from seqmap.operators.index import Index
from seqmap.plans.mapper import map_reads
from seqmap.sources.fastx import SCHEMA, lines_of, records


def read_stream(spark: SparkSession, folder: str, lenient: bool = True) -> DataFrame:
    """New files of a folder, parsed to reads."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for p, raw in zip(pdf["path"], pdf["content"]):
                got = [(p, n, *r) for n, r in enumerate(records(lines_of(bytes(raw)), lenient))]
                yield pd.DataFrame(got, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content").mapInPandas(run, SCHEMA)


def map_stream(index: Index, stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None], letters: str = "x4s") -> StreamingQuery:
    """Maps each batch and gives it to the sink with its number; a batch that is run again gives the same rows."""

    def batch(df: DataFrame, n: int) -> None:
        sink(map_reads(index, df.select("read_num", "name", "seq", "qual"), letters), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
