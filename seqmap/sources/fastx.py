"""FASTA and FASTQ as a Python data source: spark.read.format("fastx").load(path).

A record begins with > or @; its name ends at the first white space and the rest of the line is a comment; sequences
may span lines; a quality string has the sequence's length. Plain and gzip files; a file is read by one task, as
records have no places where one could begin elsewhere.
"""

from __future__ import annotations

import glob
import gzip
import io
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, read_num long, name string, comment string, seq string, qual string"


class BadRecord(ValueError):
    pass


def records(lines: Iterator[str], lenient: bool = False) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, sequence, quality or None); junk before a record and short qualities stop a strict reader and are skipped by a lenient one."""
    line = next(lines, None)
    while line is not None:
        if not line[:1] or line[0] not in ">@":
            if line.strip() and not lenient:
                raise BadRecord(f"no record begins with {line[:20]!r}")
            line = next(lines, None)
            continue
        head = line[1:].split(None, 1)
        name, comment = (head[0] if head else ""), (head[1].strip() if len(head) > 1 else "")
        parts = []
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            parts.append(line.strip())
            line = next(lines, None)
        seq, qual = "".join(parts), None
        if line is not None and line[:1] == "+":
            got, line = [], next(lines, None)
            while line is not None and sum(map(len, got)) < len(seq):
                got.append(line.strip())
                line = next(lines, None)
            qual = "".join(got)
            if len(qual) != len(seq):
                if not lenient:
                    raise BadRecord(f"{name}: {len(seq)} letters and {len(qual)} qualities")
                continue
        yield name, comment, seq, qual


def lines_of(raw: bytes) -> Iterator[str]:
    data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    return iter(io.StringIO(data.decode("latin-1")).read().splitlines())


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class FastxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.lenient = options["path"], options.get("mode") == "lenient"

    def partitions(self) -> list[_File]:
        p = self.path.removeprefix("file://")
        found = sorted(glob.glob(os.path.join(p, "*"))) if os.path.isdir(p) else sorted(glob.glob(p))
        if not found:
            raise FileNotFoundError(self.path)
        return [_File(x) for x in found if os.path.isfile(x)]

    def read(self, part: _File) -> Iterator[tuple]:
        opened = gzip.open(part.path, "rt", encoding="latin-1") if part.path.endswith(".gz") else open(part.path, encoding="latin-1")
        with opened as f:
            for n, (name, comment, seq, qual) in enumerate(records((x.rstrip("\r\n") for x in f), self.lenient)):
                yield part.path, n, name, comment, seq, qual


class FastxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> FastxReader:
        return FastxReader(dict(self.options))


def read_fastx(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("mode", "lenient" if lenient else "strict").load(path)


def read_stored(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """The same from any store that Spark reads: whole files come as binary rows."""

    def run(rows: Iterator) -> Iterator:
        import pandas as pd

        for pdf in rows:
            for p, raw in zip(pdf["path"], pdf["content"]):
                got = [(p, n, *r) for n, r in enumerate(records(lines_of(bytes(raw)), lenient))]
                yield pd.DataFrame(got, columns=[f.split()[0] for f in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def contigs_from(fastx: DataFrame) -> DataFrame:
    """Contigs of one file, numbered as they stand; letters in upper case."""
    from pyspark.sql import functions as F

    return fastx.select(F.col("read_num").alias("contig_id"), "name", "comment", F.upper("seq").alias("seq"))
