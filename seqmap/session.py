"""Session helper for scripts and tests; on a cluster the caller's own session is used."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group, before compression, of tables that are written to be read many times.
BLOCK_BYTES = 1 << 22


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", name: str = "seqmap") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session without one gets its own under /tmp."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (found or "/tmp/checkpoints").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to the shared checkpoint folder and goes on from there, so that stages' plans do not nest."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a large table compressed to a folder of its own below the shared one, and reads it from there.

    Row groups are small, so that many tasks share a table that few have written.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").option("parquet.block.size", BLOCK_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
