"""Shared pieces of the corpus operators: scratch tables, text batches, 64-bit hashing."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmap.session import shared_dir

#: Bytes of text that one vectorised step holds at once (a longer document is one step).
STEP_BYTES = 1 << 19
#: Bytes of a batch that a Python worker gets, or gives, at once (a longer row is one batch).
BATCH_BYTES = 1 << 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Intermediate tables of one operator.

    `keep` holds a table on the executors' disks: a lost executor's part is computed again from its inputs. `save`
    writes one to the shared folder, which also cuts the plan and sets free what it was shuffled from.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.kept: dict[str, DataFrame] = {}
        self.saved: set[str] = set()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df = df.persist(StorageLevel.DISK_ONLY)
        df.count()
        self.kept[name] = df
        return df

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        self.saved.add(name)
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        fs = None
        for name in names:
            if name in self.kept:
                self.kept.pop(name).unpersist()
                continue
            if name not in self.saved:
                continue
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            fs = fs or path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)


def free(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of tables that nothing refers to any more, and shrinks the driver.

    A collection of the whole heap shrinks it to what is used. What the driver's JVM has freed outside its heap the C
    library keeps in an arena for each of many threads, until it is told to give it back; JVMs without such a command
    keep it.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    trim_jvm(spark)
    release()


def trim_jvm(spark: SparkSession) -> None:
    """Gives what the driver's JVM has freed outside its heap back to the system, by its own command."""
    sc = spark.sparkContext
    jvm, array = sc._jvm, sc._gateway.new_array
    named = jvm.java.lang.Class.forName
    kinds, values = array(jvm.java.lang.Class, 4), array(jvm.java.lang.Object, 4)
    for k, (kind, value) in enumerate(
        (
            ("javax.management.ObjectName", jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")),
            ("java.lang.String", "systemTrimNativeHeap"),
            ("[Ljava.lang.Object;", array(jvm.java.lang.Object, 0)),
            ("[Ljava.lang.String;", array(jvm.java.lang.String, 0)),
        )
    ):
        kinds[k], values[k] = named(kind), value
    # the server's class is not public, so it is called by the interface's method
    call = named("javax.management.MBeanServer").getMethod("invoke", kinds)
    with suppress(Py4JJavaError):  # a JVM without the command
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Tables that are made meanwhile go to Python in batches of BATCH_BYTES at most; the session's own limit comes back after.

    A batch is held twice by the JVM and twice by its worker, so the default of 64 MB is much for tasks that share a node.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Gives a process's unused memory back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidy(run: Run) -> Run:
    """The same; a worker that waits for its next task after it keeps no unused memory."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return tidied


def parts(b: pa.RecordBatch, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about `most` bytes."""
    rows = max(1, b.num_rows * most // max(1, b.nbytes))
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def distinct_ids(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Documents with ids that name one text each, and (doc_id, own_id) to come back, or None if they are so already.

    Where an id is null or has several rows, each distinct (id, text) gets a new id in the order of ids, nulls first,
    and of the texts' hashes.
    """
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return docs, None
    named = docs.select(F.col("doc_id").alias("own_id"), *[c for c in docs.columns if c != "doc_id"]).withColumn("text_hash", F.xxhash64("text"))
    order = (F.col("own_id").asc_nulls_first(), "text_hash")
    ids = named.select("own_id", "text_hash").distinct().repartitionByRange(*order).sortWithinPartitions(*order)
    ids = scratch.save(ids.withColumn("doc_id", F.monotonically_increasing_id()), "ids")
    same = named.own_id.eqNullSafe(ids.own_id) & (named.text_hash == ids.text_hash)
    return named.join(ids, same).select(ids.doc_id, *[named[c] for c in docs.columns if c != "doc_id"]), ids.select("doc_id", "own_id")


def own_ids(result: DataFrame, back: DataFrame | None) -> DataFrame:
    """A result with the ids that `distinct_ids` replaced."""
    if back is None:
        return result
    return result.join(back, "doc_id").select(F.col("own_id").alias("doc_id"), *[c for c in result.columns if c != "doc_id"])


def text_of(texts: pa.Array) -> pa.Array:
    return pc.fill_null(texts, "") if texts.null_count else texts


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow string array and the n + 1 offsets of its rows."""
    texts = text_of(texts)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, at, data = texts.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(at, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser; wraps on overflow."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SALTS = mix(np.arange(101, 133, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _IS_SPACE, first_bytes: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words `[^\\x20\\x09-\\x0D]+` of each row, A-Z lower-cased, and offsets of the rows in them.

    Each (byte, place in the word) pair has a random value; a word's hash is their mixed sum. first_bytes: only so many
    bytes of a word count. A row longer than a step is read in parts that end between words, if it has such a place.
    """
    lo, hi = int(offsets[0]), int(offsets[-1])
    if len(offsets) == 2 and hi - lo > STEP_BYTES:
        parts, a = [], lo
        while a < hi:
            b = min(hi, a + STEP_BYTES)
            while b < hi and not between[data[b]]:
                gaps = np.flatnonzero(between[data[b : b + STEP_BYTES]])
                b = b + int(gaps[0]) if len(gaps) else min(hi, b + STEP_BYTES)
            parts.append(_word_hashes(data, np.array([a, b]), between, first_bytes)[0])
            a = b
        out = np.concatenate(parts)
        return out, np.array([0, len(out)])
    return _word_hashes(data, offsets, between, first_bytes)


def _word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray, first_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    lo, hi = int(offsets[0]), int(offsets[-1])
    raw = data[lo:hi]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~between[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[:-1] - lo
    cuts = cuts[cuts < len(raw)]
    first[cuts] = inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, starts)
    lens = np.diff(np.append(begin, len(at)))
    place = np.arange(len(at), dtype=np.int64) - np.repeat(begin, lens)
    each = mix((place.astype(np.uint64) << np.uint64(8)) + _LOWER[raw[at]] + np.uint64(0x9E3779B97F4A7C15))
    if first_bytes:
        each[place >= first_bytes] = 0
    return mix(np.add.reduceat(each, begin)), np.searchsorted(starts, offsets - lo)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's word n-grams; a shorter row is one gram, an empty one none."""
    words, rows = word_hashes(data, offsets)
    n = len(words)
    if n >= width:
        grams = np.full(n - width + 1, np.uint64(width) * _SALTS[31])
        for k in range(width):
            grams += words[k : n - width + 1 + k] * _SALTS[k]
        grams = mix(grams)
    out = []
    for i, j in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if j - i >= width:
            out.append(np.unique(grams[i : j - width + 1]))
        elif j > i:
            acc = np.uint64(j - i) * _SALTS[31 : 32] + (words[i:j] * _SALTS[: j - i]).sum(dtype=np.uint64)
            out.append(mix(acc))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(items: np.ndarray) -> int:
    """A signed 64-bit digest of a set of hashes, given sorted."""
    if not len(items):
        return 0
    x = mix(items + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) + np.uint64(len(items)) * _SALTS[30]
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def plain(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra columns with clashing names never reach the operators."""
    return df.select(*[F.col(f"`{n}`") for n in names])
