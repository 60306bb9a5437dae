"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmap.llm.common import Scratch, tidy

#: Links that one task may join by itself (16 bytes each).
LOCAL_LINKS = 1 << 20
ROUNDS = 100
#: Groups of which a broadcast table has a row at most.
LARGE = 1 << 16


def components(links: DataFrame, scratch: Scratch, name: str, rows: int, local: int = LOCAL_LINKS) -> DataFrame:
    """rows links (a, b) -> (node, root): root is the smallest node that links reach; nodes without links are left out.

    Few links are joined in one task. More are joined in rounds of large and small stars.
    """
    if rows <= local:
        return scratch.save(joined(links), f"{name}_roots")
    return scratch.save(stars(links, scratch, name, rows), f"{name}_roots")


def beside(df: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """df with an aggregate of each group beside its rows.

    Large groups, of which there are LARGE at most, get theirs by broadcast, so that no group meets in one task.
    """
    groups = df.groupBy(key).agg(value.alias(name), F.count(F.lit(1)).alias("_n"))
    large = max(256, df.count() // LARGE)
    one = df.join(F.broadcast(groups.where(F.col("_n") >= large)), key, "left")
    rest = one.where("_n is null").drop(name, "_n").join(groups.where(F.col("_n") < large), key)
    cols = [*df.columns, name]
    return one.where("_n is not null").select(*cols).union(rest.select(*cols))


def joined(links: DataFrame) -> DataFrame:
    """Union-find over all links, for a number of links that is known to be small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], names=["node", "root"])

    return links.select("a", "b").coalesce(1).mapInArrow(tidy(run), "node long, root long")


def stars(links: DataFrame, scratch: Scratch, name: str, rows: int) -> DataFrame:
    """Each round first hangs a node's larger neighbours below its smallest one, then its smaller ones.

    The smallest neighbour is pre-aggregated and joined back, so a node with very many links is never gathered. Rounds
    are written to the shared folder. It ends when a round changes nothing, which the links' count and sum show; the
    number of rounds grows with the logarithm of the nodes, so ROUNDS are never reached.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, seen = scratch.save(edges, f"{name}_0"), None
    for k in range(1, ROUNDS):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(lower, "u")
        small = near.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        new = scratch.save(small.where("u <> v").distinct(), f"{name}_{k}")
        scratch.drop(f"{name}_{k - 1}")
        edges = new
        rows, total = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (rows, total) == seen or not rows:
            break
        seen = (rows, total)
    else:
        raise RuntimeError(f"components: links still change after {ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
