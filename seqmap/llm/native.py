"""Spans of regular expressions, as DataFrame expressions with code-point offsets.

A projection whose column is used once is inlined into the next one, also into a lambda, where it would be evaluated
for every element. So every array that a lambda reads is also read outside of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end:int,text:string>>"
BLOCK = 256


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0), lambda a, x: a + x)


def locate(df: DataFrame, text: str, out: str, pattern: str, kind: int, gate: Column) -> DataFrame:
    """Adds `out`: the leftmost non-overlapping matches of a Java pattern; rows without gate are not searched.

    Starts are prefix sums of the gaps between matches and of the matches, in blocks, so that many matches in one
    text cost little more than their number.
    """
    g, m, n, b = (f"_{out}_{x}" for x in "gmnb")
    none = F.array().cast("array<string>")
    df = df.withColumns({g: F.when(gate, F.split(text, pattern, -1)).otherwise(none), m: F.when(gate, F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none)})
    some = F.size(g) > 1
    df = df.withColumn(n, F.when(some, F.transform(m, lambda x, i: F.length(F.get(F.col(g), i)) + F.length(x))).otherwise(F.array().cast("array<int>")))
    df = df.withColumn(b, F.when(F.size(n) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / BLOCK).cast("int")), lambda k: _total(F.slice(n, k * BLOCK + 1, BLOCK)))).otherwise(F.array().cast("array<int>")))

    def span(x: Column, i: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        start = _total(F.slice(b, 1, block)) + _total(F.slice(n, block * BLOCK + 1, i - block * BLOCK)) + F.length(F.get(F.col(g), i))
        return F.struct(start.alias("start"), F.lit(kind).alias("kind"), (start + F.length(x)).alias("end"), x.alias("text"))

    read_once = (F.size(g) > 1) & (F.size(b) > 0) & (F.size(n) > 0)
    return df.withColumn(out, F.when(read_once, F.transform(m, span)).otherwise(F.array()).cast(SPAN)).drop(g, m, n, b)


def joined(spans: Column, kinds: tuple[str, ...]) -> Column:
    """`kind:start:end` of sorted spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(spans: str, base: str) -> Column:
    """The spans that overlap no base span."""
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))).otherwise(F.col(spans))


def count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(number)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = d * 2
        return acc + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0
