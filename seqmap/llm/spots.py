r"""Document fingerprints from spot signatures.

A spot is a common word (an anchor); its signature is the anchor with the chain of the next CHAIN content words, other
anchors being skipped. Spots sit where running text is. The beginning of a text is an anchor, too, whose chain may be
shorter, so that every text with a word has a signature; there is no other rule for any kind or size of text. Words are
runs of letters and digits in lower case.
A fingerprint is the partition of its set's length, then the sorted distinct 32-bit signatures.

Two fingerprints are compared by Jaccard likeness. Sets of lengths x <= y have a likeness of x / y at most, so a search
for likeness `least` or more skips those below it; the query reports likeness as it is. Two empty sets have likeness 1,
an empty and another one 0. `near` finds all pairs of a likeness: partitions whose lengths are too far apart are never
compared, and of a set only as many of its rarest-hashed signatures are looked up as must hold a shared one.

All of it is DataFrame expressions: one pattern finds the chains, with a lookahead that lets them overlap.

Null texts are empty. Rows with null ids come first, rows of one id are ordered by text. The only document of a table
is its own next one. Ids may be any long. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqmap.llm.common import plain

#: Common words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be but by for from had has have he her his i if in is it its not of on or she that the their there they this to was we were which who will with you
am auf aus bei das dem den der des die ein eine einen es für hat ich im ist mit nach nicht noch sich sie sind so und uns von vor war wie wir wird zu zum
au aux avec ce ces cette dans de du elle en est et il je la le les leur lui mais ne nous on ont ou par pas pour qu que qui sa se ses son sont sur un une vous
al como con del el ella ellos era esta este fue ha hay la las lo los más me mi muy no nos para pero por se si sin sobre son su sus también una uno y ya
"""
CHAIN = 2
RATIO = 0.75
#: Documents for each bucket of neighbouring ids; buckets are told apart by two levels of so many each at most.
BUCKET_ROWS, LEVEL = 512, 128


def trie(words: list[str]) -> str:
    """A pattern of the words that never tries two branches."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    if not heads:
        return ""
    out = "|".join(c + trie(rest) for c, rest in sorted(heads.items()))
    return f"(?:{out})" + ("?+" if "" in words else "")


_ANY = trie(sorted(set(ANCHORS.split())))
ANCHOR = rf"{_ANY}(?!\S)"
_NEXT = rf"(?:{ANCHOR}\ )*+\S++"
SPOT = rf"(?<!\S)(?={ANCHOR})(?=(\S++" + rf"\ {_NEXT}" * CHAIN + "))"
BEGIN = rf"^({_NEXT}" + rf"(?:\ {_NEXT}" * (CHAIN - 1) + ")?" * (CHAIN - 1) + ")"
SKIPPED = rf"(?<=\ ){ANCHOR}\ "


def signatures(text: Column) -> Column:
    """The sorted distinct signatures of a text."""
    words = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " "))
    chain = lambda x: F.hash(F.regexp_replace(x, SKIPPED, ""))
    begin = F.hash(F.lit("begin"), F.regexp_extract(words, BEGIN, 1))
    chains = F.concat(F.array(begin), F.transform(F.regexp_extract_all(words, F.lit(SPOT), F.lit(1)), chain))
    return F.when(words == "", F.array().cast("array<int>")).otherwise(F.sort_array(F.array_distinct(chains)))


def partition(n: Column) -> Column:
    """The partition of a set's length: lengths of one partition differ by less than RATIO."""
    return F.when(n == 0, F.lit(0)).otherwise(F.floor(F.log(n) / -math.log(RATIO)).cast("int") + 1)


def fingerprint(sigs: Column) -> Column:
    return F.concat(partition(F.size(sigs)).cast("string"), F.lit(":"), sigs.cast("string"))


def likeness(a: str, b: str, least: float = 0.0) -> Column:
    """Jaccard likeness; null where the lengths alone keep it below `least`."""
    x, y = F.size(a), F.size(b)
    both = F.size(F.array_intersect(a, b))
    return F.when((x == 0) & (y == 0), 1.0).when((x == 0) | (y == 0), 0.0).when(F.least(x, y) >= least * F.greatest(x, y), both / (x + y - both))


def near(docs: DataFrame, least: float = 0.75) -> DataFrame:
    """(a, b, likeness) of all pairs of different fingerprints of that likeness; a and b are their smallest doc_ids.

    Of two such sets, among any n - ceil(least * n) + 1 signatures of either one is shared; both take those of least
    hash. A set is listed for its own length's partition and for those of lengths that are not too far apart.
    """
    own = plain(docs, "doc_id", "text").select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs")).where(F.size("sigs") > 0)
    own = own.groupBy("sigs").agg(F.min("doc_id").alias("id"), F.max(F.size("sigs")).alias("n"))
    ranked = F.array_sort(F.transform("sigs", lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("sig"))))
    prefix = F.slice(ranked, 1, (F.col("n") - F.ceil(F.col("n") * least) + 1).cast("int"))
    listed = own.select("id", "n", F.explode(F.transform(prefix, lambda p: p["sig"])).alias("sig"))
    low, high = partition(F.ceil(F.col("n") * least)), partition(F.floor(F.col("n") / least))
    left = listed.select(F.col("id").alias("a"), F.col("n").alias("m"), "sig", F.explode(F.sequence(low, high)).alias("part"))
    right = listed.select(F.col("id").alias("b"), F.col("n").alias("k"), "sig", partition(F.col("n")).alias("part"))
    pairs = left.join(right, ["sig", "part"]).where((F.col("a") < F.col("b")) & (F.least("m", "k") >= least * F.greatest("m", "k"))).select("a", "b").distinct()
    sets = own.select("id", "sigs")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("sigs").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("sigs").alias("y")), "b")
    return both.withColumn("likeness", likeness("x", "y", least)).where(F.col("likeness") >= least).select("a", "b", "likeness")


def buckets(docs: DataFrame) -> Column:
    """A bucket for each doc_id, in the order of ids and of about equal rows, by quantiles of all ids; nulls are first."""
    n = docs.count()
    level = max(1, min(LEVEL, round((n / BUCKET_ROWS) ** 0.5)))
    if level == 1:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    shares = [i / level**2 for i in range(1, level**2)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10 * level**2).alias("q")).first().q  # LEVEL^2 ids at most
    rows = F.from_json(F.lit(json.dumps([cuts[i * level : (i + 1) * level - 1] for i in range(level)])), "array<array<bigint>>")
    tops = F.from_json(F.lit(json.dumps(cuts[level - 1 :: level])), "array<bigint>")
    passed = lambda some: F.size(F.filter(some, lambda x: x <= F.col("doc_id")))
    first = passed(tops)
    return F.when(F.col("doc_id").isNull(), -1).otherwise(first * level + passed(F.get(rows, first)))


def with_next(docs: DataFrame) -> DataFrame:
    """documents(doc_id, text) in buckets of neighbouring ids, each with `last` rows: copies of the next bucket's first document.

    Only texts are dealt out, once; what is broadcast has at most one row for each bucket.
    """
    own = plain(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    bucket = buckets(own.select("doc_id"))
    firsts = own.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("first_id"))
    order = W.orderBy("bucket")
    ends = firsts.withColumn("before", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))).select(F.col("bucket").alias("of"), "first_id", "before")
    placed = own.withColumn("bucket", bucket)
    placed = placed.join(F.broadcast(ends), (placed.bucket == ends.of) & placed.doc_id.eqNullSafe(ends.first_id), "left")
    here = F.struct("bucket", F.lit(False).alias("last"))
    rows = F.when(F.col("before").isNotNull(), F.array(here, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("last")))).otherwise(F.array(here))
    return placed.select("doc_id", "text", F.explode(rows).alias("at")).select("doc_id", "text", "at.bucket", "at.last")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and its likeness to that and to the next document."""
    w = W.partitionBy("bucket").orderBy("last", F.col("doc_id").asc_nulls_first(), "text")
    df = with_next(docs).withColumn("next", F.lead("text").over(w)).withColumn("sigs", signatures(F.col("text")))
    df = df.withColumn("next_sigs", F.lead("sigs").over(w)).where("not last")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring(F.coalesce("next", F.lit("")), F.lit(1), half)))
    df = df.withColumn("edited_sigs", signatures(F.col("edited")))
    return df.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness("sigs", "edited_sigs").cast("double").alias("near_edited"),
        likeness("sigs", "next_sigs").cast("double").alias("near_next"),
    )
