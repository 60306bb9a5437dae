"""Personal data: base patterns, and candidates judged by boosted trees.

High-recall generators propose spans that may overlap (number groups, spelled-out addresses, account codes). Format
features (digits, groups, separators, check digit) and context features (words before the span, characters beside
it) go to gradient-boosted trees; the threshold is calibrated on held-out samples to a stated precision. Selected
candidates that touch no base span and no longer selected candidate are added to the base spans.

The trees are fitted from a seeded, bounded set of labelled samples written by rules in this module; features of
samples and of documents come from the same expressions. All work on documents is DataFrame expressions.

Null texts are empty and have no spans. Offsets are code points, ends exclusive. Repeated rows repeat their spans, an
empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmap.llm.boost import Boosted, fit
from seqmap.llm.common import plain
from seqmap.llm.native import apart, count, digits, joined, locate, luhn

KINDS = ("email", "ip", "card", "phone", "email_spelled", "number", "code")
_LOCAL, _LABEL = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
#: The base patterns, written without backtracking: a match can only begin at a run's start or where the last ended.
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Candidates.
SPELLED = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++"
NUMBER = r"(?<![0-9A-Za-z.])\(?[0-9]++(?:[\x20().-]{1,3}+[0-9]++)++(?![0-9A-Za-z])"
CODE = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![0-9A-Za-z])"
CONTEXT = 24
SAMPLES, SEED = 4000, 7
FEATURES = ("kind", "n", "digits", "groups", "first_group", "last_group", "dashes", "dots", "spaces", "parens", "check", "named", "counted", "before_word", "after_word")


def features(s: Column, before: Column, after: Column) -> dict[str, Column]:
    """Format and context of a candidate span; all numbers."""
    t = s["text"]
    d = digits(t)
    removed = lambda p: (F.length(t) - F.length(F.regexp_replace(t, p, ""))).cast("double")
    return {
        "kind": s["kind"].cast("double"),
        "n": F.length(t).cast("double"),
        "digits": F.length(d).cast("double"),
        "groups": F.size(F.split(t, "[^0-9]+")).cast("double"),
        "first_group": F.length(F.regexp_extract(t, "[0-9]+", 0)).cast("double"),
        "last_group": F.length(F.regexp_extract(t, "([0-9]+)[^0-9]*$", 1)).cast("double"),
        "dashes": removed("-"),
        "dots": removed(r"\."),
        "spaces": removed(" "),
        "parens": removed("[()]"),
        "check": F.when(F.length(d) > 0, luhn(d)).otherwise(False).cast("double"),
        "named": before.rlike(r"(?i)(tel|phone|call|fax|mobile|ssn|social|iban|account|card|mail|contact|reach)\W*$").cast("double"),
        "counted": before.rlike(r"(?i)(version|page|chapter|order|item|no|isbn|year|date|total|price|room|[$#€£v])\W*$").cast("double"),
        "before_word": before.rlike(r"[A-Za-z0-9]$").cast("double"),
        "after_word": after.rlike(r"^[A-Za-z0-9]").cast("double"),
    }


def samples(n: int = SAMPLES, seed: int = SEED) -> list[dict]:
    """Labelled spans in made-up sentences: telephone numbers, identity and account numbers, spelled-out addresses; dates, amounts, versions, ranges and phrases against them."""
    r = random.Random(seed)
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(["an", "re", "tion", "le", "os", "sch", "er", "ou", "mi", "ta"]) for _ in range(r.randint(1, 4)))
    cap = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(k))
    good = [
        (5, lambda: f"({num(3)}) {num(3)}-{num(4)}"),
        (5, lambda: f"{num(3)}-{num(3)}-{num(4)}"),
        (5, lambda: f"{num(3)}.{num(3)}.{num(4)}"),
        (5, lambda: f"0{num(2)} {num(4)} {num(4)}"),
        (5, lambda: f"{num(3)}-{num(2)}-{num(4)}"),
        (6, lambda: f"{cap(2)}{num(2)} " + " ".join(num(4) for _ in range(r.randint(3, 6)))),
        (6, lambda: f"{cap(2)}{num(2)}{cap(4)}{num(r.choice([12, 14, 16]))}"),
        (4, lambda: f"{word()}.{word()} at {word()} dot com"),
        (4, lambda: f"{word()}{num(2)}(at){word()}.org"),
        (4, lambda: f"{word()} [at] {word()} [dot] net"),
    ]
    bad = [
        (5, lambda: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}"),
        (5, lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1900, 2030)}"),
        (5, lambda: f"{r.randint(1, 28):02}-{r.randint(1, 12):02}-{r.randint(1900, 2030)}"),
        (5, lambda: f"{r.randint(1900, 2000)}-{r.randint(2001, 2030)}"),
        (5, lambda: f"{num(r.randint(1, 3))}.{num(2)}"),
        (5, lambda: f"{num(r.randint(1, 3))}.{num(3)}.{num(3)}"),
        (5, lambda: f"{num(2)} {num(2)} {num(2)}"),
        (5, lambda: f"978-{num(1)}-{num(4)}-{num(4)}"),
        (5, lambda: f"{num(4)} {num(4)}"),
        (5, lambda: " ".join(num(r.randint(2, 5)) for _ in range(r.randint(2, 6)))),
        (6, lambda: f"{cap(2)}{num(2)} {cap(4)} {cap(4)}"),
        (4, lambda: f"{word()} at {word()} dot"),
        (4, lambda: f"{word()} at {word()}. {word()}"),
        (4, lambda: f"{word()} at {word()}.{word()}"),
    ]
    named = ["call ", "phone: ", "tel. ", "contact ", "ssn ", "iban: ", "account ", "reach me "]
    counted = ["version ", "page ", "order ", "on date ", "total ", "year ", "no. ", "item #"]
    out = []
    for i in range(n):
        y = i % 2
        kind, make = r.choice(good if y else bad)
        lead = r.choice(["", "", f"{word()} ", r.choice(named if r.random() < 0.9 else counted) if y else r.choice(counted if r.random() < 0.9 else named)])
        out.append({"kind": kind, "text": make(), "before": f"{word()} {lead}"[-CONTEXT:], "after": r.choice([" ", ". ", ", ", "\n", "*** "]) + word(), "y": y})
    return out


def train(spark: SparkSession, n: int = SAMPLES, seed: int = SEED) -> Boosted:
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(samples(n, seed))), "array<struct<kind:int,text:string,before:string,after:string,y:int>>")).alias("r")).select("r.*")
    f = features(F.struct("kind", "text"), F.col("before"), F.col("after"))
    got = rows.select(*[f[k].alias(k) for k in FEATURES], "y").collect()  # n rows
    x = np.array([list(r) for r in got], float)
    return fit(list(FEATURES), x[:, :-1], x[:, -1], np.arange(len(x)) % 5 < 2)


def find(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, text, base (spans of the four base kinds) and spans (with the added ones)."""
    model = model or train(docs.sparkSession)
    df = plain(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    t = F.col("text")
    df = locate(df, "text", "_email", EMAIL, 0, t.contains("@"))
    df = locate(df, "text", "_ip", IP, 1, t.rlike(r"[0-9]\.[0-9]+\.[0-9]"))
    df = locate(df, "text", "_card", CARD, 2, t.rlike(r"(?:[0-9][\x20-]?){13}[0-9]"))
    df = locate(df, "text", "_phone", PHONE, 3, t.rlike(r"\+[0-9]"))
    df = locate(df, "text", "_spelled", SPELLED, 4, t.rlike(r"[(\[]at[)\]]|\x20at\x20"))
    df = locate(df, "text", "_number", NUMBER, 5, t.rlike(r"[0-9][\x20().-]{1,3}[0-9]"))
    df = locate(df, "text", "_code", CODE, 6, t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"))
    part = lambda s, i: F.get(F.split(s["text"], r"\."), F.lit(i))
    byte = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    n = lambda s: F.length(digits(s["text"]))
    df = df.withColumns(
        {
            "_ip": F.when(F.size("_ip") > 0, F.filter("_ip", lambda s: byte(part(s, 0)) & byte(part(s, 1)) & byte(part(s, 2)) & byte(part(s, 3)))).otherwise(F.col("_ip")),
            "_card": F.when(F.size("_card") > 0, F.filter("_card", lambda s: (n(s) >= 14) & (n(s) <= 19) & luhn(digits(s["text"])))).otherwise(F.col("_card")),
            "_phone": F.when(F.size("_phone") > 0, F.filter("_phone", lambda s: (n(s) >= 10) & (n(s) <= 15))).otherwise(F.col("_phone")),
        }
    )
    df = df.withColumn("base", F.array_sort(F.concat("_email", "_ip", "_card", "_phone"))).drop("_email", "_ip", "_card", "_phone")
    df = df.withColumn("_all", F.concat("_spelled", "_number", "_code")).drop("_spelled", "_number", "_code")
    df = df.withColumn("_apart", apart("_all", "base")).drop("_all")

    def judged(s: Column) -> Column:
        before = F.substring(t, F.greatest(s["start"] - CONTEXT + 1, F.lit(1)), F.least(s["start"], F.lit(CONTEXT)))
        after = F.substring(t, s["end"] + 1, F.lit(2))
        found = F.array(F.struct(*[f.alias(k) for k, f in features(s, before, after).items()]))  # computed once for all trees
        return F.get(F.transform(found, lambda f: model.column({k: f[k] for k in FEATURES}) >= model.threshold), F.lit(0))

    df = df.withColumn("_chosen", F.when(F.size("_apart") > 0, F.filter("_apart", judged)).otherwise(F.col("_apart"))).drop("_apart")
    longer = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"]) & ((b["end"] - b["start"] > a["end"] - a["start"]) | ((b["end"] - b["start"] == a["end"] - a["start"]) & (b["kind"] < a["kind"])))
    df = df.withColumn("_added", F.when(F.size("_chosen") > 1, F.filter("_chosen", lambda a: ~F.exists("_chosen", lambda b: longer(a, b)))).otherwise(F.col("_chosen"))).drop("_chosen")
    return df.withColumn("spans", F.array_sort(F.concat("base", "_added"))).drop("_added")


def redact(found: DataFrame) -> DataFrame:
    """The texts with each span replaced by its kind in brackets."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ends = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["end"]))
    parts = F.transform("spans", lambda s, i: F.concat(F.substring("text", F.get(ends, i) + 1, F.greatest(s["start"] - F.get(ends, i), F.lit(0))), F.lit("["), F.get(names, s["kind"]), F.lit("]")))
    return found.withColumn("redacted", F.concat(F.array_join(parts, ""), F.substring("text", F.coalesce(F.array_max(ends), F.lit(0)) + 1, F.length("text"))))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[count("base", k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
