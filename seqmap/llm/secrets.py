"""Secrets: base patterns, and strings that a random-string model explains better than an identifier model.

Two Markov models over characters, each of order one with add-one smoothing, are trained from labelled samples:
random strings (hexadecimal, base-32, base-62 and base-64 draws, seeded) and ordinary identifiers (words of a bounded
sample of documents, alone, hyphenated, joined with underscores and in camel case, plus numbers and paths). A candidate
is a token of LEAST characters or more. It is a secret if the mean log-likelihood ratio over its characters reaches
the threshold of its length's class (CLASSES), which is calibrated on held-out samples of both kinds: in the middle
between them where they are apart, else where false alarms stay below the stated share.

The sample is of about DOCS documents, those whose id's hash falls to one of so many equal parts, and of WORDS words.

Scoring reads one table of character-pair weights; all work on documents is DataFrame expressions.

Null texts are empty and have no spans. Offsets are code points, ends exclusive. Repeated rows repeat their spans, an
empty table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmap.llm.common import plain
from seqmap.llm.native import apart, count, joined, locate

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: A candidate token; its characters are the models' states.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
LEAST = 12
TOKEN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST},}}+"
DOCS, WORDS, SAMPLES, SEED = 400, 8000, 6000, 11
#: The least length of each class of tokens with a threshold of its own.
CLASSES = (12, 16, 20, 32)
FALSE_ALARMS = 0.0005


@dataclass
class Markov:
    """Weights of (previous, next) character pairs, row by row; index 0 is a token's begin."""

    weights: list[float]
    thresholds: list[float]


def random_strings(n: int, r: random.Random) -> list[str]:
    kinds = ["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64], ALPHABET[:62] + "-_", "abcdefghijklmnopqrstuvwxyz0123456789"]
    return [r.choice(["", "", "sk-", "ghp_", "xoxb-"]) + "".join(r.choice(kinds[i % len(kinds)]) for _ in range(r.randint(12, 64) if i % 2 else r.randint(12, 20))) for i in range(n)]


def identifiers(words: list[str], n: int, r: random.Random) -> list[str]:
    words = words or ["value", "index", "count", "name", "table", "reader"]
    out = []
    for i in range(n):
        some = [r.choice(words) for _ in range(r.randint(1, 6))]
        style = i % 8
        if style == 0:
            out.append("_".join(some))
        elif style == 1:
            out.append("-".join(some))
        elif style == 2:
            out.append(some[0] + "".join(w.capitalize() for w in some[1:]))
        elif style == 3:
            out.append("/".join(some))
        elif style == 4:
            out.append("".join(some).upper() if r.random() < 0.5 else "".join(some))
        elif style == 5:
            out.append("_".join(some) + str(r.randint(0, 9999)))
        elif style == 6:
            out.append(max((r.choice(words) for _ in range(12)), key=len))
        else:
            out.append(r.choice(["-", "=", "_"]) * r.randint(3, 30) if r.random() < 0.3 else "-".join(str(r.randint(0, 9999)) for _ in range(r.randint(4, 7))))
    return out


def _model(tokens: list[str]) -> list[float]:
    k = len(ALPHABET) + 1
    at = {c: i + 1 for i, c in enumerate(ALPHABET)}
    counts = [1.0] * (k * k)
    for t in tokens:
        prev = 0
        for c in t:
            counts[prev * k + at[c]] += 1
            prev = at[c]
    out = []
    for i in range(k):
        row = counts[i * k : (i + 1) * k]
        out += [math.log(x / sum(row)) for x in row]
    return out


def _mean(token: str, weights: list[float]) -> float:
    k, prev, total = len(ALPHABET) + 1, 0, 0.0
    for c in token:
        now = ALPHABET.index(c) + 1
        total += weights[prev * k + now]
        prev = now
    return total / len(token)


def fit(words: list[str], n: int = SAMPLES, seed: int = SEED) -> Markov:
    r = random.Random(seed)
    secret, plain_ = random_strings(n, r), identifiers(words, n, r)
    a, b = _model(secret[: n // 2]), _model(plain_[: n // 2])
    weights = [x - y for x, y in zip(a, b)]
    cuts = []
    for low, high in zip(CLASSES, [*CLASSES[1:], 1 << 30]):
        held = sorted(_mean(t, weights) for t in plain_[n // 2 :] if low <= len(t) < high)
        hits = sorted(_mean(t, weights) for t in secret[n // 2 :] if low <= len(t) < high)
        cut = held[min(len(held) - 1, int(len(held) * (1 - FALSE_ALARMS)))] if held else 0.0
        cuts.append(max(cut, (cut + hits[int(len(hits) * 0.01)]) / 2) if hits else cut)
    return Markov(weights, cuts)


def train(docs: DataFrame, limit: int = DOCS, words: int = WORDS) -> Markov:
    """Fits with the letters-only words of about `limit` documents, `words` at most."""
    own = plain(docs, "doc_id", "text").where("doc_id is not null")
    parts = max(1, own.count() // limit)
    some = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0)
    each = some.select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?<![^ ])[A-Za-z]{3,40}+(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("w")).distinct()
    return fit([r.w for r in each.orderBy(F.xxhash64("w"), "w").limit(words).collect()])


def ratio(token: Column, model: Markov) -> Column:
    """The mean log-likelihood ratio of a token's characters."""
    k = len(ALPHABET) + 1
    # one literal, not one for each pair: every rule of the planner copies a plan's expressions on the driver
    table = F.split(F.lit(",".join(repr(round(w, 6)) for w in model.weights)), ",").cast("array<double>")
    step = lambda acc, c: F.struct((acc["total"] + F.get(table, acc["prev"] * k + F.instr(F.lit(ALPHABET), c))).alias("total"), F.instr(F.lit(ALPHABET), c).alias("prev"))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("prev"))
    return F.aggregate(F.split(token, ""), start, step, lambda acc: acc["total"]) / F.length(token)


def threshold(token: Column, model: Markov) -> Column:
    out = F.lit(model.thresholds[0])
    for low, cut in zip(CLASSES[1:], model.thresholds[1:]):
        out = F.when(F.length(token) >= low, cut).otherwise(out)
    return out


def find(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """documents(doc_id, text, ...) -> their columns, base (spans of the three base kinds) and spans (with the added ones)."""
    model = model or train(docs)
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    t = F.col("text")
    df = locate(df, "text", "_assign", ASSIGN, 0, t.rlike("(?i)pass|secret|token|key"))
    df = locate(df, "text", "_access", ACCESS, 1, t.contains("AKIA"))
    df = locate(df, "text", "_hex", HEX, 2, t.rlike("[0-9a-f]{24}"))
    df = locate(df, "text", "_token", TOKEN, 3, t.rlike(f"[A-Za-z0-9+/_=-]{{{LEAST}}}"))
    long = lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 1)) >= 6
    df = df.withColumn("_assign", F.when(F.size("_assign") > 0, F.filter("_assign", long)).otherwise(F.col("_assign")))
    df = df.withColumn("base", F.array_sort(F.concat("_assign", "_access", "_hex"))).drop("_assign", "_access", "_hex")
    df = df.withColumn("_apart", apart("_token", "base")).drop("_token")
    df = df.withColumn("_added", F.when(F.size("_apart") > 0, F.filter("_apart", lambda s: ratio(s["text"], model) >= threshold(s["text"], model))).otherwise(F.col("_apart"))).drop("_apart")
    return df.withColumn("spans", F.array_sort(F.concat("base", "_added"))).drop("_added")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        *[count("base", k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"),
        count("spans", 3).alias("n_random"),
        F.size("spans").cast("long").alias("n_spans"),
    )


def redact(found: DataFrame, column: str = "text") -> DataFrame:
    """The texts with the spans' characters replaced by `[SECRET]`; overlapping spans are one."""
    piece = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.substring(F.col(column), acc["at"] + 1, s["start"] - acc["at"]), F.lit("[SECRET]"))).otherwise(acc["out"]).alias("out"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    done = F.aggregate("spans", start, piece, lambda acc: F.concat(acc["out"], F.substring(F.col(column), acc["at"] + 1, F.length(column))))
    return found.withColumn(column, F.when(F.size("spans") > 0, done).otherwise(F.col(column)))
