"""Sequence scalars as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters and their complements, case kept; others stand for themselves.
LETTERS, COMPLEMENTS = "ACGTUacgtu", "TGCAAtgcaa"


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, LETTERS, COMPLEMENTS))


def n_count(seq: Column) -> Column:
    return (F.length(seq) - F.length(F.translate(seq, "Nn", ""))).cast("long")


def usable(seq: Column, k: int) -> Column:
    """Whether a read has enough letters other than N for one key."""
    return F.length(seq) - n_count(seq) >= k


def subsequence(seq: Column, start: Column, length: Column, reverse: Column | None = None) -> Column:
    """Half-open from a 0-based start; reverse-complemented where asked."""
    part = F.substring(seq, start.cast("int") + 1, length.cast("int"))
    return part if reverse is None else F.when(reverse, revcomp(part)).otherwise(part)


def from_text(text: Column) -> Column:
    """A text's letters a-z dealt to A, C, G, T; used to run the engine over document tables."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")


def mismatches(a: Column, b: Column) -> Column:
    """Hamming distance of equally long sequences; letters other than ACGTU count as A.

    Each letter becomes two bits of a number, 24 letters at a time, so that whole words are compared with bit_count.
    """
    code = lambda x: F.translate(F.regexp_replace(F.translate(F.upper(x), "U", "T"), "[^ACGT]", "A"), "ACGT", "0123")
    step = 24
    blocks = F.sequence(F.lit(0), F.floor((F.greatest(F.length(a), F.lit(1)) - 1) / step).cast("int"))

    def one(acc: Column, i: Column) -> Column:
        word = lambda x: F.conv(F.substring(code(x), i * step + 1, F.lit(step)), 4, 10).cast("decimal(20,0)").cast("long")
        x = word(a).bitwiseXOR(word(b))
        odd = x.bitwiseAND(F.lit(0x555555555555))
        even = F.shiftright(x, 1).bitwiseAND(F.lit(0x555555555555))
        return acc + F.bit_count(odd.bitwiseOR(even))

    return F.aggregate(blocks, F.lit(0), one).cast("long")
