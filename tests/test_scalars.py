"""Scalars, encodings, guides, alignment operations: goldens and properties."""

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from seqmap.functions.encodings import BITWISE, GAPPED, HPC, PLAIN, SWAP, encoding, letters_of
from seqmap.functions.guides import GUIDES, homopolymer_runs
from seqmap.operators.cigar import consumed, describe, from_moves, parse, reduce_ops, render
from seqmap.operators.index import key_limits
from seqmap.operators.kernels import Key, Read, diagonal_clusters, extremes, leftmost, meet, nested, refine, two_smallest
from seqmap.operators.verify import align, hamming
from seqmap.sources.annotation import parse_state_guide, parse_tuple_guide
from seqmap.sources.fastx import BadRecord, records

LONG = "ACGGATTACAGGCTTTACGACCCGTACGTTAGCATGCAAGGCTAGCTAGGATCCATGGCAAA"
dna = st.text("ACGT", min_size=0, max_size=120)


@pytest.mark.parametrize(
    ("guide", "places"),
    [
        ("XYX", [(10, False), (18, True), (26, True), (34, True), (42, True)]),
        ("XXX", [(16, False), (23, False), (31, True), (39, True)]),
        ("XXX+", [(16, False), (23, False), (31, True)]),
        ("X?X", [(10, False), (16, False), (23, False), (31, True)]),
        ("palindrome", [(8, False), (16, True), (24, True), (32, True), (51, False)]),
    ],
)
def test_guide_goldens(guide, places):
    assert GUIDES[guide](LONG, 8) == places


def test_default_guide_never_takes_the_last_place():
    assert [p for p, _ in GUIDES["default"](LONG, 8)] == list(range(53))
    assert GUIDES["default"]("ACGT", 8) == []


@given(dna)
def test_guides_increase_and_stay_inside(s):
    for name in ("default", "XX", "XXX", "XYX", "XXYY", "PAL4"):
        places = [p for p, _ in GUIDES[name](s, 8)]
        assert all(a < b for a, b in zip(places, places[1:]))
        assert all(0 <= p <= len(s) - 9 for p in places)


def test_key_goldens():
    s = letters_of("ACGTTGCAACGT")
    assert [e.bulk(s, 12).tolist() for e in (BITWISE, PLAIN, GAPPED, SWAP)] == [[2457], [1827867], [153], [42]]
    keys = letters_of(LONG)
    assert [int(BITWISE.bulk(keys, 8)[p]) for p in (10, 18, 26, 34, 42)] == [30, 67, 57, 152, 204]
    assert [int(PLAIN.bulk(keys, 8)[p]) for p in (10, 18, 26, 34, 42)] == [42993, 34156, 28452, 58409, 51658]
    assert HPC.bulk(letters_of("CCATTTGACGG"), 6)[0] == 9
    assert HPC.bulk(letters_of("ACGTGT"), 6)[0] == 0


def test_n_has_no_key_and_wide_keys_are_refused():
    for e in (BITWISE, PLAIN, HPC):
        assert e.bulk(letters_of("ACGNACGT"), 8).tolist()[0] == -1
    with pytest.raises(ValueError):
        encoding("plain", 24)


def test_guide_files():
    text = "# c\nT\n24\n1\n3\n" + "".join(f"{a}{b}{a} 1 3\n" for a in "ACGT" for b in "ACGT" if a != b)
    assert parse_tuple_guide(text)(LONG, 8) == GUIDES["XYX"](LONG, 8)
    state = GUIDES["XXX+"]
    rows = "".join(f"{s}\t" + "\t".join(map(str, r)) + "\tx\n" for s, r in state.table.items())
    assert parse_state_guide("X\n24\n1\n3\n" + rows)(LONG, 8) == state(LONG, 8)


def test_runs():
    assert homopolymer_runs("AAACGG") == [3, 1, 2]
    assert homopolymer_runs("") == []


def test_limits_golden():
    sizes = np.log10([1, 2, 30])
    assert key_limits(float(sizes.mean()), float(sizes.std(ddof=1)), 2) == (2, 5187)


@pytest.mark.parametrize(("text", "out", "left"), [("100M", "100M", 1000), ("50M2D50M", "50M2D50M", 1000), ("5X95M", "5S95M", 1005), ("4M1I95M", "5S95M", 1005), ("20M3I3D77M", "20M3X77M", 1000)])
def test_cigar_goldens(text, out, left):
    got = describe(text)
    assert (got["out"], got["left"]) == (out, left)


@given(st.lists(st.tuples(st.sampled_from("MXID"), st.integers(1, 60)), min_size=1, max_size=9))
def test_reduction_keeps_the_reads_length(ops):
    assert consumed(reduce_ops(ops, 500, 900).ops) == consumed(ops) or not consumed(ops)


@given(dna.filter(lambda s: len(s) >= 4), dna.filter(lambda s: len(s) >= 4))
def test_alignment_moves_spell_both(a, b):
    cost, moves = align(a, b)
    ops = from_moves(moves)
    assert sum(n for op, n in ops if op in "MXI") == len(b) and sum(n for op, n in ops if op in "MXD") == len(a)
    assert render(parse(render(ops))) == render(ops)
    gap = lambda n: min(4 + 2 * n, 12 + n)
    assert cost == sum(6 * m.count("X") if m[0] in "MX" else gap(len(m)) for m in __import__("re").findall(r"[MX]+|I+|D+", moves))


def test_hamming_takes_n_for_a():
    assert (hamming("ACGT", "AGGT"), hamming("ACGN", "ACGA"), hamming("ACGN", "ACGT"), hamming("AC", "GG")) == (1, 0, 1, 0)


def test_band_golden():
    a, b = Key(0, [100, 200, 300]), Key(10, [110, 260, 305])
    assert meet(a, b, 13) == [(100, 0), (300, 0)]
    assert len(meet(a, b, 13)) == len(meet(b, a, 13))
    many = Key(0, list(range(0, 30000, 100)))
    assert meet(many, many, 1) == []
    assert refine([(100, 0), (300, 0)], Key(20, [121, 900]), 25) == [(100, 0)]


@pytest.mark.parametrize("kernel", [extremes, two_smallest, leftmost, nested, diagonal_clusters])
def test_kernels_find_a_planted_read(kernel):
    keys = [Key(r, sorted([1000 + r, *(50000 + 7919 * (r + 1) * i for i in range(1, 4))])) for r in range(0, 120, 10)]
    got = kernel(Read(150, 24, (keys, [])), 50)
    assert any(f.strand == 0 and f.gpos - f.rpos == 1000 for f in got)
    assert kernel(Read(150, 24, ([], [])), 50) == []


def test_records():
    text = ">a first one\nACG\nTT\n@b\nACGT\n+\nIIII\n>c\n\n@d x\nAC\n+\n@I"
    assert list(records(iter(text.split("\n")))) == [("a", "first one", "ACGTT", None), ("b", "", "ACGT", "IIII"), ("c", "", "", None), ("d", "x", "AC", "@I")]
    with pytest.raises(BadRecord):
        list(records(iter("@b\nACGT\n+\nII".split("\n"))))
    assert list(records(iter("junk\n@b\nACGT\n+\nIIIIII\n>k\nA".split("\n")), lenient=True)) == [("k", "", "A", None)]
