"""Queries against their SQL twins, planted reads, files and streams."""

import glob
import gzip
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from seqmap.functions.sequences import mismatches, revcomp
from seqmap.operators import counting, genome, index, pairing, probe
from seqmap.operators.verify import hamming
from seqmap.plans import mapper
from seqmap.plans.queries import ORACLES, QUERIES
from seqmap.sources.annotation import by_order, read_gtf
from seqmap.sources.fastx import contigs_from, read_fastx, read_stored
from seqmap.sources.sinks import base_name, fasta, sam_header, write_sam
from seqmap.streaming.ingest import map_stream, read_stream

from .conftest import SF

LINE = "ACGGATTACAGGCTTTACGACCCGTACGTTAGCATGCAAGGCTAGCTAGGATCCATGGCAAATCGGACTTAGC"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", ["revcomp", "n_count", "guide_default", "key_plain", "key_gapped", "key_swap", "prefix_offsets", "key_histogram", "q95_limits", "locate_contig", "nearest_posting", "band_refine", "argmax_ties", "diag_vote", "diag_vote_low", "postings", "key_sizes", "probe_hits", "size_rank", "hamming_verify", "blast_like_x", "guide_tuple_xx", "guide_tuple_xyx", "guide_tuple_xxx", "guide_tuple_xxyy", "guide_tuple_pal4", "guide_state_xxxp", "guide_state_xyx", "guide_state_palindrome", "homopolymer_runs", "key_hpc", "unmapped_split", "pair_tree", "paired_scan", "sweep_window", "band_join", "pair_within_insert", "gene_layout", "state_totals", "n_runs", "extract_with_n", "contigs_by_number", "sequence_lengths", "size_dump", "unmapped_text", "exon_tables", "count_rows", "count_table", "pseudo_genes", "gene_vote", "exon_tpm"])
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


def _genome(spark):
    import random

    r = random.Random(5)
    rows = [(i, f"c{i}", "".join(r.choice("ACGT") for _ in range(3000))) for i in range(3)]
    return rows, index.with_offsets(spark.createDataFrame(rows, "contig_id long, name string, seq string"))


def test_planted_reads_are_found(spark, tmp_path):
    rows, contigs = _genome(spark)
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    wrong = rows[2][2][700:850]
    wrong = wrong[:70] + ("A" if wrong[70] != "A" else "C") + wrong[71:]
    reads = [(0, rows[0][2][100:250]), (1, rc(rows[1][2][2000:2150])), (2, wrong), (3, "ACGT" * 37), (4, "ACG")]
    rd = spark.createDataFrame([(n, 1, f"r{n}", s) for n, s in reads], "read_num long, mate byte, name string, seq string")
    built = index.build_index(contigs, 16)
    index.save_index(built, str(tmp_path / "ix"))
    with pytest.warns(UserWarning, match="ignored"):
        loaded = index.load_index(spark, str(tmp_path / "ix"), k=20)
    assert loaded.meta == built.meta
    params = mapper.params_of(loaded, low=1000, high=2000)
    got = mapper.map_reads(loaded, rd, "x4s", params=params)
    found = {(r.read_num, r.strand, r.contig_id, r.start, r.err) for r in got.collect()}
    assert found == {(0, 0, 0, 100, 0), (1, 1, 1, 2000, 0), (2, 0, 2, 700, 1)}
    usable = probe.prepared(rd, 16).where("usable").select("read_num", "mate")
    figures = {r.func: (r.calls, r.hits) for r in pairing.strategy_summary(usable, got, "x4s").collect()}
    assert figures["x"][0] == usable.count() == figures["4"][0] + figures["x"][1] and sum(h for _, h in figures.values()) == 3
    sam = pairing.sam_rows(probe.prepared(rd, 16), got.withColumn("cigar0", F.col("cigar")), contigs)
    write_sam(sam, str(tmp_path / "sam"), sam_header(contigs, "default", "bitwise", "test"))
    lines = [x.value.split("\t") for x in spark.read.text(str(tmp_path / "sam/rows")).collect()]
    assert {(x[0], x[2], x[3], x[5]) for x in lines} == {("r0", "c0", "101", "150M"), ("r1", "c1", "2001", "150M"), ("r2", "c2", "701", "150M"), ("r3", "*", "0", "*"), ("r4", "*", "0", "*")}
    stay, aside = pairing.route_unmapped(sam, 2)
    assert (stay.count(), aside.count()) == (3, 2)


def test_unknown_letters_stop(spark):
    from seqmap.operators.strategies import schedule

    with pytest.raises(ValueError, match="no strategy"):
        schedule("x?")


def test_empty_reads(spark):
    _, contigs = _genome(spark)
    rd = spark.createDataFrame([], "read_num long, mate byte, name string, seq string")
    assert probe.read_keys(rd, 16).count() == 0


def test_column_mismatches_equal_the_bulk_form(spark):
    rows = [("ACGT", "AGGT"), ("ACGN", "ACGA"), ("A" * 60, "A" * 59 + "C"), (LINE, LINE[::-1])]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", mismatches(F.col("a"), F.col("b")).alias("n"), revcomp(revcomp(F.col("a"))).alias("same"))
    assert [(r.n, r.same == r.a) for r in df.collect()] == [(hamming(a, b), True) for a, b in rows]


def test_files(spark, tmp_path):
    text = f">chr1 one\n{LINE[:30]}\n{LINE[30:].lower()}\n>chr2\nNNNN{LINE}"
    (tmp_path / "g.fa").write_text(text)
    with gzip.open(tmp_path / "g2.fa.gz", "wt") as f:
        f.write(text)
    for p in ("g.fa", "g2.fa.gz"):
        for read in (read_fastx, read_stored):
            rows = contigs_from(read(spark, str(tmp_path / p))).orderBy("contig_id").collect()
            assert [(r.name, r.comment, r.seq) for r in rows] == [("chr1", "one", LINE), ("chr2", "", "NNNN" + LINE)]
    out = fasta(contigs_from(read_fastx(spark, str(tmp_path / "g.fa"))), width=40).orderBy("value").first().value
    assert out.split("\n") == [">chr1", LINE[:40], LINE[40:]]
    assert base_name("x/genome.fasta.gz") == "x/genome"
    gtf = 'chr1\tt\texon\t1\t20\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\nchr1\tt\texon\t1\t20\t.\t+\t.\tgene_id g1; transcript_id t2;\nchr1\tt\tgene\t1\t40\t.\t+\t.\tgene_id "g1";\nchr1\tt\texon\t15\t40\t.\t+\t.\tgene_id "g1"; transcript_id "t1";\n'
    (tmp_path / "a.gtf").write_text(gtf)
    g = read_gtf(spark, str(tmp_path / "a.gtf"))
    own = spark.createDataFrame([(0, "one", LINE), (1, "two", LINE)], "contig_id long, name string, seq string")
    (tmp_path / "b.gtf").write_text("1\tt\texon\t1\t9\t.\t+\t.\tgene_id g;\n2\tt\texon\t2\t9\t.\t+\t.\tgene_id h;\n1\tt\texon\t3\t9\t.\t+\t.\tgene_id g;\n")
    assert {(r.seqname, r.start) for r in by_order(read_gtf(spark, str(tmp_path / "b.gtf")), own).collect()} == {("one", 1), ("two", 2), ("one", 3)}
    lay = counting.layout(counting.distinct_exons(g)).orderBy("exon_no").collect()
    assert [(r.phy_start, r.phy_end, r.overlaps_prev) for r in lay] == [(0, 19, False), (23, 48, True)]
    assert counting.genes(g).select("n_exons", "n_transcripts").first() == (2, 2)
    assert counting.effective_size(counting.distinct_exons(g)).first().eff_size == 40


def test_rates_golden(spark):
    g = spark.createDataFrame([(1, 10), (2, 20)], "gene_id long, reads long")
    s = spark.createDataFrame([(1, 1000), (2, 500)], "gene_id long, eff_size long")
    assert [round(r.tpm, 4) for r in counting.gene_tpm(g, s).orderBy("gene_id").collect()] == [200000.0, 800000.0]
    e = spark.createDataFrame([(1, 1, 100, 10, False), (1, 2, 50, 10, True), (1, 3, 200, 10, False)], "gene_id long, exon_no long, size long, reads long, overlaps_prev boolean")
    assert [round(r.tpm) for r in counting.exon_tpm(e).orderBy("exon_no").collect()] == [400000, 800000, 200000]
    assert counting.gene_tpm(g.where("false"), s).first().tpm is None


def test_gene_votes_ties(spark):
    def hits(read, votes):
        return [(read, 1, 0, i, 1, g) for g, keys in votes.items() for i in keys]

    rows = [x for n in (2, 3) for x in hits(n, {"A": range(5), "B": range(1, 6)})] + hits(4, {"A": range(5), "B": range(1, 6), "C": range(5)}) + hits(5, {"A": range(3)})
    h = spark.createDataFrame(rows, "read_num long, mate int, strand int, key_idx int, size long, gene_id string")
    got = {r.read_num: (r.gene_id, r.score) for r in counting.gene_votes(h, h).collect()}
    assert got == {2: ("A", 83), 3: ("B", 83)}


def test_stream(spark, tmp_path):
    rows, contigs = _genome(spark)
    built = index.build_index(contigs, 16)
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.fq").write_text(f"@r0\n{rows[0][2][100:250]}\n+\n{'I' * 150}\n")
    got = []
    q = map_stream(built, read_stream(spark, str(src)), str(tmp_path / "cp"), lambda df, n: got.extend(df.select("contig_id", "start").collect()), "O")
    q.awaitTermination(120)
    assert [tuple(r) for r in got] == [(0, 100)]


def test_letters_of_contigs(spark):
    rows = [(0, "NNACGNNTn" + "A" * 70000 + "N" * 70000 + "C"), (1, "ACGT"), (2, ""), (3, None), (4, "N")]
    c = spark.createDataFrame(rows, "contig_id long, seq string")
    runs = genome.n_runs(c)
    assert {tuple(r) for r in runs.collect()} == {(0, 0, 2), (0, 5, 2), (0, 8, 1), (0, 70009, 70000), (4, 0, 1)}
    places = [(0, 0, 1, 8), (1, 0, 70005, 10), (2, 0, 140005, 5), (3, 1, 0, 4), (4, 4, 0, 1), (5, 0, 100000, 3), (6, 1, 2, 9)]
    p = spark.createDataFrame(places, "place_id long, contig_id long, cpos long, n long")
    got = {r.place_id: r.part for r in genome.extract(p, genome.packed(c), runs, 100).collect()}
    text = {i: (s or "").upper() for i, s in rows}
    assert got == {i: text[k][a : a + n] for i, k, a, n in places if a + n <= len(text[k])}
    assert {r.key: r.size for r in index.size_dump(spark.createDataFrame([(2, 5)], "key long, size long"), 4).collect()} == {0: 0, 1: 0, 2: 5, 3: 0}
    r = spark.createDataFrame([(0, "ab", None, "ACG", "III")], "read_num long, name string, comment string, seq string, qual string")
    assert tuple(genome.lengths(r).first()) == (0, 2, 0, 3, 3)


def test_cascade_makes_and_deals_out_only_what_reads_meet(spark, tmp_path):
    """Frequent keys are hits without a place, and other keys' postings and other blocks are never made; places stay the same."""
    from seqmap.operators import strategies, verify
    from seqmap.plans import queries

    rows, contigs = _genome(spark)
    same = contigs.select("contig_id", "name", "seq").unionByName(contigs.select((F.col("contig_id") + 3).alias("contig_id"), "name", F.substring("seq", 1, 1500).alias("seq")))
    built = index.build_index(index.with_offsets(same), 12)
    rd = spark.createDataFrame([(i, 1, f"r{i}", rows[i % 3][2][a : a + 120]) for i, a in enumerate(range(0, 2800, 400))], "read_num long, mate byte, name string, seq string")
    params = mapper.params_of(built, low=6, high=8)
    assert strategies.most_of("x4s", params) == 6 and strategies.most_of("xn", params) is None
    every, few = mapper.probe_of(built, rd, params), mapper.probe_of(built, rd, params, 6)
    assert few.hits.count() < every.hits.count()
    keys = lambda p: sorted(tuple(r) for r in p.hits.select("read_num", "strand", "key_idx", "rpos", "size").distinct().collect())
    assert keys(few) == keys(every)
    found = 0
    for x in "x4l":
        got, want = (sorted(map(tuple, strategies.STRATEGIES[x].run(p).collect())) for p in (few, every))
        assert got == want
        found += len(got)
    assert found
    some = built.of(spark.createDataFrame([(built.sizes.first().key,)], "key long"))
    assert 0 < some.count() < 20
    one = verify.genome_blocks(contigs, 10, 1000, (index.np.array([1, 1, 2]), index.np.array([0, 2, 7])))
    assert [(r.contig_id, r.block, r.text) for r in one.collect()] == [(1, 0, rows[1][2][:1010]), (1, 2, rows[1][2][2000:3000])]
    ix = queries.the_index(spark, SF, queries.reads(spark, SF))
    wanted = probe.read_keys(queries.reads(spark, SF), queries.K).select("key").distinct()
    assert ix.sizes.join(wanted, "key", "left_anti").isEmpty()


def test_pseudo_genes_take_a_contig_once(spark):
    """Genes on one contig, on two, without letters; and sizes that tasks count in one array."""
    c = spark.createDataFrame([("a", LINE), ("b", LINE[::-1]), ("n", None)], "name string, seq string")
    e = [("g", 1, "a", 1, 9, "+"), ("g", 2, "a", 5, 20, "-"), ("h", 1, "a", 3, 8, "+"), ("h", 2, "b", 1, 5, "-"), ("i", 1, "n", 1, 3, "+")]
    placed = spark.createDataFrame(e, "gene_id string, exon_no int, chr string, start long, end long, strand string")
    rc = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {("g", LINE[:9] + "NNN" + rc(LINE[4:20])), ("h", LINE[2:8] + "NNN" + rc(LINE[::-1][:5])), ("i", "")}
    assert {tuple(r) for r in counting.pseudo_genes(placed, c).collect()} == want
    joins = counting.pseudo_genes(placed.where("gene_id = 'g'"), c)._jdf.queryExecution().optimizedPlan().toString()
    assert "substr" not in joins  # no contig is copied and cut for each exon
    long = spark.createDataFrame([(0, LINE * 80000), (1, LINE), (2, None)], "contig_id long, seq string").repartition(1)
    got = {tuple(r) for r in index.sizes_of(long, 20).collect()}
    assert got == {tuple(r) for r in index.key_sizes(index.keys_of(long, "contig_id", "seq", 20)).collect()}



def test_alignment_rows_take_the_index_of_their_mates(spark):
    from seqmap.plans import queries

    rd = queries.mates(spark, SF)
    wanted = probe.read_keys(rd, queries.K).select("key").distinct()
    ix = queries.the_index(spark, SF, rd)
    post = ix.of(wanted)
    assert post.join(wanted, "key", "left_anti").isEmpty() and index.key_sizes(post).exceptAll(ix.sizes).isEmpty()
    assert QUERIES["sam_rows"](spark, SF).select("qname", "seq").where("flag < 256").count() == rd.count()



def test_figures_add_up(spark, monkeypatch):
    from seqmap.plans import queries

    def whole(*_):
        raise AssertionError("postings of all keys are counted")

    monkeypatch.setattr(index, "key_sizes", whole)
    got = {r.func: (r.calls, r.hits) for r in QUERIES["strategy_figures"](spark, SF).collect()}
    usable = probe.prepared(queries.reads(spark, SF), queries.K).where("usable").count()
    assert got["x"][0] == usable and got["4"][0] == usable - got["x"][1] and got["s"][0] == got["4"][0] - got["4"][1]


def test_saved_postings_are_keys_and_places(spark, tmp_path):
    """What follows from a place is not stored again, and the index that is read has the same postings."""
    _, contigs = _genome(spark)
    built = index.build_index(contigs, 16)
    index.save_index(built, str(tmp_path / "ix"))
    assert spark.read.parquet(str(tmp_path / "ix/postings")).columns == ["key", "gpos"]
    loaded, some = index.load_index(spark, str(tmp_path / "ix")), built.sizes.limit(50)
    for got, want in ((loaded.postings, built.postings), (loaded.of(some), built.of(some))):
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_alignment_rows_deal_out_no_texts(spark, monkeypatch):
    from seqmap.plans import queries

    def dealt(*_):
        raise AssertionError("texts are dealt out")

    monkeypatch.setattr(index, "spread", dealt)
    assert QUERIES["sam_rows"](spark, SF).where("flag < 256").count() == queries.mates(spark, SF).count()


def test_last_places_and_sizes_of_some_keys(spark, monkeypatch):
    """Places and counts that tasks sum up are those of the postings, with short and long keys, few and many of them."""
    from seqmap.plans import queries

    c = queries.contigs(spark, SF, once=True)
    for k, name in ((24, "bitwise"), (14, "plain")):
        post = index.postings(c, k, name)
        only = post.where("key % 3 = 0").select("key").union(spark.createDataFrame([(-5,), (1 << 40,)], "key long"))
        mine = post.where("key % 3 = 0").groupBy("key")
        want = {tuple(r) for r in mine.agg(F.max("gpos")).collect()}, {tuple(r) for r in mine.count().collect()}
        for most in (1 << 20, 10):
            monkeypatch.setattr(index, "FILTER_KEYS", most)
            got = index.last_places(c, k, name, "default", only), index.sizes_of(c, k, name, only=only)
            assert tuple({tuple(r) for r in x.collect()} for x in got) == want


def test_reference_deals_out_windows_alone(spark, monkeypatch):
    from seqmap.operators import verify

    c = spark.createDataFrame([(0, LINE * 500), (1, LINE), (2, None), (3, "")], "contig_id long, seq string")
    rows = [(c, s, n) for c, s, n in ((0, 16380, 20), (0, 16380, 20), (0, 35980, 20), (0, 35981, 20), (1, 0, 72), (1, 60, 20), (2, 0, 4), (3, 0, 4), (9, 0, 4), (None, 0, 4), (0, -1, 4), (0, 7, 4))]
    text = {0: LINE * 500, 1: LINE}
    want = sorted((c, s, n, text[c][s : s + n]) for c, s, n in rows if c in text and 0 <= s <= len(text[c]) - n)
    df = spark.createDataFrame(rows, "contig_id long, at long, n int")
    run = lambda: sorted(map(tuple, verify.with_reference(df, c, 72, F.col("at"), F.col("n")).select("contig_id", "at", "n", "ref").collect()))
    with monkeypatch.context() as m:
        m.setattr(verify, "genome_blocks", None)
        assert run() == want
    for most in (10, 0):
        monkeypatch.setattr(verify, "FILTER_WINDOWS", 0)
        monkeypatch.setattr(verify, "FILTER_BLOCKS", most)
        assert run() == want
