"""One query for each operator, over documents as contigs and benchmark passages as reads, with SQL twins.

Letters a-z of a text become A, C, G and T. All documents and all passages are used. Where a table of all keys would
be the result, the query gives sums over it, by contig or by size, so that every row counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce as fold

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmap.functions import encodings, guides
from seqmap.functions import sequences as q
from seqmap.operators import candidates, cigar, counting, genome, index, pairing, probe, strategies, verify
from seqmap.plans import mapper
from seqmap.session import cut, shared_dir, stored
from seqmap.sources import sinks

K, LOW, HIGH = 24, 53, 79
PARAMS = strategies.MapParams(k=K, low=LOW, high=HIGH)

_SEQ = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_CONTIGS = f"""contigs AS (SELECT doc_id AS contig_id, {_SEQ} AS seq FROM documents),
placed AS (SELECT contig_id, seq, length(seq) AS size, CAST(sum(length(seq)) OVER (ORDER BY contig_id) - length(seq) AS BIGINT) AS start FROM contigs)"""
_READS = f"reads AS (SELECT item_id AS read_num, {_SEQ} AS seq, length({_SEQ}) AS len FROM benchmark)"
_KEY = "CAST('0b' || translate({w}, 'ACGT', '1001') AS BIGINT)"
_POST = f"""post AS (SELECT {_KEY.format(w=f"substr(seq, CAST(cpos AS INT) + 1, {K})")} AS key, start + cpos AS gpos, contig_id, cpos
FROM (SELECT contig_id, seq, start, unnest(range(0, greatest(size - {K + 1}, 0))) AS cpos FROM placed)),
sizes AS (SELECT key, count(*) AS size FROM post GROUP BY key)"""
_RK = f"""both_strands AS (SELECT read_num, 0 AS strand, seq, len FROM reads UNION ALL SELECT read_num, 1, translate(reverse(seq), 'ACGT', 'TGCA'), len FROM reads),
rk AS (SELECT read_num, strand, rpos AS key_idx, rpos, {_KEY.format(w=f"substr(seq, CAST(rpos AS INT) + 1, {K})")} AS key, len
FROM (SELECT read_num, strand, seq, len, unnest(range(0, greatest(len - {K + 1}, 0))) AS rpos FROM both_strands))"""
_HITS = """hits AS (SELECT rk.read_num, rk.strand, rk.key_idx, rk.rpos, rk.len, rk.key, s.size, p.gpos, p.contig_id, p.cpos, p.gpos - rk.rpos AS diag
FROM rk JOIN sizes s USING (key) JOIN post p USING (key) WHERE p.gpos >= rk.rpos)"""
_ALL = f"WITH {_CONTIGS}, {_READS}, {_POST}, {_RK}, {_HITS}"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def contigs(spark: SparkSession, d: str, once: bool = False) -> DataFrame:
    """once: the letters are made from the texts once and written, for a query that reads them many times; no text is dealt out."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    docs = docs if once else index.spread(docs, "doc_id")
    own = docs.select(F.col("doc_id").alias("contig_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), q.from_text(F.col("text")).alias("seq"))
    return index.with_offsets(stored(own, "contigs") if once else own)


def reads(spark: SparkSession, d: str) -> DataFrame:
    b = spark.read.parquet(f"{d}/benchmark.parquet")
    return b.select(F.col("item_id").alias("read_num"), F.lit(1).cast("tinyint").alias("mate"), F.concat(F.lit("r"), F.col("item_id").cast("string")).alias("name"), q.from_text(F.col("text")).alias("seq"))


def mates(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last third of each passage, the last as reverse complement."""
    r = reads(spark, d)
    n = F.floor(F.length("seq") / 3).cast("int")
    one = r.withColumn("seq", F.substring("seq", F.lit(1), n))
    two = r.withColumn("mate", F.lit(2).cast("tinyint")).withColumn("seq", q.revcomp(F.substring("seq", F.length("seq") - n + 1, n)))
    return one.unionByName(two)


def post(spark: SparkSession, d: str, k: int = K, encoding: str = "bitwise", guide: str = "default") -> DataFrame:
    return index.postings(contigs(spark, d), k, encoding, guide)


def all_sizes(spark: SparkSession, d: str) -> DataFrame:
    return index.sizes_of(contigs(spark, d), K)


def hits(spark: SparkSession, d: str, rd: DataFrame | None = None) -> DataFrame:
    """Reads' keys are few, so postings are first cut down to them; sizes are counted over what is left, which is all of each key."""
    keys = probe.read_keys(rd if rd is not None else reads(spark, d), K)
    own = index.postings(contigs(spark, d), K, only=keys)
    return probe.hits(keys.join(index.key_sizes(own), "key"), own)


def a_probe(spark: SparkSession, d: str, rd: DataFrame | None = None) -> strategies.Probe:
    rd = rd if rd is not None else reads(spark, d)
    return strategies.Probe(hits(spark, d, rd), probe.prepared(rd, K).where("usable"), contigs(spark, d), PARAMS, keys=probe.read_keys(rd, K))


# ---- scalars and guides


@query("revcomp", f"WITH {_READS} SELECT read_num, translate(reverse(seq), 'ACGT', 'TGCA') AS rseq FROM reads")
def _revcomp(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("read_num", q.revcomp(F.col("seq")).alias("rseq"))


@query("n_count", "SELECT doc_id, CAST(length(text) - length(replace(replace(text, 'N', ''), 'n', '')) AS BIGINT) AS n FROM documents")
def _n_count(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", q.n_count(F.col("text")).alias("n"))


@query("subsequence", f"WITH {_READS} SELECT read_num, substr(seq, 11, 20) AS part, translate(reverse(substr(seq, 11, 20)), 'ACGT', 'TGCA') AS turned FROM reads")
def _subsequence(spark: SparkSession, d: str) -> DataFrame:
    cut = lambda turn: q.subsequence(F.col("seq"), F.lit(10), F.lit(20), F.lit(turn))
    return reads(spark, d).select("read_num", cut(False).alias("part"), cut(True).alias("turned"))


@query("guide_default", f"WITH {_CONTIGS} SELECT contig_id AS id, greatest(length(seq) - {K + 1}, 0) AS guides, CAST(greatest(length(seq) - {K + 2}, -1) AS BIGINT) AS last FROM contigs")
def _guide_default(spark: SparkSession, d: str) -> DataFrame:
    c = contigs(spark, d)
    g = index.guides_of(c, "contig_id", "seq", K, "default").groupBy("id").agg(F.count(F.lit(1)).alias("guides"), F.max("pos").alias("last"))
    return c.select(F.col("contig_id").alias("id")).join(g, "id", "left").select("id", F.coalesce("guides", F.lit(0)).cast("long").alias("guides"), F.coalesce("last", F.lit(-1)).cast("long").alias("last"))


def _guide_query(guide: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return index.guides_of(contigs(spark, d), "contig_id", "seq", K, guide).groupBy("id").agg(F.count(F.lit(1)).alias("guides"), F.sum(F.col("over").cast("long")).alias("by_length"), F.sum("pos").alias("places"))

    return run


def _guide_sql(event: str, ahead: int, step: int, tuples: bool, levels: int = 15) -> str:
    """The guides' rule without a scan: where one leads to is known for every place, and the places that are reached from 0 are found by doubling steps.

    event: what stands at a place from which the guide is `ahead` letters off. Steps by length come after 24 letters.
    """
    room = "q + {a} <= i + 24 AND q + {a} < n" if tuples else "q + {a} < i + 24 AND q + {a} <= n - {k}"
    by_length = "i + 24 < n" if tuples else f"i + 23 <= n - {K + 1}"
    room = room.format(a=ahead, k=K + 1)
    jumps = ", ".join(f"j{x} AS MATERIALIZED (SELECT a.id, a.i, b.dest FROM j{x - 1} a JOIN j{x - 1} b ON a.id = b.id AND a.dest = b.i)" for x in range(1, levels))
    reached = ", ".join(f"r{x + 1} AS (SELECT id, i FROM r{x} UNION ALL SELECT r.id, j.dest FROM r{x} r JOIN j{x} j ON r.id = j.id AND r.i = j.i)" for x in range(levels))
    return f"""WITH {_CONTIGS}, l AS (SELECT contig_id AS id, seq AS s, length(seq) AS n, unnest(range(length(seq))) AS i FROM contigs),
c AS (SELECT id, n, i, substr(s, CAST(i AS INT) + 1, 1) AS a, substr(s, CAST(i AS INT) + 2, 1) AS b, substr(s, CAST(i AS INT) + 3, 1) AS c, substr(s, CAST(i AS INT) + 4, 1) AS d FROM l),
e AS (SELECT id, n, i, min(CASE WHEN {event} THEN i END) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM c),
t AS (SELECT id, n, i, CASE WHEN {room} THEN q + {ahead} WHEN {by_length} THEN i + {step} END AS dest, NOT coalesce({room}, false) AS longer FROM e),
j0 AS MATERIALIZED (SELECT id, i, dest, longer FROM t WHERE i <= n - {K + 1} AND dest <= n - {K + 1}), {jumps}, r0 AS (SELECT contig_id AS id, CAST(0 AS BIGINT) AS i FROM contigs), {reached}
SELECT id, count(*) AS guides, count(*) FILTER (WHERE longer) AS by_length, CAST(sum(dest) AS BIGINT) AS places FROM j0 JOIN r{levels} USING (id, i) GROUP BY id"""


for _name, _guide, _event, _ahead, _step in (
    ("guide_tuple_xx", "XX", "a = b", 2, 12),
    ("guide_tuple_xyx", "XYX", "a = c AND a <> b AND b <> ''", 3, 8),
    ("guide_tuple_xxx", "XXX", "a = b AND b = c", 3, 8),
    ("guide_tuple_xxyy", "XXYY", "a = b AND b <> c AND c = d", 4, 6),
    ("guide_tuple_pal4", "PAL4", "a = d AND b = c", 4, 6),
    ("guide_state_xxxp", "XXX+", "a = b AND b = c AND d NOT IN (c, '')", 3, 8),
    ("guide_state_xyx", "X?X", "a = c", 3, 8),
    ("guide_state_palindrome", "palindrome", "a <> b AND b = c AND a = d", 4, 8),
):
    query(_name, _guide_sql(_event, _ahead, _step, "tuple" in _name))(_guide_query(_guide))


_HEADS = "l AS (SELECT {id}, seq, length(seq) AS n, unnest(range(1, length(seq) + 1)) AS i FROM {t}), h AS (SELECT * FROM l WHERE i = 1 OR substr(seq, CAST(i AS INT), 1) <> substr(seq, CAST(i AS INT) - 1, 1))"


@query("homopolymer_runs", f"WITH {_CONTIGS}, {_HEADS.format(id='contig_id', t='contigs')}, r AS (SELECT contig_id, coalesce(lead(i) OVER (PARTITION BY contig_id ORDER BY i), n + 1) - i AS size FROM h) SELECT CAST(size AS INT) AS n, count(*) AS runs, count(DISTINCT contig_id) AS contigs FROM r GROUP BY 1")
def _runs(spark: SparkSession, d: str) -> DataFrame:
    runs = F.regexp_extract_all("seq", F.lit(r"((.)\2*)"), F.lit(1))
    one = contigs(spark, d).select("contig_id", F.explode(F.transform(runs, F.length)).alias("n"))
    return one.groupBy("n").agg(F.count(F.lit(1)).alias("runs"), F.countDistinct("contig_id").alias("contigs"))


_STATES = " UNION ALL ".join(f"SELECT '{g}' AS guide, CAST(sum(guides - by_length) AS BIGINT) AS by_rule, CAST(sum(by_length) AS BIGINT) AS by_length, round(sum(guides - by_length) / sum(guides), 3) AS share FROM (SELECT * FROM ({_guide_sql(event, ahead, 8, False)}))" for g, event, ahead in (("XXX+", "a = b AND b = c AND d NOT IN (c, '')", 3), ("X?X", "a = c", 3), ("palindrome", "a <> b AND b = c AND a = d", 4)))


@query("state_totals", _STATES)
def _state_totals(spark: SparkSession, d: str) -> DataFrame:
    return fold(DataFrame.unionByName, [genome.guide_totals(contigs(spark, d), K, g) for g in ("XXX+", "X?X", "palindrome")])


_NSEQ = "translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTANGTACGTACGTAC')"


def n_contigs(spark: SparkSession, d: str) -> DataFrame:
    """Contigs in which the texts' n stays N."""
    docs = index.spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), "doc_id")
    letters = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTANGTACGTACGTAC")
    return docs.select(F.col("doc_id").alias("contig_id"), letters.alias("seq"))


@query("n_runs", f"""WITH c AS (SELECT doc_id AS contig_id, {_NSEQ} AS seq FROM documents), l AS (SELECT contig_id, seq, unnest(range(length(seq))) AS i FROM c), n AS (SELECT contig_id, i, i - row_number() OVER (PARTITION BY contig_id ORDER BY i) AS isle FROM l WHERE substr(seq, CAST(i AS INT) + 1, 1) = 'N')
SELECT contig_id, min(i) AS start, count(*) AS size FROM n GROUP BY contig_id, isle""")
def _n_runs(spark: SparkSession, d: str) -> DataFrame:
    return genome.n_runs(n_contigs(spark, d))


@query("extract_with_n", f"""WITH c AS (SELECT doc_id AS contig_id, {_NSEQ} AS seq FROM documents), p AS (SELECT contig_id, seq, unnest(range(0, length(seq), 100)) AS cpos FROM c)
SELECT contig_id, cpos, translate(reverse(substr(seq, CAST(cpos AS INT) + 1, 120)), 'ACGT', 'TGCA') AS part FROM p""")
def _extract(spark: SparkSession, d: str) -> DataFrame:
    """Every 100 letters the next 120, from contigs without N and the runs, as reverse complement."""
    c = n_contigs(spark, d)
    size = F.length("seq").cast("long")
    places = c.where("seq <> ''").select("contig_id", size.alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(100).cast("long"))).alias("cpos"))
    places = places.select((F.col("contig_id") * (1 << 32) + F.col("cpos")).alias("place_id"), "contig_id", "cpos", F.least(F.lit(120), F.col("size") - F.col("cpos")).alias("n"))
    return genome.extract(places, genome.packed(c), genome.n_runs(c), 120, reverse=True).select("contig_id", "cpos", "part")


@query("contigs_by_number", f"WITH {_CONTIGS} SELECT '>d' || contig_id || chr(10) || rtrim(regexp_replace(seq, '(.{{80}})', '\\1' || chr(10), 'g'), chr(10)) AS value FROM contigs WHERE contig_id BETWEEN 19 AND 21")
def _by_number(spark: SparkSession, d: str) -> DataFrame:
    """The 20th to the 22nd contig as text in lines of 80 letters; the choice of three is the feature."""
    return sinks.fasta(genome.by_number(contigs(spark, d), 19, 21))


@query("sequence_lengths", "SELECT item_id AS read_num, CAST(length('r' || item_id) AS BIGINT) AS name_len, CAST(0 AS BIGINT) AS comment_len, CAST(length(regexp_replace(lower(text), '[^a-z]', '', 'g')) AS BIGINT) AS seq_len, CAST(0 AS BIGINT) AS qual_len FROM benchmark")
def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return genome.lengths(reads(spark, d))


def _key_query(name: str, k: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return index.keys_of(reads(spark, d), "read_num", "seq", k, name).select(F.col("id").alias("read_num"), "pos", "key")

    return run


def _key_sql(k: int, word: str) -> str:
    return f"WITH {_READS}, w AS (SELECT read_num, seq, unnest(range(0, greatest(len - {k + 1}, 0))) AS pos FROM reads), v AS (SELECT read_num, pos, substr(seq, CAST(pos AS INT) + 1, {k}) AS w FROM w) SELECT read_num, pos, {word} AS key FROM v"


_TWO = "CAST('0b' || replace(replace(replace(replace(w, 'A', '00'), 'C', '01'), 'G', '10'), 'T', '11') AS BIGINT)"
_SIDE, _GAP = encodings.gapped_parts(12)
for _name, _k, _sql in (
    ("bitwise", K, _KEY.format(w="w")),
    ("plain", 12, _TWO),
    ("gapped", 12, _KEY.format(w=f"(substr(w, 1, {_SIDE}) || substr(w, {_SIDE + _GAP + 1}, {_SIDE}))")),
    ("swap", 12, _KEY.format(w="(" + " || ".join(f"substr(w, {i}, 1)" for i in range(1, 12, 2)) + ")")),
):
    query(f"key_{_name}", _key_sql(_k, _sql))(_key_query(_name, _k))
query(
    "key_hpc",
    f"""WITH {_READS}, {_HEADS.format(id='read_num', t='reads')}, o AS (SELECT *, row_number() OVER (PARTITION BY read_num ORDER BY i) AS run, coalesce(lead(i) OVER (PARTITION BY read_num ORDER BY i), n + 1) AS stop FROM h),
s AS (SELECT read_num, string_agg(substr(seq, CAST(i AS INT), 1), '' ORDER BY i) AS rs FROM h GROUP BY read_num), w AS (SELECT o.*, substr(rs, CAST(run AS INT), 12) AS w FROM o JOIN s USING (read_num)),
k AS (SELECT read_num, n, i, stop, CAST((strpos('ACGT', w[1]) - 1) * list_product([strpos(replace('ACGT', w[x], ''), w[x + 1]) for x in range(1, 12)]) AS BIGINT) AS key FROM w WHERE length(w) = 12),
p AS (SELECT read_num, n, unnest(range(i - 1, stop - 1)) AS pos, key FROM k) SELECT read_num, pos, key FROM p WHERE pos < n - 13""",
)(_key_query("hpc", 12))

# ---- the index


@query("contig_offsets", f"WITH {_CONTIGS} SELECT contig_id, size, start, start + size AS \"end\" FROM placed")
def _offsets(spark: SparkSession, d: str) -> DataFrame:
    return contigs(spark, d).select("contig_id", "size", "start", "end")


@query("postings", f"WITH {_CONTIGS}, {_POST} SELECT contig_id, count(*) AS n, CAST(sum(key) AS BIGINT) AS keys, CAST(sum(gpos) AS BIGINT) AS places FROM post GROUP BY contig_id")
def _postings(spark: SparkSession, d: str) -> DataFrame:
    return post(spark, d).groupBy("contig_id").agg(F.count(F.lit(1)).alias("n"), F.sum("key").alias("keys"), F.sum("gpos").alias("places"))


@query("key_sizes", f"WITH {_CONTIGS}, {_POST} SELECT size, count(*) AS keys, CAST(sum(key) AS BIGINT) AS total FROM sizes GROUP BY size")
def _key_sizes(spark: SparkSession, d: str) -> DataFrame:
    return all_sizes(spark, d).groupBy("size").agg(F.count(F.lit(1)).alias("keys"), F.sum("key").alias("total"))


@query("prefix_offsets", f"WITH {_CONTIGS}, {_POST}, o AS (SELECT key, size, sum(size) OVER (ORDER BY key) - size AS off FROM sizes) SELECT key // 65536 AS range, count(*) AS keys, CAST(sum(off) AS BIGINT) AS offsets FROM o GROUP BY 1")
def _prefix(spark: SparkSession, d: str) -> DataFrame:
    o = index.prefix_offsets(all_sizes(spark, d))
    return o.groupBy(F.floor(F.col("key") / 65536).alias("range")).agg(F.count(F.lit(1)).alias("keys"), F.sum("offset").alias("offsets"))


_CUTS = f"(SELECT CAST(unnest([{', '.join(map(str, index.CUTS))}]) AS BIGINT) AS cut)"
_CUT = f"(SELECT min(cut) FROM {_CUTS} c WHERE c.cut >= s.size)"


@query("key_histogram", f"WITH {_CONTIGS}, {_POST}, by_size AS (SELECT size, count(*) AS n FROM sizes GROUP BY size) SELECT cut, CAST(sum(n) AS BIGINT) AS keys FROM (SELECT {_CUT} AS cut, n FROM by_size s UNION ALL SELECT 0, {1 << K} - (SELECT count(*) FROM sizes)) GROUP BY cut")
def _histogram(spark: SparkSession, d: str) -> DataFrame:
    return index.size_histogram(all_sizes(spark, d), index.total_keys("bitwise", K))


@query("size_dump", f"WITH {_CONTIGS}, {_POST} SELECT r // 65536 AS range, count(*) AS keys, count(*) FILTER (WHERE size IS NULL) AS empty, CAST(coalesce(sum(size), 0) AS BIGINT) AS places FROM range({1 << K}) t(r) LEFT JOIN sizes ON key = r GROUP BY 1")
def _size_dump(spark: SparkSession, d: str) -> DataFrame:
    dump = index.size_dump(all_sizes(spark, d), index.total_keys("bitwise", K))
    return dump.groupBy(F.floor(F.col("key") / 65536).alias("range")).agg(F.count(F.lit(1)).alias("keys"), F.count_if(F.col("size") == 0).alias("empty"), F.sum("size").alias("places"))


@query("key_stats", f"WITH {_CONTIGS}, {_POST} SELECT count(*) AS keys, round(avg(log10(size)), 6) AS mean_log10, round(stddev_samp(log10(size)), 6) AS sd_log10 FROM sizes")
def _stats(spark: SparkSession, d: str) -> DataFrame:
    return index.key_stats(all_sizes(spark, d)).select("keys", F.round("mean_log10", 6).alias("mean_log10"), F.round("sd_log10", 6).alias("sd_log10"))


@query("q95_limits", f"WITH {_CONTIGS}, {_POST}, h AS (SELECT {_CUT} AS cut, count(*) AS n FROM sizes s GROUP BY 1), r AS (SELECT cut, sum(n) OVER (ORDER BY cut) AS so_far, sum(n) OVER () AS total FROM h) SELECT CAST(min(cut) AS BIGINT) AS q95 FROM r WHERE so_far >= floor(total * 95 / 100)")
def _q95(spark: SparkSession, d: str) -> DataFrame:
    return index.q95(all_sizes(spark, d))


@query("drop_heavy_keys", f"WITH {_CONTIGS}, {_POST} SELECT count(*) AS keys, CAST(sum(size) AS BIGINT) AS places, max(size) AS most FROM sizes WHERE size < 20")
def _heavy(spark: SparkSession, d: str) -> DataFrame:
    return index.drop_heavy_keys(all_sizes(spark, d), 20).agg(F.count(F.lit(1)).alias("keys"), F.sum("size").alias("places"), F.max("size").alias("most"))


@query("locate_contig", f"WITH {_CONTIGS}, {_POST} SELECT contig_id, count(*) AS n, CAST(sum(cpos) AS BIGINT) AS places FROM post GROUP BY contig_id")
def _locate(spark: SparkSession, d: str) -> DataFrame:
    c = contigs(spark, d)
    found = index.locate_contig(index.postings(c, K).select("gpos"), c.select("contig_id", "start", "end"))
    return found.groupBy("contig_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cpos").alias("places"))


# ---- reads and hits


@query("read_window", f"WITH {_READS} SELECT read_num, CAST(len AS BIGINT) AS len FROM reads WHERE read_num >= 5 AND read_num < 30")
def _window(spark: SparkSession, d: str) -> DataFrame:
    return probe.read_window(reads(spark, d), 5, 30).select("read_num", F.length("seq").cast("long").alias("len"))


@query("probe_hits", f"{_ALL} SELECT read_num, strand, key_idx, rpos, size, gpos, contig_id, cpos FROM hits")
def _hits(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("read_num", F.col("strand").cast("int").alias("strand"), F.col("key_idx").cast("long").alias("key_idx"), "rpos", "size", "gpos", "contig_id", "cpos")


@query("size_rank", f"{_ALL} SELECT read_num, strand, rpos, coalesce(size, 0) AS size, row_number() OVER (PARTITION BY read_num, strand ORDER BY coalesce(size, 0), rpos) AS size_rank FROM rk LEFT JOIN sizes USING (key)")
def _rank(spark: SparkSession, d: str) -> DataFrame:
    keys = probe.read_keys(reads(spark, d), K)
    sizes = index.key_sizes(index.postings(contigs(spark, d), K, only=keys))
    return probe.sized(keys, sizes).select("read_num", F.col("strand").cast("int").alias("strand"), "rpos", "size", F.col("size_rank").cast("long").alias("size_rank"))


_TARGET = "targets AS (SELECT DISTINCT 2 * read_num + strand AS id, key, 1000 * read_num AS target FROM rk)"


@query("nearest_posting", f"{_ALL}, {_TARGET}, r AS (SELECT id, key, target, gpos, row_number() OVER (PARTITION BY id, key, target ORDER BY abs(gpos - target), gpos) AS n FROM targets JOIN post USING (key) WHERE abs(gpos - target) <= 100000) SELECT id, key, target, gpos FROM r WHERE n = 1")
def _nearest(spark: SparkSession, d: str) -> DataFrame:
    keys = probe.read_keys(reads(spark, d), K)
    t = keys.select((2 * F.col("read_num") + F.col("strand")).alias("id"), "key", (F.col("read_num") * 1000).alias("target")).distinct()
    return probe.nearest_posting(t, index.postings(contigs(spark, d), K, only=t), 100000)


_A = "a AS (SELECT DISTINCT read_num, strand, contig_id, key_idx, gpos FROM hits), b AS (SELECT read_num, strand, contig_id, key_idx - 1 AS key_idx, gpos AS gpos2 FROM a)"
_ON = ["read_num", "strand", "contig_id", "key_idx"]


def _neighbours(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Places of all keys, and of the keys after them under the number of the key before."""
    h = hits(spark, d).select("read_num", F.col("strand").cast("int").alias("strand"), "contig_id", F.col("key_idx").cast("long").alias("key_idx"), "gpos").distinct()
    return h, h.select("read_num", "strand", "contig_id", (F.col("key_idx") - 1).alias("key_idx"), F.col("gpos").alias("gpos2"))


@query("band_join", f"{_ALL}, {_A} SELECT read_num, strand, contig_id, key_idx, gpos, gpos2 FROM a JOIN b USING (read_num, strand, contig_id, key_idx) WHERE abs(gpos - gpos2) <= 33")
def _band(spark: SparkSession, d: str) -> DataFrame:
    return candidates.band_join(*_neighbours(spark, d), _ON, 33)


@query("band_refine", f"{_ALL}, {_A}, m AS (SELECT DISTINCT read_num, strand, contig_id, key_idx, gpos FROM a JOIN b USING (read_num, strand, contig_id, key_idx) WHERE abs(gpos - gpos2) <= 33) SELECT * FROM m UNION ALL SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.read_num = a.read_num AND m.strand = a.strand AND m.contig_id = a.contig_id AND m.key_idx = a.key_idx)")
def _refine(spark: SparkSession, d: str) -> DataFrame:
    a, b = _neighbours(spark, d)
    return candidates.band_refine(a, b.withColumnRenamed("gpos2", "gpos"), _ON, 33)


@query("distinct_diag", f"{_ALL}, r AS (SELECT read_num, strand, diag, rpos, gpos, row_number() OVER (PARTITION BY read_num, strand, diag ORDER BY rpos, gpos) AS n FROM hits) SELECT read_num, strand, diag, rpos, gpos FROM r WHERE n = 1")
def _distinct(spark: SparkSession, d: str) -> DataFrame:
    return candidates.distinct_diagonals(hits(spark, d)).select("read_num", F.col("strand").cast("int").alias("strand"), "diag", "rpos", "gpos")


_VOTES = "votes AS (SELECT read_num, strand, contig_id, diag, count(*) AS votes FROM hits GROUP BY ALL)"


@query("argmax_ties", f"{_ALL}, {_VOTES}, m AS (SELECT read_num, max(votes) AS best FROM votes GROUP BY 1) SELECT read_num, best, count(*) - 1 AS ties FROM votes JOIN m USING (read_num) WHERE votes = best GROUP BY read_num, best")
def _ties(spark: SparkSession, d: str) -> DataFrame:
    v = hits(spark, d).groupBy("read_num", "strand", "contig_id", "diag").agg(F.count(F.lit(1)).alias("votes"))
    return candidates.best_with_ties(v, ["read_num"], "votes")


# ---- strategies


@query("best_location", f"{_ALL}, {_VOTES}, r AS (SELECT *, rank() OVER (PARTITION BY read_num ORDER BY votes DESC) AS k FROM votes WHERE votes >= 2) SELECT read_num, contig_id, strand, diag, votes FROM r WHERE k = 1")
def _best(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    v = hits(spark, d).groupBy("read_num", "strand", "contig_id", "diag").agg(F.count(F.lit(1)).alias("votes")).where("votes >= 2")
    v = v.withColumn("k", F.rank().over(W.partitionBy("read_num").orderBy(F.desc("votes")))).where("k = 1")
    return v.select("read_num", "contig_id", F.col("strand").cast("int").alias("strand"), "diag", "votes")


def _diag_sql(used: str, hits: str) -> str:
    return f"""{_ALL}, {_VOTES.replace("FROM hits", f"FROM (SELECT * FROM hits WHERE {hits})")}, ks AS (SELECT read_num, strand, count(*) AS possible, count(*) FILTER (WHERE {used}) AS used FROM rk LEFT JOIN sizes USING (key) GROUP BY ALL),
b AS (SELECT v.*, used, possible, max(votes) OVER (PARTITION BY read_num, strand) AS best FROM votes v JOIN ks USING (read_num, strand)), t AS (SELECT *, count(*) OVER (PARTITION BY read_num, strand) - 1 AS ties, votes * 80 // greatest(used, 5) + used * 20 // possible AS score FROM b WHERE votes = best)
SELECT read_num, strand, contig_id, diag, votes FROM t WHERE (used > 1 OR ties <= 16) AND NOT (ties > 128 AND score < 50) AND NOT (votes < 4 AND ties > 16) AND NOT (ties > 0 AND votes < 3 AND used >= 6)"""


@query("diag_vote_low", _diag_sql("coalesce(size, 0) < 3", "size < 3"))
def _diag_low(spark: SparkSession, d: str) -> DataFrame:
    return strategies.diag_votes(a_probe(spark, d), 3).select("read_num", F.col("strand").cast("int").alias("strand"), "contig_id", "diag", "votes")


@query("diag_vote", _diag_sql("true", "true"))
def _diag(spark: SparkSession, d: str) -> DataFrame:
    return strategies.diag_votes(a_probe(spark, d), None).select("read_num", F.col("strand").cast("int").alias("strand"), "contig_id", "diag", "votes")


@query("diag_vote_tolerant", f"{_ALL}, v AS (SELECT read_num, strand, diag, count(*) AS votes FROM hits GROUP BY ALL) SELECT read_num, strand, diag, votes, CAST(sum(votes) OVER (PARTITION BY read_num, strand ORDER BY diag RANGE BETWEEN 9 PRECEDING AND 9 FOLLOWING) AS BIGINT) AS near_votes FROM v")
def _tolerant(spark: SparkSession, d: str) -> DataFrame:
    return strategies.tolerant_votes(hits(spark, d)).select("read_num", F.col("strand").cast("int").alias("strand"), "diag", "votes", "near_votes")


_PLACES = """places AS (SELECT h.read_num, h.strand, h.contig_id, h.diag, h.len, h.size, h.rpos, b.seq, substr(p.seq, CAST(h.cpos - h.rpos + 1 AS INT), CAST(h.len AS INT)) AS ref
FROM hits h JOIN placed p USING (contig_id) JOIN both_strands b ON b.read_num = h.read_num AND b.strand = h.strand WHERE h.cpos >= h.rpos)"""


@query("blast_like_x", f"""{_ALL}, {_PLACES}, k AS (SELECT read_num, strand, rpos, row_number() OVER (PARTITION BY read_num ORDER BY size, strand, rpos) AS key_rank FROM (SELECT DISTINCT read_num, strand, rpos, size FROM hits WHERE size < {LOW // 2})),
f AS (SELECT p.*, key_rank, row_number() OVER (PARTITION BY read_num, strand, diag ORDER BY key_rank) AS n FROM places p JOIN k USING (read_num, strand, rpos)),
e AS (SELECT read_num, strand, contig_id, diag, len, key_rank, hamming(seq, ref) AS err FROM f WHERE n = 1 AND length(ref) = len),
g AS (SELECT *, min(CASE WHEN (len - err) * 100 // len >= 98 THEN key_rank END) OVER (PARTITION BY read_num) AS stop FROM e WHERE err <= len // 8 + 1),
s AS (SELECT *, min(err) OVER (PARTITION BY read_num) AS best FROM g WHERE stop IS NULL OR key_rank <= stop)
SELECT read_num, strand, contig_id, diag, CAST(len - err AS BIGINT) AS votes FROM s WHERE err = best""")
def _blast(spark: SparkSession, d: str) -> DataFrame:
    return strategies.STRATEGIES["x"].run(a_probe(spark, d)).select("read_num", F.col("strand").cast("int").alias("strand"), "contig_id", "diag", "votes")


@query("sweep_window", f"{_ALL}, a AS (SELECT DISTINCT read_num, strand, gpos, len FROM hits WHERE size < {LOW}) SELECT a.read_num, a.strand, a.gpos, count(DISTINCT b.key_idx) AS keys FROM a JOIN hits b ON a.read_num = b.read_num AND a.strand = b.strand AND b.size < {LOW} AND b.gpos >= a.gpos AND b.gpos <= a.gpos + 2 * a.len GROUP BY ALL")
def _sweep(spark: SparkSession, d: str) -> DataFrame:
    p = a_probe(spark, d)
    return strategies.sweep_votes(p.hits.where(F.col("size") < LOW), p.reads).select("read_num", F.col("strand").cast("int").alias("strand"), "gpos", "keys")


def _strategy_query(letter: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return strategies.STRATEGIES[letter].run(a_probe(spark, d))

    return run


for _name, _letter in (("extremes_4", "4"), ("half_1", "1"), ("two_keys_s", "s"), ("leftmost_l", "l"), ("nested_n", "n"), ("min_apart_a", "a"), ("clusters_h", "h"), ("tree_i", "i"), ("moving_window_m", "m"), ("sweep_q", "Q")):
    QUERIES[_name] = _strategy_query(_letter)


@query("mates_u")
def _mates_u(spark: SparkSession, d: str) -> DataFrame:
    return strategies.STRATEGIES["U"].run(a_probe(spark, d, mates(spark, d)))


def the_index(spark: SparkSession, d: str, rd: DataFrame) -> index.Index:
    """An index with the fixed limits for some reads: all contigs, with the places of the reads' keys, which are all that a probe can meet."""
    c, keys = contigs(spark, d, once=True), probe.read_keys(rd, K)
    make = lambda some, own: index.postings(own, K, only=some)
    ends = lambda some: index.last_places(c, K, "bitwise", "default", some)
    return index.Index(index.IndexMeta(K, "bitwise", "default", 0, 0.0, 0.0, 200), c, index.postings(c, K), index.sizes_of(c, K, only=keys), make, ends)


@query("strategy_figures")
def _figures(spark: SparkSession, d: str) -> DataFrame:
    rd = reads(spark, d)
    got = mapper.map_reads(the_index(spark, d, rd), rd, "x4s", params=PARAMS)
    return pairing.strategy_summary(probe.prepared(rd, K).where("usable").select("read_num", "mate"), got, "x4s")


@query("cascade_x4s")
def _cascade(spark: SparkSession, d: str) -> DataFrame:
    rd = reads(spark, d)
    return mapper.map_reads(the_index(spark, d, rd), rd, "x4s", params=PARAMS)


# ---- verification, alignment, mates


def _placed(spark: SparkSession, d: str) -> DataFrame:
    p = a_probe(spark, d)
    one = p.hits.dropDuplicates(["read_num", "mate", "strand", "diag"]).drop("key")
    return strategies.compared(one, p)


_ERR = f"{_ALL}, {_PLACES}, e AS (SELECT DISTINCT read_num, strand, diag, len, hamming(seq, ref) AS err FROM places WHERE length(ref) = len)"


@query("hamming_verify", f"{_ERR} SELECT read_num, strand, diag, CAST(err AS BIGINT) AS err FROM e")
def _hamming(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).select("read_num", F.col("strand").cast("int").alias("strand"), "diag", "err")


@query("accept_classes", f"{_ERR} SELECT CASE WHEN err <= len // 16 THEN 'A' WHEN err <= len // 8 THEN 'G' WHEN err <= len // 4 THEN '2' WHEN err <= len // 2 THEN '3' ELSE 'g' END AS status, count(*) AS places, count(DISTINCT read_num) AS reads FROM e GROUP BY 1")
def _classes(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d).groupBy(verify.accept_class(F.col("err"), F.col("len")).alias("status")).agg(F.count(F.lit(1)).alias("places"), F.countDistinct("read_num").alias("reads"))


@query("gapped_align")
def _gapped(spark: SparkSession, d: str) -> DataFrame:
    p = _placed(spark, d).where(F.col("err") <= F.shiftright("len", 1))
    return verify.gapped(p, pos="cstart").select("read_num", F.col("strand").cast("int").alias("strand"), "contig_id", "cstart", "err", "cost", "cigar0", "cigar", "score", "left")


@query("cigar_reduce")
def _cigar(spark: SparkSession, d: str) -> DataFrame:
    aligned = _gapped(spark, d).select("cigar0").distinct()

    def run(batches):  # noqa: ANN001, ANN202
        import pyarrow as pa

        for b in batches:
            got = [cigar.describe(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_pylist([{"cigar0": g["in"], "consumed": g["consumed"], "cigar": g["out"], "reduced": g["out_consumed"]} for g in got], schema=pa.schema([("cigar0", pa.string()), ("consumed", pa.int64()), ("cigar", pa.string()), ("reduced", pa.int64())]))

    return aligned.mapInArrow(run, "cigar0 string, consumed long, cigar string, reduced long")


def _mate_places(spark: SparkSession, d: str) -> DataFrame:
    """Places of both mates with at most a sixteenth of mismatches."""
    p = a_probe(spark, d, mates(spark, d))
    c = strategies.compared(p.hits.dropDuplicates(["read_num", "mate", "strand", "diag"]).drop("key"), p).where(F.col("err") <= F.shiftright("len", 4))
    return c.select("read_num", "mate", "contig_id", "strand", F.col("cstart").alias("start"), "len", verify.hamming_score(F.col("err"), F.col("len")).alias("score"))


_MATES = f"""WITH {_CONTIGS}, {_READS}, third AS (SELECT read_num, 1 AS mate, substr(seq, 1, len // 3) AS seq FROM reads UNION ALL SELECT read_num, 2, translate(reverse(right(seq, len // 3)), 'ACGT', 'TGCA') FROM reads),
m AS (SELECT read_num, mate, 0 AS strand, seq, length(seq) AS len FROM third UNION ALL SELECT read_num, mate, 1, translate(reverse(seq), 'ACGT', 'TGCA'), length(seq) FROM third), {_POST},
rk AS (SELECT read_num, mate, strand, seq, len, rpos, {_KEY.format(w=f"substr(seq, CAST(rpos AS INT) + 1, {K})")} AS key FROM (SELECT *, unnest(range(0, greatest(len - {K + 1}, 0))) AS rpos FROM m)),
h AS (SELECT DISTINCT read_num, mate, strand, contig_id, cpos - rpos AS start, len, seq FROM rk JOIN post USING (key) WHERE cpos >= rpos),
e AS (SELECT h.*, hamming(h.seq, substr(p.seq, CAST(h.start + 1 AS INT), CAST(len AS INT))) AS err FROM h JOIN placed p USING (contig_id) WHERE h.start + len <= p.size),
pl AS (SELECT read_num, mate, contig_id, strand, start, len, (len - err) * 100 // len AS score FROM e WHERE err <= len // 16),
pairs AS (SELECT a.read_num, a.contig_id, a.strand AS a_strand, a.start AS a_start, b.start AS b_start, greatest(a.start + a.len, b.start + b.len) - least(a.start, b.start) AS span, (a.score + b.score) // 2 AS pair_score
FROM pl a JOIN pl b ON a.read_num = b.read_num AND a.contig_id = b.contig_id AND a.mate = 1 AND b.mate = 2 AND a.strand <> b.strand),
near AS (SELECT * FROM pairs WHERE span <= 1500), best AS (SELECT *, max(pair_score) OVER (PARTITION BY read_num) AS top FROM near),
cls AS (SELECT r.read_num, CASE WHEN EXISTS (SELECT 1 FROM near n WHERE n.read_num = r.read_num) THEN 'R1R2' WHEN p1 AND p2 THEN 'Trans' WHEN p1 THEN 'R1' WHEN p2 THEN 'R2' ELSE 'Unmapped' END AS class
FROM (SELECT read_num, EXISTS (SELECT 1 FROM pl WHERE pl.read_num = reads.read_num AND mate = 1) AS p1, EXISTS (SELECT 1 FROM pl WHERE pl.read_num = reads.read_num AND mate = 2) AS p2 FROM reads) r)"""


@query("pair_within_insert", f"{_MATES} SELECT read_num, contig_id, a_strand, a_start, b_start, span, CAST(pair_score AS BIGINT) AS pair_score, count(*) OVER (PARTITION BY read_num) - 1 AS ties FROM best WHERE pair_score = top")
def _pairs(spark: SparkSession, d: str) -> DataFrame:
    p = _mate_places(spark, d)
    return pairing.within_insert(p.where("mate = 1"), p.where("mate = 2")).select("read_num", "contig_id", F.col("a_strand").cast("int").alias("a_strand"), "a_start", "b_start", "span", "pair_score", "ties")


@query("pair_classes", f"{_MATES} SELECT read_num, class FROM cls")
def _pair_classes(spark: SparkSession, d: str) -> DataFrame:
    p = _mate_places(spark, d)
    pairs = pairing.within_insert(p.where("mate = 1"), p.where("mate = 2"))
    return pairing.classes(mates(spark, d), p, pairs)


@query("summary_classes", f"{_MATES} SELECT class, count(*) AS reads, round(count(*) * 100.0 / (SELECT count(*) FROM cls), 4) AS percent FROM cls GROUP BY class")
def _summary(spark: SparkSession, d: str) -> DataFrame:
    return pairing.summary(_pair_classes(spark, d))


@query("mate_search")
def _mate_search(spark: SparkSession, d: str) -> DataFrame:
    rd = mates(spark, d)
    p = a_probe(spark, d, rd)
    anchors = _mate_places(spark, d).where("mate = 1")
    return pairing.mate_search(anchors, p.hits.where("mate = 2"), p.reads, p.contigs, strategies.reach(p))


def _sam(spark: SparkSession, d: str) -> DataFrame:
    rd = mates(spark, d)
    own = the_index(spark, d, rd)
    got = mapper.map_reads(own, rd, "x", params=PARAMS).withColumn("cigar0", F.col("cigar"))
    return pairing.sam_rows(probe.prepared(rd, K), got, own.contigs, read_group="lane1")


@query("sam_rows")
def _sam_rows(spark: SparkSession, d: str) -> DataFrame:
    return _sam(spark, d)


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    """A row for each mate with the flags of unmapped ones."""
    placed = _mate_places(spark, d).select("read_num", "mate").distinct().withColumn("here", F.lit(True))
    other = placed.select("read_num", (3 - F.col("mate")).cast("tinyint").alias("mate"), F.col("here").alias("there"))
    rows = mates(spark, d).join(placed, ["read_num", "mate"], "left").join(other, ["read_num", "mate"], "left")
    flags = F.lit(pairing.PAIRED) + F.when(F.col("here").isNull(), pairing.UNMAPPED).otherwise(0) + F.when(F.col("there").isNull(), pairing.MATE_UNMAPPED).otherwise(0)
    return rows.select("read_num", "mate", F.col("name").alias("qname"), "seq", F.lit("*").alias("qual"), flags.alias("flag"))


@query("unmapped_text", f"{_MATES} SELECT '@r' || read_num || chr(10) || seq || chr(10) || '+' || chr(10) || '*' AS value FROM third JOIN cls USING (read_num) WHERE class IN ('R1', 'R2', 'Unmapped')")
def _unmapped_text(spark: SparkSession, d: str) -> DataFrame:
    """Pairs with an unmapped mate, as the file of unmapped reads has them."""
    return sinks.unmapped_fastq(pairing.route_unmapped(_flagged(spark, d), 1)[1])


@query("unmapped_split", f"""{_MATES}, c AS (SELECT CAST(2 * count(*) AS BIGINT) AS n, CAST(2 * count(*) FILTER (WHERE class IN ('R1', 'R2', 'Unmapped')) AS BIGINT) AS part, CAST(2 * count(*) FILTER (WHERE class = 'Unmapped') AS BIGINT) AS lost FROM cls)
SELECT mode, n - CASE mode WHEN 0 THEN 0 WHEN 1 THEN part WHEN 2 THEN lost WHEN 3 THEN part ELSE lost END AS stay, CASE mode WHEN 1 THEN part WHEN 2 THEN lost ELSE 0 END AS aside FROM c, (SELECT CAST(unnest(range(5)) AS INT) AS mode)""")
def _split(spark: SparkSession, d: str) -> DataFrame:
    rows = cut(_flagged(spark, d).select("read_num", "mate", "flag"))
    parts = [(mode, *pairing.route_unmapped(rows, mode)) for mode in range(5)]
    every = [x.select(F.lit(mode).alias("mode"), F.lit(k).alias("k")) for mode, *two in parts for k, x in enumerate(two)]
    n = fold(DataFrame.unionByName, every).groupBy("mode").agg(F.sum(1 - F.col("k")).alias("stay"), F.sum("k").alias("aside"))
    return spark.range(5).select(F.col("id").cast("int").alias("mode")).join(n, "mode", "left").select("mode", F.coalesce("stay", F.lit(0)).cast("long").alias("stay"), F.coalesce("aside", F.lit(0)).cast("long").alias("aside"))


def _searched(spark: SparkSession, d: str, mate: int, rd: DataFrame, p: strategies.Probe, places: DataFrame) -> DataFrame:
    return pairing.mate_search(places.where(F.col("mate") == mate), p.hits.where(F.col("mate") == 3 - mate), p.reads, p.contigs, strategies.reach(p))


@query("pair_tree", f"""{_MATES}, near_by AS (SELECT DISTINCT a.read_num, a.mate FROM pl a JOIN e b ON a.read_num = b.read_num AND a.contig_id = b.contig_id AND a.mate <> b.mate AND a.strand <> b.strand
WHERE b.err < b.len / 2 AND greatest(a.start + a.len, b.start + b.len) - least(a.start, b.start) <= 1500)
SELECT read_num, CASE WHEN 1 IN (SELECT mate FROM near_by n WHERE n.read_num = r.read_num) THEN 'R1R2' WHEN 2 IN (SELECT mate FROM near_by n WHERE n.read_num = r.read_num) THEN 'R2R1'
WHEN p1 AND p2 THEN 'Trans' WHEN p1 THEN 'R1' WHEN p2 THEN 'R2' ELSE 'Unmapped' END AS class
FROM (SELECT read_num, EXISTS (SELECT 1 FROM pl WHERE pl.read_num = reads.read_num AND mate = 1) AS p1, EXISTS (SELECT 1 FROM pl WHERE pl.read_num = reads.read_num AND mate = 2) AS p2 FROM reads) r""")
def _pair_tree(spark: SparkSession, d: str) -> DataFrame:
    """The mate is searched near the places of mate 1, and for pairs without any near those of mate 2."""
    rd = mates(spark, d)
    p, places = a_probe(spark, d, rd), _mate_places(spark, d)
    one = _searched(spark, d, 1, rd, p, places)
    two = _searched(spark, d, 2, rd, p, places).join(one.select("read_num").distinct(), "read_num", "left_anti")
    return pairing.classes(rd, places, one.select("read_num", "a_mate").unionByName(two.select("read_num", "a_mate")))


_OTHER_NAME = "CASE WHEN item_id % 3 = 0 THEN 'x' ELSE 'r' END || item_id || '/2'"


@query("paired_scan", f"SELECT item_id AS read_num, mate, CASE WHEN mate = 1 THEN 'r' || item_id || '/1' ELSE {_OTHER_NAME} END AS name, item_id % 3 = 0 AS warn FROM benchmark, (SELECT unnest([1, 2]) AS mate)")
def _paired_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two files of reads by number; every third name of the second differs."""
    r = reads(spark, d).drop("mate")
    n = F.col("read_num").cast("string")
    one = r.withColumn("name", F.concat(F.lit("r"), n, F.lit("/1")))
    two = r.withColumn("name", F.concat(F.when(F.col("read_num") % 3 == 0, "x").otherwise("r"), n, F.lit("/2")))
    return probe.zip_mates(one, two).select("read_num", F.col("mate").cast("int").alias("mate"), "name", "warn")


# ---- genes and exons: each document is a gene with exons of 120 letters every 100, twice in two transcripts

_EXONS = f"""WITH {_CONTIGS}, x AS (SELECT contig_id AS gene_id, size, unnest(range(0, greatest(size // 100, 1))) AS i FROM placed WHERE size > 0),
exons AS (SELECT gene_id, i * 100 + 1 AS start, least(i * 100 + 120, size) AS "end", CASE WHEN gene_id % 2 = 0 THEN '+' ELSE '-' END AS strand, i FROM x)"""


def gtf(spark: SparkSession, d: str, c: DataFrame | None = None) -> DataFrame:
    c = (contigs(spark, d) if c is None else c).where("size > 0")
    i = F.explode(F.sequence(F.lit(0), F.greatest(F.floor(F.col("size") / 100), F.lit(1)) - 1)).alias("i")
    e = c.select(F.col("name").alias("seqname"), F.col("contig_id").alias("gene_id"), "size", i)
    strand = F.when(F.col("gene_id") % 2 == 0, "+").otherwise("-")
    e = e.select("seqname", "gene_id", (F.col("i") * 100 + 1).alias("start"), F.least(F.col("i") * 100 + 120, F.col("size")).alias("end"), strand.alias("strand"), F.lit("exon").alias("feature"), "i")
    two = e.withColumn("transcript_id", F.lit("t1")).unionByName(e.where("i % 2 = 0").withColumn("transcript_id", F.lit("t2")))
    return two.drop("i")


@query("exon_distinct", f"{_EXONS} SELECT gene_id, start, \"end\", strand FROM exons")
def _exons(spark: SparkSession, d: str) -> DataFrame:
    return counting.distinct_exons(gtf(spark, d)).select("gene_id", "start", "end", "strand")


@query("gene_summary", f"{_EXONS} SELECT gene_id, min(start) AS start, max(\"end\") AS \"end\", min(strand) AS strand, count(*) AS n_exons, CAST(1 + max(CASE WHEN i % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_transcripts FROM exons GROUP BY gene_id")
def _genes(spark: SparkSession, d: str) -> DataFrame:
    return counting.genes(gtf(spark, d)).drop("chr")


@query("transcripts", f"{_EXONS} SELECT gene_id, 't1' AS transcript_id, count(*) AS n_exons FROM exons GROUP BY 1 UNION ALL SELECT gene_id, 't2', count(*) FROM exons WHERE i % 2 = 0 GROUP BY 1")
def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    return counting.transcripts(gtf(spark, d))


_LAYOUT = f"""{_EXONS}, l AS (SELECT gene_id, row_number() OVER w AS exon_no, start, "end", CAST(coalesce(sum("end" - start + 4) OVER (PARTITION BY gene_id ORDER BY start, "end", strand ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS phy_start,
coalesce(start < lag("end") OVER w, false) AS overlaps_prev FROM exons WINDOW w AS (PARTITION BY gene_id ORDER BY start, "end", strand))"""


@query("gene_layout", f"{_LAYOUT} SELECT gene_id, exon_no, phy_start, phy_start + \"end\" - start AS phy_end, overlaps_prev FROM l")
def _layout(spark: SparkSession, d: str) -> DataFrame:
    return counting.layout(counting.distinct_exons(gtf(spark, d))).select("gene_id", F.col("exon_no").cast("long").alias("exon_no"), "phy_start", "phy_end", "overlaps_prev")


@query("pseudo_genes", f"{_LAYOUT}, p AS (SELECT l.gene_id, exon_no, CASE WHEN l.gene_id % 2 = 1 THEN translate(reverse(substr(seq, CAST(start AS INT), CAST(\"end\" - start + 1 AS INT))), 'ACGT', 'TGCA') ELSE substr(seq, CAST(start AS INT), CAST(\"end\" - start + 1 AS INT)) END AS part FROM l JOIN contigs ON contig_id = l.gene_id) SELECT gene_id, md5(string_agg(part, 'NNN' ORDER BY exon_no)) AS seq FROM p GROUP BY gene_id")
def _pseudo(spark: SparkSession, d: str) -> DataFrame:
    placed = counting.layout(counting.distinct_exons(gtf(spark, d)))
    return counting.pseudo_genes(placed, contigs(spark, d)).select("gene_id", F.md5("seq").alias("seq"))


@query("exon_tables", f"{_LAYOUT}, n AS (SELECT gene_id, exon_no, row_number() OVER (ORDER BY gene_id, exon_no) - 1 AS exon_id FROM l) SELECT gene_id, min(exon_id) AS first_exon, count(*) AS exons, CAST(2 AS BIGINT) AS transcripts FROM n GROUP BY gene_id")
def _exon_tables(spark: SparkSession, d: str) -> DataFrame:
    """Exon and transcript tables that are written, read again and summed up by gene."""
    path, g = f"{shared_dir(spark)}/exons-{uuid.uuid4().hex[:12]}", gtf(spark, d)
    counting.save_exons(counting.exon_table(counting.layout(counting.distinct_exons(g))), counting.transcripts(g), path)
    _, own, first = counting.load_exons(spark, path)
    return first.join(own.groupBy("gene_id").agg(F.count(F.lit(1)).alias("transcripts")), "gene_id")


@query("effective_size", f"{_EXONS} SELECT gene_id, CAST(max(\"end\") AS BIGINT) AS eff_size FROM exons GROUP BY gene_id")
def _effective(spark: SparkSession, d: str) -> DataFrame:
    return counting.effective_size(counting.distinct_exons(gtf(spark, d)))


def _gene_hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = hits(spark, d).withColumn("gene_id", F.col("contig_id")).withColumn("exon_id", F.floor(F.col("cpos") / 100))
    return h, h.select("read_num", "mate", "strand", "key_idx", "size").distinct()


def _won(spark: SparkSession, d: str) -> DataFrame:
    return counting.gene_votes(*_gene_hits(spark, d))


_WON = f"""{_ALL}, one AS (SELECT DISTINCT read_num, strand AS orientation, key_idx, contig_id AS gene_id FROM hits),
v AS (SELECT read_num, orientation, gene_id, count(*) AS votes, max(key_idx) AS reached FROM one GROUP BY ALL), b AS (SELECT *, max(votes) OVER (PARTITION BY read_num, orientation) AS best FROM v),
t AS (SELECT read_num, orientation, best AS votes, count(*) AS n, min_by(gene_id, reached * 10000000 + gene_id) AS f, max_by(gene_id, reached * 10000000 + gene_id) AS l FROM b WHERE votes = best GROUP BY ALL),
pick AS (SELECT *, CASE WHEN n = 1 THEN f WHEN n = 2 THEN CASE WHEN read_num % 2 = 1 THEN l ELSE f END END AS gene_id, max(votes) OVER (PARTITION BY read_num) AS top, count(*) OVER (PARTITION BY read_num, votes) AS same FROM t),
valid AS (SELECT read_num, strand AS orientation, count(DISTINCT key_idx) AS valid FROM hits GROUP BY ALL),
won AS (SELECT read_num, gene_id, votes, orientation, votes * 100 // valid AS score FROM pick JOIN valid USING (read_num, orientation) WHERE votes = top AND same = 1 AND gene_id IS NOT NULL AND votes >= 4 AND votes * 100 // valid >= 10)"""


@query("gene_vote", f"{_WON} SELECT read_num, gene_id, votes, orientation, CAST(score AS BIGINT) AS score FROM won")
def _gene_vote(spark: SparkSession, d: str) -> DataFrame:
    return _won(spark, d)


@query("gene_counts", f"{_WON} SELECT gene_id, count(*) AS reads FROM won GROUP BY gene_id")
def _gene_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.gene_counts(_won(spark, d))


_EXON_COUNTS = "ec AS (SELECT h.contig_id AS gene_id, h.cpos // 100 AS exon_id, count(DISTINCT h.read_num) AS reads FROM hits h JOIN won w ON w.read_num = h.read_num AND w.orientation = h.strand AND w.gene_id = h.contig_id GROUP BY ALL)"


@query("exon_counts", f"{_WON}, {_EXON_COUNTS} SELECT * FROM ec")
def _exon_counts(spark: SparkSession, d: str) -> DataFrame:
    return counting.exon_counts(_won(spark, d), _gene_hits(spark, d)[0])


@query("gene_tpm", f"{_WON}, g AS (SELECT contig_id AS gene_id, size AS eff_size, (SELECT count(*) FROM won WHERE won.gene_id = placed.contig_id) AS reads FROM placed WHERE size > 0) SELECT gene_id, reads, round(reads / eff_size * 1e6 / (SELECT sum(reads / eff_size) FROM g), 4) AS tpm FROM g")
def _gene_tpm(spark: SparkSession, d: str) -> DataFrame:
    sizes = contigs(spark, d).where("size > 0").select(F.col("contig_id").alias("gene_id"), F.col("size").alias("eff_size"))
    return counting.gene_tpm(counting.gene_counts(_won(spark, d)), sizes).select("gene_id", "reads", F.round("tpm", 4).alias("tpm"))


@query("exon_tpm", f"""{_WON}, {_EXON_COUNTS}, e AS (SELECT contig_id AS gene_id, i + 1 AS exon_no, least(i * 100 + 120, size) - i * 100 AS size, coalesce((SELECT reads FROM ec WHERE ec.gene_id = contig_id AND ec.exon_id = i), 0) AS reads FROM (SELECT contig_id, size, unnest(range(0, greatest(size // 100, 1))) AS i FROM placed WHERE size > 0)),
tot AS (SELECT sum(m) AS a FROM (SELECT gene_id, max(reads / size) AS m FROM e GROUP BY gene_id)) SELECT gene_id, exon_no, reads, round(reads / size * 1e6 / (SELECT a FROM tot), 4) AS tpm FROM e""")
def _exon_tpm(spark: SparkSession, d: str) -> DataFrame:
    lay = counting.layout(counting.distinct_exons(gtf(spark, d))).select("gene_id", F.col("exon_no").cast("long").alias("exon_no"), (F.col("end") - F.col("start") + 1).alias("size"), "overlaps_prev")
    n = _exon_counts(spark, d).select("gene_id", (F.col("exon_id") + 1).alias("exon_no"), "reads")
    e = lay.join(n, ["gene_id", "exon_no"], "left").withColumn("reads", F.coalesce("reads", F.lit(0)).cast("long"))
    return counting.exon_tpm(e).select("gene_id", "exon_no", "reads", F.round("tpm", 4).alias("tpm"))


@query("count_rows", f"{_WON} SELECT 'r' || read_num AS qname, CAST(66 + 16 * orientation AS INT) AS flag, gene_id AS rname, CAST(0 AS BIGINT) AS pos, CAST(score AS INT) AS mapq, len || 'M' AS cigar FROM won JOIN reads USING (read_num)")
def _count_rows(spark: SparkSession, d: str) -> DataFrame:
    return counting.count_rows(_won(spark, d), probe.prepared(reads(spark, d), K))


@query("count_table", f"{_WON}, g AS (SELECT contig_id AS gene_id, size AS eff_size, (SELECT count(*) FROM won WHERE won.gene_id = placed.contig_id) AS reads FROM placed WHERE size > 0) SELECT gene_id, eff_size, reads, round(reads / eff_size * 1e6 / (SELECT sum(reads / eff_size) FROM g), 4) AS tpm FROM g")
def _count_table(spark: SparkSession, d: str) -> DataFrame:
    """The table of counts, written with tabs and read again."""
    path = f"{shared_dir(spark)}/counts-{uuid.uuid4().hex[:12]}"
    sizes = contigs(spark, d).where("size > 0").select(F.col("contig_id").alias("gene_id"), F.col("size").alias("eff_size"))
    sinks.write_counts(counting.gene_tpm(counting.gene_counts(_won(spark, d)), sizes), path)
    return spark.read.csv(path, sep="\t", header=True, schema="gene_id long, eff_size long, reads long, tpm double").select("gene_id", "eff_size", "reads", "tpm")


@query("count_789")
def _count(spark: SparkSession, d: str) -> DataFrame:
    """The count verb from end to end: pseudo-genes, their index with exons, votes by three limits, counts of genes."""
    c = contigs(spark, d, once=True)
    placed = stored(counting.layout(counting.distinct_exons(gtf(spark, d, c))), "exons")
    genes = counting.pseudo_genes(placed, c).select(F.col("gene_id").alias("contig_id"), F.col("gene_id").cast("string").alias("name"), "seq")
    built = index.build_index(stored(genes, "genes"), K)
    exons = placed.select((F.col("gene_id") * 100000 + F.col("exon_no")).alias("exon_id"), "gene_id", "phy_start", "phy_end")
    won, by_gene, by_exon = mapper.count_reads(built, exons, reads(spark, d), params=PARAMS)
    first = won.groupBy("gene_id").agg(F.min("func").alias("func"))
    n = by_exon.groupBy("gene_id").agg(F.count(F.lit(1)).alias("exons"))
    return by_gene.join(first, "gene_id").join(n, "gene_id", "left").select("gene_id", "reads", "func", "exons")


@query("saved_index")
def _saved(spark: SparkSession, d: str) -> DataFrame:
    """An index that is built, written, read again and mapped with the limits of its own header."""
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex[:12]}"
    index.save_index(index.build_index(contigs(spark, d, once=True), K), path)
    return mapper.map_reads(index.load_index(spark, path), reads(spark, d), "x4")


FLAGSHIP = "best_location"
GUIDES = guides.GUIDES
