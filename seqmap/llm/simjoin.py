"""N-gram Jaccard join with token-combination prefixes.

A document is its set of 5-word shingles ("tokens"). Two sets of likeness 3/4 or more miss at most a quarter of
either's tokens, so among any floor(n / 4) + 1 tokens of a set at least one is shared; with both sets in one global
order, rare tokens first, it is in both prefixes.

Frequent tokens make long posting lists. So tokens are of two classes. A rare one is indexed alone. The frequent ones
are dealt by hash to groups, and pairs of a group are indexed: a group of c tokens in a prefix loses all its pairs
only if c - 1 tokens are missing. A prefix is therefore extended until the rare tokens and the sum of c - 1 over the
groups come to floor(n / 4) + 1. The number of groups must be the same for both sets, so it depends on the power of
two below the larger one's size; a set that may meet larger ones of the next power has a prefix for each. The result
is exact: there are no caps, and candidates are verified on whole sets.

A token is frequent if at least `limit` different sets have it, counted exactly over the tasks that hold it more than
once; the limit is FREQUENT, or the next power of two at which at most MOST_FREQUENT tokens are. So lists of single
tokens are short at every size of the table, whatever the sketch says: a count sketch of fixed size over all documents
only gives the order among rare tokens. An error in either changes order or class for all documents alike, so it costs
time but never a link.

Equal sets are one entity (a 64-bit digest; two different ones fall together with probability n^2 / 2^65), so copies
are never paired. Of the entities that share a signature, rounds first compare each with one pivot,
the one with the fewest tokens of its own, as the least changed of many copies is near to most of them; entities that
links already connect are not compared again, and what stands apart after the rounds is compared pair by pair, an
entity of the smaller component with those of the larger.
Single tokens of two prefixes that stand before the end of the prefix that ends first are in both if they are in both
sets, so two sets share at most what the one with fewer shared tokens in its prefix has there (`got`) and what the
other one's set has behind that end (`rest`). Sets that reach too little likeness even so are not compared, so copies
of one size that were each changed too much never pair up. A token that only a longer partner's prefix leaves out is
never taken as missing.

Null or wordless texts have the empty set, are linked with nothing and are their own component. Rows of null id are
linked as any other; a component of such rows alone has a null id. Rows of one id and different texts are documents of
their own. Repeated rows repeat their result; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqmap.llm.common import Scratch, bytes_of, digest, distinct_ids, free, mix, plain, shingle_sets, small_batches, steps, tidy
from seqmap.llm.graph import beside, components

SKETCH_BITS, DEPTH, BLOCK = 18, 2, 1 << 16
#: Sets that have a token from which on it is frequent; how many frequent tokens are sent to all tasks at most; how often
#: a task must meet a token to report it, and the tokens that it counts together.
FREQUENT, MOST_FREQUENT, REPORTED, POOL = 64, 1 << 20, 2, 1 << 21
#: Members of a component that one task meets at once.
SPLIT = 1 << 12
ROUNDS = 1
ENTITY = "doc_id long, n int, ent long, block int, counts binary"
#: The most tokens that an entity and its partner p_ may share behind the prefix that ends first; one that has all its
#: rare tokens as single ones (the whole class) does not end first.
BEHIND = "coalesce(greatest(if(n - rest <= n div 4, null, rest), if(p_n - p_rest <= p_n div 4, null, p_rest)), least(rest, p_rest))"
#: weight: the number of single tokens that the set gives, and in the low half the cost of this signature.
SIGNATURE = "sig long, ent long, n int, weight long, frequent boolean"
_BAND = mix(np.arange(64, dtype=np.uint64) + np.uint64(977))
_LOW, _HIGH = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def _places(tokens: np.ndarray) -> tuple[np.ndarray, ...]:
    mask = np.uint64((1 << SKETCH_BITS) - 1)
    return tuple(((tokens >> np.uint64(d * SKETCH_BITS)) & mask).astype(np.int64) for d in range(DEPTH))


def entities(docs: DataFrame) -> DataFrame:
    """A row for each document; each task's blocks of the sketch (block >= 0); tokens and in how many sets (block -1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sketch = np.zeros((DEPTH, 1 << SKETCH_BITS), np.uint32)
        names = [f.split()[0] for f in ENTITY.split(", ")]
        seen: set[int] = set()
        pool: list[np.ndarray] = []
        held = 0

        def reported() -> pa.RecordBatch:
            each, n = np.unique(np.concatenate(pool), return_counts=True)
            each, n = each[n >= REPORTED], n[n >= REPORTED]
            pool.clear()
            k = len(n)
            return pa.RecordBatch.from_arrays([pa.array(each.view(np.int64)), pa.array(n, pa.int32()), pa.nulls(k, pa.int64()), pa.array(np.full(k, -1, np.int32)), pa.nulls(k, pa.binary())], names=names)

        for b in batches:
            data, offsets = bytes_of(b.column(1))
            n, ent = [], []
            for i, j in steps(offsets):
                sets = shingle_sets(data, offsets[i : j + 1])
                ents = [digest(s) for s in sets]
                n += [len(s) for s in sets]
                ent += ents
                every = np.concatenate(sets)
                for d, at in enumerate(_places(every)):
                    sketch[d] += np.bincount(at, minlength=1 << SKETCH_BITS).astype(np.uint32)
                for s, e in zip(sets, ents):
                    if e not in seen:
                        seen.add(e)
                        pool.append(s)
                        held += len(s)
                if held >= POOL:
                    yield reported()
                    held = 0
            k = len(n)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int32()), pa.array(ent, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if held:
            yield reported()
        parts = sketch.reshape(-1, BLOCK)
        salt = TaskContext.get().partitionId() % 64
        k = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array([salt] * k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(range(k), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return plain(docs, "doc_id", "text").mapInArrow(tidy(run), ENTITY)


def frequent_tokens(first: DataFrame) -> np.ndarray:
    """The sorted frequent tokens, at most MOST_FREQUENT."""
    counts = first.where("block = -1").groupBy(F.col("doc_id").alias("token")).agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    power = F.floor(F.log2(F.col("n") / FREQUENT)).cast("int")
    limit, total = FREQUENT << 40, 0
    for r in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("tokens")).orderBy(F.desc("p")).collect():  # one row for each power of two
        total += r.tokens
        if total > MOST_FREQUENT:
            break
        limit = FREQUENT << r.p
    got = counts.where(F.col("n") >= limit).select("token").toArrow().column(0).combine_chunks()
    return np.sort(got.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))


def summed(blocks: DataFrame, *keys: str) -> DataFrame:
    """Adds up blocks(salt, block, counts) by the keys in a stream; a task holds one array for each key it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for salt, block, counts in zip(*(c.to_pylist() for c in b.columns)):
                key = (salt if "salt" in keys else 0, block)
                x = np.frombuffer(counts, np.uint32)
                held[key] = held[key] + x if key in held else x.copy()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["salt", "block", "counts"])

    return blocks.repartition(*keys).mapInArrow(tidy(run), "salt long, block int, counts binary")


def prefix_signatures(tokens: np.ndarray, counts: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The signatures of one set, whether each is a combination of frequent tokens (`often`), and their costs.

    A signature's cost is the number of missing tokens that a prefix which just has it rules out, and one.
    """
    n = len(tokens)
    need = n // 4 + 1
    order = np.lexsort((tokens, counts, often))
    t, rare = tokens[order], n - int(np.count_nonzero(often))
    if rare >= need:
        return t[:need], np.zeros(need, bool), np.arange(1, need + 1)
    single, combined, costs = [t[:rare]], [], [np.arange(1, rare + 1)]
    for band in sorted({n.bit_length() - 1, (4 * n // 3).bit_length() - 1}):
        groups = (1 << band) // 4
        if not groups:
            combined.append(t[rare:need])
            costs.append(np.arange(rare + 1, need + 1))
            continue
        f = t[rare:]
        g = (mix(f + _BAND[band]) % np.uint64(groups)).astype(np.int64)
        gain = np.ones(len(f), np.int64)
        gain[np.unique(g, return_index=True)[1]] = 0
        total = np.cumsum(gain)
        m = int(np.searchsorted(total, need - rare)) + 1
        by = np.argsort(g[:m], kind="stable")
        f, g, total = f[by], g[by], total[by]
        for d in range(1, int(np.bincount(g).max())):
            same = np.flatnonzero(g[d:] == g[:-d])
            if not len(same):
                break
            a, b = f[same], f[same + d]
            combined.append(mix(np.minimum(a, b) * _LOW + np.maximum(a, b) * _HIGH + _BAND[band]))
            costs.append(rare + total[same + d])
    pairs = np.concatenate(combined)
    return np.concatenate([*single, pairs]), np.append(np.zeros(rare, bool), np.ones(len(pairs), bool)), np.concatenate(costs)


def member_of(tokens: np.ndarray, some: np.ndarray) -> np.ndarray:
    if not len(some):
        return np.zeros(len(tokens), bool)
    return some[np.minimum(np.searchsorted(some, tokens), len(some) - 1)] == tokens


def signatures(docs: DataFrame, sketch: np.ndarray, frequent: np.ndarray) -> DataFrame:
    """(sig, ent, n, frequent) of each distinct set of a task."""
    sent = docs.sparkSession.sparkContext.broadcast((sketch, frequent))  # DEPTH << SKETCH_BITS counters, MOST_FREQUENT tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (counters, heavy), seen = sent.value, set()
        for b in batches:
            data, offsets = bytes_of(b.column(0))
            for i, j in steps(offsets):
                sigs, freq, ents, sizes, lens, weights = [], [], [], [], [], []
                for s in shingle_sets(data, offsets[i : j + 1]):
                    ent = digest(s)
                    if not len(s) or ent in seen:
                        continue
                    seen.add(ent)
                    counts = np.minimum.reduce([counters[d][at] for d, at in enumerate(_places(s))])
                    x, y, cost = prefix_signatures(s, counts, member_of(s, heavy))
                    sigs.append(x)
                    freq.append(y)
                    ents.append(ent)
                    sizes.append(len(s))
                    lens.append(len(x))
                    weights.append((len(y) - int(np.count_nonzero(y)) << 32) + cost.astype(np.int64))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.repeat(np.array(ents, np.int64), lens)), pa.array(np.repeat(np.array(sizes, np.int32), lens)), pa.array(np.concatenate(weights)), pa.array(np.concatenate(freq))], names=["sig", "ent", "n", "weight", "frequent"])

    return plain(docs, "text").mapInArrow(tidy(run), SIGNATURE)


def shared_rare(sigs: DataFrame) -> DataFrame:
    """The rows of rare signatures that two entities or more have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)]
        for b in batches:
            cols = [np.concatenate([h, c.to_numpy(zero_copy_only=False)]) for h, c in zip(held, b.columns)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            held = [c[last:] for c in cols]
            yield from runs([c[:last] for c in cols])
        yield from runs(held)

    def runs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        sig, ent = cols[:2]
        if len(sig) < 2:
            return
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        ends = np.append(starts[1:], len(sig)) - 1
        keep = np.repeat(ent[starts] != ent[ends], ends - starts + 1)
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names=["sig", "ent", "n", "weight"])

    dealt = sigs.where("not frequent").select("sig", "ent", "n", "weight").repartition(F.col("sig")).sortWithinPartitions("sig", "ent")
    return dealt.mapInArrow(tidy(run), "sig long, ent long, n int, weight long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, z): compressed texts, to make what is shuffled small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([pack(x or b"") for x in b.column(1).cast(pa.binary()).to_pylist()], pa.binary())], names=["doc_id", "z"])

    return plain(docs, "doc_id", "text").mapInArrow(tidy(run), "doc_id long, z binary")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs(a, b) with texts(ent, z) -> (a, b, linked) by the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            a_ids, b_ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i in range(0, len(a_ids), 256):
                need: dict[int, bytes] = {}
                for ids, col in ((a_ids, b.column(2)), (b_ids, b.column(3))):
                    for k in range(i, min(i + 256, len(ids))):
                        if ids[k] not in need:
                            need[ids[k]] = unpack(col[k].as_py())
                sets: dict[int, np.ndarray] = {}
                todo = list(need.items())
                offsets = np.append(0, np.cumsum([len(t) for _, t in todo]))
                data = np.frombuffer(b"".join(t for _, t in todo), np.uint8)
                for x, y in steps(offsets):
                    for (e, _), s in zip(todo[x:y], shingle_sets(data, offsets[x : y + 1])):
                        sets[e] = s
                out: tuple[list, list, list] = ([], [], [])
                for k in range(i, min(i + 256, len(a_ids))):
                    p, q = sets[a_ids[k]], sets[b_ids[k]]
                    if digest(p) != a_ids[k] or digest(q) != b_ids[k]:
                        continue  # another text of a repeated id
                    p, q = (p, q) if len(p) <= len(q) else (q, p)
                    at = np.searchsorted(q, p)
                    both = int(np.count_nonzero(q[np.minimum(at, len(q) - 1)] == p))
                    for c, v in zip(out, (a_ids[k], b_ids[k], 100 * both >= 75 * (len(p) + len(q) - both))):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_())], names=["a", "b", "linked"])

    one = texts.select(F.col("ent").alias("a"), F.col("z").alias("za"))
    two = texts.select(F.col("ent").alias("b"), F.col("z").alias("zb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "za", "zb").mapInArrow(tidy(run), "a long, b long, linked boolean")


def apart(live: DataFrame, shared: DataFrame, comp: DataFrame, scratch: Scratch, near: Column, early: Column) -> DataFrame:
    """All pairs of entities of different components that share a signature, each from the smaller component's side.

    A component that its neighbours meet in more rows of shared signatures than it has members for them is met as a
    whole: members that share none are compared too, which changes nothing. The others are met in the signatures.
    Bounds of the members' sizes keep out whom no member can be near to.
    """
    own = shared.select("ent", "n", "got", "rest").distinct().join(comp.select(F.col("node").alias("ent"), "root", "size"), "ent", "left")
    own = own.select("ent", "n", "got", "rest", F.coalesce("root", "ent").alias("c"), F.coalesce("size", F.lit(1)).alias("size"))
    left = scratch.keep(live, "left")
    most = lambda x: F.max(F.expr(f"7 * ({x}) - 3 * n"))
    bounds = (F.min("n").alias("lo_n"), F.max("n").alias("hi_n"), most("got").alias("hi_got"), most("rest").alias("hi_rest"), most("got + rest").alias("hi_both"), F.min("cost").alias("lo_cost"))
    there = left.groupBy("sig", F.col("c").alias("p_c"), F.col("size").alias("p_size")).agg(F.count(F.lit(1)).alias("rows"), *bounds)
    smaller = F.expr("size < p_size or (size = p_size and c < p_c)")
    possible = F.expr("4 * hi_n >= 3 * n and 4 * n >= 3 * lo_n and (7 * (got + rest) >= 3 * (n + lo_n) or 7 * got + hi_rest >= 3 * n) and (hi_both >= 3 * n or hi_got + 7 * rest >= 3 * n) and cost <= n - (3 * (n + lo_n) + 6) div 7 + 1 and lo_cost <= hi_n - (3 * (n + hi_n) + 6) div 7 + 1")
    towards = left.join(there, "sig").where(smaller & possible).groupBy("ent", "n", "got", "rest", "p_c", "p_size").agg(F.sum("rows").alias("rows"))
    towards = scratch.keep(towards, "towards")
    free(live.sparkSession)
    big = towards.groupBy("p_c", "p_size").agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("met")).where("rows > met * p_size").select("p_c")
    other = lambda df, *cols: df.select(*cols, *[F.col(x).alias(f"p_{x}") for x in ("ent", "n", "got", "rest", "c")])
    # members of a large component are dealt to parts, and each entity that meets it goes to all of them
    parts = lambda size: F.floor((size - 1) / SPLIT) + 1
    meeting = towards.join(big, "p_c", "left_semi").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts(F.col("p_size")) - 1)))
    members = other(own, F.pmod(F.xxhash64("ent"), parts(F.col("size"))).alias("part"))
    whole = meeting.join(members, ["p_c", "part"]).where(near)
    rest = other(left, "sig", F.col("size").alias("p_size"), F.col("cost").alias("p_cost")).join(big, "p_c", "left_anti")
    single = left.join(rest, "sig").where(smaller & near & early)
    cols = ("ent", "n", "got", "rest", "p_ent", "p_n", "p_got", "p_rest")
    return whole.select(*cols).union(single.select(*cols))


def near_components(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_shingles, component_id, ent (equal for equal sets)."""
    with small_batches(docs.sparkSession):
        return _near_components(docs, scratch or Scratch(docs.sparkSession, "simjoin"))


def _near_components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    spark = docs.sparkSession
    docs, back = distinct_ids(plain(docs, "doc_id", "text"), scratch)
    free(spark)  # also what came before: a driver's memory is highest in here
    first = scratch.save(entities(docs), "entities")
    blocks = first.where("block >= 0").select(F.col("doc_id").alias("salt"), "block", "counts")
    got = summed(summed(blocks, "block", "salt"), "block").select("block", "counts").collect()  # the sketch: fixed size
    sketch = np.zeros((DEPTH << SKETCH_BITS) // BLOCK * BLOCK, np.uint32).reshape(-1, BLOCK)
    for r in got:
        sketch[r.block] = np.frombuffer(r.counts, np.uint32)
    sketch = sketch.reshape(DEPTH, -1)

    rows = first.where("block is null").select("doc_id", "n", "ent")
    ents = scratch.keep(rows.where("n > 0").groupBy("ent").agg(F.min("doc_id").alias("doc_id")), "ents")
    sigs = scratch.keep(signatures(docs, sketch, frequent_tokens(first)), "signatures")
    free(spark)
    frequent = sigs.where("frequent").select("sig", "ent", "n", "weight")
    often = scratch.keep(frequent.groupBy("sig").agg(F.min("ent").alias("lo"), F.max("ent").alias("hi")).where("lo <> hi").select("sig"), "often")
    rare = shared_rare(sigs)
    both = rare.withColumn("one", F.lit(1)).unionByName(frequent.join(often, "sig").select("sig", "ent", "n", "weight", F.lit(0).alias("one")))
    both = scratch.keep(both, "both")
    ahead = both.groupBy("ent").agg(F.sum("one").cast("int").alias("got"), (F.first("n") - F.shiftright(F.first("weight"), 32)).cast("int").alias("rest"))
    shared = scratch.save(both.select("sig", "ent", "n", F.expr("cast(weight & 4294967295 as int)").alias("cost")).join(ahead, "ent").select("sig", "ent", "n", "got", "rest", "cost"), "shared")
    scratch.drop("signatures", "often", "both")
    del sigs, frequent, often, rare, both, ahead
    free(spark)
    need = ents.join(shared.select("ent").distinct(), "ent", "left_semi")
    texts = scratch.save(packed_texts(docs).join(need, "doc_id").select("ent", "z"), "texts")
    free(spark)

    comp = None
    known = 0
    near = F.expr("4 * least(n, p_n) >= 3 * greatest(n, p_n) and 7 * (least(got, p_got) + " + BEHIND + ") >= 3 * (n + p_n)")
    # a pair of like sizes shares a signature in prefixes that are shorter than those for the least partner
    early = F.expr("cost <= n - (3 * (n + p_n) + 6) div 7 + 1 and p_cost <= p_n - (3 * (n + p_n) + 6) div 7 + 1")
    for k in range(ROUNDS + 1):
        live = shared.withColumns({"c": F.col("ent"), "size": F.lit(1).cast("long")})
        if comp is not None:
            live = shared.join(comp.select(F.col("node").alias("ent"), "root", "size"), "ent", "left").select(*shared.columns, F.coalesce("root", "ent").alias("c"), F.coalesce("size", F.lit(1)).alias("size"))
        pick = F.min(F.struct(F.expr("n - rest - got").alias("alone"), F.xxhash64("ent", F.lit(k)).alias("h"), "ent", "n", "got", "rest", "cost", "c")).alias("p")
        pivots = live.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), pick).where("lo <> hi")
        pivots = scratch.keep(pivots.select("sig", F.col("p.ent").alias("p_ent"), F.col("p.n").alias("p_n"), F.col("p.got").alias("p_got"), F.col("p.rest").alias("p_rest"), F.col("p.cost").alias("p_cost"), F.col("p.c").alias("p_c")), f"pivots_{k}")
        free(spark)
        if k < ROUNDS:
            pairs = live.join(pivots, "sig").where("c <> p_c")
        else:
            pairs = apart(live.join(pivots.select("sig"), "sig", "left_semi"), shared, comp, scratch, near, early)
        pairs = pairs.where(near).select(F.least("ent", "p_ent").alias("a"), F.greatest("ent", "p_ent").alias("b")).distinct()
        judged = scratch.save(verify(pairs, texts), f"judged_{k}")
        free(spark)
        new = judged.where("linked").select("a", "b")
        known += new.count()
        links = new if comp is None else comp.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new)
        comp = beside(components(links, scratch, f"comp_{k}", known), "root", F.count(F.lit(1)), "size")
        # the components are written, so what they came from may go
        scratch.drop(f"pivots_{k}", f"judged_{k}", "left", "towards")
        live = pivots = pairs = judged = new = links = None
        free(spark)

    if back is not None:
        rows = rows.join(back, "doc_id").select(F.col("own_id").alias("doc_id"), "n", "ent")
        ents = rows.where("n > 0").groupBy("ent").agg(F.min("doc_id").alias("doc_id"))
    member = ents.join(comp.select(F.col("node").alias("ent"), "root"), "ent", "left").select("ent", "doc_id", F.coalesce("root", "ent").alias("root"))
    ends = scratch.save(beside(scratch.save(member, "member"), "root", F.min("doc_id"), "top").select("ent", "top"), "ends")
    scratch.drop("ents", "texts", "shared")
    return rows.join(ends, "ent", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("top", "doc_id").alias("component_id"), "ent")
