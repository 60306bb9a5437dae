"""Quality and toxicity of documents by co-training of two views.

One classifier sees a document's words and character statistics, the other its metadata (language, source, length).
Each is fitted on labelled rows; over some rounds each labels the unlabelled rows it is surest of for the other. On
held-out labelled rows the two views are then calibrated into one probability, with a threshold that keeps the
stated share of clean documents. This is done once for quality and once for toxicity; a document stays if it is good
and not toxic.

Fitting uses a bounded sample (LABELLED and UNLABELLED rows, those of least hash of their id, so the same rows at any
partitioning) in one task; every document is scored over its whole text. Features are hashed, and the model that travels to the
executors is two tables of fixed size.

Null texts are empty, null languages and sources are values of their own, null lengths are 0. Repeated rows are scored
each. Rows of `labels` with nulls or unknown documents are not used; without any usable label all documents stay at
probability 0.5. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmap.llm.common import bytes_of, mix, parts, plain, small_batches, steps, tidy, word_hashes

LABELLED, UNLABELLED = 8000, 4000
WIDTH = 1 << 18
LEAST_DF = 4
#: Bytes of a word's stem; standard deviations from independence of a feature that is used.
STEM, LEAST_Z = 6, 3.0
ROUNDS = 3
SURE = 0.97
PER_ROUND = 400
KEEP_CLEAN = 0.995
SCHEMA = "doc_id long, p_quality double, p_toxic double, keep boolean"
FEATURES = "doc_id long, words array<int>, stats array<double>, meta array<int>"
SAMPLE = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int32())), ("stats", pa.list_(pa.float64())), ("meta", pa.list_(pa.int32())), ("quality", pa.int32()), ("toxic", pa.int32())])

_BETWEEN = np.zeros(256, bool)
_BETWEEN[:128] = True
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_KIND = np.zeros(256, np.int64)
_KIND[48:58] = 1
_KIND[65:91] = 2
_KIND[97:123] = 3
_KIND[128:] = 3
_KIND[[32, 9, 11, 12, 13]] = 4
_KIND[10] = 5
_KIND[[44, 46, 39, 59, 58, 45]] = 6
N_STATS = 10


def _hash(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


def meta_of(lang: str | None, source: str | None, n_chars: int | None) -> list[int]:
    size = int(np.log2((n_chars or 0) + 1) * 2)
    return sorted({_hash(x) % WIDTH for x in (f"l:{lang}", f"s:{source}", f"n:{size}", f"l:{lang}/n:{size // 2}")})


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a step of rows: (row, bucket) of distinct words and stems, and the statistics of each row."""
    hashes, rows = word_hashes(data, offsets, _BETWEEN)
    n = len(offsets) - 1
    of = np.repeat(np.arange(n), np.diff(rows))
    stems = mix(word_hashes(data, offsets, _BETWEEN, STEM)[0])
    bucket = lambda h: of * WIDTH + (h & np.uint64(WIDTH - 1)).astype(np.int64)
    whole = np.unique(bucket(hashes))
    distinct = np.bincount(whole // WIDTH, minlength=n)
    key = np.union1d(whole, bucket(stems))
    doc, word = key // WIDTH, key % WIDTH
    raw = data[offsets[0] : offsets[-1]]
    kinds = np.stack([np.add.reduceat(np.append(_KIND[raw] == k, False), np.minimum(offsets[:-1] - offsets[0], len(raw))) for k in range(7)], 1).astype(float) if len(raw) else np.zeros((n, 7))
    size = np.diff(offsets).astype(float)
    kinds[size == 0] = 0
    words = np.diff(rows).astype(float)
    stats = np.column_stack([kinds[:, [0, 1, 2, 3, 4, 5, 6]] / np.maximum(size, 1)[:, None], np.log1p(size), distinct / np.maximum(words, 1), np.minimum(words / np.maximum(size, 1), 1)])
    return doc, word, stats


def featurise(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = bytes_of(b.column(1))
            words, stats = [], []
            for i, j in steps(offsets):
                doc, word, s = features(data, offsets[i : j + 1])
                cuts = np.searchsorted(doc, np.arange(j - i + 1))
                words += [word[x:y].astype(np.int32) for x, y in zip(cuts[:-1], cuts[1:])]
                stats += list(s)
            meta = [meta_of(*x) for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(words, pa.list_(pa.int32())), pa.array(stats, pa.list_(pa.float64())), pa.array(meta, pa.list_(pa.int32()))], names=["doc_id", "words", "stats", "meta"])

    return docs.mapInArrow(tidy(run), FEATURES)


@dataclass
class View:
    """A logistic model over hashed presence features, and over statistics scaled by their own spread."""

    weights: np.ndarray
    bias: float
    dense: np.ndarray
    centre: np.ndarray
    spread: np.ndarray

    def logits(self, row: np.ndarray, col: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = len(stats)
        return self.bias + np.bincount(row, self.weights[col], n) + np.clip((stats - self.centre) / self.spread, -8, 8) @ self.dense


def _parts(rows: list[np.ndarray], size: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, feature) of some rows at a time, so that all are never held in wide numbers."""
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield np.repeat(np.arange(i, i + len(part)), [len(r) for r in part]), np.concatenate(part).astype(np.int64)


def fit(rows: list[np.ndarray], stats: np.ndarray, y: np.ndarray, epochs: int = 150, rate: float = 0.05, l2: float = 1e-4) -> View:
    """Logistic regression by Adam over all rows.

    A feature stands with its naive-Bayes log ratio; those of too few rows, or too near to independence, are left out.
    """
    n = len(y)
    share = np.clip(y.mean(), 0.01, 0.99) if n else 0.5
    df, hits = np.zeros(WIDTH, np.int64), np.zeros(WIDTH)
    for row, col in _parts(rows):
        df += np.bincount(col, minlength=WIDTH)
        hits += np.bincount(col, y[row], WIDTH)
    z = (hits - share * df) / np.sqrt(df * share * (1 - share) + 1e-9)
    used = np.flatnonzero((df >= LEAST_DF) & (np.abs(z) >= LEAST_Z))
    ratio = np.log((hits[used] + 0.5) / (share * n + 1)) - np.log((df[used] - hits[used] + 0.5) / ((1 - share) * n + 1))
    place = np.full(WIDTH, -1)
    place[used] = np.arange(len(used))
    kept = [(row[place[col] >= 0], place[col][place[col] >= 0]) for row, col in _parts(rows)]
    row, col = (np.concatenate(x) if kept else np.zeros(0, np.int64) for x in (zip(*kept) if kept else ((), ())))
    value = ratio[col]
    centre, spread = (stats.mean(0), stats.std(0) + 1e-6) if n else (np.zeros(stats.shape[1]), np.ones(stats.shape[1]))
    z = np.clip((stats - centre) / spread, -8, 8)
    theta = np.concatenate([np.zeros(len(used) + z.shape[1]), [0.0]])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    each = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share)) if n else y
    for t in range(1, epochs + 1):
        w, d, c = theta[: len(used)], theta[len(used) : -1], theta[-1]
        p = 1 / (1 + np.exp(-np.clip(c + np.bincount(row, w[col] * value, n) + z @ d, -30, 30)))
        e = (p - y) * each / max(n, 1)
        g = np.concatenate([np.bincount(col, e[row] * value, len(used)) + l2 * w, z.T @ e + l2 * d, [e.sum()]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(WIDTH, np.float32)
    weights[used] = theta[: len(used)] * ratio
    return View(weights, float(theta[-1]), theta[len(used) : -1], centre, spread)


@dataclass
class Model:
    text: View
    meta: View
    mixing: np.ndarray  # of the text's logit, the metadata's logit, and a constant
    threshold: float


def _logits(view: View, rows: list[np.ndarray], stats: np.ndarray) -> np.ndarray:
    out = [view.logits(row - row0, col, stats[row0 : row0 + 512]) for row0, (row, col) in zip(range(0, len(rows), 512), _parts(rows))]
    return np.concatenate(out) if out else np.zeros(0)


def _calibrate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of few columns by Newton steps; a weight below 0 would turn a view round, so it is 0."""
    use = np.ones(x.shape[1], bool)
    while True:
        a = x[:, use]
        w = np.zeros(a.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(a.shape[1])
            w = w - np.linalg.solve(h, a.T @ (p - y) + 1e-2 * w)
        out = np.zeros(x.shape[1])
        out[use] = w
        bad = (out < 0) & np.append(np.ones(x.shape[1] - 1, bool), False)
        if not bad.any():
            return out
        use &= ~bad


def co_train(words: list, stats: np.ndarray, meta: list, y: np.ndarray, held: np.ndarray, clean: float) -> Model:
    """y: 1, 0 or nan (unlabelled). Rows in `held` are for calibration. clean: the label of documents to keep."""
    none = np.zeros((len(y), 0))
    known = ~np.isnan(y)
    pool = np.flatnonzero(~known)
    labels = {"text": np.where(known & ~held, y, np.nan), "meta": np.where(known & ~held, y, np.nan)}
    views: dict[str, View] = {}
    for r in range(ROUNDS):
        for name, feats, dense in (("text", words, stats), ("meta", meta, none)):
            k = np.flatnonzero(~np.isnan(labels[name]))
            views[name] = fit([feats[i] for i in k], dense[k], labels[name][k])
        if r == ROUNDS - 1 or not len(pool):
            break
        for name, other, feats, dense in (("text", "meta", words, stats), ("meta", "text", meta, none)):
            p = 1 / (1 + np.exp(-_logits(views[name], [feats[i] for i in pool], dense[pool])))
            for value, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.argsort(-sure, kind="stable")[:PER_ROUND]
                best = pool[best[sure[best] >= SURE]]
                labels[other][best[np.isnan(labels[other][best])]] = value
    k = np.flatnonzero(held & known)
    x = np.column_stack([_logits(views["text"], [words[i] for i in k], stats[k]), _logits(views["meta"], [meta[i] for i in k], none[k]), np.ones(len(k))])
    mixing = _calibrate(x, y[k])
    p = 1 / (1 + np.exp(-np.clip(x @ mixing, -30, 30)))
    good = np.sort(p[y[k] == clean])
    # the middle, or where that would lose more clean documents than stated, as far as needed
    cut = 0.5
    if len(good):
        cut = min(cut, float(np.quantile(good, 1 - KEEP_CLEAN))) if clean == 1 else max(cut, float(np.quantile(good, KEEP_CLEAN)))
    return Model(views["text"], views["meta"], mixing, cut)


def _lists(col: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column, as views of its values."""
    a = col.combine_chunks()
    return np.split(a.flatten().to_numpy(), np.cumsum(a.value_lengths().to_numpy())[:-1])


def _fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The models for quality and toxicity from all rows of the sample; nothing without usable labels."""
    got = pa.Table.from_batches(batches, SAMPLE)
    if not len(got):
        return
    got = got.sort_by("doc_id")
    y = {k: got.column(k).cast(pa.float64()).fill_null(float("nan")).to_numpy() for k in ("quality", "toxic")}
    if np.isnan(y["quality"]).all():
        return
    words, meta = (_lists(got.column(k)) for k in ("words", "meta"))
    stats = got.column("stats").combine_chunks().flatten().to_numpy().reshape(len(got), N_STATS)
    held = np.array([_hash(f"held {d}") % 4 == 0 for d in got.column("doc_id").to_pylist()])
    both = co_train(words, stats, meta, y["quality"], held, 1), co_train(words, stats, meta, y["toxic"], held, 0)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(both)], pa.binary())], names=["models"])


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> tuple[Model, Model] | None:
    """(quality, toxicity) from a bounded sample; None without usable labels.

    One task fits them, as the sample is bounded; the driver only gets the tables of the models.
    """
    own = plain(docs, "doc_id", "text", "lang", "source", "n_chars")
    marks = plain(labels, "doc_id", "quality", "toxic").where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    ids = own.select("doc_id").where("doc_id is not null").distinct()
    some = marks.join(ids, "doc_id", "left_semi").orderBy(order, "doc_id").limit(labelled)
    rest = ids.join(marks, "doc_id", "left_anti").orderBy(order, "doc_id").limit(unlabelled).selectExpr("doc_id", "cast(null as int) quality", "cast(null as int) toxic")
    sample = some.select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")).unionByName(rest)
    # at most labelled + unlabelled rows of three numbers
    rows = featurise(own.join(F.broadcast(sample.select("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"])).join(F.broadcast(sample), "doc_id")
    with small_batches(docs.sparkSession):
        got = rows.select(*SAMPLE.names).repartition(1).mapInArrow(tidy(_fitted), "models binary").first()
    return pickle.loads(got.models) if got else None


def probabilities(b: pa.RecordBatch, both: tuple[Model, Model]) -> tuple[np.ndarray, np.ndarray]:
    """Of a batch (doc_id, text, lang, source, n_chars): the probabilities of quality and toxicity, and who stays."""
    data, offsets = bytes_of(b.column(1))
    meta = [np.array(meta_of(*x), np.int64) for x in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist())]
    p = np.zeros((2, b.num_rows))
    for i, j in steps(offsets):
        doc, word, stats = features(data, offsets[i : j + 1])
        for k, m in enumerate(both):
            x = np.column_stack([m.text.logits(doc, word, stats), _logits(m.meta, meta[i:j], np.zeros((j - i, 0))), np.ones(j - i)])
            p[k, i:j] = 1 / (1 + np.exp(-np.clip(x @ m.mixing, -30, 30)))
    return p, (p[0] >= both[0].threshold) & (p[1] <= both[1].threshold)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, both probabilities and `keep` of every document."""
    models = train(docs, labels)
    own = plain(docs, "doc_id", "text", "lang", "source", "n_chars")
    if models is None:
        return own.selectExpr("doc_id", "cast(0.5 as double) p_quality", "cast(0.5 as double) p_toxic", "true keep")
    sent = docs.sparkSession.sparkContext.broadcast(models)  # tables of WIDTH floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, keep = probabilities(b, sent.value)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(p[0]), pa.array(p[1]), pa.array(keep)], names=["doc_id", "p_quality", "p_toxic", "keep"])

    return own.mapInArrow(tidy(run), SCHEMA)


def filter_docs(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that stay, with the columns of documents; each row is decided by itself, so nothing is joined."""
    models = train(docs, labels)
    own = plain(docs, "doc_id", "text", "lang", "source", "n_chars")
    if models is None:
        return own
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in parts(batch):
                yield b.filter(pa.array(probabilities(b, sent.value)[1]))

    return own.mapInArrow(tidy(run), own.schema)
