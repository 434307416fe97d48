"""Quality scores from histogram gradient-boosted trees over document statistics.

Statistics come from the text alone.  Labelled documents are a bounded sample
(``sample`` rows at most, spread by a hash of doc_id) from outside the held-out
fold; trees are grown on the driver from quantile bins of that sample, then
flattened into arrays that every task traverses for a whole batch at once.

Null and empty texts have all-zero statistics and get a score like others.
Labels that are null are left out of training; without labels of both kinds
every document scores the share of good labels (0.5 if there is none).
Repeated rows score alike.  An id that is labelled both ways counts as
unlabelled; of several texts under one labelled id the one of least hash is
learnt from.  Other columns (lang, source, doc_id) never enter a
score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, texts


@dataclass(frozen=True)
class QualityParams:
    #: Most labelled rows that are brought to the driver.
    sample: int = 20_000
    trees: int = 120
    depth: int = 4
    bins: int = 64
    rate: float = 0.1
    least_leaf: int = 8
    ridge: float = 1.0
    threshold: float = 0.7
    folds: int = 4
    held_out: int = 2


FEATURES = (
    "log_chars", "log_words", "mean_word", "long_words", "lower", "upper", "digit", "space", "newline", "sentence", "symbol", "other",
    "upper_words", "symbol_words", "capital_words", "single_words", "distinct_words", "top_word", "repeated_next", "distinct_pairs",
    "log_lines", "mean_line", "distinct_lines", "short_lines", "words_per_stop", "word_entropy",
)

_CLASS = np.full(256, 7, np.uint8)  # other
_CLASS[128:] = 0  # bytes of letters beyond ASCII count as lower case
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:!?", "#$%&*|<>{}[]\\^~_=+@/`")):
    _CLASS[[ord(c) for c in _chars]] = _k
_ODD = re.compile(rb"[#$%&*|<>{}\[\]\\^~_=+@]|!!")


def statistics(text: str | None) -> list[float]:
    """The features of one text."""
    if not text:
        return [0.0] * len(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    shares = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8) / len(data)
    words = data.split()
    n = len(words)
    if not n:
        return [np.log1p(len(text)), *[0.0] * 3, *shares.tolist(), *[0.0] * (len(FEATURES) - 12)]
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    tally = np.fromiter(counts.values(), np.float64, len(counts)) / n
    lines = [x for x in data.split(b"\n") if x]
    return [
        np.log1p(len(text)),
        np.log1p(n),
        float(sizes.mean()),
        float((sizes > 12).mean()),
        *shares.tolist(),
        sum(map(bytes.isupper, words)) / n,
        sum(c for w, c in counts.items() if _ODD.search(w)) / n,
        sum(map(bytes.istitle, words)) / n,
        float((sizes == 1).mean()),
        len(counts) / n,
        float(tally.max()),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        len(set(zip(words, words[1:]))) / max(n - 1, 1),
        np.log1p(len(lines)),
        float(np.log1p(n / max(len(lines), 1))),
        len(set(lines)) / max(len(lines), 1),
        sum(len(x) < 30 for x in lines) / max(len(lines), 1),
        float(np.log1p(n / (1 + data.count(b".")))),
        float(-(tally * np.log(tally)).sum() / np.log(n + 1)),
    ]


def matrix(given: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in given], np.float64).reshape(len(given), len(FEATURES))


@dataclass
class Trees:
    """A forest as arrays: node i of tree t tests ``feature`` against ``cut`` and goes to ``left`` or ``left + 1``."""

    prior: float
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row, all rows and trees in step."""
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, left, value in zip(self.feature, self.cut, self.left, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = left[at] > 0
                at = np.where(inner, left[at] + (x[rows, feature[at]] > cut[at]), at)
            total += value[at]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, params: QualityParams = QualityParams()) -> Trees:
    """Boost trees on the logistic loss; splits are sought in histograms of quantile bins."""
    nodes = 2 ** (params.depth + 1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    none = np.zeros((0, nodes))
    if len(set(y.tolist())) < 2:
        return Trees(prior, none.astype(np.int64), none, none.astype(np.int64), none, params.depth)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, params.bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    offsets = np.arange(x.shape[1]) * params.bins
    total, grown = np.full(len(y), prior), []
    for _ in range(params.trees):
        p = 1 / (1 + np.exp(-total))
        gradient, hessian = y - p, p * (1 - p)
        feature, cut = np.zeros(nodes, np.int64), np.zeros(nodes)
        left, value = np.zeros(nodes, np.int64), np.zeros(nodes)
        used, open_nodes = 1, [(0, np.arange(len(y)), 0)]
        while open_nodes:
            node, rows, level = open_nodes.pop()
            g, h = gradient[rows].sum(), hessian[rows].sum()
            value[node] = params.rate * g / (h + params.ridge)
            if level == params.depth or len(rows) < 2 * params.least_leaf:
                continue
            at = (binned[rows] + offsets).ravel()
            width, shape = x.shape[1], (x.shape[1], params.bins)
            sums = [np.bincount(at, np.repeat(w, width), minlength=width * params.bins).reshape(shape).cumsum(axis=1) for w in (gradient[rows], hessian[rows], np.ones(len(rows)))]
            gl, hl, nl = sums
            gain = gl**2 / (hl + params.ridge) + (g - gl) ** 2 / (h - hl + params.ridge) - g**2 / (h + params.ridge)
            gain[(nl < params.least_leaf) | (len(rows) - nl < params.least_leaf)] = -np.inf
            j, b = np.unravel_index(int(gain.argmax()), shape)
            if not gain[j, b] > 1e-9 or b >= len(edges[j]):
                continue
            feature[node], cut[node], left[node] = j, edges[j][b], used
            goes = binned[rows, j] > b
            open_nodes += [(used, rows[~goes], level + 1), (used + 1, rows[goes], level + 1)]
            used += 2
        tree = Trees(0.0, feature[None], cut[None], left[None], value[None], params.depth)
        at = np.zeros(len(y), np.int64)
        for _ in range(params.depth):
            at = np.where(left[at] > 0, left[at] + (x[np.arange(len(y)), feature[at]] > cut[at]), at)
        total = total + value[at]
        grown.append(tree)
    return Trees(prior, *(np.concatenate([getattr(t, name) for t in grown]) for name in ("feature", "cut", "left", "value")), params.depth)


def fold(doc_id: Column, params: QualityParams) -> Column:
    """Fold of a document: crc32 of its id as text, modulo the number of folds."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(params.folds))


SAMPLE = "doc_id bigint, quality int, th bigint, features binary"


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> Trees:
    """Fit on a bounded sample of the labelled documents outside the held-out fold.

    The sampled ids (bounded too) are broadcast to the documents, so no text is shuffled.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(fold(F.col("doc_id"), params) != params.held_out)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = matrix(b.column("text").to_pylist())
            yield batch(SAMPLE, b.column("doc_id"), b.column("quality"), b.column("th"), [r.tobytes() for r in rows])

    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id bigint, quality int")
    seen = texts(docs).join(F.broadcast(ids), "doc_id").select("doc_id", "quality", F.xxhash64("text").alias("th"), "text").mapInArrow(run, SAMPLE)
    # One row for each sampled id, so as bounded as the sample.
    rows = seen.groupBy("doc_id").agg(F.min(F.struct("th", "features", "quality")).alias("x")).select("x.features", "x.quality").collect()
    rows = sorted((bytes(r["features"]), r["quality"]) for r in rows)
    x = np.frombuffer(b"".join(f for f, _ in rows), np.float64).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([q for _, q in rows], float), params)


SCORED = "doc_id bigint, score double"


def score_documents(docs: DataFrame, trees: Trees) -> DataFrame:
    """doc_id and score of every document: one narrow pass."""
    shipped = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield batch(SCORED, b.column("doc_id"), shipped.value.score(matrix(b.column("text").to_pylist())))

    return texts(docs).mapInArrow(run, SCORED)


def classify(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    return score_documents(docs, train(docs, labels, params)).select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), params) == params.held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= params.threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """The documents that the classifier accepts, unchanged."""
    shipped = docs.sparkSession.sparkContext.broadcast(train(docs, labels, params))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = shipped.value.score(matrix(b.column("text").to_pylist())) >= params.threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, schema)
