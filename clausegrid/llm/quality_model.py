"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Every word has a fixed sparse random index vector. A word's vector is the sum of the index
vectors of its neighbours over the whole corpus, so words used alike come close; words share
``BUCKETS`` hashed rows, which bounds the table whatever the vocabulary. A document is the
mean of its words' vectors. A two-layer network, fitted on a bounded sample of labelled
documents, turns it into a probability, and a temperature found on held-back labelled
documents calibrates it.

Null and empty text score the share of good documents among the labels. Repeated rows give
repeated rows; null ids are kept. Without labels of both kinds every score is that share, or
0.5 without any label.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.sampling import label_weights, sample_by_label
from clausegrid.llm.tokens import byte_runs

BUCKETS = 1 << 13
WIDTH = 32
NONZERO = 4
REACH = 2  # neighbours on each side
HIDDEN = 24
#: The network is fitted on at most this many labelled documents, chosen by a hash of the id.
FIT_DOCUMENTS = 10_000
VOCABULARY_ENTRIES = 300_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class Buckets(dict):
    """Hashed row of a token. Capitals, numbers and long words also stand for their shape."""

    def __missing__(self, token: str) -> int:
        if len(self) >= VOCABULARY_ENTRIES:
            self.clear()
        if token.isdigit():
            key = "<number>"
        elif len(token) > 1 and token.isupper():
            key = "<capitals>"
        else:
            key = token.lower()
        row = self[token] = xxhash.xxh32_intdigest(key.encode()) % BUCKETS
        return row

    def of(self, text: str) -> np.ndarray:
        tokens = TOKEN.findall(text)
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def index_vectors() -> np.ndarray:
    """Sparse random vectors of -1, 0 and 1, the same in every task."""
    rng = np.random.default_rng(20_240)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for j in range(NONZERO):
        out[np.arange(BUCKETS), rng.integers(0, WIDTH, BUCKETS)] += rng.choice([-1.0, 1.0], BUCKETS).astype(np.float32)
    return out


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit vectors of the hashed words, summed over all texts.

    A task counts the neighbour pairs of its texts and adds one table of fixed size; the
    tables are added row by row on the executors, and one table reaches the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, index = Buckets(), index_vectors()
        # The few places of each index vector that are not 0, and their values.
        place = np.argsort(index == 0, axis=1, kind="stable")[:, :NONZERO]
        value = np.take_along_axis(index, place, 1)
        sums = np.zeros(BUCKETS * WIDTH)
        for run in byte_runs(batches, "_text", 1 << 20):
            gap = np.full(REACH, -1)
            line = np.concatenate([x for t in run.column(0).to_pylist() for x in (buckets.of(t), gap)])
            for d in range(1, REACH + 1):
                a, b = line[:-d], line[d:]
                both = (a >= 0) & (b >= 0)
                a, b = a[both], b[both]
                for word, other in ((a, b), (b, a)):
                    for j in range(NONZERO):
                        sums += np.bincount(word * WIDTH + place[other, j], value[other, j], minlength=len(sums))
        sums = sums.reshape(BUCKETS, WIDTH)
        at = np.flatnonzero(np.abs(sums).sum(1))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(list(sums[at]), pa.list_(pa.float64()))], names=["bucket", "v"])

    tables = docs.filter(F.col(text_col).isNotNull()).select(F.col(text_col).alias("_text")).mapInArrow(count, "bucket long, v array<double>")
    summed = tables.groupBy("bucket").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(WIDTH)]).toArrow()
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    out[summed.column("bucket").to_numpy()] = np.stack([summed.column(f"v{i}").to_numpy() for i in range(WIDTH)], 1) if summed.num_rows else 0
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def pooled(text: str, vectors: np.ndarray, buckets: Buckets) -> np.ndarray:
    """Mean and spread of the word vectors, and the share of distinct words."""
    rows = buckets.of(text)
    if not len(rows):
        return np.zeros(2 * WIDTH + 1, np.float32)
    at, n = np.unique(rows, return_counts=True)
    v, w = vectors[at], (n / len(rows)).astype(np.float32)
    mean = w @ v
    return np.r_[mean, np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0)), np.float32(len(at) / len(rows))]


@dataclasses.dataclass
class Network:
    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple | None = None
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2

    def scores(self, x: np.ndarray, empty: np.ndarray) -> np.ndarray:
        if self.layers is None:
            return np.full(len(x), self.prior)
        p = 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))
        return np.where(empty, self.prior, p)


def fit_network(
    x: np.ndarray, y: np.ndarray, rounds: int = 400, rate: float = 0.01, ridge: float = 1e-3, seed: int = 5, weights: np.ndarray | None = None,
) -> Network:
    weights = np.ones(len(y)) if weights is None else weights
    prior = float(np.average(y, weights=weights)) if len(y) else 0.5
    if len(set(y.tolist())) < 2 or len(y) < 10:
        return Network(prior)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        held = np.zeros(len(y), bool)
    centre, scale = x[~held].mean(0), x[~held].std(0) + 1e-6
    a, t, weight = (x[~held] - centre) / scale, y[~held], weights[~held] / weights[~held].sum()
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, a.shape[1] ** -0.5, (a.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for k in range(1, rounds + 1):
        h = a @ params[0] + params[1]
        r = np.maximum(h, 0)
        d = (1 / (1 + np.exp(-np.clip(r @ params[2] + params[3], -30, 30))) - t) * weight
        back = np.outer(d, params[2]) * (h > 0)
        grads = [a.T @ back + ridge * params[0], back.sum(0), r.T @ d + ridge * params[2], np.array([d.sum()])]
        for p, g, (m, v) in zip(params, grads, moments):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    net = Network(prior, centre, scale, tuple(params))
    if held.any():
        z, t, weight = net.logits(x[held]), y[held], weights[held]
        grid = np.geomspace(0.25, 8, 41)
        loss = [np.average(np.logaddexp(0, z / s) - t * z / s, weights=weight) for s in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def _features(rows: DataFrame, vectors, kind: str) -> DataFrame:
    """``(id, label, x)`` of rows ``(id, label, _text)``."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for run in byte_runs(batches, "_text"):
            x = [pooled(t, vectors.value, buckets).astype("<f4").tobytes() for t in run.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([run.column(0), run.column(1), pa.array(x, pa.binary())], names=["id", "label", "x"])

    return rows.mapInArrow(work, f"id {kind}, label int, x binary")


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, id_col: str = "doc_id", text_col: str = "text", documents: int = FIT_DOCUMENTS) -> Network:
    """The network fitted on at most ``documents`` rows of ``labels (id, quality)``, half of them of
    each label, weighted as the labels are frequent. Of the rows that repeat a labelled id the
    least text counts, so that the sample stays bounded."""
    marked, share = sample_by_label(labels.select(F.col(id_col).alias("id"), F.col("quality").cast("int").alias("label")), documents, "id", "label")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = F.broadcast(marked).join(texts, "id").groupBy("id", "label").agg(F.min("_text").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)
    found = _features(rows, shared, rows.schema[0].dataType.simpleString()).drop("id").toArrow()
    order = sorted(zip((x for x in found.column("x").to_pylist()), found.column("label").to_pylist()), key=lambda r: xxhash.xxh64_intdigest(r[0]))
    x = np.array([np.frombuffer(b, "<f4") for b, _ in order], np.float64).reshape(-1, 2 * WIDTH + 1)
    y = np.array([y for _, y in order], float)
    return fit_network(x, y, weights=label_weights(y, share))


def score(docs: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, score, predicted)`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast((vectors, network))  # of a fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (table, net), buckets = shared.value, Buckets()
        for run in byte_runs(batches, "_text"):
            x = np.array([pooled(t, table, buckets) for t in run.column(1).to_pylist()], np.float64)
            p = net.scores(x, x[:, -1] == 0)
            yield pa.RecordBatch.from_arrays([run.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    return rows.mapInArrow(work, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)
