"""Language identification as inference of a mixture of languages.

Each language is a distribution over hashed byte trigrams of the lower-cased text. A document
is a mixture of languages; expectation-maximisation estimates the proportions over its
trigrams, and the set of languages grows one by one while the gain in likelihood exceeds the
penalty for another language. The largest proportion names the document's language.

Null text and text without a letter is ``und`` with score 0. Repeated rows give repeated
rows; null ids are kept. Without any labelled text every document is ``und``.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.llm.tokens import byte_runs

#: The fit sees at most this many distinct texts of each language: those with the least hashes.
FIT_DOCUMENTS = 400
MAX_LANGUAGES = 1000
BUCKETS = 1 << 16
SLICES = 32
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: Cost of one more language, in nats per doubling of the trigrams; trigrams overlap, so it is above the usual half.
PENALTY = 3.0
MIN_PROPORTION = 0.02


@dataclasses.dataclass
class Languages:
    names: list[str]
    log_p: np.ndarray  # buckets x languages


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram that holds part of a word, digits and marks as spaces."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8)
    letters = (data >= 128) | ((data >= 97) & (data <= 122))
    data = np.where(letters, data, 32).astype(np.uint32)
    a, b, c = data[:-2], data[1:-1], data[2:]
    code = (a << 16) | (b << 8) | c
    code = code[(b != 32) | ((a != 32) & (c != 32))]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", documents: int = FIT_DOCUMENTS) -> Languages:
    """Trigram distributions of every non-null value of ``lang``; only counts reach the driver."""
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    found = rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count()
    if found > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not found:
        return Languages([], np.zeros((BUCKETS, 0)))
    # First the least hashes of each slice of a language, so that no task ranks a whole language.
    first = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("h"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    near = rows.select("lang", "h").distinct().withColumn("slice", F.pmod(F.hash("h"), F.lit(SLICES)))
    near = near.withColumn("rank", first).filter(F.col("rank") <= documents)
    chosen = near.withColumn("rank", rank).filter(F.col("rank") <= documents).select("lang", "h")
    sample = rows.join(F.broadcast(chosen), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for run in byte_runs(batches, "text"):
            for lang, text in zip(run.column(0).to_pylist(), run.column(1).to_pylist()):
                held = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                held += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, held in sums.items():
            at = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(held[at])], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.full((BUCKETS, len(names)), 0.5)
    column = {name: i for i, name in enumerate(names)}
    at = np.array([column[x] for x in counts.column("lang").to_pylist()], int)
    table[counts.column("bucket").to_numpy(), at] += counts.column("n").to_numpy()
    return Languages(names, np.log(table / table.sum(0)) if names else table)


def proportions(log_p: np.ndarray, n: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, float]:
    """Mixture weights of the columns of ``log_p`` for trigrams seen ``n`` times, and the log likelihood."""
    top = log_p.max(1, keepdims=True)
    p = np.exp(log_p - top)
    w = np.full(p.shape[1], 1.0 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        joint = p * w
        w = (n / joint.sum(1)) @ joint / total
    return w, float(n @ (np.log(np.maximum(p @ w, 1e-300)) + top[:, 0]))


def mixture(text: str, model: Languages) -> dict[str, float]:
    """Proportion of each language in the chosen set; empty for a text without letters."""
    if not model.names or not LETTER.search(text):
        return {}
    found = trigrams(text)
    if not len(found):
        return {model.names[0]: 1.0}
    at, n = np.unique(found, return_counts=True)
    log_p = model.log_p[at]
    alone = n @ log_p
    chosen = [int(alone.argmax())]
    best, weights = float(alone[chosen[0]]), np.ones(1)
    cost = PENALTY * np.log2(n.sum() + 1)
    while len(chosen) < len(model.names):
        held = log_p[:, chosen].max(1)
        # No mixture is likelier than taking the best language at every single trigram.
        open_ = [k for k in range(len(model.names)) if k not in chosen and n @ np.maximum(held, log_p[:, k]) - best > cost]
        tried = [(*proportions(log_p[:, [*chosen, k]], n), k) for k in open_]
        if not tried:
            break
        w, likelihood, k = max(tried, key=lambda x: x[1])
        if likelihood - best <= cost or w[-1] < MIN_PROPORTION:
            break
        chosen, best, weights = [*chosen, k], likelihood, w
    return {model.names[k]: float(w) for k, w in zip(chosen, weights)}


def predict(docs: DataFrame, model: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score, languages)``; ``languages`` maps the chosen set to its proportions."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, both bounded by the fit

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in byte_runs(batches, "_text"):
            mixes = [mixture(t, shared.value) for t in run.column(1).to_pylist()]
            best = [max(m, key=m.get) if m else UNKNOWN for m in mixes]
            score = [min(1.0, m[b]) if m else 0.0 for m, b in zip(mixes, best)]
            maps = pa.array([sorted(m.items()) for m in mixes], pa.map_(pa.string(), pa.float64()))
            yield pa.RecordBatch.from_arrays([run.column(0), pa.array(best), pa.array(score), maps], names=["id", "lang_pred", "score", "languages"])

    out = rows.mapInArrow(work, f"id {kind}, lang_pred string, score double, languages map<string,double>")
    return out.withColumnRenamed("id", id_col)


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(False))
