"""Approximate vector search over stored lists with residual codes.

The lists and the code books are fitted on a bounded sample; every vector is then assigned to
its nearest list and stored there, one partition per list, with the code of what its list's
centre leaves over: one byte per group of dimensions (product quantiser). A search probes the
lists nearest to each question. Only their partitions are scanned, and of those only the
codes; the best candidates by code are then scored exactly from their vectors.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausegrid.functions import fixed
from clausegrid.functions.stages import materialise
from clausegrid.operators.retrieval import SCORE_DIGITS, top_k
from clausegrid.operators.vectors import _matrix, dimension_of, usable

SAMPLE = 50_000  # vectors that the fit sees
WORDS = 256  # entries of each code book
GROUP = 4  # dimensions per code byte, about
PART_ROWS = 50_000
OVERSAMPLE = 10  # candidates by code for each of the k
CELLS = 4_000_000


class Lists(NamedTuple):
    folder: str
    centres: np.ndarray  # lists x dimension
    books: list[np.ndarray]  # one per group of dimensions: words x its dimensions


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Row of the nearest centre by distance, in slices of bounded size."""
    half = (centres**2).sum(1) / 2
    step = max(1, CELLS // len(centres))
    return np.concatenate([np.argmax(x[i : i + step] @ centres.T - half, 1) for i in range(0, len(x), step)] or [np.zeros(0, int)])


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """At most ``k`` centres; an empty cluster takes the vector farthest from its own centre."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        of = _nearest(x, centres)
        sums, n = np.zeros_like(centres), np.bincount(of, minlength=len(centres))
        np.add.at(sums, of, x)
        far = np.argsort(-((x - centres[of]) ** 2).sum(1), kind="stable")
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        for at, i in zip(np.flatnonzero(n == 0), far):
            centres[at] = x[i]
    return centres


def _groups(dimension: int) -> list[slice]:
    n = max(1, dimension // GROUP)
    edges = [dimension * i // n for i in range(n + 1)]
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def _codes(residuals: np.ndarray, books: list[np.ndarray]) -> np.ndarray:
    return np.stack([_nearest(residuals[:, g], book) for g, book in zip(_groups(residuals.shape[1]), books)], 1).astype(np.uint8)


def build(chunks: DataFrame, folder: str, lists: int = 100, seed: int = 7, sample: int = SAMPLE) -> Lists:
    """Fit on at most ``sample`` vectors, those with the least hashes of their ids, and store all
    ``chunks (chunk_id, ord, embedding)`` by list. Vectors of another length than the first
    usable one's, or with a null, take no part."""
    dimension = chunks.agg(F.max(F.size("embedding"))).first()[0] or 0
    held = chunks.filter(usable(dimension)).select("chunk_id", "ord", F.col("embedding").cast("array<float>").alias("embedding"))
    seen = held.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("embedding").toArrow()
    if not len(seen):
        return Lists(folder, np.zeros((0, dimension)), [])
    x = _matrix(seen.column("embedding"))
    centres = k_means(x, lists, seed)
    left = x - centres[_nearest(x, centres)]
    books = [k_means(left[:, g], WORDS, seed) for g in _groups(dimension)]
    kinds = {c: held.schema[c].dataType.simpleString() for c in ("chunk_id", "ord")}

    def assign(batches):
        for batch in batches:
            m = _matrix(pa.chunked_array([batch.column(2)]))
            of = _nearest(m, centres)
            codes = _codes(m - centres[of], books)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(of.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary())],
                names=["chunk_id", "ord", "embedding", "list_id", "code"])

    rows = held.mapInArrow(assign, f"chunk_id {kinds['chunk_id']}, ord {kinds['ord']}, embedding array<float>, list_id int, code binary")
    # A list may be large, so its rows come from several tasks, each with a file of its own.
    spread = F.pmod(F.xxhash64("chunk_id"), F.lit(8))
    rows.repartition("list_id", spread).write.mode("overwrite").partitionBy("list_id").parquet(folder)
    return Lists(folder, centres, books)


def _best_by_code(centres: np.ndarray, books: list[np.ndarray], take: int):
    def best(questions: pa.Table, held: pa.Table) -> pa.Table:
        """The best ``take`` rows of one part of a list for each question, by list and code."""
        empty = pa.table({"query_id": questions.column("query_id").slice(0, 0), "chunk_id": held.column("chunk_id").slice(0, 0),
                          "list_id": pa.array([], pa.int32()), "about": pa.array([], pa.float64())})
        if not len(questions) or not len(held):
            return empty
        of = held.column("list_id")[0].as_py()
        asked = _matrix(questions.column("asked"))
        codes = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint8).reshape(len(held), -1)
        tables = [asked[:, g] @ book.T for g, book in zip(_groups(asked.shape[1]), books)]
        base, out_q, out_c, out_s = asked @ centres[of], [], [], []
        for start in range(0, len(asked), step := max(1, CELLS // len(held))):
            about = base[start : start + step, None] + sum(t[start : start + step][:, codes[:, j]] for j, t in enumerate(tables))
            n = min(take, about.shape[1])
            at = np.argpartition(-about, n - 1, axis=1)[:, :n]
            out_q.append(np.repeat(np.arange(start, start + len(about)), n))
            out_c.append(at.ravel())
            out_s.append(np.take_along_axis(about, at, 1).ravel())
        q, c = np.concatenate(out_q), np.concatenate(out_c)
        return pa.table({"query_id": questions.column("query_id").take(pa.array(q)), "chunk_id": held.column("chunk_id").take(pa.array(c)),
                         "list_id": pa.array(np.full(len(q), of, np.int32)), "about": pa.array(np.concatenate(out_s))})

    return best


class Found(NamedTuple):
    hits: DataFrame
    lists_read: list[int]  # the partitions that the scan is limited to


def search(spark: SparkSession, questions: DataFrame, lists: Lists, k: int = fixed.TOP_K_RETRIEVAL, probes: int = 10, oversample: int = OVERSAMPLE) -> Found:
    """Best k chunks of each question ``(query_id, embedding)`` among its ``probes`` nearest lists.

    The lists to scan are known before the scan, at most as many ids as there are lists, so
    other partitions are not listed. A list is met in parts of about ``PART_ROWS`` rows.
    """
    dimension = lists.centres.shape[1]
    kind = questions.schema["query_id"].dataType.simpleString()
    asked = questions.filter(usable(dimension)).select("query_id", "embedding")
    if not len(lists.centres) or dimension_of(questions) == 0:
        none = spark.createDataFrame([], f"query_id {kind}, rank long, chunk_id string, score double")
        return Found(none, [])
    centres, n = lists.centres, min(probes, len(lists.centres))

    def probe(batches):
        for batch in batches:
            m = _matrix(pa.chunked_array([batch.column(1)]))
            near = np.argsort(-(m @ centres.T - (centres**2).sum(1) / 2), axis=1, kind="stable")[:, :n].astype(np.int32)
            row = pa.array(np.repeat(np.arange(len(m)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(near.ravel())], names=["query_id", "asked", "_list"])

    pairs = materialise(asked.mapInArrow(probe, f"query_id {kind}, asked {asked.schema['embedding'].dataType.simpleString()}, _list int"))
    read = sorted(r["_list"] for r in pairs.select("_list").distinct().collect())
    held = spark.read.parquet(lists.folder).filter(F.col("list_id").isin(read))
    sizes = held.groupBy("list_id").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"))
    sizes = F.broadcast(sizes)  # one row per list
    met = held.select("chunk_id", "list_id", "code").join(sizes, "list_id").withColumn("_part", F.pmod(F.xxhash64("chunk_id"), F.col("_parts")).cast("int")).drop("_parts")
    dealt = pairs.join(sizes.withColumnRenamed("list_id", "_list"), "_list").withColumn("_of", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    take = k * oversample
    chunk = met.schema["chunk_id"].dataType.simpleString()
    near = dealt.groupBy("_list", "_of").cogroup(met.groupBy("list_id", "_part")).applyInArrow(
        _best_by_code(centres, lists.books, take), f"query_id {kind}, chunk_id {chunk}, list_id int, about double")
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("about").desc(), "chunk_id"))
    candidates = near.withColumn("_r", best).filter(F.col("_r") <= take).select("query_id", "chunk_id", "list_id")
    vectors = held.select("chunk_id", "list_id", "ord", "embedding")
    both = candidates.join(vectors, ["list_id", "chunk_id"]).join(asked.withColumnRenamed("embedding", "asked"), "query_id")
    score = _cosine("asked", "embedding")
    hits = top_k(both.select("query_id", "chunk_id", "ord", score.alias("score")), k)
    return Found(hits.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score"), read)


def _cosine(a: str, b: str):
    def dot(x, y):
        return F.aggregate(F.zip_with(F.col(x).cast("array<double>"), F.col(y).cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm), SCORE_DIGITS)
