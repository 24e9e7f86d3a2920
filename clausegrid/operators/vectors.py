"""Vector retrieval.

Every question meets every chunk it may match, which is a matrix product, so it is done as
one. Questions of a single block are broadcast, and each task compares the chunks it reads, so
no chunk is stored or shuffled. More questions and the chunks are dealt into blocks of bounded
size on the executors, each pair of blocks meets in one task. The task returns the best k per
question, and the plan has the same size for any number of questions.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import fixed
from clausegrid.functions.sizes import BROADCAST_BYTES
from clausegrid.operators.retrieval import SCORE_DIGITS, corpus_order, top_k

QUESTION_BLOCK_ROWS = 4096
CHUNK_BLOCK_ROWS = 50_000
HEAD_COLUMNS = 2048  # columns whose k-th best is the floor of the others
CELLS = 1_000_000  # largest similarity matrix held at once in a task, besides a few copies of it


def usable(dimension: int) -> Column:
    """Whether ``embedding`` is a vector of this dimension without nulls."""
    whole = F.forall("embedding", lambda x: x.isNotNull())
    return F.coalesce((F.size("embedding") == dimension) & whole, F.lit(False))


def dimension_of(questions: DataFrame) -> int:
    """The largest dimension among the questions, 0 without any."""
    return max(0, questions.agg(F.max(F.size("embedding"))).first()[0] or 0)


def rejected_vectors(vectors: DataFrame, dimension: int) -> DataFrame:
    """Rows whose vector is null, has a null in it or another length, with the reason."""
    reason = F.when(F.col("embedding").isNull(), "no vector").when(F.size("embedding") != dimension, "wrong length").otherwise("null in vector")
    return vectors.filter(~usable(dimension)).withColumn("reason", reason)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Row-normalised float64 matrix of an Arrow list column."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    m = flat.reshape(len(column), -1)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1.0, norms)


def nearest(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded value) of the best ``k`` of each row, of equal ones the first. The k-th
    of the first columns is a floor for all, so that the rest is only compared with it; what
    reaches it is rounded and sorted."""
    head = sim[:, :HEAD_COLUMNS]
    if head.shape[1] > k:
        floor = np.partition(head, head.shape[1] - k, axis=1)[:, -k] - 2.0 * 10.0**-SCORE_DIGITS
        i, j = np.nonzero(sim >= floor[:, None])
    else:
        i, j = (x.ravel() for x in np.indices(sim.shape))
    s = np.round(sim[i, j], SCORE_DIGITS)
    order = np.lexsort((j, -s, i))
    counts = np.bincount(i, minlength=len(sim))
    nth = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)
    best = order[nth < k]
    return i[best], j[best], s[best]


def _best_in_block(k: int):
    def best(questions: pa.Table, chunks: pa.Table) -> pa.Table:
        """Best k chunks of each question of one pair of blocks; ties by corpus order."""
        if not len(questions) or not len(chunks):
            return pa.table({"q": questions.column("query_id").slice(0, 0), "c": chunks.column("chunk_id").slice(0, 0),
                             "o": chunks.column("ord").slice(0, 0), "s": pa.array([], pa.float64())})
        order = corpus_order(chunks.column("ord"))
        asked, held = _matrix(questions.column("asked")), _matrix(chunks.column("held"))[order]
        q, c, s = [], [], []
        for start in range(0, len(asked), step := max(1, CELLS // len(held))):
            i, j, score = nearest(asked[start : start + step] @ held.T, k)
            q.append(i + start)
            c.append(order[j])
            s.append(score)
        q, c = np.concatenate(q), np.concatenate(c)
        return pa.table({"q": questions.column("query_id").take(pa.array(q)), "c": chunks.column("chunk_id").take(pa.array(c)),
                         "o": chunks.column("ord").take(pa.array(c)), "s": pa.array(np.concatenate(s))})

    return best


def _best_where_read(asked: pa.Table, k: int):
    best = _best_in_block(k)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Best k chunks of each question, batch by batch; of later ones only those as good as the
        k-th so far of the same task."""
        ids = asked.column("query_id").combine_chunks()
        kth = np.full(len(ids), -np.inf)
        for batch in batches:
            found = best(asked, pa.Table.from_batches([batch]))
            q = pc.index_in(found.column("q").combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False)
            s = found.column("s").to_numpy()
            keep = s >= kth[q]
            full = np.flatnonzero(np.bincount(q, minlength=len(ids)) >= k)
            least = np.full(len(ids), np.inf)
            np.minimum.at(least, q, s)
            kth[full] = np.maximum(kth[full], least[full])
            yield from found.filter(pa.array(keep)).to_batches()

    return work


def _meet(questions: DataFrame, chunks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Best k per question where rows meet on ``keys``, then over all of them."""
    # Both sides may come from one table; names of their own keep their columns apart.
    a = questions.select("query_id", F.col("embedding").alias("asked"), *[F.col(c).alias(f"_a{c}") for c in keys]).groupBy(*[f"_a{c}" for c in keys])
    b = chunks.select("chunk_id", "ord", F.col("embedding").alias("held"), *[F.col(c).alias(f"_b{c}") for c in keys]).groupBy(*[f"_b{c}" for c in keys])
    kinds = {n: d.schema[c].dataType.simpleString() for n, d, c in (("q", questions, "query_id"), ("c", chunks, "chunk_id"), ("o", chunks, "ord"))}
    return _ranked(a.cogroup(b).applyInArrow(_best_in_block(k), f"q {kinds['q']}, c {kinds['c']}, o {kinds['o']}, s double"), k)


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    ranked = top_k(partial.withColumnsRenamed({"q": "query_id", "c": "chunk_id", "o": "ord", "s": "score"}), k)
    return ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def vector_top_k(
    questions: DataFrame,
    chunks: DataFrame,
    k: int = fixed.TOP_K_RETRIEVAL,
    allowed_tags: list[str] | None = None,
    block_rows: int = QUESTION_BLOCK_ROWS,
    chunk_rows: int = CHUNK_BLOCK_ROWS,
) -> DataFrame:
    """Cosine similarity, best k per question, ties in corpus order.

    Questions ``(query_id, embedding)``, chunks ``(chunk_id, ord, embedding)`` with ids and
    order of any orderable type. Vectors that ``rejected_vectors`` names take no part.
    """
    if allowed_tags is not None:
        chunks = chunks.filter(F.arrays_overlap("access_tags", F.array(*[F.lit(t) for t in allowed_tags])))
    dimension = dimension_of(questions)
    asked, held = questions.filter(usable(dimension)), chunks.filter(usable(dimension))
    n_questions = asked.count()
    if n_questions <= block_rows and n_questions * dimension * 8 <= BROADCAST_BYTES:
        given = chunks.sparkSession.sparkContext.broadcast(asked.select("query_id", F.col("embedding").alias("asked")).toArrow())
        kinds = {n: d.schema[c].dataType.simpleString() for n, d, c in (("q", asked, "query_id"), ("c", held, "chunk_id"), ("o", held, "ord"))}
        near = lambda batches: _best_where_read(given.value, k)(batches)
        rows = held.select("chunk_id", "ord", F.col("embedding").alias("held"))
        return _ranked(rows.mapInArrow(near, f"q {kinds['q']}, c {kinds['c']}, o {kinds['o']}, s double"), k)
    n_chunks = held.count()
    blocks, parts = max(1, -(-n_questions // block_rows)), max(1, -(-n_chunks // chunk_rows))
    # As many parts as the session has cores at least, so that a small corpus is not one task.
    parts = max(parts, min(chunks.sparkSession.sparkContext.defaultParallelism, -(-n_chunks // 1000) or 1))
    asked = asked.select("query_id", "embedding", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block"), _every(parts).alias("_part"))
    held = held.select("chunk_id", "ord", "embedding", F.pmod(F.xxhash64("chunk_id"), F.lit(parts)).cast("int").alias("_part"), _every(blocks).alias("_block"))
    return _meet(asked, held, ["_block", "_part"], k)


def assign_lists(chunks: DataFrame, lists: int = 100, seed: int = 7):
    """(chunks with ``list_id``, centroid rows (list_id, centroid)), fitted on all chunks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    vectors = chunks.withColumn("features", array_to_vector(F.col("embedding")))
    model = KMeans(k=lists, seed=seed, maxIter=10, distanceMeasure="cosine", predictionCol="list_id").fit(vectors)
    centres = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    centroids = chunks.sparkSession.createDataFrame(centres, "list_id int, centroid array<double>")
    return model.transform(vectors).drop("features"), centroids


def approximate_top_k(
    questions: DataFrame, listed: DataFrame, centroids: DataFrame, k: int = fixed.TOP_K_RETRIEVAL, probes: int = 10,
    chunk_rows: int = CHUNK_BLOCK_ROWS,
) -> DataFrame:
    """Exact cosine top-k inside the ``probes`` nearest lists of each question.

    ``listed`` is the first result of ``assign_lists``, best stored partitioned by
    ``list_id``. A list is dealt into parts by its size, since one may hold a large share of
    the chunks; with ``probes`` equal to the number of lists the result is that of
    ``vector_top_k``.
    """
    nearest = vector_top_k(
        questions, centroids.select(F.col("list_id").alias("chunk_id"), F.col("list_id").alias("ord"), F.col("centroid").alias("embedding")), probes,
    ).select("query_id", F.col("chunk_id").alias("list_id"))
    dimension = dimension_of(questions)
    held = listed.filter(usable(dimension))
    parts = held.groupBy("list_id").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("_parts"))
    blocks = max(1, -(-questions.count() // QUESTION_BLOCK_ROWS))
    asked = questions.filter(usable(dimension)).select("query_id", "embedding").join(nearest, "query_id").join(parts, "list_id")
    asked = asked.select("query_id", "embedding", "list_id", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"),
                         F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("_block"))
    met = held.join(parts, "list_id").select("chunk_id", "ord", "embedding", "list_id",
                                             F.pmod(F.xxhash64("chunk_id"), F.col("_parts")).cast("int").alias("_part"), _every(blocks).alias("_block"))
    return _meet(asked, met, ["list_id", "_part", "_block"], k)
