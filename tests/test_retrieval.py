"""Search against brute force; fusion on fixed lists."""

import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from clausegrid.operators import retrieval as R
from clausegrid.operators import vectors as V
from clausegrid.sources.lines import line_chunks, register_documents


def brute_bm25(questions, chunks, k):
    docs = [(c, re.findall("[a-z0-9]+", t.lower())) for c, t in chunks]
    docs = [(c, t) for c, t in docs if t]
    n, avg = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = Counter(w for _, t in docs for w in set(t))
    idf = {w: math.log((n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for q, text in questions:
        asked = re.findall("[a-z0-9]+", text.lower())
        if not asked:
            continue
        scores = []
        for c, t in docs:
            tf = Counter(t)
            s = sum(idf.get(w, 0) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(t) / avg)) for w in asked)
            scores.append((-round(s, 9), c))
        out[q] = [(c, -s) for s, c in sorted(scores)[:k]]
    return out


def test_bm25_equals_brute_force(spark):
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(40)]
    chunks = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12)))) for i in range(60)] + [(60, "...")]
    questions = [(1, "w1 w2 w2 W3"), (2, "nothing here"), (3, "..."), (4, " ".join(vocabulary))]
    df = spark.createDataFrame([(c, c, t) for c, t in chunks], "chunk_id long, ord long, text string")
    asked = spark.createDataFrame(questions, "query_id long, question string")
    got = {}
    for r in R.bm25_top_k(asked, df, k=7).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.score))
    want = brute_bm25(questions, chunks, 7)
    assert got.keys() == want.keys()
    for q in want:
        assert [c for c, _ in got[q]] == [c for c, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8)


def test_large_question_sets_are_not_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, i, f"a b{i % 3} c{i}") for i in range(20)], "chunk_id long, ord long, text string")
    asked = spark.createDataFrame([(1, "a b1"), (2, "c7")], "query_id long, question string")
    small = R.bm25_top_k(asked, df, k=5).collect()
    monkeypatch.setattr(R, "BROADCAST_ROWS", -1)
    assert sorted(R.bm25_top_k(asked, df, k=5).collect()) == sorted(small)


@pytest.mark.parametrize("zero_fill", [True, False])
def test_slices_and_blocks_give_the_same_hits(spark, zero_fill, monkeypatch):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["all"] * 6
    chunks = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 9)))) for i in range(80)]
    questions = [(q, " ".join(rng.choice(vocabulary + ["unknown"]) for _ in range(rng.randint(0, 5)))) for q in range(9)]
    df = spark.createDataFrame([(c, (9, c), t) for c, t in chunks], "chunk_id long, ord struct<a:long,b:long>, text string").repartition(3)
    asked = spark.createDataFrame(questions, "query_id long, question string")
    whole = sorted(R.bm25_top_k(asked, df, 6, zero_fill=zero_fill).collect())
    for name, value in (("SLICE_QUESTIONS", 2), ("SLICE_TERMS", 3), ("CELLS", 30)):
        monkeypatch.setattr(R, name, value)
    cut = R.Scorer(pa.table({"query_id": [1, 1, 2, 3], "term": ["a", "b", "a", "c"], "weight": [1.0, 1.0, 1.0, 0.0]}), 2, 1.5, 0.75, 2.0, zero_fill)
    assert [(a, e) for a, e, *_ in cut.slices] == [(0, 2), (2, 3)]
    some = cut.best(pa.table({"chunk_id": [7, 8, 9], "ord": [7, 8, 9], "terms": [["a"], [], ["c"]], "tfs": pa.array([[1], [], [3]], pa.list_(pa.int32()))}))
    want = {(1, 7), (2, 7), (3, 9)} | ({(1, 9), (2, 9), (3, 7)} if zero_fill else set())
    assert set(zip(some["q"].to_pylist(), some["c"].to_pylist())) == want
    monkeypatch.setattr(R, "BROADCAST_ROWS", 5)
    monkeypatch.setattr(R, "PART_CHUNKS", 20)
    assert sorted(R.bm25_top_k(asked, df, 6, zero_fill=zero_fill).collect()) == whole


def test_pairs_of_questions_and_chunks_are_not_shuffled(spark):
    df = spark.createDataFrame([(i, i, f"a b{i}") for i in range(9)], "chunk_id long, ord long, text string")
    asked = spark.createDataFrame([(1, "a b1"), (2, "a")], "query_id long, question string")
    plan = R.bm25_top_k(asked, df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(chunk_id" not in plan and "hashpartitioning" in plan
    assert "Exchange" not in R.postings(df)._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in R.postings(spark.createDataFrame([(1, 1, "b a B"), (2, 2, "-"), (3, 3, None)], df.schema)).collect()) == [(1, 1, 3, "a", 1), (1, 1, 3, "b", 2)]


def test_fusion_of_fixed_lists(spark):
    def hits(names):
        return spark.createDataFrame([(1, i + 1, c) for i, c in enumerate(names)], "query_id long, rank long, chunk_id string")

    got = R.reciprocal_rank_fusion([hits("xyz"), hits("yw")]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["y", "x", "w", "z"]
    assert [round(r.score, 9) for r in got] == [0.032522475, 0.016393443, 0.016129032, 0.015873016]


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)).astype(np.float32)
    v[n // 2] = v[0]  # a tie
    return v


@pytest.mark.parametrize("block_rows", [3, 4096])
def test_vectors_equal_brute_force(spark, block_rows, monkeypatch):
    monkeypatch.setattr(V, "CELLS", 40)
    c, q = vectors(50, 6, 1), vectors(11, 6, 2)
    chunks = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(c)], "chunk_id long, ord long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    got = {}
    for r in V.vector_top_k(asked, chunks, 5, block_rows=block_rows).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.chunk_id)
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    sim = np.round(unit(q) @ unit(c).T, 9)
    assert got == {i: [int(x) for x in sorted(range(50), key=lambda j: (-sim[i, j], j))[:5]] for i in range(11)}


def test_memory_of_a_pair_of_blocks_is_bounded():
    rng = np.random.default_rng(5)

    def table(n, prefix, name):
        flat = pa.array(rng.normal(size=n * 16).astype(np.float32))
        return pa.table({prefix: pa.array(np.arange(n)), "ord": pa.array(np.arange(n)), name: pa.ListArray.from_arrays(pa.array(np.arange(0, n * 16 + 1, 16), pa.int32()), flat)})

    asked, held = table(1000, "query_id", "asked"), table(20_000, "chunk_id", "held")
    tracemalloc.start()
    assert len(V._best_in_block(20)(asked, held)) == 20_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


def test_blocks_of_chunks_and_hot_ties(spark):
    chunks = spark.createDataFrame([(f"c{i}", (0, 99 - i), [1.0, 0.0] if i < 70 else [0.5, float(i)]) for i in range(100)],
                                   "chunk_id string, ord struct<a:int,b:int>, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", [1.0, 0.001 * i]) for i in range(9)], "query_id string, embedding array<double>")
    for chunk_rows in (7, 1000):
        got = V.vector_top_k(asked, chunks, 3, block_rows=2, chunk_rows=chunk_rows).filter("query_id = 'q0'").orderBy("rank").collect()
        assert [r.chunk_id for r in got] == ["c69", "c68", "c67"]


def test_bad_vectors_take_no_part(spark):
    rows = [(1, 1, [1.0, 0.0]), (2, 2, None), (3, 3, [1.0]), (4, 4, [None, 1.0])]
    chunks = spark.createDataFrame(rows, "chunk_id long, ord long, embedding array<double>")
    asked = chunks.select(F.col("chunk_id").alias("query_id"), "embedding")
    assert [tuple(r) for r in V.vector_top_k(asked, chunks, 3).collect()] == [(1, 1, 1, 1.0)]
    assert {(r.chunk_id, r.reason) for r in V.rejected_vectors(chunks, 2).collect()} == {(2, "no vector"), (3, "wrong length"), (4, "null in vector")}
    assert V.vector_top_k(asked.limit(0), chunks, 3).count() == 0


def test_chunks_that_match_nothing_rank_above_negative_scores(spark):
    chunks = spark.createDataFrame([(0, 0, "alpha beta"), (1, 1, "alpha beta"), (2, 2, "gamma")], "chunk_id long, ord long, text string")
    asked = spark.createDataFrame([(1, "alpha")], "query_id long, question string")
    got = [tuple(r) for r in R.bm25_top_k(asked, chunks, 3).orderBy("rank").select("chunk_id", "score").collect()]
    assert [g[0] for g in got] == [2, 0, 1] and got[0][1] == 0 and got[1][1] == pytest.approx(-0.039053947, abs=1e-8)


def test_saved_index_gives_the_same_hits(spark, tmp_path):
    chunks = spark.createDataFrame([(i, i, f"alpha {'beta ' * (i % 3)} w{i}") for i in range(30)], "chunk_id long, ord long, text string")
    asked = spark.createDataFrame([(1, "beta w3"), (2, "alpha")], "query_id long, question string")
    R.save_index(R.build_index(chunks), str(tmp_path / "index"))
    loaded = R.load_index(spark, str(tmp_path / "index"))
    assert sorted(R.bm25_top_k(asked, chunks, 5, index=loaded).collect()) == sorted(R.bm25_top_k(asked, chunks, 5).collect())
    assert "text" not in R.bm25_top_k(asked, chunks, 5, index=loaded)._jdf.queryExecution().optimizedPlan().toString()


def test_line_ids_of_any_document_id(spark):
    docs = spark.createDataFrame([(1, "a"), (4294967297, "a\nb"), (2200000000, "a")], "doc_id long, text string")
    rows = line_chunks(docs).orderBy("ord").collect()
    assert [(r.document_id, r.line_no) for r in rows] == [(1, 0), (2200000000, 0), (4294967297, 0), (4294967297, 1)]
    assert len({r.chunk_id for r in rows}) == 4
    named = register_documents(spark.createDataFrame([("x/a.docx",)], "source_uri string"), "2024-01-01").withColumn("text", F.lit("one\ntwo"))
    assert line_chunks(named, "document_id").count() == 2


def test_lists_with_all_probes_are_exact(spark):
    c, q = vectors(80, 6, 3), vectors(5, 6, 4)
    chunks = spark.createDataFrame([(i, i, v.tolist()) for i, v in enumerate(c)], "chunk_id long, ord long, embedding array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedding array<float>")
    listed, centroids = V.assign_lists(chunks, lists=6)
    exact = sorted((r.query_id, r.rank, r.chunk_id) for r in V.vector_top_k(asked, chunks, 4).collect())
    assert sorted((r.query_id, r.rank, r.chunk_id) for r in V.approximate_top_k(asked, listed, centroids, 4, probes=6).collect()) == exact
    some = {(r.query_id, r.chunk_id) for r in V.approximate_top_k(asked, listed, centroids, 4, probes=3).collect()}
    assert len(some & {(q, c) for q, _, c in exact}) >= 0.5 * len(exact)


def test_missing_index_is_refused_unless_asked(spark):
    asked = spark.createDataFrame([(1, "bm25")], "query_id long, mode string")
    fake = lambda q: q.selectExpr("query_id", "1L as rank", "5L as chunk_id", "0.5D as score")
    with pytest.raises(ValueError):
        R.search(asked, None, fake)
    assert R.search(asked, None, fake, missing_index="fallback").count() == 1


def test_few_questions_meet_the_chunks_where_they_are(spark, monkeypatch):
    rng = random.Random(8)
    vector = lambda: [float(rng.randrange(3)) for _ in range(4)]
    chunks = spark.createDataFrame([(i, -i, vector()) for i in range(300)], "chunk_id long, ord long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([(i, vector()) for i in range(9)], "query_id long, embedding array<double>")
    rows = lambda hits: sorted(tuple(r) for r in hits.collect())
    dealt = rows(V.vector_top_k(asked, chunks, 5, block_rows=2, chunk_rows=50))
    monkeypatch.setattr(V, "_meet", lambda *a: (_ for _ in ()).throw(AssertionError("chunks are dealt out")))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(V.vector_top_k(asked, chunks, 5)) == dealt
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_texts_are_not_shuffled_to_meet_candidates(spark):
    from clausegrid.operators import models as M

    chunks = spark.range(1000).select(F.col("id").alias("chunk_id"), F.lit("a b").alias("text"))
    asked = spark.createDataFrame([(1, "a")], "query_id long, question string")
    found = spark.createDataFrame([(1, 1, 5), (1, 2, 6)], "query_id long, rank long, chunk_id long")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        M.MODELS["one"] = M.Model(lambda a, b: pa.array([1.0] * len(a)))
        for scorer in ("overlap", M.pair_scores(found, asked, chunks, "one")):
            best = R.rerank(found, asked, chunks, scorer=scorer)
            assert [tuple(r) for r in best.orderBy("rank").collect()] == [(1, 1, 5, 1.0), (1, 2, 6, 1.0)]
            assert "BroadcastHashJoin [chunk_id" in best._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        M.MODELS.pop("one", None)


def test_best_of_each_row_with_ties(monkeypatch):
    monkeypatch.setattr(V, "HEAD_COLUMNS", 7)
    rng = np.random.default_rng(5)
    for width in (1, 3, 4, 40):
        sim = np.round(rng.random((30, width)), 1) + rng.random((30, width)) * 1e-11
        i, j, s = V.nearest(sim, 3)
        want = {(r, c) for r in range(30) for c in sorted(range(width), key=lambda c: (-round(sim[r, c], 9), c))[:3]}
        assert set(zip(i.tolist(), j.tolist())) == want and np.allclose(s, sim[i, j]) and len(i) == len(want)
