"""The segmented index beside a rebuild and brute force."""

import os
import random

import pytest
from pyspark.sql import functions as F

from clausegrid.operators import retrieval as R
from clausegrid.operators import segments as S

CHUNKS = "chunk_id long, ord long, text string"


def texts(n, seed=3):
    rng = random.Random(seed)
    common, rare = ["the", "of", "and", "to"], [f"w{i}" for i in range(n // 2)]
    out = []
    for i in range(n):
        words = rng.choices(common, k=rng.randrange(0, 9)) + rng.choices(rare, k=rng.randrange(0, 4))
        rng.shuffle(words)
        out.append((i, i * 7 % n, " ".join(words)))
    return out


def rows(hits):
    return sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 8)) for r in hits.collect())


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(S, "BLOCK_BITS", 2)


def files(folder):
    """Stored segments and tombstones with their times."""
    found = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if "manifest" not in d]
    return {f: os.path.getmtime(f) for f in found}


@pytest.mark.parametrize("zero_fill", [True, False])
def test_segments_equal_a_rebuild(spark, tmp_path, small_blocks, zero_fill):
    data, folder = texts(300), str(tmp_path / "index")
    chunks = spark.createDataFrame(data, CHUNKS)
    asked = spark.createDataFrame([(1, "the w3 w9 w3"), (2, "of and"), (3, "nothing known"), (4, "..."), (5, "w1 w2 w4 w5 w6 w7 w8 the of")], "query_id long, question string")

    def check(live):
        got = S.search(asked, S.load(spark, folder), 7, zero_fill=zero_fill, first_blocks=1)
        assert rows(got.hits) == rows(R.bm25_top_k(asked, chunks.filter(live), 7, zero_fill=zero_fill))
        return got

    S.add(chunks.filter("chunk_id % 3 = 0"), folder)
    check("chunk_id % 3 = 0")
    S.add(chunks.filter("chunk_id % 3 = 1"), folder)
    check("chunk_id % 3 < 2")
    gone = chunks.filter("chunk_id % 5 = 2 or chunk_id = 9").select("chunk_id")
    before = files(folder)
    S.delete(gone, folder)
    S.delete(gone, folder)  # again: nothing left to delete
    S.delete(spark.createDataFrame([(12345,)], "chunk_id long"), folder)
    assert before.items() <= files(folder).items()
    check("chunk_id % 3 < 2 and not (chunk_id % 5 = 2 or chunk_id = 9)")
    merged = S.merge(spark, folder)
    assert S.load(spark, folder).names == [merged] and before.items() <= files(folder).items()
    check("chunk_id % 3 < 2 and not (chunk_id % 5 = 2 or chunk_id = 9)")
    S.add(chunks.filter("chunk_id % 3 = 2"), folder)
    S.add(chunks.filter("(chunk_id % 5 = 2 or chunk_id = 9) and chunk_id % 3 < 2"), folder)  # what was deleted comes back
    check("true")
    S.merge(spark, folder, S.load(spark, folder).names)
    check("true")


def test_a_broken_change_does_not_count(spark, tmp_path, small_blocks, monkeypatch):
    folder = str(tmp_path / "index")
    chunks = spark.createDataFrame(texts(40), CHUNKS)
    asked = spark.createDataFrame([(1, "the w3")], "query_id long, question string")
    S.add(chunks.filter("chunk_id < 20"), folder)
    before = rows(S.search(asked, S.load(spark, folder), 5).hits)
    monkeypatch.setattr(S, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    for change in (lambda: S.add(chunks.filter("chunk_id >= 20"), folder), lambda: S.delete(chunks.select("chunk_id"), folder)):
        with pytest.raises(RuntimeError):
            change()
        assert rows(S.search(asked, S.load(spark, folder), 5).hits) == before
    monkeypatch.undo()
    monkeypatch.setattr(S, "BLOCK_BITS", 2)
    S.add(chunks.filter("chunk_id >= 20"), folder)
    assert rows(S.search(asked, S.load(spark, folder), 5).hits) == rows(R.bm25_top_k(asked, chunks, 5))


def test_everything_deleted_and_nothing_added(spark, tmp_path):
    folder = str(tmp_path / "index")
    asked = spark.createDataFrame([(1, "the w3")], "query_id long, question string")
    assert S.search(asked, S.load(spark, folder), 5).hits.collect() == [] and S.merge(spark, folder) is None
    chunks = spark.createDataFrame(texts(10), CHUNKS)
    S.add(chunks, folder)
    S.add(chunks.limit(0), folder)
    S.delete(chunks.select("chunk_id"), folder)
    assert S.load(spark, folder).n_chunks == 0
    assert S.search(asked, S.load(spark, folder), 5).hits.collect() == []


def test_blocks_without_a_rare_word_are_left_alone(spark, tmp_path, small_blocks):
    rng = random.Random(4)
    data = [(i, i, " ".join(["the of"] + ["and"] * rng.randrange(3) + ([f"rare{i % 40}"] if i % 40 < 2 else []))) for i in range(2000)]
    chunks = spark.createDataFrame(data, CHUNKS)
    asked = spark.createDataFrame([(i, f"the of and rare{i}") for i in range(2)], "query_id long, question string")
    folder = str(tmp_path / "index")
    S.add(chunks, folder)
    found = S.search(asked, S.load(spark, folder), 10)
    assert rows(found.hits) == rows(R.bm25_top_k(asked, chunks, 10))
    common = found.read.filter("term in ('the', 'of', 'and')").count()
    assert 0 < common < 0.4 * 3 * 2 * 500


def test_sizes_to_merge():
    assert S.to_merge({"a": 100, "b": 90, "c": 5000}) == ["a", "b"]
    assert S.to_merge({"a": 100, "b": 2000, "c": 2100, "d": 2200}) == ["b", "c", "d"]
    assert S.to_merge({"a": 1, "b": 10**6}) == [] and S.to_merge({}) == []


def test_negative_weights_with_many_unmatched(spark, tmp_path, small_blocks, monkeypatch):
    monkeypatch.setattr(R, "SPAN_ROWS", 3)
    data = [(i, 99 - i, "common" if i % 4 else "other common" if i % 8 else "rare") for i in range(100)]
    chunks = spark.createDataFrame(data, CHUNKS)
    asked = spark.createDataFrame([(1, "common"), (2, "other common"), (3, "rare common")], "query_id long, question string")
    scores = {}
    import math
    docs = {c: t.split() for c, _, t in data}
    n, avg = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {w: sum(w in t for t in docs.values()) for w in ("common", "other", "rare")}
    idf = {w: math.log((n - f + 0.5) / (f + 0.5)) for w, f in df.items()}
    mean = sum(idf.values()) / 3
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    for q, text in [(1, "common"), (2, "other common"), (3, "rare common")]:
        each = sorted((-round(sum(idf[w] * 2.5 / (1 + 1.5 * (0.25 + 0.75 * len(docs[c]) / avg)) for w in text.split() if w in docs[c]), 9), o, c) for c, o, _ in data)
        scores[q] = [c for _, _, c in each[:30]]
    hits = R.bm25_top_k(asked, chunks, 30)
    got = {q: [r.chunk_id for r in hits.filter(F.col("query_id") == q).orderBy("rank").collect()] for q in scores}
    assert got == scores
    S.add(chunks, str(tmp_path / "index"))
    assert rows(S.search(asked, S.load(spark, str(tmp_path / "index")), 30).hits) == rows(hits)


@pytest.mark.parametrize("zero_fill", [True, False])
def test_access_bitmaps_equal_the_row_filter(spark, tmp_path, small_blocks, zero_fill):
    rng, folder = random.Random(6), str(tmp_path / "index")
    held = {0: None, 1: [], 2: ["a"], 3: ["b", "a"], 4: ["c", None, "c"], 5: ["b"]}
    data = [(*r, held[rng.randrange(6)]) for r in texts(120)]
    chunks = spark.createDataFrame(data, CHUNKS + ", access_tags array<string>").cache()
    asked = spark.createDataFrame([(1, "the w3 w9"), (2, "of and"), (3, "unknown")], "query_id long, question string")
    S.add(chunks.filter("chunk_id < 50"), folder)
    S.add(chunks.filter("chunk_id >= 50 and chunk_id < 110"), folder)
    S.merge(spark, folder, S.load(spark, folder).names)
    S.add(chunks.filter("chunk_id >= 110"), folder)
    S.delete(chunks.filter("chunk_id % 7 = 3").select("chunk_id"), folder)
    live, index = chunks.filter("chunk_id % 7 <> 3"), S.load(spark, folder)
    every = [["a"], ["b"], ["c"], ["a", "b"], ["a", "c"], ["b", "c"], ["a", "b", "c"], ["none"]]
    for tags in every if zero_fill else every[::3]:
        got = S.search(asked, index, 7, zero_fill=zero_fill, first_blocks=1, allowed_tags=tags)
        assert rows(got.hits) == rows(R.bm25_top_k(asked, live, 7, zero_fill=zero_fill, allowed_tags=tags)), tags
    assert S.search(asked, index, 7, allowed_tags=[]).hits.count() == 0


def test_blocks_without_an_allowed_chunk_are_not_read(spark, tmp_path, small_blocks):
    data = [(i, i, f"the w{i}", ["rare"] if 40 <= i < 44 else ["common"]) for i in range(400)]
    folder = str(tmp_path / "index")
    S.add(spark.createDataFrame(data, CHUNKS + ", access_tags array<string>"), folder)
    asked = spark.createDataFrame([(1, "the")], "query_id long, question string")
    found = S.search(asked, S.load(spark, folder), 10, allowed_tags=["rare"])
    assert {r.chunk_id for r in found.hits.collect()} == {40, 41, 42, 43}
    assert 1 <= found.read.distinct().count() <= 2


def test_chunks_added_without_tags_are_hidden_from_an_access_filter(spark, tmp_path, small_blocks):
    folder = str(tmp_path / "index")
    S.add(spark.createDataFrame(texts(20), CHUNKS), folder)
    asked = spark.createDataFrame([(1, "the w3")], "query_id long, question string")
    index = S.load(spark, folder)
    assert S.search(asked, index, 5).hits.count() == 5 and S.search(asked, index, 5, allowed_tags=["a"]).hits.count() == 0


def test_a_block_is_one_row_and_no_posting_is_shuffled(spark, tmp_path, small_blocks):
    folder = str(tmp_path / "index")
    S.add(spark.createDataFrame(texts(60), CHUNKS).coalesce(1), folder)
    index = S.load(spark, folder)
    assert index.blocks.count() == index.blocks.select("segment", "block").distinct().count() == -(-index.n_chunks // 4)
    asked = spark.createDataFrame([(1, "the w3")], "query_id long, question string")
    plan = S.search(asked, index, 5).hits._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "MapInArrow" in plan and "Join" not in plan
