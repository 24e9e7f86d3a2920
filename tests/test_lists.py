"""Stored lists beside the exact search."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausegrid.operators import lists as L
from clausegrid.operators import vectors as V


@pytest.fixture(scope="module")
def chunks(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(30, 16))
    v = (centres[rng.integers(0, 30, 3000)] + 0.3 * rng.normal(size=(3000, 16))).astype(np.float32)
    v[5] = v[6] = v[7]
    rows = [(i, 3000 - i, x.tolist()) for i, x in enumerate(v)] + [(9000, 1, None), (9001, 2, [1.0]), (9002, 3, [None] * 16), (9003, 4, [0.0] * 16)]
    return spark.createDataFrame(rows, "chunk_id long, ord long, embedding array<float>").repartition(3)


@pytest.fixture(scope="module")
def asked(chunks):
    return chunks.filter("chunk_id % 100 = 0 or chunk_id = 9001").select(F.col("chunk_id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def stored(chunks, tmp_path_factory):
    return L.build(chunks, str(tmp_path_factory.mktemp("lists") / "all"), lists=24)


def exact(asked, chunks):
    return {(r.query_id, r.chunk_id): r.score for r in V.vector_top_k(asked, chunks, 20).collect()}


def test_every_vector_is_stored_once(spark, stored):
    rows = spark.read.parquet(stored.folder)
    assert rows.count() == 3001 == rows.select("chunk_id").distinct().count()
    assert len([d for d in os.listdir(stored.folder) if d.startswith("list_id=")]) <= 24


def test_recall_with_few_probes(spark, chunks, asked, stored):
    want = exact(asked, chunks)
    found = L.search(spark, asked, stored, 20, probes=4)
    got = {(r.query_id, r.chunk_id): r.score for r in found.hits.collect()}
    assert len(got.keys() & want.keys()) >= 0.9 * len(want)
    assert all(abs(got[p] - want[p]) < 1e-6 for p in got.keys() & want.keys())


def test_only_probed_partitions_are_scanned(spark, asked, stored):
    one = asked.filter("query_id = 100")
    found = L.search(spark, one, stored, 5, probes=2)
    assert len(found.lists_read) == 2 and found.hits.count() == 5
    plan = found.hits._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list_id" in plan.split("PartitionFilters")[1][:200]


def test_all_probes_and_candidates_are_exact(spark, chunks, asked, stored):
    found = L.search(spark, asked, stored, 20, probes=24, oversample=200)
    assert {(r.query_id, r.chunk_id) for r in found.hits.collect()} == set(exact(asked, chunks))


def test_large_lists_come_in_parts(spark, asked, stored, monkeypatch):
    whole = sorted(map(tuple, L.search(spark, asked, stored, 5, probes=6, oversample=400).hits.collect()))
    monkeypatch.setattr(L, "PART_ROWS", 17)
    assert sorted(map(tuple, L.search(spark, asked, stored, 5, probes=6, oversample=400).hits.collect())) == whole


def test_nothing_stored_or_asked(spark, chunks, asked, stored, tmp_path):
    empty = L.build(chunks.limit(0), str(tmp_path / "none"))
    assert L.search(spark, asked, empty).hits.collect() == []
    assert L.search(spark, asked.limit(0), stored).hits.collect() == []
