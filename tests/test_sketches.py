"""Percentiles of calls from merged daily sketches beside exact ranks."""

import random

import pytest
from pyspark.sql import functions as F

from clausegrid.operators import browse as B


@pytest.fixture(scope="module")
def calls(spark):
    rng = random.Random(1)
    rows = [("a", d, rng.random() < 0.7, int(rng.expovariate(0.01))) for d in range(10) for _ in range(900)]
    rows += [("b", 0, None, 5), ("b", 1, True, None), ("c", 3, False, 7)]
    return spark.createDataFrame(rows, "tool string, day int, success boolean, latency_ms long").repartition(4)


def test_ranks_are_within_the_error(calls):
    for days in (10, 3):
        some = calls.filter(F.col("day") < days)
        got = {r.tool: r for r in B.outcomes_of_sketches(B.call_sketches(some)).collect()}
        exact = {r.tool: r for r in B.call_outcomes(some).collect()}
        assert got.keys() == exact.keys()
        for tool, r in got.items():
            assert (r.calls, r.max_ms) == (exact[tool].calls, exact[tool].max_ms)
            assert r.success_rate == pytest.approx(exact[tool].success_rate)
            values = sorted(x.latency_ms for x in some.filter(F.col("tool") == tool).collect() if x.latency_ms is not None)
            for p, v in ((0.5, r.p50_ms), (0.95, r.p95_ms)):
                assert sum(x < v for x in values) / len(values) <= p + B.RANK_ERROR and sum(x <= v for x in values) / len(values) >= p - B.RANK_ERROR


def test_no_calls(calls):
    assert B.outcomes_of_sketches(B.call_sketches(calls.limit(0))).collect() == []


def test_percentiles_are_exact(spark):
    n = 400_000
    ids = spark.range(0, n, 1, 4).select((F.col("id") % 3 == 0).alias("b"), (F.col("id") * 7 % n).alias("latency_ms"))
    rows = ids.select(F.when(F.col("b"), "b").otherwise("a").alias("tool"), "b", "latency_ms").select("tool", F.col("b").alias("success"), "latency_ms")
    more = spark.createDataFrame([(None, True, 3), (None, None, None), (None, False, 300_000), ("c", None, None)], "tool string, success boolean, latency_ms long")
    got = {r.tool: r for r in B.call_outcomes(rows.unionByName(more)).collect()}
    held = {t: sorted(i * 7 % n for i in range(n) if (i % 3 == 0) == (t == "b")) for t in "ab"}
    for tool, values in held.items():
        assert (got[tool].p50_ms, got[tool].p95_ms) == tuple(values[-(-len(values) * p // 100) - 1] for p in (50, 95))
        assert (got[tool].calls, got[tool].max_ms, got[tool].success_rate) == (len(values), values[-1], float(tool == "b"))
    assert tuple(got[None])[1:] == (3, 0.5, 3, 300_000, 300_000) and tuple(got["c"])[1:] == (1, None, None, None, None)
