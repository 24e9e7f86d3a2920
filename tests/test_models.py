"""Batch models: slices, errors, nulls, and the places that take them."""

import pyarrow as pa
import pytest

from clausegrid.operators import models as M


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, "a" * (i % 7), None if i % 5 == 0 else "b") for i in range(50)], "id long, first string, second string").repartition(3)


def lengths():
    """Made inside a function, so that workers need not import this module."""
    def answer(a, b):
        return pa.array([len(x) + (0 if y is None else 10) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int64())

    return answer


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_answers_in_slices(rows, batch):
    got = M.answered(rows, ["first", "second"], M.Model(lengths(), "long", batch), "n").collect()
    assert {r.id: r.n for r in got} == {i: i % 7 + (0 if i % 5 == 0 else 10) for i in range(50)}
    assert got[0].__fields__ == ["id", "first", "second", "n"]


def test_a_column_of_that_name_is_replaced(rows):
    model = M.Model(lambda a: a, "string")
    got = M.answered(rows, ["second"], model, "first").collect()
    assert all(r.first == r.second for r in got) and got[0].__fields__ == ["id", "second", "first"]


def test_loaded_once_a_task_and_passed_first(rows):
    model = M.Model(lambda state, a: pa.array([state] * len(a), pa.int64()), "long", 4, lambda: 41)
    assert {r.x for r in M.answered(rows, ["first"], model, "x").collect()} == {41}


def test_wrong_number_of_answers(rows):
    with pytest.raises(Exception, match="answers to"):
        M.answered(rows, ["first"], M.Model(lambda a: a[:0], "string"), "x").collect()


def test_names(rows):
    with pytest.raises(ValueError, match="no model"):
        M.answered(rows, ["first"], "unknown", "x")


def test_judged_candidates(spark):
    pairs = spark.createDataFrame([(1, 2, "x", "y"), (1, 3, "x", "no"), (1, 2, "x", "y")], "clause_a long, clause_b long, text_a string, text_b string")
    model = M.Model(lambda a, b: pa.array([None if y == "no" else "YES" for y in b.to_pylist()], pa.string()), "string")
    assert [tuple(r) for r in M.judged_candidates(pairs, model).collect()] == [("CONFLICTS_WITH", "Clause", "1", "Clause", "2")]
    assert M.judged_candidates(pairs.limit(0), model).collect() == []


def test_pairs_are_made_once_for_their_judge(spark):
    from clausegrid.operators import models as M

    pairs = spark.createDataFrame([(1, 1, 5, 6, "a", "b"), (1, 2, 5, 7, "a", "c")], "query_id long, pair_no int, clause_a long, clause_b long, text_a string, text_b string")
    seen = M.judged_pairs(pairs, M.Model(lambda a, b: pa.array(["yes" if x == "c" else "no" for x in b.to_pylist()]), "string"))
    assert [(r.query_id, r.clause_a, r.clause_b, r.source) for r in seen.collect()] == [(1, "5", "7", "model")]
    assert "Join" not in seen._jdf.queryExecution().executedPlan().toString()
