"""Every registered query beside its check SQL, on the smallest given tables."""

import os

import check
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="given tables are not here")

# Derived inputs whose condition no row of the smallest tables meets.
MAY_BE_EMPTY = {"stored_conflicts", "version_conflicts"}


@pytest.fixture(scope="module")
def con():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_check(spark, con, name):
    problems = check.compare(spark, con, FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    if name in MAY_BE_EMPTY:
        problems = [p for p in problems if p != "no rows"]
    assert problems == []


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "rank", "chunk_id", "document_id", "title", "score"]
