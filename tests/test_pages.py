"""Deep pages beside a sorted list."""

import pytest
from pyspark.sql import functions as F

from clausegrid.operators import pages as P


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("pages"))
    rows = [(i, i * 37 % 1000, f"r{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, ts long, note string").repartition(5)
    P.store_ordered(df, [F.col("ts").desc(), F.col("id").desc()], folder, 60)
    return folder, [r[0] for r in sorted(rows, key=lambda r: (-r[1], -r[0]))]


@pytest.mark.parametrize("offset,limit", [(0, 50), (500, 50), (980, 50), (1000, 10), (5000, 1), (59, 2), (333, 0), (10, 400)])
def test_pages(spark, stored, offset, limit):
    folder, want = stored
    got = P.page(spark, folder, offset, limit).orderBy("place").collect()
    assert [r.id for r in got] == want[offset : offset + limit]
    assert [r.place for r in got] == list(range(offset, offset + len(got)))


def test_a_page_reads_its_files_alone(spark, stored):
    folder, _ = stored
    assert P.total(spark, folder) == 1000
    assert 1 <= len(P.files_of_page(spark, folder, 500, 50)) <= 2
    assert len(P.page(spark, folder, 500, 50).inputFiles()) <= 2 < len(spark.read.parquet(f"{folder}/rows").inputFiles())


def test_an_empty_table(spark, tmp_path):
    P.store_ordered(spark.createDataFrame([], "id long"), [F.col("id")], str(tmp_path))
    assert P.total(spark, str(tmp_path)) == 0 and P.page(spark, str(tmp_path), 0, 5).collect() == []
