"""Blocked scans against plain loops, with blocks far smaller than a key."""

import random

import pytest
from pyspark.sql import functions as F

from clausegrid.operators.ordered import running, with_neighbours


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for key in range(4):
        places = sorted(rng.sample(range(60), [40, 1, 7, 3][key]))
        out += [(key, o, rng.randint(0, 9), rng.choice(["a", "b", None])) for o in places]
    return out


@pytest.mark.parametrize("block", [1, 3, 10, 1000])
def test_running(spark, rows, block):
    df = spark.createDataFrame(rows, "k int, o long, v int, t string").repartition(3)
    got = {(r.k, r.o): (r.s, r.l) for r in running(df, ["k"], "o", sums={"s": F.col("v")}, lasts={"l": F.col("t")}, block_rows=block).collect()}
    want = {}
    for key in range(4):
        total, last = 0, None
        for k, o, v, t in rows:
            if k == key:
                total, last = total + v, t if t is not None else last
                want[k, o] = (total, last)
    assert got == want


@pytest.mark.parametrize("block", [1, 2, 5, 1000])
@pytest.mark.parametrize("before,after", [(0, 4), (5, 0), (1, 1), (2, 3)])
def test_neighbours(spark, rows, block, before, after):
    df = spark.createDataFrame(rows, "k int, o long, v int, t string").repartition(3)
    got = with_neighbours(df, ["k"], "o", ["o"], before, after, block).collect()
    assert len(got) == len(rows)
    for r in got:
        places = [o for k, o, _, _ in rows if k == r.k]
        i = places.index(r.o)
        assert [p.o for p in r.prev] == (places[max(0, i - before):i] if before else [])
        assert [p.o for p in r.next] == (places[i + 1:i + 1 + after] if after else [])


def test_payload_is_moved_once_and_columns_keep_their_order(spark):
    df = spark.createDataFrame([(1, o, "t" * o, o * 10) for o in range(1, 6)], "k long, o long, text string, n long").select("text", "k", "o", "n")
    near = with_neighbours(df, ["k"], "o", ["text", "o"], 1, 1, 2)
    assert near.columns == ["text", "k", "o", "n", "prev", "next"]
    got = [(r.text, r.k, r.o, r.n, [x.o for x in r.prev], [x.text for x in r.next]) for r in near.orderBy("o").collect()]
    assert got == [("t" * o, 1, o, o * 10, [o - 1] if o > 1 else [], ["t" * (o + 1)] if o < 5 else []) for o in range(1, 6)]
    # A text that is payload is not sorted beside the item that holds it.
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Project [" in line and "AS _item#" in line]
    assert windows and not any(line.split("Project [")[1].startswith("text#") for line in windows)
