"""Rows that ids and texts do not tell apart."""

import collections
import random

from pyspark.sql import functions as F

from clausegrid.llm import jaccard


def test_one_row_of_each_component(spark):
    rng = random.Random(6)
    text = {k: " ".join(f"w{rng.randrange(999)}" for _ in range(60)) for k in "abcdef"}
    near = text["f"] + " tail"
    rows = (
        [(1, text["a"])] * 5  # a document ingested five times
        + [(None, text["b"])] * 4  # equal texts without an id
        + [(2, text["c"]), (2, text["c"]), (3, text["c"]), (None, text["c"])]
        + [(4, text["d"])]
        + [(5, text["e"]), (5, text["a"])]
        + [(None, text["f"])] * 2 + [(None, near)] * 2
        + [(6, ""), (6, ""), (7, None), (None, None)]  # no shingles: all stay
    )
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("place", F.create_map(F.lit("x"), F.lit(1)))
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in kept.collect())
    one_of_f = [k for k in got if k[1] in (text["f"], near)]
    assert len(one_of_f) == 1 and got.pop(one_of_f[0]) == 1
    assert got == {(1, text["a"]): 1, (None, text["b"]): 1, (2, text["c"]): 1, (4, text["d"]): 1, (5, text["e"]): 1, (6, ""): 2, (7, None): 1, (None, None): 1}


def test_the_row_that_stays_does_not_depend_on_the_order(spark):
    rows = [(1, "one two three four five six seven eight nine ten " * 3, f"s{i}") for i in range(20)]
    kept = [jaccard.keep_one(spark.createDataFrame(r, "doc_id long, text string, source string").repartition(n)).collect()
            for r, n in ((rows, 3), (rows[::-1], 5))]
    assert kept[0] == kept[1] and len(kept[0]) == 1
