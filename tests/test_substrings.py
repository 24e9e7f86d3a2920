"""Names in texts and searches by trigrams beside plain comparison."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clausegrid.operators import substrings as U


def test_names_equal_plain_contains(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("abAB %é", k=rng.randrange(12))) for _ in range(300)] + [None, "", "Straße", "ab"] * 3
    names = ["".join(rng.choices("abB é", k=rng.randrange(6))) for _ in range(80)] + [None, "", "never here", "aß", "%"]
    got = U.contained_names(spark.createDataFrame([(n,) for n in names], "wanted string"), spark.createDataFrame([(t,) for t in texts], "process string"), "wanted", "process")
    want = sorted({(n, t) for n in names for t in texts if n is not None and t is not None and n.lower() in t.lower()})
    assert sorted(map(tuple, got.collect())) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_names_and_no_texts(spark):
    none = spark.createDataFrame([], "wanted string")
    some = spark.createDataFrame([("abc",)], "process string")
    assert U.contained_names(none, some, "wanted", "process").collect() == []
    assert U.contained_names(some, none, "process", "wanted").collect() == []


def test_common_grams_are_not_the_ones_that_meet(spark):
    texts = spark.range(2000).select(F.concat(F.lit("approval of "), F.col("id").cast("string")).alias("process"))
    names = spark.createDataFrame([("approval of 777",)], "wanted string")
    assert [tuple(r) for r in U.contained_names(names, texts, "wanted", "process").collect()] == [("approval of 777", "approval of 777")]


@pytest.mark.parametrize("pattern,parts", [("%ceo_approval%", ["ceo", "approval"]), ("", []), ("%%", []), (r"100\%", ["100%"]), (r"a\_b_C", ["a_b", "c"]), ("%x%yz%", ["x", "yz"])])
def test_literal_parts(pattern, parts):
    assert U.literals(pattern) == parts


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(2)
    words = ["CEO approval", "ceo-Approval", "100% sure", "a_b", "Été", "x", "", "plain text"]
    rows = [(i, i % 5, rng.choice([None, "Rule 1", "ceo rule"]), " ".join(rng.choices(words, k=rng.randrange(4)))) for i in range(400)] + [(999, 1, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id int, clause_ref string, text string")
    folder = str(tmp_path_factory.mktemp("trigrams"))
    U.BLOCK_BITS, bits = 4, U.BLOCK_BITS
    U.build_trigrams(chunks, folder, ["clause_ref", "text"])
    U.BLOCK_BITS = bits
    return rows, folder


def like(pattern, text):
    """ILIKE by hand."""
    out, i = "", 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 1
            out += re.escape(pattern[i])
        else:
            out += {"%": "(?s:.*)", "_": "(?s:.)"}.get(pattern[i], re.escape(pattern[i]))
        i += 1
    return text is not None and re.fullmatch(out, text, re.I) is not None


@pytest.mark.parametrize("search", ["ceo_approval", "CEO%sure", "é", "été", "x", "", "%", r"100\%", r"a\_b", "nothing of it", "rule 1", "plain  text"])
def test_searches_equal_ilike(spark, index, search):
    rows, folder = index
    found = U.search_trigrams(spark, folder, search, ["clause_ref", "text"])
    want = [r[0] for r in rows if like(f"%{search}%", r[2]) or like(f"%{search}%", r[3])]
    assert sorted(r.chunk_id for r in found.rows.collect()) == want
    assert (found.candidates is None) == (len(U.needed_grams(f"%{search}%")) == 0)
    if found.candidates is not None:
        assert len(want) <= found.candidates.count() < 400


def test_pages(spark, index):
    rows, folder = index
    found = U.search_trigrams(spark, folder, "ceo", ["text"])
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0])) if like("%ceo%", r[3])]
    got = U.page(found, ["document_id", "chunk_id"], 7, 5).collect()
    assert [r.chunk_id for r in got] == want[5:12] and {r.total for r in got} == {len(want)}


def test_postings_are_made_where_texts_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(U, "BLOCK_BITS", 3)
    rows = [(i, "Abcd é\x00x" if i % 3 else None if i % 2 else "ab") for i in range(40)]
    U.build_trigrams(spark.createDataFrame(rows, "chunk_id long, text string").coalesce(2), str(tmp_path), ["text"])
    posts = spark.read.parquet(f"{tmp_path}/postings")
    # One row per gram and run of a block: a numbering of all chunks by their ids would leave 5 blocks.
    assert posts.groupBy("gram", "field", "_part").count().filter("count > 1").count() == 0
    got = {r.gram: sorted(r.n) for r in posts.groupBy("gram").agg(F.flatten(F.collect_list("nums")).alias("n")).collect()}
    chunks = {r._num: r.text for r in spark.read.parquet(f"{tmp_path}/chunks").collect()}
    text = "abcd é\x00x"
    assert got == {text[i:i + 3]: sorted(n for n, t in chunks.items() if t and len(t) > 2) for i in range(len(text) - 2)}
