"""Very long and odd texts, samples by label, the ledger behind op2, and tables of empty texts."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clausegrid.llm import languages, line_dedup, packing, quality_rules, queries, sampling, secrets, tokens, urls, vocab

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(FILE)


@pytest.mark.parametrize("mark", [" ", "\n", "\t", "\x85", "　", "\x1c", "a", "="])
@pytest.mark.parametrize("n", [255, 256, 257, 10_000])
def test_runs_equal_the_library(theirs, mark, n):
    for text in (mark * n, "x" + mark * n + "y", mark * n + "\n", "a  b" + mark * n + " c\n\n" + mark * n):
        assert vocab.load(FILE).ids(text) == theirs.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def long_runs(spark):
    rows = [(i, mark * n + tail) for i, (mark, n, tail) in enumerate([(" ", 1_200_000, "x"), ("\n", 1_000_000, ""), ("a", 1_000_000, " b"), (" ", 3_000_000, "")])]
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_long_runs_in_both_queries(long_runs, theirs):
    rows, docs = long_runs
    want = {k: len(theirs.encode(t, add_special_tokens=False).ids) for k, t in rows}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == want
    packed = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n - 1 for r in packed} == want


def test_empty_texts_fill_more_than_one_group(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    packed = packing.pack(docs, group_bytes=256 * 1024)
    groups = packed.select(F.shiftright("sequence_id", 40).alias("g")).distinct().count()
    assert packed.count() == 5000 and groups >= 3
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 1024


@pytest.mark.parametrize("text", ["½ ²", "① Ⅷ", "12 _ .", "٣", "̈", "", None])
def test_texts_without_a_letter(spark, text):
    model = languages.Languages(["en"], np.zeros((languages.BUCKETS, 1)))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert [tuple(r)[:3] for r in languages.predict(docs, model).collect()] == [(1, "und", 0.0)]
    assert languages.mixture("½ ª", model)


def test_documents_of_many_lines(spark):
    n = 100_000
    shared = [f"shared line {i}" for i in range(n)]
    rows = [(i, f"site{i}", "\n".join(["own", *shared, f"end {i}"])) for i in range(11)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    start = time.time()
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in line_dedup.remove_lines(docs).collect()}
    assert time.time() - start < 120
    assert got[0] == (rows[0][2], 0)
    assert all(got[i] == (f"end {i}", n + 1) for i in range(1, 11))


def test_lost_lines_at_every_place(spark):
    rng = random.Random(8)
    rows = [(i, f"site{i}", "\n".join(rng.choice(["a b", "c d", "own %d" % rng.randrange(999), "", " "]) for _ in range(12))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    sites = {line: {s for _, s, t in rows if line in t.split("\n")} for line in ("a b", "c d")}
    first = {line: min(i for i, _, t in rows if line in t.split("\n")) for line in sites}
    want = {i: "\n".join(x for x in t.split("\n") if not (x in sites and len(sites[x]) >= 10 and first[x] != i)) for i, _, t in rows}
    assert {r.doc_id: r.text for r in line_dedup.remove_lines(docs).collect()} == want


def test_every_line_of_a_labelled_document_teaches(spark):
    """Pages whose junk starts after a long clean head: with the head alone both labels look alike."""
    clean = "A sentence of ordinary words that reads like the text of a page."
    junk = "$$$ ### BUY NOW ||| $$$"
    rows = [(i, "\n".join([clean] * 80 + ([junk] * 80 if i % 2 else [clean] * 80))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)], "doc_id long, quality int")
    field = quality_rules.fit(docs, labels)
    marked = field.viterbi(quality_rules.line_features([junk.encode()] * 20))
    assert not marked.any() and quality_rules.content_share(rows[0][1].encode(), field) == 1.0


def test_long_documents_weigh_as_others():
    rng = np.random.default_rng(1)
    docs = [rng.random((n, quality_rules.N_FEATURES)) for n in (3, 200, 64, 65)]
    marks = np.array([0, 1, 0, 1])
    whole = quality_rules.fit_field(docs, marks, rounds=5)
    again = quality_rules.fit_field([d for d in docs for _ in range(2)], np.repeat(marks, 2), rounds=5)
    assert np.allclose(whole.emit, again.emit) and np.allclose(whole.step, again.step)


def test_rare_labels_stay_in_the_sample(spark):
    rows = spark.range(5000).select(F.col("id").alias("_id"), (F.col("id") == 77).cast("int").alias("_label"))
    marked, share = sampling.sample_by_label(rows, 10)
    labels = [r._label for r in marked.collect()]
    assert sorted(labels) == [0] * 5 + [1] and share == {0: 0.9998, 1: 0.0002}
    weights = sampling.label_weights(np.array(labels), share)
    assert np.isclose(weights.sum(), 6) and np.isclose(weights[labels.index(1)], 6 * 0.0002)


def test_repeated_labelled_ids_are_one_document(spark):
    docs = spark.createDataFrame([(1, "b c"), (1, "a b")] * 50 + [(2, "$$$")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)] * 9, "doc_id long, quality int")
    seen = []
    real = quality_rules.fit_field
    quality_rules.fit_field = lambda d, m, **k: seen.extend(map(len, d)) or real(d, m, **k)
    try:
        quality_rules.fit(docs, labels)
    finally:
        quality_rules.fit_field = real
    assert seen == [1, 1]


def test_rare_blocked_urls_still_grow_trees(spark):
    pages = spark.createDataFrame([(i, f"http://site{i}.fr/p/{i}") for i in range(400)] + [(400, "http://bad.org/es/x")], "page_id long, url string")
    features = urls.lexical(urls.with_parts(pages.select(F.col("url").alias("_url")))).withColumn("label", F.col("_url").contains("bad").cast("int"))
    assert urls.fit(urls.with_suffix_rates(features, features), trees=2, limit=20) is not None


def test_op2_goes_through_the_ledger(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "password = abcdefghijkl1"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = []
    real = secrets.update_ledger
    monkeypatch.setattr(secrets, "update_ledger", lambda *a, **k: asked.append(a) or real(*a, **k))
    got = {r.doc_id: (r.n_assign, r.spans) for r in queries.op2(spark, str(tmp_path)).collect()}
    assert got == {1: (1, "assign:0:24"), 2: (0, "")} and len(asked) == 1
