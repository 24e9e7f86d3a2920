"""The pipeline and each of its stages beside brute force on a small folder of tables."""

import collections
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from clausegrid.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sentence(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnoprstu", k=rng.randrange(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    where = str(tmp_path_factory.mktemp("tables"))
    rows = []
    footer, passage = "Read our terms and more of it here", sentence(rng, 60)
    for i in range(60):
        lines = [sentence(rng, rng.randrange(12, 30)) for _ in range(rng.randrange(2, 6))]
        if i % 3 == 0:
            lines.insert(1, footer)
        if i % 7 == 0:
            lines.append(passage)
        rows.append((i, "\n".join(lines), "en", f"site{i % 25}"))
    copy = rows[5][1]
    rows += [(100, copy, "en", "site1"), (101, copy.replace(copy.split()[0], "Changed", 1), "en", "site2"), (102, copy.upper(), "en", "site3"), (100, copy, "en", "site1")]
    test = [sentence(rng, 30), sentence(rng, 25)]
    rows += [(110, sentence(rng, 40) + " " + test[0] + " " + sentence(rng, 20), "en", "site4"), (111, sentence(rng, 40) + " " + test[1].replace("a", "x", 2), "en", "site4")]
    rows += [(120, "$$$ ### " * 40, "en", "site5"), (121, "same words again and " * 30, "en", "site5"), (122, "short", "en", "site6"), (123, None, None, None), (124, "", "en", None), (None, sentence(rng, 50), "en", "site7")]
    rows += [(130 + i, "\n".join(["BUY $$$ NOW ### " + str(rng.random())] * 1 + [f"||| {rng.random()} $$$ ### &&& {rng.random()}" for _ in range(12)]), "en", "site8") for i in range(12)]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA).repartition(3).write.parquet(f"{where}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(130 + i, 0, 0) for i in range(0, 12, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate([*test, None, "", "tiny"])], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows after each stage, each over what the one before it kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [("documents", docs.collect())]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, folder), name)
        out.append((name, docs.collect()))
    return out


def as_rows(rows):
    return collections.Counter(map(tuple, rows))


def test_columns_and_names(stages):
    assert [n for n, _ in stages[1:]] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "best_fit_packing"]
    for _, rows in stages[1:-1]:
        assert rows[0].__fields__ == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def test_quality_stage(spark, folder, stages):
    docs, kept = stages[0][1], stages[1][1]
    field = quality_rules.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    want = []
    for r in docs:
        words = WORD.findall(r.text or "")
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count, covered = collections.Counter(grams), set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                covered.update(range(i, i + 5))
        if len(words) < 10 or 100 * len(covered) > 20 * len(words):
            continue
        lines = (r.text or "").encode().split(b"\n")
        marks = best_labels(field, quality_rules.line_features(lines))
        sizes = [len(line.split()) for line in lines]
        if sum(n for n, y in zip(sizes, marks) if y) >= quality_rules.MIN_CONTENT_SHARE * sum(sizes):
            want.append(r)
    assert as_rows(kept) == as_rows(want)
    ids = {r.doc_id for r in kept}
    assert set(range(60)) <= ids and not ids & {120, 121, 122, 123, 124, *range(130, 142)}


def best_labels(field, features):
    """The best sequence by plain dynamic programming over both labels, with whole sequences."""
    emit = features @ field.emit
    best = {y: (emit[0][y], [y]) for y in (0, 1)}
    for e in emit[1:]:
        best = {y: max(((s + field.step[p][y] + e[y], seq + [y]) for p, (s, seq) in best.items()), key=lambda x: x[0]) for y in (0, 1)}
    return max(best.values(), key=lambda x: x[0])[1]


def test_line_stage(stages):
    docs, kept = stages[1][1], stages[2][1]
    sites, first = collections.defaultdict(set), {}
    order = lambda r: (r.doc_id is None, r.doc_id or 0)
    for r in docs:
        for line in r.text.split("\n"):
            if WORD.search(line):
                sites[line].add(r.source)
                first[line] = min(first.get(line, (True, 0)), order(r))
    want = []
    for r in docs:
        lost = [WORD.search(x) and len(sites[x]) >= (5 if len(WORD.findall(x)) >= 50 else 10) and first[x] != order(r) for x in r.text.split("\n")]
        text = "\n".join(x for x, gone in zip(r.text.split("\n"), lost) if not gone)
        if not any(lost) or WORD.search(text):
            want.append((r.doc_id, text, r.lang, r.source, len(text) if any(lost) else r.n_chars))
    assert as_rows(kept) == collections.Counter(want) and as_rows(kept) != as_rows(docs)


def shingles(text):
    words = WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def test_near_duplicate_stage(stages):
    docs, kept = stages[2][1], stages[3][1]
    sets, group = [shingles(r.text) for r in docs], list(range(len(docs)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                group[top(i)] = top(j)
    groups = collections.defaultdict(list)
    for i, r in enumerate(docs):
        groups[top(i)].append(r)
    assert len(kept) == len(groups) < len(docs)
    left = as_rows(kept)
    for members in groups.values():
        ids = [r.doc_id for r in members if r.doc_id is not None]
        held = [r for r in members if left[tuple(r)]]
        assert held and (not ids or held[0].doc_id == min(ids))


def edits_inside(m, text):
    row = list(range(len(m) + 1))
    best = row[-1]
    for c in text:
        above, row[0] = row[0], 0
        for i in range(1, len(m) + 1):
            above, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, above + (m[i - 1] != c))
        best = min(best, row[-1])
    return best


def test_benchmark_stage(spark, folder, stages):
    passages = [" ".join(r.text.lower().split()).encode() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if r.text]
    passages = [p for p in passages if len(p) >= 8]
    docs, kept = stages[3][1], stages[4][1]
    hit = {r.doc_id for r in docs if any(edits_inside(p, " ".join(r.text.lower().split()).encode()) <= 0.08 * len(p) for p in passages)}
    assert {110, 111} <= hit
    assert as_rows(kept) == as_rows([r for r in docs if r.doc_id not in hit])


def test_packing_stage(stages):
    docs, pieces = stages[4][1], stages[5][1]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in docs:
        ids = np.array([*tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4")
        assert len(ids) <= 1024
        want[(r.doc_id, 0, 0, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert collections.Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    filled = collections.defaultdict(list)
    for p in pieces:
        filled[p.sequence_id].append((p.offset, p.length))
    total = sum(p.length for p in pieces)
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(filled) <= total // 1024 + 2


def test_run_is_its_stages(spark, folder, stages):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert as_rows(corpus_pipeline.run(spark, folder).select(*columns).collect()) == collections.Counter(tuple(p[c] for c in columns) for p in stages[-1][1])


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_no_labels_and_no_benchmark(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ids = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert {110, 111, 130} <= ids and not ids & {121, 122, 123, 124}


def test_a_very_long_run_passes_through(spark, folder, tmp_path):
    rng = random.Random(3)
    text = sentence(rng, 200) + " " * 1_000_000 + sentence(rng, 200)
    spark.createDataFrame([(1, text, "en", "a", len(text)), (2, sentence(rng, 50), "en", "b", 9)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    packed = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r.doc_id: r.n for r in packed.collect()}[1] == len(tokenizer.encode(text, add_special_tokens=False).ids) + 1
