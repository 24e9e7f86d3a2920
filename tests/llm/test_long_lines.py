"""Long lines of the pipeline, where one source holds a third of the rows."""

import random

import corpus_pipeline
from clausegrid.llm import line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_long_lines_need_few_sites(spark):
    rng = random.Random(4)
    longs = {s: " ".join(f"w{rng.randrange(999)}" for _ in range(line_dedup.LONG_WORDS)) for s in range(3, 13)}
    rows, want = [], {}
    for spread, passage in longs.items():
        for kind, line in (("long", passage), ("short", passage.rsplit(" ", 1)[0])):  # one word below the bound
            least = line_dedup.LONG_SITES if kind == "long" else line_dedup.MIN_SITES
            ids = [len(rows) + i for i in range(18)]
            for i, doc in enumerate(ids):
                site = "hot" if i < 6 else f"s{i % (spread - 1)}"
                rows.append((doc, f"own {doc} text\n{line}", "en", site, 1))
            want[(spread, kind)] = 17 if spread >= least else 0
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()}
    got = {key: sum("\n" not in kept[k * 18 + i] for i in range(18)) for k, key in enumerate(want)}
    assert len(kept) == len(rows) and got == want
    # Without the lower threshold, as in op5 and its SQL, all lines are alike.
    plain = {r.doc_id: r.text for r in line_dedup.remove_lines(docs).collect()}
    assert {key: sum("\n" not in plain[k * 18 + i] for i in range(18)) for k, key in enumerate(want)} == {
        (spread, kind): 17 if spread >= line_dedup.MIN_SITES else 0 for spread, kind in want}
