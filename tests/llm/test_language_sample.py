"""The sample of the language fit: distinct texts, bounded, of every labelled language."""

import numpy as np

from clausegrid.llm import languages

SCHEMA = "doc_id long, text string, lang string"


def test_every_language_is_learned_whatever_its_copies(spark):
    texts = {f"l{k:02}": f"{'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10]}uv wxyz" for k in range(30)}
    rows = [(0, text, lang) for lang, text in texts.items() for _ in range(40)]
    model = languages.fit(spark.createDataFrame(rows, SCHEMA), documents=2)
    assert model.names == sorted(texts)


def test_copies_count_once_and_the_bound_holds(spark):
    alone = [(i, f"word{chr(97 + i // 26)}{chr(97 + i % 26)} text", "xx") for i in range(50)]
    one = languages.fit(spark.createDataFrame(alone, SCHEMA), documents=10)
    many = languages.fit(spark.createDataFrame(alone + alone[:1] * 30 + alone[7:8] * 300, SCHEMA), documents=10)
    assert np.array_equal(one.log_p, many.log_p)
    # Ten texts of ten letters: every text has as many trigrams as another.
    share = np.exp(one.log_p[:, 0])
    counts = np.round(share / share.min() * 0.5 - 0.5)
    assert counts.sum() == 10 * len(languages.trigrams(alone[0][1]))
