"""Extraction from lines equals extraction from the joined text."""

import random
import re

import pytest

from clausegrid.functions import fixed
from clausegrid.operators import entities as X

WORDS = ["NGN", "USD", "$", "₦", "1,000", "50", "must", "shall", "marshall", "required", "be", "done.", "within", "every", "30", "days",
         "weeks", "CFO", "cfo", "Head of", "approval", "Consent", ",", "manager", "é", "x", "7.50", "."]


def expected(text):
    out = []
    for m in re.findall(fixed.THRESHOLD, text):
        digits = re.sub(r"[^\d.]", "", m)
        if digits:
            out.append(("threshold", m, float(digits), "NGN" if "NGN" in m or "₦" in m else "USD"))
    out += [("approval", m, None, None) for m in re.findall(fixed.APPROVAL, text, re.I)]
    out += [("deadline", m, None, None) for m in re.findall(fixed.DEADLINE, text, re.I)]
    out += [("requirement", m, None, None) for m in re.findall(fixed.REQUIREMENT, text, re.I)[:5]]
    return out


@pytest.mark.parametrize("block", [2, 1000])
def test_lines_give_what_the_whole_text_gives(spark, block):
    rng = random.Random(17)
    docs = {d: [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 15))] for d in range(60)}
    docs[99] = ["must"] * 9 + ["within", "30", "days", "Head of", "approval", "NGN", "5"]
    rows = [(d, i, t) for d, lines in docs.items() for i, t in enumerate(lines)]
    found = X.extract_entities(spark.createDataFrame(rows, "document_id long, ord long, content string").repartition(3), block_rows=block)
    got = {d: [] for d in docs}
    for r in found.orderBy("seq").collect():
        got[r.document_id].append((r.type, r.attrs.original_text, r.attrs.amount, r.attrs.currency))
    for d, lines in docs.items():
        assert got[d] == expected("\n".join(lines)), lines


def test_fixed_amounts_and_authorities(spark):
    rows = [(1, 0, "NGN 1,000,000 and USD 5.00 , $ , €7"), (1, 1, "Head of approval; cfo Consent.")]
    got = X.extract_entities(spark.createDataFrame(rows, "document_id long, ord long, content string")).orderBy("seq").collect()
    assert [(r.attrs.amount, r.attrs.currency) for r in got if r.type == "threshold"] == [(1000000.0, "NGN"), (5.0, "USD"), (7.0, "USD")]
    assert [r.attrs.authority for r in got if r.type == "approval"] == ["Head", "cfo"]


def test_texts_of_unlinked_lines_are_not_shuffled(spark):
    from clausegrid.operators import entities as X

    rows = [(1, i, "The buyer must") if i == 4 else (1, i, f"pay USD {i} within 3 days.") for i in range(50)]
    sections = spark.createDataFrame(rows + [(None, 7, "must"), (None, 8, "sign")], "document_id long, ord long, content string")
    runs = X.text_runs(sections)
    got = {(r.document_id, r.ord): r.text for r in runs.collect()}
    assert got[1, 4] == "The buyer must\npay USD 5 within 3 days." and (1, 5) not in got and len(got) == 50
    assert got[None, 7] == "must\nsign"
    assert "BroadcastNestedLoopJoin" not in (plan := runs._jdf.queryExecution().executedPlan().toString())
    assert "Window" not in plan
