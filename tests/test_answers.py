"""Intents, amounts, risk, verification, confidence, chat, feedback, sinks."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from clausegrid.functions.text import title_case
from clausegrid.operators import answers as A
from clausegrid.operators import browse as B
from clausegrid.operators import questions as P
from clausegrid.sources import tables as T


def value(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("x")).first().x


@pytest.mark.parametrize("question,want", [
    ("Who approves and is it a violation?", ("approval", 0.9)), ("How to reset", ("procedure", 0.8)), ("hello", ("general", 0.6))])
def test_intent(spark, question, want):
    assert tuple(value(spark, P.classify(F.col("t")), question)) == want


@pytest.mark.parametrize("question,want", [
    ("over $1,250.50 on travel", 1250.5), ("300 dollars", 300.0), ("amount of ,", None), ("exceed 40", 40.0), ("nothing", None)])
def test_amount(spark, question, want):
    assert value(spark, P.amount_of(F.col("t")), question) == want


@pytest.mark.parametrize("verdict,mandatory,want", [("clear", 3, "medium"), ("clear", 2, "low"), ("violation", 0, "high")])
def test_risk(spark, verdict, mandatory, want):
    assert value(spark, P.risk_level(F.col("t"), F.lit(mandatory)), verdict) == want


@pytest.mark.parametrize("text,want", [("head-of it's 3rd iT", "Head-Of It'S 3Rd It"), ("ÉCOLE", "École")])
def test_title_case(spark, text, want):
    assert value(spark, title_case(F.col("t")), text) == want


def judged(spark, answer, n_hits, strict=False):
    q = spark.createDataFrame([(1,)], "query_id long")
    a = spark.createDataFrame([(1, answer)], "query_id long, answer string")
    h = spark.createDataFrame([(1, i + 1, "T1", f"{i + 1} A > Rule 1", 0.8 - i / 10) for i in range(n_hits)],
                              "query_id long, rank long, title string, clause_ref string, score double")
    return A.judge_answers(q, a, h, strict).first()


def test_verification_and_confidence(spark):
    r = judged(spark, "x [Doc: T1, Clause: 1 A > Rule 1] y [Doc: T1, Clause: 9]", 3)
    assert (r.is_valid, r.message, r.verdict, r.confidence, r.abstained) == (False, "Invalid citation found: T1 9", "abstained", 70.1, False)
    assert judged(spark, "Insufficient policy basis", 2).confidence == 79.3
    plain = judged(spark, "no citation", 2)
    assert plain.is_valid and plain.verdict == "clear"
    assert judged(spark, "no citation", 2, strict=True).verdict == "abstained"
    none = judged(spark, "x", 0)
    assert (none.verdict, none.confidence, none.abstained, none.state) == ("abstained", 0.0, True, "abstained")


def test_roles_repeat_per_record_when_asked(spark):
    records = P.approval_records(spark.createDataFrame([("B", "Purchase x"), ("A", "purchase"), ("B", "My Purchase")], "role string, process string"))
    q = spark.createDataFrame([(1, "Purchase", 5.0, "a"), (2, None, None, None)], "query_id long, process string, amount double, role string")
    got = {r.query_id: r for r in P.resolve_approvals(q, records, repeat_roles=True).collect()}
    assert got[1].answer_text == "Approval authority for 'Purchase': A, B, B; Requested amount: $5.00" and got[1].user_can_approve
    assert got[2].error and got[2].answer_text is None
    assert {r.query_id: r.roles for r in P.resolve_approvals(q, records, repeat_roles=False).collect()}[1] == ["A", "B"]


@pytest.mark.parametrize("block", [1, 1000])
def test_chat_history(spark, block):
    turns = spark.createDataFrame([(1, i, f"q{i}", f"a{i}") for i in range(1, 8)], "conversation_id long, ord long, question string, answer string")
    got = {r.ord: r.full_question for r in A.chat_questions(turns, block_rows=block).collect()}
    assert got[1] == "q1"
    assert got[7] == "Conversation History:\n" + "\n".join(f"User: q{i}\nAssistant: a{i}" for i in range(2, 7)) + "\n\nQuestion: q7"


def test_feedback(spark):
    f = spark.createDataFrame([(1, 5), (1, 6), (2, 3), (1, None)], "answer_id long, rating int")
    good, bad = B.submit_feedback(f, spark.createDataFrame([(1,)], "answer_id long"))
    assert [tuple(r) for r in good.collect()] == [(1, 5)]
    assert sorted(r.reason for r in bad.collect()) == ["answer not found", "rating out of range", "rating out of range"]


def test_large_documents_go_on_in_parts(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, title string")
    chunks = spark.createDataFrame([(1, i, i, str(i % 3), f"r{i}", "t", 1) for i in range(10)],
                                   "document_id long, chunk_id long, ord long, section_path string, clause_ref string, text string, token_count int")
    ents = spark.createDataFrame([(1, "e", "t", "n", 0)], "document_id long, entity_id string, type string, name string, ord long")
    rows = B.document_detail(docs, chunks, ents, part_span=4).orderBy("document_id", "kind", "section", "part").collect()
    assert [(r.document_id, r.kind, r.section, r.part, [c.chunk_id for c in r.chunks or []]) for r in rows] == [
        (1, "chunks", "0", 0, [0, 3]), (1, "chunks", "0", 1, [6]), (1, "chunks", "0", 2, [9]), (1, "chunks", "1", 0, [1]), (1, "chunks", "1", 1, [4, 7]),
        (1, "chunks", "2", 0, [2]), (1, "chunks", "2", 1, [5]), (1, "chunks", "2", 2, [8]), (1, "entities", "t", 0, []), (2, None, None, None, [])]
    assert rows[8].entities[0].entity_id == "e"


def test_sinks(spark, tmp_path):
    folder = str(tmp_path)
    chunks = spark.createDataFrame([(1, "a"), (2, "b")], "document_id long, text string")
    rejected = spark.createDataFrame([(2,)], "document_id long")
    for _ in range(2):
        T.append_whole_documents(chunks, chunks, rejected, folder, "b1")
    chunks.write.parquet(f"{folder}/chunks/batch=b2")  # broke off before its mark
    assert [tuple(r) for r in T.published(spark, folder, "chunks").collect()] == [(1, "a")]
    T.rebuild(chunks, f"{folder}/rebuilt")
    T.rebuild(chunks, f"{folder}/rebuilt")
    assert spark.read.parquet(f"{folder}/rebuilt").count() == 2
    for name, columns in T.GRAPH_COLUMNS.items():
        T.rebuild(spark.createDataFrame([tuple("x" for _ in columns) + ("extra",)], [*columns, "more"]), f"{folder}/graph/{name}")
    assert T.load_for_graph(spark, f"{folder}/graph")["documents"].columns == T.GRAPH_COLUMNS["documents"]


def test_upsert_last_write_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    new = spark.createDataFrame([("a", 7, 2), ("a", 8, 1), ("c", 9, 0)], "name string, v int, seq long")
    assert sorted(tuple(r) for r in T.upsert(old, new, ["name"], "seq").collect()) == [("a", 7), ("b", 2), ("c", 9)]


def test_citations_meet_the_hits_within_one_row(spark):
    q = spark.createDataFrame([(i,) for i in range(1, 6)], "query_id long")
    one, other, bare = "[Doc: T, Clause: 1]", "[Doc: U, Clause: 2]", "[Doc: V, Clause: N/A]"
    a = spark.createDataFrame([(1, f"{one} {one} {bare}"), (2, f"{one} {other} {bare}"), (3, one), (4, None)], "query_id long, answer string")
    h = spark.createDataFrame([(i, 1, "T", "1", 0.5) for i in (1, 4, 5)] + [(1, 2, "V", None, 0.4), (2, 1, None, "2", 0.9), (2, 2, "T", "1", 0.3)],
                              "query_id long, rank long, title string, clause_ref string, score double")
    out = A.judge_answers(q, a, h)
    got = {r.query_id: (r.is_valid, r.message, r.verdict, r.state, r.error) for r in out.collect()}
    none = "No relevant policy clauses found"
    assert got == {1: (True, "All citations verified.", "clear", "done", None), 2: (False, "Invalid citation found: U 2", "abstained", "done", None),
                   3: (None, None, "abstained", "abstained", none), 4: (None, None, "abstained", "abstained", None), 5: (None, None, "abstained", "abstained", None)}
    checked = {(r.query_id, r.pos): r.valid for r in A.checked_citations(a, h).collect()}
    assert checked == {(1, 0): True, (1, 1): True, (1, 2): True, (2, 0): True, (2, 1): False, (2, 2): False, (3, 0): False}
    # The hits are grouped once and joined once: (title, reference) is no key of a join or a shuffle.
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") == 2


def test_a_question_is_classified_once(spark):
    q = spark.createDataFrame([(1, "Who can APPROVE?"), (2, "a conflict"), (3, None), (4, "hello"), (5, "Who can approve this")], "query_id long, question string")
    known = P.classified(q)
    assert [tuple(r) for r in known.orderBy("query_id").select("query_id", "intent", "intent_confidence").collect()] == [
        tuple(r) for r in q.orderBy("query_id").select("query_id", P.classify(F.col("question")).alias("i")).select("query_id", "i.*").collect()]
    hits = spark.createDataFrame([(1, 7, "approval"), (2, 8, "conflict")], "query_id long, chunk_id long, intent string")
    mine, met = P.routed(known, hits, "approval")
    assert [r.query_id for r in mine.collect()] == [1] and [tuple(r) for r in met.collect()] == [(1, 7)]
    # The text is not read again by the filter of the step.
    assert mine._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1


def test_risk_levels_are_those_of_the_assessment(spark):
    q = spark.createDataFrame([(1, "violation"), (2, "conditional"), (3, "clear"), (4, "clear")], "query_id long, risk_verdict string")
    h = spark.createDataFrame([(i, c, 9) for i in range(1, 5) for c in range(i)], "query_id long, chunk_id long, document_id long")
    duty = spark.createDataFrame([(c, "mandatory" if c != 1 else "optional") for c in range(4)], "clause_id long, obligation string")
    edges = spark.createDataFrame([("MAPS_TO", "9", "GDPR")], "type string, src string, dst string")
    whole = {r.query_id: r.risk_level for r in P.assess_risk(q, h, edges, duty).collect()}
    assert {r.query_id: r.risk_level for r in P.risk_levels(q, h, duty).collect()} == whole == {1: "high", 2: "medium", 3: "low", 4: "medium"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="given tables are not here")
def test_answered_questions_reads_no_question_twice(spark):
    plan = entry.queries()["answered_questions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    # The keywords of the intents, in the filter of each step before, are gone with the stored questions.
    assert "who can approve" not in plan


def test_hits_without_texts_give_the_same_pairs_and_processes(spark):
    texts = ["Approval " + "x" * 60, "y" * 49, None, "z" * 50, "approve" * 90, "w" * 70, "v" * 400]
    rows = [(q, r + 1, 10 * q + r, texts[(q + r) % 7]) for q in range(1, 9) for r in range(q)]
    whole = spark.createDataFrame(rows, "query_id long, rank long, chunk_id long, text string")
    bare = whole.select("query_id", "rank", "chunk_id", P.tells_approval(F.col("text")).alias("tells"), F.length(F.coalesce("text", F.lit(""))).alias("n_chars"))
    for limit, cut in ((5, 400), (3, 40)):
        want = sorted((r.query_id, r.clause_a, r.clause_b) for r in P.judge_pairs(whole, cut=cut, limit=limit).collect())
        assert sorted(map(tuple, P.pairs_judged_before(bare, cut=cut, limit=limit).collect())) == want and bool(want) == (cut == 400)
    asked = spark.createDataFrame([(q, "a travel over $5" if q == 3 else "what then") for q in range(1, 10)], "query_id long, question string")
    want = sorted(map(tuple, P.wanted_processes(asked, whole).collect()), key=str)
    assert sorted(map(tuple, P.wanted_processes(asked, bare).collect()), key=str) == want
    assert {r[2] for r in want} > {None, "Approval"}
