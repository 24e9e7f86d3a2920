"""Headings, numbering, chunking and statistics: fixed rows and sequential scans."""

import random
import re

import pytest
from pyspark.sql import functions as F

from clausegrid.operators import chunking as C
from clausegrid.operators import quality as Q
from clausegrid.operators import structure as S
from clausegrid.sources import lines as L


def value(spark, column, **inputs):
    names = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'string'}" for n, v in inputs.items())
    return spark.createDataFrame([tuple(inputs.values())], names).select(column.alias("x")).first().x


@pytest.mark.parametrize("line,level", [
    ("1. Policy", 2), ("5.2 Network Access", 1), ("POLICY", 1), ("the end.", None), ("Hello world", None), ("1 Scope", 1),
    ("It's Fine", None), ("One Two Three Four Five Six", None), ("1. A.b.c.d.e.f", 5), ("X" * 80, None), ("Éa Ça", 1), ("12 34", None),
])
def test_plain_heading(spark, line, level):
    assert value(spark, S.plain_level(F.col("t")), t=line) == level


@pytest.mark.parametrize("style,level", [("Heading 2", 2), ("Heading", 1), ("Heading 9", 5), ("Normal", None)])
def test_styled_heading(spark, style, level):
    assert value(spark, S.styled_level(F.col("t")), t=style) == level


def marked(spark, rows):
    return spark.createDataFrame(rows, "document_id long, ord long, page int, text string, level int, format string")


@pytest.mark.parametrize("block", [1, 2, 100])
def test_numbers_of_fixed_rows(spark, block):
    levels = [1, 3, None, 2, None, 1, None]
    rows = [(1, i, 1, f"t{i}", l, "docx") for i, l in enumerate(levels)]
    got = S.number_sections(marked(spark, rows), block).orderBy("ord").collect()
    assert [r.section_path for r in got] == ["1", "1.1", "1.1", "1.1", "1.1", "2", "2"]
    assert [len(r.heading_hierarchy) for r in got] == [1, 2, 2, 2, 2, 1, 1]


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_numbers_equal_a_sequential_scan(spark, block):
    rng = random.Random(11)
    rows, want = [], {}
    for doc in range(6):
        counters, stack = [0] * 5, []
        for i, o in enumerate(sorted(rng.sample(range(100), 30))):
            level = rng.choice([None, None, 1, 2, 3, 4, 5])
            rows.append((doc, o, 1, f"d{doc}l{o}", level, "docx" if doc % 2 else "pdf"))
            if level:
                counters = [c if j < level else 0 for j, c in enumerate(counters)]
                counters[level - 1] += 1
                stack = [e for e in stack if e[0] < level] + [(level, f"d{doc}l{o}")]
            if not stack and doc % 2:
                want[doc, o] = ("0", ["Document Header"], 0)
            else:
                want[doc, o] = (".".join(str(c) for c in counters if c), [t for _, t in stack], level or len(stack))
    got = {}
    for r in S.number_sections(marked(spark, rows).repartition(3), block).collect():
        headless = r.section_path == "0"
        got[r.document_id, r.ord] = (r.section_path, r.heading_hierarchy, 0 if headless else r.section_level)
    assert got == want


def test_tables_follow_the_lines(spark):
    lines = spark.createDataFrame([(1, 0, 1, "docx", "Heading 1", "Top"), (1, 1, 1, "docx", "Normal", " a ")],
                                  "document_id long, ord long, page int, format string, style string, text string")
    tables = spark.createDataFrame([(1, 0, [[" x ", "y"], ["z", " "]]), (1, 1, [[" ", ""]]), (2, 0, [["q"]])],
                                   "document_id long, table_no long, rows array<array<string>>")
    got = S.parse_structure(lines, tables).filter("is_table").orderBy("document_id").collect()
    assert [(r.document_id, r.section_path, r.heading_hierarchy, r.content) for r in got if r.document_id == 2] == [(2, "0", ["Document Header"], "q")]
    first = [r for r in got if r.document_id == 1]
    assert [r.content for r in first if r.content.strip(" |\n")] == ["x | y\nz | "]
    assert first[0].section_path == "1" and first[0].heading_hierarchy == ["Top"]


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_full_text_in_parts(spark, span):
    sections = spark.createDataFrame([(1, i, f"l{i}") for i in range(7)], "document_id long, ord long, content string")
    parts = S.full_text(sections, part_span=span).orderBy("part").collect()
    assert [p.part for p in parts] == list(range(-(-7 // span)))
    assert "\n".join(p.text for p in parts) == "\n".join(f"l{i}" for i in range(7))


def test_overlap(spark):
    got = value(spark, C.overlapped(F.col("c")), c=["a b", "c", "d e f g", "h"])
    assert got == ["a b", "a b c", "a b c d e f g", "e f g h"]


def split_by_loop(text, limit, keep=3):
    done, current, size, tail = [], [], 0, ""
    for sentence in re.split(r"(?<=[.!?])\s+", text.strip()):
        own = f"{tail} {sentence}" if tail else sentence
        n = len(own.split())
        if current and size + n > limit:
            done.append(" ".join(current))
            w = current[-1].split()
            tail = " ".join(w[-keep:]) if len(w) > keep else current[-1]
            current, size = [own], n
        else:
            current.append(own)
            size += n
    return done + [" ".join(current)]


def test_split_of_fixed_text(spark):
    got = value(spark, C.split_long(F.col("t"), 10, 3), t="A b c d. E f g h. I j k l. M n o p.")
    assert got == ["A b c d. E f g h.", "I j k l.", "f g h. M n o p."]


def test_split_equals_a_loop(spark):
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("ab ") for _ in range(rng.randint(1, 30))).strip() + rng.choice([".", "!", "?", ",", ".\n"])
                      for _ in range(rng.randint(1, 12))) for _ in range(80)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", C.split_long(F.col("t"), 8, 3).alias("x")).collect():
        assert row.x == split_by_loop(row.t, 8)


SECTION = "document_id long, ord long, section_path string, heading_hierarchy array<string>, content string, is_heading boolean, is_table boolean, page int"


@pytest.mark.parametrize("block", [1, 100])
def test_numbers_skip_one_for_a_split_clause(spark, block):
    rows = [(1, 0, "1", ["A"], "a b c", False, False, 1), (1, 1, "1", ["A"], "A b c d. E f g h. I j k l.", False, False, 1),
            (1, 2, "1", ["A"], "z", False, False, 1), (1, 3, "2", [], "y", False, False, 1), (1, 4, "2", [], "T", True, False, 1)]
    got = C.chunk_sections(spark.createDataFrame(rows, SECTION), max_words=10, block_rows=block).orderBy("ord", "piece").collect()
    assert [r.clause_number for r in got] == [1, 3, 4, 5, 1]
    assert got[0].clause_ref == "1 A > Rule 1" and got[4].clause_ref == "2 Content > Rule 1"


@pytest.mark.parametrize("reply,clauses", [
    ('ok ["a"," ",2," b "] end', ["a", "b"]), ('["a"] and ["b"]', None), ("none", None), ("[1]", None), ('["x",]', None),
    ('```json\n["q",\n"r"]\n```', ["q", "r"]), ("[]", None), (None, None),
])
def test_clause_reply(spark, reply, clauses):
    assert value(spark, C.reply_clauses(F.col("r")), r=reply) == clauses


def test_statistics_of_nothing_are_zero(spark):
    empty = spark.createDataFrame([], "text string, token_count int, section_path string, clause string")
    assert set(C.chunk_statistics(empty).first()) == {0} and set(C.clause_statistics(empty).first()) == {0}


def test_violations_reject_whole_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "document_id long, title string")
    chunks = spark.createDataFrame([(1, 10, "t", "r"), (1, 11, "t", "r" * 101), (3, 12, "t", None), (9, 13, "t", "r"), (4, 14, None, "r")],
                                   "document_id long, chunk_id long, text string, clause_ref string")
    broken = Q.violations(chunks, docs)
    assert sorted((r.document_id, r.problem) for r in broken.collect()) == [
        (1, "clause_ref too long"), (2, "title is null"), (4, "text is null"), (9, "no such document")]
    accepted, rejected = Q.split_documents(docs, broken)
    assert [r.document_id for r in accepted.collect()] == [3]
    assert sorted(r.document_id for r in rejected.collect()) == [1, 2, 4]


def test_documents_without_text(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "document_id long")
    sections = spark.createDataFrame([(1, "x"), (2, " \n ")], "document_id long, content string")
    kept, empty = L.skip_empty(docs, sections)
    assert [r.document_id for r in kept.collect()] == [1] and sorted(r.document_id for r in empty.collect()) == [2, 3]


def test_texts_are_cut_once(spark):
    lines = spark.createDataFrame([(1, 1, 1, "Normal", "Keep it. " * 30, "docx")], "document_id long, ord long, page int, style string, text string, format string")
    chunks = C.chunk_sections(S.parse_structure(lines), max_words=12)
    # What is left of the plan reads stored pieces and splits no sentence.
    plan = chunks._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan and "(?<=[.!?])" not in plan and chunks.count() > 1
