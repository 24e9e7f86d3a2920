"""Graph operators on rows the registered queries do not reach."""

import random

import pytest
from pyspark.sql import functions as F

from clausegrid.operators import graph as G
from clausegrid.operators import replies as L
from clausegrid.operators.entities import ATTRS


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_supersedes_equals_brute_force(spark, block):
    rng = random.Random(8)
    rows = [(i, rng.choice("AB"), rng.choice(["v1", "v2", "v3"])) for i in rng.sample(range(100), 40)]
    df = spark.createDataFrame(rows, "document_id long, title string, version string")
    pairs = {(n, o) for n, t, v in rows for o, u, w in rows if t == u and v != w and o < n}
    got = {r.new_id: (r.old_id, r.n_superseded) for r in G.supersedes(df, block).collect()}
    want = {}
    for n, o in pairs:
        best, count = want.get(n, (-1, 0))
        want[n] = (max(best, o), count + 1)
    assert got == want
    assert {(r.new_id, r.old_id) for r in G.superseded_by(df, df).collect()} == pairs


def test_approvals_without_policy_use_the_general_process(spark):
    e = spark.createDataFrame(
        [("e1", "approval", "x", 1, (None, None, "cfo", None, None, None)), ("e2", "Approval", "Authority: lead approval", 2, (None,) * 6),
         ("e3", "approval", "x", 9, (None, None, "head-of", None, None, None))],
        f"entity_id string, type string, name string, document_id long, attrs {ATTRS}")
    docs = spark.createDataFrame([(1, 1, "Travel policy", None, ""), (2, 2, "Policy", "v3", None)],
                                 "document_id long, ord long, title string, version string, status string")
    policies = G.policy_nodes(docs)
    assert [tuple(r) for r in policies.select("version", "status", "process_name").orderBy("document_id").collect()] == [
        ("v1", "active", "Travel"), ("v3", "active", "Policy")]
    found = G.approvals(e)
    assert sorted(r.name for r in G.role_nodes(found).collect()) == ["Cfo", "Head-Of", "Lead"]
    assert sorted(tuple(r) for r in G.can_approve(found, policies).collect()) == [("Cfo", "Travel"), ("Lead", "Policy")]
    general = policies.unionByName(policies.limit(1).withColumns({"document_id": F.lit(5).cast("long"), "process_name": F.lit("General Compliance")}))
    assert ("Head-Of", "General Compliance") in {tuple(r) for r in G.can_approve(found, general).collect()}


REPLY = [
    ('{"role": "cto", "threshold": [{"amount": "5.5"}], "regulation": " gdpr "}', ("Cto", None, "GDPR", 5.5, "USD", False)),
    ('{"role": [], "process": {"b": "second letter", "a": 1}}', (None, "Second Letter", None, None, None, False)),
    ('{"role": "x", "threshold": [{"amount": "lots"}]}', ("X", None, None, None, None, True)),
    ('{"role": "x"} trailing {"role": "y"}', (None, None, None, None, None, False)),
    ("no json", (None, None, None, None, None, False)),
]


@pytest.mark.parametrize("reply,want", REPLY)
def test_reply_fields(spark, reply, want):
    df = spark.createDataFrame([(1, reply)], "clause_id long, reply string")
    r = L.entity_fields(df).first()
    assert (r.role, r.process, r.regulation, r.amount, r.currency, r.bad_amount) == want


def test_plain_dict_thresholds_only_when_asked(spark):
    df = spark.createDataFrame([(1, '{"role": "x", "threshold": {"amount": 9, "currency": "EUR"}}')], "clause_id long, reply string")
    assert L.entity_fields(df).first().amount is None
    assert L.entity_fields(df, accept_dict=True).first().amount == 9.0


def test_bad_amount_stops_later_edges(spark):
    df = spark.createDataFrame([(1, 7, '{"role": "x", "threshold": [{"amount": null}], "regulation": "sox"}'), (2, 7, '{"regulation": "sox"}')],
                               "clause_id long, document_id long, reply string")
    clauses = spark.createDataFrame([(1, 7, "a clause of some length"), (2, 7, "short")], "clause_id long, document_id long, text string")
    facts = G.usable_facts(L.entity_fields(df), clauses)
    assert [r.type for r in G.reply_edges(facts).collect()] == ["CAN_APPROVE"]
    policies = spark.createDataFrame([(7,)], "document_id long")
    assert G.maps_to(facts, policies).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_conflict_candidates_do_not_depend_on_blocks(spark, block):
    rng = random.Random(4)
    rows = [(d, o, d * 100 + o, rng.choice(["1 > a", "2", "1"]), "t" * rng.choice([40, 60])) for d in range(3) for o in range(15)]
    df = spark.createDataFrame(rows, "document_id long, ord long, clause_id long, section_path string, text string")
    got = sorted((r.clause_a, r.clause_b) for r in G.conflict_candidates(df, block).collect())
    want = []
    for d in range(3):
        long = [r for r in rows if r[0] == d and len(r[4]) > 50]
        for i, a in enumerate(long):
            want += [(a[2], b[2]) for b in long[i + 1:i + 5] if a[3].split(">")[0] == b[3].split(">")[0]]
    assert got == sorted(want)


def test_supersedes_of_text_ids(spark):
    rows = [("d", "T", "v1"), ("a", "T", "v1"), ("c", "T", "v2"), ("b", "T", "v1"), ("x", "U", "v1")]
    df = spark.createDataFrame(rows, "document_id string, title string, version string")
    got = {(r.new_id, r.old_id, r.n_superseded) for r in G.supersedes(df, 2).collect()}
    assert got == {("c", "b", 2), ("d", "c", 1)}


@pytest.mark.parametrize("value, want", [
    ('"false"', "false"), ('"0"', "0"), ('""', None), ("false", None), ("0.0", None), ("0", None), ("null", None), ("[]", None), ("{}", None), ("1.5", "1.5"), ("true", "true"),
    ('["a", "b"]', "a"), ("[0]", None), ('["0"]', "0"), ('{"k": "v", "l": "w"}', "v"), ('{"k": 0.0}', None), ('{"k": "false"}', "false"),
])
def test_falsy_reply_values_go_by_their_type(spark, value, want):
    df = spark.createDataFrame([(1, 2, f'Sure: {{"role": {value}}}')], "clause_id long, document_id long, reply string")
    parsed = L.parse_entity_replies(df)
    assert parsed.select(L.first_value("role").alias("v")).first().v == want


def test_pairs_are_those_of_the_candidates(spark):
    rows = [(d, i, d * 100 + i, f"{i % 3} > a", ("x" * (40 + i * 7 % 30))) for d in range(3) for i in range(20)]
    clauses = spark.createDataFrame(rows, "document_id long, ord long, clause_id long, section_path string, text string")
    want = sorted((r.clause_a, r.clause_b) for r in G.conflict_candidates(clauses, 4).collect())
    assert sorted(map(tuple, G.conflict_pairs(clauses, 4).collect())) == want and want


def test_edge_counts_tell_shared_types_apart(spark):
    rows = [("GOVERNS", "Clause", "1", "Process", "p")] * 3 + [("GOVERNS", "Clause", "2", "Process", "p"), ("PART_OF", "Clause", "1", "Policy", "9"), ("PART_OF", "Clause", "2", "Policy", "9")]
    edges = spark.createDataFrame(rows, "type string, src_label string, src string, dst_label string, dst string").repartition(3)
    counts = G.summary(G.edge_counts(edges, ["GOVERNS"]), "type", "k").collect()
    assert {r.type: r.n for r in counts} == {None: 4, "GOVERNS": 2, "PART_OF": 2}


def test_staged_first_values_equal_the_expression(spark):
    replies = ['{"role": ["a", "b"]}', '{"role": {"x": "c", "y": 1}}', '{"role": 0}', '{"role": ""}', '{"role": [[]]}', '{"role": false}', '{"role": 12}', '{"role": [null]}', '{}', 'no', '{"role": [{"k": 1}]}', '{"role": {}}']
    parsed = L.parse_entity_replies(spark.createDataFrame([(r,) for r in replies], "reply string"))
    staged = L.first_values(parsed, ["role"])
    assert [r.v for r in staged.select(F.col("_first_role").alias("v")).collect()] == [r.v for r in parsed.select(L.first_value("role").alias("v")).collect()]
    # One generator after the other: the variant of a field is taken once.
    assert staged._jdf.queryExecution().optimizedPlan().toString().count("Generate") >= 6


def test_obligations_need_no_other_field(spark):
    values = ['"mandatory"', '["optional", "x"]', '{"a": "b"}', '[{"a": "b"}]', "5", "true", "null", "[]", '""', "[[1]]"]
    replies = spark.createDataFrame([(i, f'So: {{"role": "r", "obligation": {v}}} end') for i, v in enumerate(values)] + [(90, "none"), (91, '{"obligation": "x"'), (92, None)],
                                    "clause_id long, reply string")
    want = {r.clause_id: r.obligation for r in L.entity_fields(replies).collect()}
    found = L.reply_obligations(replies)
    assert {r.clause_id: r.obligation for r in found.collect()} == want and found.columns == ["clause_id", "reply", "obligation"]
    assert "_first_role" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_pairs_of_given_clauses(spark):
    rows = [(d, i, d * 100 + i, f"{i % 3} > a", ("x" * (40 + i * 7 % 30))) for d in range(3) for i in range(20)]
    clauses = spark.createDataFrame(rows, "document_id long, ord long, clause_id long, section_path string, text string")
    some = {3, 104, 219, 999}
    want = sorted(tuple(r) for r in G.conflict_pairs(clauses, 4).collect() if r.clause_a in some)
    of = spark.createDataFrame([(i,) for i in some], "clause_id long")
    assert sorted(map(tuple, G.conflict_pairs(clauses, 4, of).collect())) == want and want
