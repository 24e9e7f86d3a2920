"""Entity, reply and graph queries: policies from `customer`, clauses and replies from `orders`."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.catalog.derived import CLAUSES, POLICIES, REPLIES, Derived
from clausegrid.catalog.registry import query, with_ctes
from clausegrid.functions.stages import materialise, new_folder
from clausegrid.operators import entities as X
from clausegrid.operators import graph as G
from clausegrid.operators import replies as L
from clausegrid.sources import merge as M
from clausegrid.sources import tables as T

W = r"[\p{L}\p{N}_]"
KINDS = "(?:Manager|Director|CFO|CEO|VP|Head of|Lead)"


def sql_all(pattern, group, kind, options=""):
    extract = f"regexp_extract_all(text, '{pattern}', {group}{options})"
    return f"""select document_id, ord, '{kind}' as type, unnest({extract}) as m, generate_subscripts({extract}, 1) - 1 as pos from clauses"""


ENTITIES = CLAUSES.cte + rf""",
found as ({sql_all(r'(?:NGN|USD|EUR|GBP|₦|\$|€|£)\s*[\d,]+(?:\.\d{2})?', 0, 'threshold')}
  union all {sql_all(KINDS + r'\s+(?:approval|authorization|consent)', 0, 'approval', ", 'i'")}
  union all {sql_all(r'(?:every|within|after|before)\s+(\d+)\s+(?:days|weeks|months|hours|minutes)', 1, 'deadline', ", 'i'")}
  union all select * from (select * from ({sql_all(rf'(?:must|required|mandatory|shall)\s+({W}+(?:\s+{W}+)?)', 1, 'requirement', ", 'i'")})
    qualify row_number() over (partition by document_id order by ord, pos) <= 5)),
entities as (select concat(document_id, ':', type, ':', ord, ':', pos) as entity_id, type, document_id, ord, pos,
  concat(case type when 'threshold' then 'Monetary Threshold: ' when 'approval' then 'Approval Authority: '
    when 'deadline' then 'Time Deadline: ' else 'Requirement: ' end, m, case when type = 'deadline' then ' days' else '' end) as name,
  case when type = 'threshold' then cast(regexp_replace(m, '[^\d.]', '', 'g') as double) end as amount,
  case when type = 'threshold' then case when contains(m, 'NGN') or contains(m, '₦') then 'NGN' else 'USD' end end as currency,
  case when type = 'approval' then string_split(m, ' ')[1] end as authority,
  case when type = 'deadline' then cast(m as bigint) end as days,
  case when type = 'requirement' then m end as requirement, m as original_text
  from found where type <> 'threshold' or regexp_matches(m, '\d'))"""

POLICY = POLICIES.cte + r""",
policy as (select document_id, title, coalesce(nullif(version, ''), 'v1') as version, coalesce(nullif(status, ''), 'active') as status,
  coalesce(nullif(trim(regexp_replace(title, '(?i)\s*policy\s*$', '')), ''), title) as process_name from policies)"""


def sql_title(x):
    return (f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), "
            "lambda r: upper(r[1]) || lower(r[2:])), '')")


FACTS = REPLIES.cte + rf""",
found_json as (select *, regexp_extract(reply, '(?s)(\{{.*\}})', 1) as b from replies),
parsed as (select *, case when b <> '' and json_valid(b) then cast(b as json) end as j from found_json),
all_facts as (select clause_id, document_id, b, j,
  {sql_title("case json_type(j->'role') when 'ARRAY' then j->>'$.role[0]' when 'OBJECT' then json_extract_string(j->'role', '$.' || json_keys(j->'role')[1]) else j->>'role' end")} as role,
  {sql_title("j->>'department'")} as department,
  {sql_title("case json_type(j->'process') when 'ARRAY' then j->>'$.process[0]' else j->>'process' end")} as process,
  trim(upper(case json_type(j->'regulation') when 'ARRAY' then j->>'$.regulation[0]' else j->>'regulation' end)) as regulation,
  case json_type(j->'obligation') when 'ARRAY' then j->>'$.obligation[0]' else j->>'obligation' end as obligation,
  case when json_type(j->'threshold') = 'ARRAY' then cast(j->>'$.threshold[0].amount' as double) end as amount,
  case when json_type(j->'threshold') = 'ARRAY' then j->>'$.threshold[0].currency' end as currency
  from parsed),
facts as (select * from all_facts where clause_id in (select {CLAUSES.columns['clause_id']} from orders where length({CLAUSES.columns['text']}) >= 20))"""


def clauses(spark, sf):
    return CLAUSES.df(spark, sf)


def policies(spark, sf):
    return G.policy_nodes(POLICIES.df(spark, sf))


def entities(spark, sf):
    return X.extract_entities(clauses(spark, sf).select("document_id", "ord", F.col("text").alias("content")))


def stored_entities(spark, sf):
    """The entity table as ingestion stores it, for queries that read it more than once."""
    return materialise(entities(spark, sf))


def stored_facts(spark, sf):
    return materialise(facts(spark, sf))


def facts(spark, sf):
    return G.usable_facts(L.entity_fields(REPLIES.df(spark, sf)), clauses(spark, sf))


def obligations_of(spark, sf, of):
    """The obligations in the replies to the clauses ``of (clause_id)``, the only ones parsed."""
    replies = REPLIES.df(spark, sf).join(of, "clause_id", "left_semi")
    return G.obligations(G.usable_facts(L.reply_obligations(replies), clauses(spark, sf)))


ATTRS = ["amount", "currency", "authority", "days", "requirement", "original_text"]


@query("entities", with_ctes(ENTITIES, select=f"select entity_id, type, name, document_id, {', '.join(ATTRS)} from entities"))
def entity_table(spark, sf):
    return entities(spark, sf).select("entity_id", "type", "name", "document_id", *[f"attrs.{a}" for a in ATTRS])


@query("policy_nodes", with_ctes(POLICY, select="select document_id, title, version, status, process_name from policy"))
def policy_nodes(spark, sf):
    return policies(spark, sf).select("document_id", "title", "version", "status", "process_name")


@query("process_nodes", with_ctes(POLICY, select="select process_name as name, max_by(title, document_id) as source_policy from policy group by 1"))
def process_nodes(spark, sf):
    return G.process_nodes(policies(spark, sf))


@query("clause_nodes", with_ctes(CLAUSES.cte, select="""
  select clause_id, document_id, clause_ref, section_path, left(text, 300) as text_ref, coalesce(version, 'v1') as version from clauses"""))
def clause_nodes(spark, sf):
    return G.clause_nodes(clauses(spark, sf))


def edge_sql(kind, src_label, src, dst_label, dst):
    return (f"select distinct '{kind}' as type, '{src_label}' as src_label, cast({src} as varchar) as src, "
            f"'{dst_label}' as dst_label, cast({dst} as varchar) as dst")


CLAUSE_EDGES = (edge_sql("PART_OF", "Clause", "clause_id", "Policy", "document_id") + " from clauses join policy using (document_id) union all "
                + edge_sql("GOVERNS", "Clause", "clause_id", "Process", "process_name") + " from clauses join policy using (document_id)")


@query("clause_edges", with_ctes(CLAUSES.cte, POLICY, select=CLAUSE_EDGES))
def clause_edges(spark, sf):
    return G.clause_edges(clauses(spark, sf), policies(spark, sf))


APPROVERS = f"""approvers as (select distinct {sql_title('authority')} as role, process_name as process
  from entities join policy using (document_id) where type = 'approval')"""


def approvers(spark, sf, found=None):
    return G.can_approve(G.approvals(entities(spark, sf) if found is None else found), policies(spark, sf))


@query("can_approve", with_ctes(ENTITIES, POLICY, APPROVERS, select="select role, process from approvers"))
def can_approve(spark, sf):
    return approvers(spark, sf)


@query("role_nodes", with_ctes(ENTITIES, select=f"select distinct {sql_title('authority')} as name from entities where type = 'approval'"))
def role_nodes(spark, sf):
    return G.role_nodes(G.approvals(entities(spark, sf)))


@query("threshold_edges", with_ctes(ENTITIES, POLICY, select=edge_sql("HAS_THRESHOLD", "Policy", "document_id", "Threshold", "entity_id")
       + " from entities join policy using (document_id) where amount > 0"))
def threshold_edges(spark, sf):
    return G.has_threshold(G.thresholds(entities(spark, sf)), policies(spark, sf))


LIMITS = """limits as (select role, max_by({'a': amount, 'c': currency}, {'d': e.document_id, 'o': ord, 'p': pos}) as v
  from entities e join policy p using (document_id) join approvers a on a.process = p.process_name
  where type = 'threshold' and amount > 0 group by role)"""


def limits(spark, sf):
    found = stored_entities(spark, sf)
    return G.role_limits(approvers(spark, sf, found), policies(spark, sf), G.thresholds(found))


@query("role_limits", with_ctes(ENTITIES, POLICY, APPROVERS, LIMITS, select="select role, v.a as max_amount, v.c as currency from limits"))
def role_limits(spark, sf):
    return limits(spark, sf)


@query("supersedes", with_ctes(POLICY, select="""
  select n.document_id as new_id, max(o.document_id) as old_id, count(*) as n_superseded, n.title
  from policy n join policy o on n.title = o.title and o.document_id < n.document_id and o.version <> n.version group by n.document_id, n.title"""))
def supersedes(spark, sf):
    return G.supersedes(policies(spark, sf))


@query("superseded_by", with_ctes(POLICY, select="""
  select n.document_id as new_id, o.document_id as old_id
  from policy n join policy o on n.title = o.title and o.document_id < n.document_id and o.version <> n.version where n.status = 'active'"""))
def superseded_by(spark, sf):
    p = policies(spark, sf)
    return G.superseded_by(p, p.filter("status = 'active'"))


@query("entity_replies", with_ctes(FACTS, select="""
  select clause_id, role, department, process, regulation, obligation, amount, currency, (b = '' or j is not null) as success,
    case when b <> '' and j is null then 'reply holds no valid JSON' end as error from all_facts"""))
def entity_replies(spark, sf):
    return L.entity_fields(REPLIES.df(spark, sf)).select(
        "clause_id", "role", "department", "process", "regulation", "obligation", "amount", "currency", "success", "error")


REPLY_EDGES = " union all ".join([
    edge_sql("CAN_APPROVE", "Role", "role", "Process", "coalesce(process, 'General Compliance')") + " from facts where role is not null",
    edge_sql("BELONGS_TO", "Role", "role", "Department", "department") + " from facts where role is not null and department is not null",
    edge_sql("REQUIRES_THRESHOLD", "Process", "coalesce(process, 'General Compliance')", "Threshold", "'llm_' || clause_id") + " from facts where role is not null and amount > 0",
    edge_sql("GOVERNS", "Clause", "clause_id", "Process", "coalesce(process, 'General Compliance')") + " from facts where role is not null",
])


@query("reply_edges", with_ctes(FACTS, select=REPLY_EDGES))
def reply_edges(spark, sf):
    return G.reply_edges(facts(spark, sf))


@query("clause_obligations", with_ctes(FACTS, select="select clause_id, obligation from facts where obligation is not null"))
def clause_obligations(spark, sf):
    return G.obligations(facts(spark, sf))


MAPS = edge_sql("MAPS_TO", "Policy", "document_id", "Regulation", "regulation") + " from facts join policy using (document_id) where regulation is not null"


def regulation_edges(spark, sf, known=None):
    return G.maps_to(facts(spark, sf) if known is None else known, policies(spark, sf))


@query("maps_to", with_ctes(FACTS, POLICY, select=MAPS))
def maps_to(spark, sf):
    return regulation_edges(spark, sf)


PAIRS = """long as (select *, row_number() over (partition by document_id order by ord) as n, string_split(section_path, '>')[1] as section
  from clauses where length(text) > 50),
pairs as (select a.document_id, a.clause_id as clause_a, b.clause_id as clause_b, cast(b.n - a.n as int) as gap,
    left(a.text, 300) as text_a, left(b.text, 300) as text_b
  from long a join long b on a.document_id = b.document_id and b.n between a.n + 1 and a.n + 4 and a.section = b.section)"""


def candidates(spark, sf):
    return G.conflict_candidates(clauses(spark, sf))


def verdicts_of(pairs):
    """A judge's reply to every candidate pair."""
    said = F.when((F.col("clause_a") + F.col("clause_b")) % 3 == 0, "Yes, they do.").when(
        (F.col("clause_a") + F.col("clause_b")) % 3 == 1, "no")
    return pairs.select("clause_a", "clause_b", said.alias("reply"))


@query("conflict_candidates", with_ctes(CLAUSES.cte, PAIRS, select="select document_id, clause_a, clause_b, gap, text_a, text_b from pairs"))
def conflict_candidates(spark, sf):
    return candidates(spark, sf)


CONFLICTS = edge_sql("CONFLICTS_WITH", "Clause", "clause_a", "Clause", "clause_b") + " from pairs where (clause_a + clause_b) % 3 = 0"


def conflict_edges(spark, sf, of=None):
    pairs = materialise(G.conflict_pairs(clauses(spark, sf), of=of))
    return G.conflicts_with(pairs, verdicts_of(pairs))


@query("conflicts_with", with_ctes(CLAUSES.cte, PAIRS, select=CONFLICTS))
def conflicts_with(spark, sf):
    return conflict_edges(spark, sf)


ENTITY_EDGES = (edge_sql("HAS_THRESHOLD", "Policy", "document_id", "Threshold", "entity_id") + " from entities join policy using (document_id) where amount > 0 union all "
                + edge_sql("CAN_APPROVE", "Role", "role", "Process", "process") + " from approvers union all "
                + edge_sql("SUPERSEDES", "Policy", "n.document_id", "Policy", "o.document_id")
                + " from policy n join policy o on n.title = o.title and o.document_id < n.document_id and o.version <> n.version")
ALL_EDGES = f"""edges as (select distinct * from ({CLAUSE_EDGES} union all {REPLY_EDGES} union all {MAPS} union all {CONFLICTS} union all {ENTITY_EDGES}))"""


def all_edges(spark, sf):
    c, p, f = clauses(spark, sf), policies(spark, sf), stored_facts(spark, sf)
    e = stored_entities(spark, sf)
    approve = approvers(spark, sf, e).select(*G.edge("CAN_APPROVE", "Role", "role", "Process", "process"))
    parts = [G.clause_edges(c, p), G.reply_edges(f), G.maps_to(f, p), conflict_edges(spark, sf), G.has_threshold(G.thresholds(e), p), approve]
    return reduce(DataFrame.unionByName, parts)


@query("graph_summary", with_ctes(ENTITIES, POLICY, APPROVERS, FACTS, PAIRS, ALL_EDGES, select="""
  select type, cast(count(*) as bigint) as n from edges group by rollup (type)"""))
def graph_summary(spark, sf):
    """SUPERSEDES is counted from the number that each policy supersedes, without its pairs."""
    older = G.supersedes(policies(spark, sf)).select(F.lit("SUPERSEDES").alias("type"), F.col("n_superseded").alias("k"))
    edges = G.edge_counts(all_edges(spark, sf), ["GOVERNS", "CAN_APPROVE"])
    return G.summary(edges.unionByName(older), "type", "k")


REPLY_NODES = f"""reply_nodes as (select distinct * from (select src_label as label, src as name from ({REPLY_EDGES} union all {MAPS})
  union all select dst_label, dst from ({REPLY_EDGES} union all {MAPS})) where label not in ('Clause', 'Policy'))"""


@query("reply_nodes", with_ctes(FACTS, POLICY, REPLY_NODES, select="select label, name from reply_nodes"))
def reply_nodes(spark, sf):
    return G.reply_nodes(stored_facts(spark, sf), policies(spark, sf))


@query("reply_thresholds", with_ctes(FACTS, select="select 'llm_' || clause_id as threshold_id, amount, currency from facts where role is not null and amount > 0"))
def reply_thresholds(spark, sf):
    return G.reply_thresholds(facts(spark, sf))


@query("node_summary", with_ctes(ENTITIES, POLICY, FACTS, REPLY_NODES, f"""
nodes as (select label, name from reply_nodes union select 'Policy', cast(document_id as varchar) from policy union select 'Clause', cast(clause_id as varchar) from clauses
  union select 'Process', process_name from policy union select 'Role', {sql_title('authority')} from entities where type = 'approval'
  union select 'Threshold', entity_id from entities where amount > 0)""", select="select label, count(*) as n from nodes group by rollup (label)"))
def node_summary(spark, sf):
    c, p, e = clauses(spark, sf), policies(spark, sf), stored_entities(spark, sf)

    def nodes(df, label, name):
        return df.select(F.lit(label).alias("label"), F.col(name).cast("string").alias("name"))

    parts = [G.reply_nodes(stored_facts(spark, sf), p), nodes(p, "Policy", "document_id"), nodes(c, "Clause", "clause_id"), nodes(G.process_nodes(p), "Process", "name"),
             nodes(G.role_nodes(G.approvals(e)), "Role", "name"), nodes(G.thresholds(e), "Threshold", "threshold_id")]
    return G.summary(reduce(DataFrame.unionByName, parts).distinct(), "label")


@query("new_edges", with_ctes(ENTITIES, POLICY, FACTS, select=f"""
  select * from ({REPLY_EDGES}) except (select * from ({CLAUSE_EDGES}) union all select * from ({REPLY_EDGES}) where src like '%3')"""))
def new_edges(spark, sf):
    found = G.reply_edges(stored_facts(spark, sf))
    stored = G.clause_edges(clauses(spark, sf), policies(spark, sf)).unionByName(found.filter("src like '%3'"))
    return T.new_edges(found, stored)


@query("upserted_processes", with_ctes(POLICY, """
writes as (select process_name as name, title, document_id as seq from policy
  union all select case when c_custkey % 2 = 0 then 'Dept ' || (c_custkey % 7) else (select min(process_name) from policy) end, c_name, 100000000 + c_custkey from customer)""", select="""
  select name, max_by(title, seq) as source_policy from writes group by 1"""))
def upserted_processes(spark, sf):
    stored = G.process_nodes(policies(spark, sf))
    writes = T.read(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Dept "), (F.col("c_custkey") % 7).cast("string"))).otherwise(
            stored.agg(F.min("name")).scalar()).alias("name"), F.col("c_name").alias("source_policy"),
        F.col("c_custkey").alias("seq"))
    return T.upsert(stored, writes, ["name"], "seq")


@query("merged_processes", with_ctes(POLICY, """
writes as (select process_name as name, title, document_id as seq from policy
  union all select case when c_custkey % 2 = 0 then 'Dept ' || (c_custkey % 7) else (select min(process_name) from policy) end, c_name, 100000000 + c_custkey from customer)""", select="""
  select name, max_by(title, seq) as source_policy from writes group by 1"""))
def merged_processes(spark, sf):
    """The same writes merged into a stored table, whose other buckets stay as they are."""
    folder, schema = new_folder(spark, "processes"), "name string, source_policy string"
    stored = G.process_nodes(policies(spark, sf)).select("name", "source_policy")
    M.merge(stored.withColumn("seq", F.lit(0)), folder, ["name"], "seq", 16)
    writes = T.read(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Dept "), (F.col("c_custkey") % 7).cast("string"))).otherwise(
            stored.agg(F.min("name")).scalar()).alias("name"), F.col("c_name").alias("source_policy"),
        F.col("c_custkey").alias("seq"))
    M.merge(writes, folder, ["name"], "seq", 16)
    return M.stored_table(spark, folder, schema)


@query("merged_edges", with_ctes(ENTITIES, POLICY, FACTS, select=f"""
  select * from ({CLAUSE_EDGES}) union select * from ({REPLY_EDGES})"""))
def merged_edges(spark, sf):
    """Edges of the clauses stored, then those of the replies added where they are new."""
    folder, key = new_folder(spark, "edges"), ["type", "src_label", "src", "dst_label", "dst"]
    stored = G.clause_edges(clauses(spark, sf), policies(spark, sf)).select(*key)
    M.merge(stored, folder, key, buckets=16)
    M.merge(G.reply_edges(stored_facts(spark, sf)).select(*key), folder, key, buckets=16)
    return M.stored_table(spark, folder, stored.schema)


# --- Prompts --------------------------------------------------------------------------------

@query("split_prompts", with_ctes(CLAUSES.cte, select="""
  select document_id, ord, 'List the separate rules of this section as a JSON array of strings, in its own words.' || chr(10) || chr(10) || text as prompt from clauses"""))
def split_prompts(spark, sf):
    return L.split_prompts(clauses(spark, sf).select("document_id", "ord", F.lit(False).alias("is_heading"), F.col("text").alias("content")))


@query("extraction_prompts", with_ctes(CLAUSES.cte, select="""
  select clause_id, 'Give the role, department, process, threshold, regulation and obligation of this clause as one JSON object, null where absent.'
    || chr(10) || chr(10) || text as prompt from clauses where length(text) >= 20"""))
def extraction_prompts(spark, sf):
    return L.extraction_prompts(clauses(spark, sf))


@query("conflict_prompts", with_ctes(CLAUSES.cte, PAIRS, select="""
  select clause_a, clause_b, 'Do these two clauses contradict each other? Answer yes or no.' || chr(10) || chr(10)
    || 'FIRST: ' || left(text_a, 300) || chr(10) || 'SECOND: ' || left(text_b, 300) as prompt from pairs"""))
def conflict_prompts(spark, sf):
    return L.conflict_prompts(candidates(spark, sf).drop("document_id", "gap"))


JUDGED = Derived("judged", "orders", id="o_orderkey",
                 risk="case o_orderkey % 5 when 0 then ' Violation ' when 1 then 'conditional' when 2 then 'CLEAR' when 3 then 'a violation, I think' end",
                 yes="case o_orderkey % 4 when 0 then 'YES.' when 1 then 'no' when 2 then 'Yesterday' end")


@query("judged_replies", with_ctes(JUDGED.cte, select="""
  select id, case when lower(trim(risk)) in ('clear', 'conditional', 'violation') then lower(trim(risk)) else 'clear' end as verdict,
    coalesce(contains(lower(yes), 'yes'), false) as said_yes from judged"""))
def judged_replies(spark, sf):
    return JUDGED.df(spark, sf).select("id", L.risk_verdict(F.col("risk")).alias("verdict"), L.said_yes(F.col("yes")).alias("said_yes"))
