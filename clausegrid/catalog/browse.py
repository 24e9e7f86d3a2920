"""Browsing and log queries over `events`, `documents`, `labels` and the derived tables."""

from pyspark.sql import functions as F

from clausegrid.catalog.derived import CLAUSES, Derived
from clausegrid.catalog.graph import ENTITIES, entities, stored_entities
from clausegrid.catalog.registry import query, with_ctes
from clausegrid.functions.stages import new_folder
from clausegrid.operators import browse as B
from clausegrid.operators import pages as P
from clausegrid.operators import substrings as U
from clausegrid.sources.tables import audit_rows, read

LOG = Derived("log", "events", audit_id="event_id", actor="cast(user_id as string)", action="event_type", payload="props", ts="ts", level="user_id % 4")
ASKED_LOG = Derived("asked_log", "events", query_id="event_id", user_id="user_id", question="concat('About ', event_type)", created_at="ts")
DOCS = Derived("docs", "customer", document_id="c_custkey", title="c_name", created_at="c_custkey % 97")
FEEDBACK = Derived("feedback", "labels", feedback_id="doc_id", answer_id="doc_id * 2", rating="cast(doc_id % 7 as int)", note="concat('note ', cast(quality as string))")
ANSWER_IDS = Derived("answer_ids", "documents", answer_id="doc_id")
CALLS = Derived("calls", "events", tool="event_type", success="value < 30", latency_ms="cast(floor(value * 10) as bigint)")


@query("question_history", with_ctes(ASKED_LOG.cte, select="""
  select query_id, user_id, question, row_number() over (partition by user_id order by created_at desc, query_id desc) as n from asked_log qualify n <= 50"""))
def question_history(spark, sf):
    return B.history(ASKED_LOG.df(spark, sf)).select("query_id", "user_id", "question", F.col("n").cast("long").alias("n"))


ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || case when microsecond({0}) % 1000000 <> 0 then strftime({0}, '.%f') else '' end"


@query("one_user_history", with_ctes(ASKED_LOG.cte, select=f"""
  select query_id, question, {ISO.format('created_at')} as created_at from asked_log where user_id = 7 order by asked_log.created_at desc, query_id desc limit 50"""))
def one_user_history(spark, sf):
    return B.history(ASKED_LOG.df(spark, sf), user_id=7).select("query_id", "question", "created_at")


@query("feedback_accepted", with_ctes(FEEDBACK.cte, ANSWER_IDS.cte, select="""
  select * from feedback where rating between 1 and 5 and answer_id in (select answer_id from answer_ids)"""))
def feedback_accepted(spark, sf):
    return B.submit_feedback(FEEDBACK.df(spark, sf), ANSWER_IDS.df(spark, sf))[0]


@query("feedback_rejected", with_ctes(FEEDBACK.cte, ANSWER_IDS.cte, select="""
  select *, case when rating not between 1 and 5 then 'rating out of range' else 'answer not found' end as reason from feedback
  where rating not between 1 and 5 or answer_id not in (select answer_id from answer_ids)"""))
def feedback_rejected(spark, sf):
    return B.submit_feedback(FEEDBACK.df(spark, sf), ANSWER_IDS.df(spark, sf))[1]


@query("feedback_of_answers", with_ctes(FEEDBACK.cte, ANSWER_IDS.cte, select="""
  select f.* from feedback f where answer_id in (select answer_id from answer_ids)"""))
def feedback_of_answers(spark, sf):
    return B.feedback_of(ANSWER_IDS.df(spark, sf), FEEDBACK.df(spark, sf))


@query("audit_newest", with_ctes(LOG.cte, select=f"select audit_id, actor, action, payload, {ISO.format('ts')} as ts from log order by log.ts desc, audit_id desc limit 100"))
def audit_newest(spark, sf):
    return B.audit(LOG.df(spark, sf)).select("audit_id", "actor", "action", "payload", "ts")


@query("audit_by_action", with_ctes(LOG.cte, select="""
  select audit_id, actor, cast(payload->>'$.k' as bigint) as k from log where action = 'click' and actor = '8' order by ts desc, audit_id desc limit 100"""))
def audit_by_action(spark, sf):
    rows = B.audit(LOG.df(spark, sf), action="click", actor="8")
    return rows.select("audit_id", "actor", F.get_json_object("payload", "$.k").cast("long").alias("k"))


@query("audit_gate", with_ctes(LOG.cte, select="select audit_id, coalesce(level, 1) >= 3 as allowed from log"))
def audit_gate(spark, sf):
    return LOG.df(spark, sf).select("audit_id", B.allowed(F.col("level")).alias("allowed"))


@query("audit_rows", with_ctes(LOG.cte, select="""
  select actor, action, cast(json_object('id', audit_id, 'level', level) as varchar) as payload from log"""))
def audit_rows_query(spark, sf):
    log = LOG.df(spark, sf)
    return audit_rows(log, F.col("actor"), F.col("action"), F.struct(F.col("audit_id").alias("id"), "level"), F.col("ts")).drop("ts")


COUNTS = """counts as (select document_id, title, created_at, (select count(*) from clauses c where c.document_id = d.document_id) as chunk_count,
  (select count(*) from entities e where e.document_id = d.document_id) as entity_count from docs d)"""


def clause_chunks(spark, sf):
    return CLAUSES.df(spark, sf).select(F.col("clause_id").alias("chunk_id"), "ord", "document_id", "section_path", "clause_ref", "text",
                                        F.size(F.split("text", " ")).alias("token_count"))


@query("document_list", with_ctes(ENTITIES, DOCS.cte, COUNTS, select="select * from counts order by created_at desc, document_id desc limit 50 offset 20"))
def document_list(spark, sf):
    return B.document_list(DOCS.df(spark, sf), clause_chunks(spark, sf), entities(spark, sf), limit=50, offset=20)


@query("document_counts", with_ctes(ENTITIES, DOCS.cte, COUNTS, select="select * from counts"))
def document_counts(spark, sf):
    return B.document_list(DOCS.df(spark, sf), clause_chunks(spark, sf), entities(spark, sf), limit=None)


@query("document_detail", with_ctes(ENTITIES, DOCS.cte, """
items as (select document_id, 'chunks' as kind, section_path as section, ord // 1000 as part, string_agg(clause_id || '=' || section_path || '=' || clause_ref, '|' order by ord, clause_id) as items from clauses group by all
  union all select document_id, 'entities', type, ord // 1000, string_agg(entity_id || '=' || name, '|' order by ord, entity_id) from entities group by all)""", select="""
  select d.document_id, d.title, kind, section, part, items from docs d left join items using (document_id)"""))
def document_detail(spark, sf):
    e = stored_entities(spark, sf).withColumn("ord", F.col("seq.ord"))
    detail = B.document_detail(DOCS.df(spark, sf).select("document_id", "title"), clause_chunks(spark, sf), e)
    chunks = F.array_join(F.transform("chunks", lambda c: F.concat_ws("=", c["chunk_id"].cast("string"), c["section_path"], c["clause_ref"])), "|")
    found = F.array_join(F.transform("entities", lambda x: F.concat_ws("=", x["entity_id"], x["name"])), "|")
    return detail.select("document_id", "title", "kind", "section", "part", F.coalesce(chunks, found).alias("items"))


PREVIEW = "case when length(text) > 500 then left(text, 500) || '...' else text end as text"


@query("chunk_search", with_ctes(CLAUSES.cte, "found as (select * from clauses where clause_ref ilike '%ceo_approval%' or text ilike '%ceo_approval%')", select=f"""
  select clause_id as chunk_id, document_id, section_path, clause_ref, {PREVIEW}, (select count(*) from found) as total
  from found order by section_path, document_id, clause_id limit 50 offset 10"""))
def chunk_search(spark, sf):
    return B.search_chunks(clause_chunks(spark, sf), "ceo_approval", limit=50, offset=10).drop("ord", "token_count")


@query("indexed_chunk_search", with_ctes(CLAUSES.cte, "found as (select * from clauses where clause_ref ilike '%ceo_approval%' or text ilike '%ceo_approval%')", select=f"""
  select clause_id as chunk_id, document_id, section_path, clause_ref, {PREVIEW}, (select count(*) from found) as total
  from found order by section_path, document_id, clause_id limit 50 offset 10"""))
def indexed_chunk_search(spark, sf):
    """The same page from a stored trigram index, which leaves few texts to read."""
    folder, fields = new_folder(spark, "trigrams"), ["clause_ref", "text"]
    U.build_trigrams(clause_chunks(spark, sf).drop("ord", "token_count"), folder, fields)
    rows = U.page(U.search_trigrams(spark, folder, "ceo_approval", fields), ["section_path", "document_id", "chunk_id"], 50, 10)
    return rows.withColumn("text", B.preview(F.col("text")))


@query("document_search", with_ctes("found as (select doc_id as chunk_id, source as section_path, lang as clause_ref, text from documents where lang ilike '%the%' or text ilike '%the%')", select=f"""
  select chunk_id, section_path, clause_ref, {PREVIEW}, (select count(*) from found) as total from found"""))
def document_search(spark, sf):
    chunks = read(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"),
                                                 F.col("source").alias("section_path"), F.col("lang").alias("clause_ref"), "text")
    return B.search_chunks(chunks, "the", limit=None).drop("document_id")


@query("chunk_detail", with_ctes(CLAUSES.cte, DOCS.cte, select="""
  select clause_id as chunk_id, c.document_id, text, title as document_title
  from (select * replace (case when clause_id % 5 = 2 then -document_id else document_id end as document_id) from clauses) c left join docs using (document_id)"""))
def chunk_detail(spark, sf):
    orphans = F.when(F.col("chunk_id") % 5 == 2, -F.col("document_id")).otherwise(F.col("document_id"))
    return B.chunk_detail(clause_chunks(spark, sf).withColumn("document_id", orphans), DOCS.df(spark, sf)).select("chunk_id", "document_id", "text", "document_title")


@query("entity_browse", with_ctes(ENTITIES, select="""
  select entity_id, name, document_id from entities where type = 'approval' order by ord desc, entity_id desc limit 100"""))
def entity_browse(spark, sf):
    return B.browse_entities(entities(spark, sf).withColumn("created_at", F.col("seq.ord")), type="approval").select("entity_id", "name", "document_id")


@query("call_outcomes", with_ctes(CALLS.cte, select="""
  select tool, count(*) as calls, round(avg(success::int), 6) as success_rate, quantile_disc(latency_ms, 0.5) as p50_ms,
    quantile_disc(latency_ms, 0.95) as p95_ms, max(latency_ms) as max_ms from calls group by 1"""))
def call_outcomes(spark, sf):
    return B.call_outcomes(CALLS.df(spark, sf)).withColumn("success_rate", F.round("success_rate", 6))


@query("call_outcomes_of_days", with_ctes("""timed as (select event_type as tool, value < 30 as success, cast(floor(value * 10) as bigint) as latency_ms from events
  where ts >= timestamp '2024-01-08' and ts < timestamp '2024-01-22')""", select="""
  select tool, count(*) as calls, round(avg(success::int), 6) as success_rate, max(latency_ms) as max_ms, true as p50_within, true as p95_within from timed group by 1"""))
def call_outcomes_of_days(spark, sf):
    """Two weeks from stored daily sketches; the ranks of their percentiles are then counted."""
    folder = new_folder(spark, "sketches")
    events = read(spark, sf, "events").select(
        F.col("event_type").alias("tool"), F.to_date("ts").alias("day"), (F.col("value") < 30).alias("success"), F.floor(F.col("value") * 10).cast("long").alias("latency_ms"))
    B.call_sketches(events).write.partitionBy("day").parquet(folder)
    span = (F.col("day") >= F.lit("2024-01-08").cast("date")) & (F.col("day") < F.lit("2024-01-22").cast("date"))
    found = B.outcomes_of_sketches(spark.read.parquet(folder).filter(span))

    def within(p, column):
        below, up_to = F.avg((F.col("latency_ms") < F.col(column)).cast("int")), F.avg((F.col("latency_ms") <= F.col(column)).cast("int"))
        return (below <= p + B.RANK_ERROR) & (up_to >= p - B.RANK_ERROR)

    ranks = events.filter(span).join(found.select("tool", "p50_ms", "p95_ms"), "tool").groupBy("tool").agg(
        within(0.5, "p50_ms").alias("p50_within"), within(0.95, "p95_ms").alias("p95_within"))
    return found.join(ranks, "tool").select("tool", "calls", F.round("success_rate", 6).alias("success_rate"), "max_ms", "p50_within", "p95_within")


@query("audit_page_deep", with_ctes(LOG.cte, select="""
  select audit_id, actor, action, place from (select *, row_number() over (order by ts desc, audit_id desc) - 1 as place, count(*) over () // 2 as middle from log)
  where place >= middle and place < middle + 50"""))
def audit_page_deep(spark, sf):
    """The page in the middle of the log."""
    folder = new_folder(spark, "pages")
    P.store_ordered(LOG.df(spark, sf).select("audit_id", "actor", "action", "ts"), [F.col("ts").desc(), F.col("audit_id").desc()], folder, 10_000)
    return P.page(spark, folder, P.total(spark, folder) // 2, 50).drop("ts")
