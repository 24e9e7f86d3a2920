"""Structure, chunking and quality queries over policy lines (from `orders`) and `documents`."""

from pyspark.sql import functions as F

from clausegrid.catalog.derived import CLAUSES, DOCUMENT_STATUS, POLICIES, POLICY_LINES, POLICY_TABLES, Derived, CLAUSE_TEXT
from clausegrid.catalog.registry import query, with_ctes
from clausegrid.catalog.retrieval import CHUNKS, LINES, SQL_SPACE
from clausegrid.functions.stages import new_folder
from clausegrid.operators import chunking as C
from clausegrid.operators import quality as Q
from clausegrid.operators import structure as S
from clausegrid.sources import lines as L
from clausegrid.sources import tables as T
from clausegrid.sources.tables import read

SQL_WORD = SQL_SPACE.replace("[", "[^", 1)
CASED_LOW, CASED_UP = r"\p{Ll}", r"\p{Lu}"


def sql_words(text):
    return f"len(regexp_extract_all({text}, '{SQL_WORD}+'))"


def marked_sql(source, name="marked"):
    return rf"""{name} as (select *, case
  when format = 'docx' then case when contains(style, 'Heading') then
    least(coalesce(try_cast(regexp_extract(style, 'Heading (\d+)', 1) as int), 1), 5) end
  when length(text) < 80 and not ends_with(text, '.') then case
    when regexp_matches(text, '^\d+\.?\s+[A-Z]') then least(length(text) - length(replace(text, '.', '')) + 1, 5)
    when regexp_matches(text, '{CASED_UP}') and not regexp_matches(text, '[{CASED_LOW}\p{{Lt}}]') then 1
    when regexp_matches(text, '[{CASED_UP}\p{{Lt}}]') and not regexp_matches(text, '(^|[^{CASED_UP}{CASED_LOW}\p{{Lt}}])[{CASED_LOW}]')
      and not regexp_matches(text, '[{CASED_UP}{CASED_LOW}\p{{Lt}}][{CASED_UP}\p{{Lt}}]') and {sql_words('text')} <= 5 then 1 end
  end as level from {source})"""


def sections_sql(marked="marked", name="sections"):
    groups = ", ".join(f"sum(case when level < {k} then 1 else 0 end) over w as g{k}" for k in range(1, 6))
    lasts = ", ".join(
        f"last_value(case when level <= {k} then {{'l': level, 't': text}} end ignore nulls) over w as s{k}" for k in range(1, 6))
    counts = ", ".join(
        f"sum(case when level = {k} then 1 else 0 end) over (partition by document_id, g{k} order by ord) as c{k}" for k in range(1, 6))
    return f"""{name}_g as (select *, {groups}, {lasts} from {marked} window w as (partition by document_id order by ord)),
{name}_c as (select *, {counts} from {name}_g),
{name}_p as (select *, array_to_string(list_filter([c1, c2, c3, c4, c5], lambda c: c > 0), '.') as path,
  list_transform(list_filter([case when s1.l = 1 then s1 end, case when s2.l = 2 then s2 end, case when s3.l = 3 then s3 end,
    case when s4.l = 4 then s4 end, case when s5.l = 5 then s5 end], lambda s: s is not null), lambda s: s.t) as h from {name}_c),
{name} as (select document_id, ord,
  case when len(h) = 0 and format = 'docx' then '0' else path end as section_path,
  case when len(h) = 0 and format = 'docx' then ['Document Header'] else h end as hier,
  text as content, cast(coalesce(level, case when len(h) = 0 and format = 'docx' then 0 else len(h) end) as int) as section_level,
  level is not null as is_heading, case when format = 'pdf' then page end as page from {name}_p)"""


CLEAN = POLICY_LINES.cte + """,
clean as (select document_id, ord, page, format, style, trim(text) as text from policy_lines where trim(text) <> '')"""
SECTIONS = CLEAN + ",\n" + marked_sql("clean") + ",\n" + sections_sql()


def policy_lines(spark, sf):
    return POLICY_LINES.df(spark, sf)


def policy_sections(spark, sf):
    return S.parse_structure(policy_lines(spark, sf))


@query("document_lines", with_ctes(LINES, select="select document_id, ord, text from lines"))
def document_lines(spark, sf):
    return L.document_lines(read(spark, sf, "documents"))


@query("heading_levels", with_ctes(CLEAN, marked_sql("clean"), select="select document_id, ord, text, cast(level as int) as level from marked"))
def heading_levels(spark, sf):
    return S.mark_headings(policy_lines(spark, sf)).select("document_id", "ord", "text", "level")


@query("section_numbers", with_ctes(SECTIONS, select="""
  select document_id, ord, section_path, array_to_string(hier, ' > ') as hierarchy, content, section_level, is_heading, page from sections"""))
def section_numbers(spark, sf):
    return policy_sections(spark, sf).select(
        "document_id", "ord", "section_path", F.array_join("heading_hierarchy", " > ").alias("hierarchy"), "content",
        "section_level", "is_heading", "page")


@query("document_headings", with_ctes(LINES, "raw_l as (select document_id, ord, 1 as page, 'pdf' as format, '' as style, text from lines)",
    marked_sql("raw_l"), sections_sql(), select="""
  select document_id, ord, section_path, array_to_string(hier, ' > ') as hierarchy, section_level, is_heading from sections"""))
def document_headings(spark, sf):
    """Plain-line headings and numbering over the raw documents."""
    return document_sections(spark, sf).select(
        "document_id", "ord", "section_path", F.array_join("heading_hierarchy", " > ").alias("hierarchy"), "section_level", "is_heading")


def document_sections(spark, sf):
    lines = L.document_lines(read(spark, sf, "documents"))
    return S.parse_structure(lines.select("document_id", "ord", F.lit(1).alias("page"), F.lit("pdf").alias("format"), F.lit("").alias("style"), "text"))


@query("sections_with_tables", with_ctes(SECTIONS, POLICY_TABLES.cte, """
ends as (select document_id, max_by({'p': section_path, 'h': hier}, ord) as e from sections group by 1),
tabled as (select document_id, table_no + 1099511627776 as ord,
    array_to_string([trim(cell_1), trim(cell_2)], ' | ') || chr(10) || array_to_string([trim(cell_3)], ' | ') as content from policy_tables)""",
    select="""
  select document_id, ord, section_path, array_to_string(hier, ' > ') as hierarchy, content, section_level, false as is_table from sections
  union all select t.document_id, t.ord, coalesce(e.p, '0'), coalesce(array_to_string(e.h, ' > '), 'Document Header'), content,
    cast(case when e.p is null or e.p = '0' then 0 else len(e.h) end as int), true
  from tabled t left join ends using (document_id)"""))
def sections_with_tables(spark, sf):
    tables = POLICY_TABLES.df(spark, sf).select(
        "document_id", "table_no", F.array(F.array("cell_1", "cell_2"), F.array("cell_3")).alias("rows"))
    return S.parse_structure(policy_lines(spark, sf), tables).select(
        "document_id", "ord", "section_path", F.array_join("heading_hierarchy", " > ").alias("hierarchy"), "content",
        "section_level", "is_table")


@query("document_text", with_ctes(SECTIONS, select="""
  select document_id, ord // 1000 as part, string_agg(content, chr(10) order by ord) as text from sections group by all"""))
def document_text(spark, sf):
    return S.full_text(policy_sections(spark, sf))


# --- Chunking -----------------------------------------------------------------------------
# A model's clause list for every line: usable, malformed, empty, or no list at all.

SECTION_REPLIES = Derived(
    "section_replies", "orders", document_id="o_custkey", ord="o_orderkey",
    reply=f"""case o_orderkey % 4
      when 0 then concat('Rules: ["', {CLAUSE_TEXT}, '", "Keep  it.", 7, "  ", " See the annex now and then. Ask first! "] done')
      when 1 then concat('["cut off ', cast(o_orderkey as string))
      when 2 then '["one"] or ["two"]' else 'I cannot split this.' end""")

LISTS = SECTIONS + f""",
{SECTION_REPLIES.cte},
blocks as (select document_id, ord, regexp_extract(reply, '(?s)(\\[.*\\])', 1) as b from section_replies),
lists as (select document_id, ord, [regexp_replace(c, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g') for c in
    [json_extract_string(j, '$') for j in cast(case when json_valid(b) then b else '[]' end as json[]) if json_type(j) = 'VARCHAR']
    if regexp_matches(c, '{SQL_WORD}')] as found from blocks),
clause_lists as (select s.*, case when len(found) > 0 then found else [content] end as clauses
  from sections s left join lists using (document_id, ord) where not is_heading)"""


def chunks_sql(source, limit):
    """Check SQL of D13-D16: overlap by closed form, long clauses by a recursive scan."""
    def words(text):
        return f"regexp_extract_all({text}, '{SQL_WORD}+')"

    own = "case when tail <> '' then tail || ' ' || sents[i + 1] else sents[i + 1] end"
    return f"""flat as (select document_id, ord, section_path, hier, page, unnest(clauses) as clause, generate_subscripts(clauses, 1) - 1 as no from {source}),
worded as (select *, {words('clause')} as w from flat),
tailed as (select *, case when no = 0 then clause else array_to_string(list_slice(flatten(list(w) over
    (partition by document_id, ord order by no rows between 3 preceding and 1 preceding)), -3, -1), ' ') || ' ' || clause end as text from worded),
numbered as (select *, row_number() over (order by document_id, ord, no) as id, {sql_words('text')} as n from tailed),
rec as (
  select id, string_split(regexp_replace(text, '([.!?]){SQL_SPACE}+', '\\1' || chr(1), 'g'), chr(1)) as sents,
    0 as i, []::varchar[] as done, '' as open, '' as last, 0::bigint as size, '' as tail from numbered where n > {limit}
  union all
  select id, sents, i + 1,
    case when cut then list_append(done, open) else done end,
    case when cut or last = '' then own else open || ' ' || own end, own,
    case when cut then osize else size + osize end,
    case when cut then case when len({words('last')}) > 3
      then array_to_string(list_slice({words('last')}, -3, -1), ' ') else last end else tail end
  from (select *, size + osize > {limit} and last <> '' as cut from (select *, {sql_words('own')} as osize from
    (select *, {own} as own from rec where i < len(sents))))),
pieces as (select id, list_append(done, open) as texts from rec where i = len(sents)),
whole as (select n.*, coalesce(texts, [text]) as texts, case when texts is null then 0 else 1 end as extra from numbered n left join pieces using (id)),
counted as (select *, sum(extra + len(texts)) over (partition by document_id, section_path order by ord, no) - len(texts) as before from whole),
pieced as (select document_id, ord, no, section_path, hier, page, before, unnest(texts) as text, generate_subscripts(texts, 1) - 1 as piece from counted),
chunked as (select document_id, ord, cast(no as int) as clause_no, cast(piece as int) as piece, section_path,
  concat(section_path, ' ', case when len(hier) > 0 then array_to_string(hier, ' > ') else 'Content' end, ' > Rule ', cast(before + piece + 1 as bigint)) as clause_ref,
  text, cast({sql_words('text')} as int) as token_count, page, cast(before + piece + 1 as bigint) as clause_number from pieced)"""


CHUNK_COLUMNS = ["document_id", "ord", "clause_no", "piece", "section_path", "clause_ref", "text", "token_count", "page", "clause_number"]
CHUNK_SELECT = "select " + ", ".join(CHUNK_COLUMNS) + " from chunked"
POLICY_CHUNKS = LISTS + ",\n" + chunks_sql("clause_lists", 12)
DOCUMENT_CHUNKS = (LINES + ", raw_l as (select document_id, ord, 1 as page, 'pdf' as format, '' as style, text from lines),\n"
                   + marked_sql("raw_l") + ",\n" + sections_sql()
                   + ",\nraw_clauses as (select *, [content] as clauses from sections where not is_heading),\n" + chunks_sql("raw_clauses", 50))


@query("clause_lists", with_ctes(LISTS, select="""
  select document_id, ord, cast(generate_subscripts(clauses, 1) - 1 as int) as clause_no, unnest(clauses) as clause from clause_lists"""))
def clause_lists(spark, sf):
    cut = C.section_clauses(policy_sections(spark, sf), SECTION_REPLIES.df(spark, sf))
    return cut.select("document_id", "ord", F.posexplode("clauses").alias("clause_no", "clause"))


def policy_chunks_df(spark, sf):
    return C.chunk_sections(policy_sections(spark, sf), SECTION_REPLIES.df(spark, sf), max_words=12)


@query("policy_chunks", with_ctes(POLICY_CHUNKS, select=CHUNK_SELECT))
def policy_chunks(spark, sf):
    return policy_chunks_df(spark, sf).select(*CHUNK_COLUMNS)


@query("document_chunks", with_ctes(DOCUMENT_CHUNKS, select=CHUNK_SELECT))
def document_chunks(spark, sf):
    return C.chunk_sections(document_sections(spark, sf)).select(*CHUNK_COLUMNS)


STATISTICS = """count(*) as total_chunks, round(avg(length(text)), 6) as avg_chunk_size,
  min(length(text)) as min_chunk_size, max(length(text)) as max_chunk_size, cast(sum(token_count) as bigint) as total_tokens,
  count(distinct section_path) as unique_sections, round(avg(token_count), 6) as avg_tokens,
  cast(min(token_count) as bigint) as min_tokens, cast(max(token_count) as bigint) as max_tokens"""


def rounded(df):
    return df.withColumns({c: F.round(c, 6) for c in ("avg_chunk_size", "avg_tokens") if c in df.columns})


@query("chunk_statistics", with_ctes(DOCUMENT_CHUNKS, select=f"select {STATISTICS} from chunked"))
def chunk_statistics(spark, sf):
    return rounded(C.chunk_statistics(C.chunk_sections(document_sections(spark, sf))))


@query("chunk_statistics_by_document", with_ctes(POLICY_CHUNKS, select=f"select document_id, {STATISTICS} from chunked group by 1"))
def chunk_statistics_by_document(spark, sf):
    return rounded(C.chunk_statistics(policy_chunks_df(spark, sf), ["document_id"]))


@query("clause_statistics", with_ctes(LISTS, f"w as (select {sql_words('c')} as n from (select unnest(clauses) as c from clause_lists))", select="""
  select count(*) as total_clauses, round(avg(n), 6) as avg_tokens, min(n) as min_tokens, max(n) as max_tokens, cast(sum(n) as bigint) as total_tokens from w"""))
def clause_statistics(spark, sf):
    cut = C.section_clauses(policy_sections(spark, sf), SECTION_REPLIES.df(spark, sf))
    return rounded(C.clause_statistics(cut.select(F.explode("clauses").alias("clause"))))


# --- Sources and quality ------------------------------------------------------------------

FILES = Derived(
    "files", "documents", doc_id="doc_id",
    source_uri="concat('/archive/', source, '/Policy ', cast(doc_id as string), '.', case doc_id % 4 when 0 then 'docx' when 1 then 'PDF' when 2 then 'txt' else 'Docx' end)")


@query("folder_scan", with_ctes(FILES.cte, select="""
  select doc_id, source_uri, lower(regexp_extract(source_uri, '\\.([^./\\\\]+)$', 1)) as format from files
  where lower(source_uri) like '%.docx' or lower(source_uri) like '%.pdf'"""))
def folder_scan(spark, sf):
    return L.scan_folder(FILES.df(spark, sf)).withColumn("format", L.extension(F.col("source_uri")))


@query("rejected_formats", with_ctes(FILES.cte, select="""
  select doc_id, source_uri, 'unsupported format: .txt' as reason from files where doc_id % 4 = 2"""))
def rejected_formats(spark, sf):
    return L.dispatch_formats(FILES.df(spark, sf))[1]


@query("registered_documents", with_ctes(FILES.cte, select="""
  select sha256(source_uri) as document_id, regexp_extract(source_uri, '([^/]+)$', 1) as title, 'policy' as type, 'active' as status,
    source_uri, 'internal' as access_tags, '2024-01-01' as effective_date from files"""))
def registered_documents(spark, sf):
    return L.register_documents(FILES.df(spark, sf), "2024-01-01").withColumns(
        {"access_tags": F.array_join("access_tags", ","), "effective_date": F.col("effective_date").cast("string")})


@query("documents_with_text", with_ctes(POLICIES.cte, SECTIONS, select="""
  select document_id, title, case when document_id % 13 <> 5 and document_id in (select document_id from sections) then 'kept' else 'no text' end as outcome from policies"""))
def documents_with_text(spark, sf):
    blank = F.when(F.col("document_id") % 13 == 5, F.lit(" \t ")).otherwise(F.col("content"))
    sections = policy_sections(spark, sf).withColumn("content", blank)
    kept, empty = L.skip_empty(POLICIES.df(spark, sf).select("document_id", "title"), sections)
    return kept.withColumn("outcome", F.lit("kept")).unionByName(empty.withColumnRenamed("reason", "outcome"))


CHECKED = SECTIONS + """,
checked as (select case when ord % 31 = 7 then -document_id else document_id end as document_id, ord as chunk_id, case when ord % 97 = 3 then null else content end as text,
    concat(section_path, ' ', array_to_string(hier, ' > '), ' > Rule ', ord) as clause_ref from sections where not is_heading),
registered as (select c_custkey as document_id, case when c_custkey % 50 = 9 then null else c_name end as title from customer),
broken as (select document_id, chunk_id, 'text is null' as problem from checked where text is null
  union all select document_id, chunk_id, 'clause_ref too long' from checked where length(clause_ref) > 42
  union all select document_id, chunk_id, 'no such document' from checked where document_id not in (select document_id from registered)
  union all select document_id, null, 'title is null' from registered where title is null)"""


def checked_inputs(spark, sf):
    content = policy_sections(spark, sf).filter("not is_heading")
    chunks = content.select(
        F.when(F.col("ord") % 31 == 7, -F.col("document_id")).otherwise(F.col("document_id")).alias("document_id"), F.col("ord").alias("chunk_id"), F.when(F.col("ord") % 97 != 3, F.col("content")).alias("text"),
        F.concat("section_path", F.lit(" "), F.array_join("heading_hierarchy", " > "), F.lit(" > Rule "), F.col("ord").cast("string")).alias("clause_ref"))
    documents = read(spark, sf, "customer").select(
        F.col("c_custkey").alias("document_id"), F.when(F.col("c_custkey") % 50 != 9, F.col("c_name")).alias("title"))
    return chunks, documents


@query("constraint_violations", with_ctes(CHECKED, select="select document_id, chunk_id, problem from broken"))
def constraint_violations(spark, sf):
    chunks, documents = checked_inputs(spark, sf)
    return Q.violations(chunks, documents, clause_ref_limit=42)


@query("rejected_documents", with_ctes(CHECKED, select="""
  select document_id, title, count(*) as n_problems, min(problem) as reason from registered join broken using (document_id) group by all"""))
def rejected_documents(spark, sf):
    chunks, documents = checked_inputs(spark, sf)
    return Q.split_documents(documents, Q.violations(chunks, documents, clause_ref_limit=42))[1].select("document_id", "title", "n_problems", "reason")


@query("chunks_after_delete", with_ctes(CHUNKS, select="select chunk_id, document_id from chunks where document_id % 7 <> 3"))
def chunks_after_delete(spark, sf):
    status = DOCUMENT_STATUS.df(spark, sf)
    chunks = L.line_chunks(read(spark, sf, "documents")).join(status.filter("status = 'active'").select("document_id"), "document_id")
    return Q.cascade(chunks.select("chunk_id", "document_id"), status.filter("document_id % 7 = 3"), "document_id")


@query("rating_violations", "select doc_id as answer_id, cast(doc_id % 7 as int) as rating from labels where doc_id % 7 not between 1 and 5")
def rating_violations(spark, sf):
    return Q.rating_violations(read(spark, sf, "labels").selectExpr("doc_id as answer_id", "cast(doc_id % 7 as int) as rating"))


@query("published_chunks", with_ctes(CHECKED, select="""
  select document_id, chunk_id, text from checked where document_id not in (select document_id from broken where document_id is not null)"""))
def published_chunks(spark, sf):
    """Write two batches, one of them twice, leave a third one without its mark, and read back."""
    chunks, documents = checked_inputs(spark, sf)
    rejected = Q.violations(chunks, documents, clause_ref_limit=42)
    folder, rows = new_folder(spark, "batches"), chunks.select("document_id", "chunk_id", "text")
    for batch, odd in (("a", 0), ("b", 1), ("a", 0)):
        part = rows.filter(F.pmod("document_id", F.lit(2)) == odd)
        T.append_whole_documents(part, part, rejected, folder, batch)
    rows.limit(10).write.parquet(f"{folder}/chunks/batch=c")
    return T.published(spark, folder, "chunks")


@query("loaded_for_graph", with_ctes(POLICIES.cte, select="select document_id as id, title, version, status from policies"))
def loaded_for_graph(spark, sf):
    """Rebuild the stored tables twice and load what the graph needs of them."""
    folder = new_folder(spark, "graph")
    documents = POLICIES.df(spark, sf).select(F.col("document_id").alias("id"), "title", "version", "status", F.current_date().alias("effective_date"), "department")
    for _ in range(2):
        T.rebuild(documents, f"{folder}/documents")
    T.rebuild(documents.select("id", *[F.lit("x").alias(c) for c in ("document_id", "section_path", "clause_ref", "text", "version")]), f"{folder}/chunks")
    T.rebuild(documents.select("id", *[F.lit("x").alias(c) for c in ("type", "name", "document_id", "attrs")]), f"{folder}/entities")
    return T.load_for_graph(spark, folder)["documents"].drop("effective_date")
