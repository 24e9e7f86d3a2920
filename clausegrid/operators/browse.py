"""Browsing and log queries (B1-B10) and call statistics."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.functions.sizes import BROADCAST_ROWS
from clausegrid.functions.stages import materialise
from clausegrid.functions.text import iso, preview
from clausegrid.operators.ordered import running


def _shown(rows: DataFrame, column: str) -> DataFrame:
    """``column`` as an ISO time, if it is one."""
    return rows.withColumn(column, iso(F.col(column))) if rows.schema[column].dataType.typeName().startswith("timestamp") else rows


def history(queries: DataFrame, user_id=None, limit: int = 50) -> DataFrame:
    """B1: newest questions of one user, or of every user, ``limit`` each; times in ISO form."""
    if user_id is not None:
        newest = queries.filter(F.col("user_id") == user_id).orderBy(F.col("created_at").desc(), F.col("query_id").desc()).limit(limit)
        return _shown(newest, "created_at")
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("query_id").desc())
    return _shown(queries.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= limit), "created_at")


def submit_feedback(feedback: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """B2: (accepted, rejected with ``reason``): the rating is 1..5 and the answer exists."""
    rated = feedback.filter(F.col("rating").between(1, 5))
    bad = feedback.filter(~F.coalesce(F.col("rating").between(1, 5), F.lit(False))).withColumn("reason", F.lit("rating out of range"))
    known = answers.select("answer_id")
    accepted = rated.join(known, "answer_id", "left_semi")
    lost = rated.join(known, "answer_id", "left_anti").withColumn("reason", F.lit("answer not found"))
    return accepted, bad.unionByName(lost)


def feedback_of(answers: DataFrame, feedback: DataFrame) -> DataFrame:
    """Feedback of the given answers."""
    return feedback.join(answers.select("answer_id"), "answer_id", "left_semi")


def audit(log: DataFrame, action: str | None = None, actor: str | None = None, limit: int | None = 100) -> DataFrame:
    """Newest audit rows, optionally of one action or actor; ties by ``audit_id``; times in ISO form."""
    rows = log
    if action:
        rows = rows.filter(F.col("action") == action)
    if actor:
        rows = rows.filter(F.col("actor") == actor)
    rows = rows.orderBy(F.col("ts").desc(), F.col("audit_id").desc())
    return _shown(rows if limit is None else rows.limit(limit), "ts")


def document_list(documents: DataFrame, chunks: DataFrame, entities: DataFrame, limit: int | None = 50, offset: int = 0) -> DataFrame:
    """Documents with chunk and entity counts, newest first."""
    newest = [F.col("created_at").desc(), F.col("document_id").desc()]
    page = documents.orderBy(*newest).offset(offset)
    page = page if limit is None else page.limit(limit)

    def counted(df: DataFrame, name: str) -> DataFrame:
        # A page holds at most ``limit`` documents, so only their rows are counted.
        if limit is not None:
            wanted = page.select("document_id")
            df = df.join(F.broadcast(wanted) if limit <= BROADCAST_ROWS else wanted, "document_id", "left_semi")
        return df.groupBy("document_id").agg(F.count("*").alias(name))

    return (
        page.join(counted(chunks, "chunk_count"), "document_id", "left").join(counted(entities, "entity_count"), "document_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chunk_count", "entity_count")})
        .orderBy(*newest)
    )


def document_detail(documents: DataFrame, chunks: DataFrame, entities: DataFrame, part_span: int = 1000) -> DataFrame:
    """Documents with nested chunks (by section path as text, then ``ord``) and nested
    entities (by type, then ``ord``).

    Each row holds the items of one ``kind`` ('chunks' or 'entities') and ``section`` (path
    or type) whose ``ord`` lies in its ``part``, a span of ``part_span`` numbers, at every
    size; a document without items has one row without a kind. Sorting by kind, section and
    part gives the whole order. Entities of the same ``ord`` go by their id.
    """
    part = F.floor(F.col("ord") / part_span).cast("long").alias("part")

    def nested(rows: DataFrame, kind: str, section: str, key: str, fields: list[str]) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("ord", *[F.col(f) for f in (key, *fields)])))
        out = rows.groupBy("document_id", F.lit(kind).alias("kind"), F.col(section).alias("section"), part).agg(items.alias("_items"))
        return out.select("document_id", "kind", "section", "part", F.transform("_items", lambda r: F.struct(*[r[f].alias(f) for f in (key, *fields)])).alias(kind))

    c = nested(chunks, "chunks", "section_path", "chunk_id", ["section_path", "clause_ref", "text", "token_count"])
    e = nested(entities, "entities", "type", "entity_id", ["type", "name"])
    return documents.join(c.unionByName(e, allowMissingColumns=True), "document_id", "left")


def search_chunks(
    chunks: DataFrame, search: str | None = None, document_id=None, limit: int | None = 50, offset: int = 0
) -> DataFrame:
    """Chunks whose reference or text matches ``%search%`` (case ignored, wildcards in
    the input work), by section path, with the total before paging and a text preview."""
    rows = chunks
    if document_id is not None:
        rows = rows.filter(F.col("document_id") == document_id)
    if search:
        rows = rows.filter(F.col("clause_ref").ilike(f"%{search}%") | F.col("text").ilike(f"%{search}%"))
    total = rows.agg(F.count("*").alias("n")).scalar()
    page = rows.orderBy("section_path", "document_id", "chunk_id").offset(offset)
    page = page if limit is None else page.limit(limit)
    return page.withColumns({"text": preview(F.col("text")), "total": total})


def chunk_detail(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks with their document's title, null where there is no document."""
    return chunks.join(documents.select("document_id", F.col("title").alias("document_title")), "document_id", "left")


def browse_entities(entities: DataFrame, type: str | None = None, document_id=None, limit: int | None = 100) -> DataFrame:
    """Newest entities, optionally of one type or document."""
    rows = entities
    if type:
        rows = rows.filter(F.col("type") == type)
    if document_id is not None:
        rows = rows.filter(F.col("document_id") == document_id)
    rows = rows.orderBy(F.col("created_at").desc(), F.col("entity_id").desc())
    return rows if limit is None else rows.limit(limit)


def allowed(level: Column, needed: int = 3) -> Column:
    """Access level at least ``needed``; a missing level is 1."""
    return F.coalesce(level, F.lit(1)) >= needed


def call_outcomes(calls: DataFrame) -> DataFrame:
    """Calls ``(tool, success, latency_ms)``: count, success rate and exact latency
    percentiles, the least latency that such a share of the tool's latencies does not exceed.

    Calls are first counted by latency, on the map side, and ranks are running totals of the
    counts, so no task holds the calls or latencies of a tool.
    """
    key = F.struct("tool")  # equal to itself for a null tool
    counted = materialise(calls.groupBy(key.alias("_key"), "latency_ms").agg(
        F.count("*").alias("calls"), F.count_if(F.col("success")).alias("succeeded"), F.count("success").alias("judged")))
    totals = counted.groupBy("_key").agg(
        F.sum("calls").alias("calls"), F.try_divide(F.sum("succeeded"), F.sum("judged")).alias("success_rate"),
        F.max("latency_ms").alias("max_ms"), F.sum(F.when(F.col("latency_ms").isNotNull(), F.col("calls"))).alias("timed"))
    ranked = running(counted.filter("latency_ms is not null").select("_key", "latency_ms", "calls"), ["_key"], "latency_ms", sums={"up_to": F.col("calls")})
    placed = ranked.select("_key", "latency_ms", "up_to").join(totals.select("_key", "timed"), "_key")

    def share(percent: int) -> Column:
        return F.min(F.when(F.col("up_to") >= F.ceil(F.col("timed") * percent / F.lit(100).cast("decimal(3,0)")), F.col("latency_ms")))

    found = placed.groupBy("_key").agg(share(50).alias("p50_ms"), share(95).alias("p95_ms"))
    return totals.join(found, "_key", "left").select(F.col("_key.tool").alias("tool"), "calls", "success_rate", "p50_ms", "p95_ms", "max_ms")


#: Entries per level of a sketch, and the rank error it keeps with 99 % confidence.
SKETCH_K, RANK_ERROR = 400, 0.01


def call_sketches(calls: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """Calls ``(tool, day, success, latency_ms)`` as one row per tool and day: counts, the
    greatest latency and a KLL sketch of all latencies. Sketches are merged on the map side,
    so no task holds the calls of a tool. Store them by day and later spans need no calls."""
    return calls.groupBy("tool", "day").agg(
        F.count("*").alias("calls"), F.count_if(F.col("success")).alias("succeeded"), F.count("success").alias("judged"),
        F.max("latency_ms").alias("max_ms"), F.kll_sketch_agg_bigint("latency_ms", F.lit(k)).alias("sketch"))


def outcomes_of_sketches(sketches: DataFrame) -> DataFrame:
    """``call_outcomes`` of the days in ``sketches``, from merged sketches alone; the
    percentiles are latencies whose rank is within ``RANK_ERROR``."""
    merged = sketches.groupBy("tool").agg(
        F.sum("calls").alias("calls"), (F.sum("succeeded") / F.sum("judged")).alias("success_rate"),
        F.max("max_ms").alias("max_ms"), F.kll_merge_agg_bigint("sketch").alias("_all"))

    def share(p: float) -> Column:
        return F.kll_sketch_get_quantile_bigint("_all", F.lit(p))

    return merged.select("tool", "calls", "success_rate", share(0.5).alias("p50_ms"), share(0.95).alias("p95_ms"), "max_ms")
