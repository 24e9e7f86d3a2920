"""Answers: citations, verification, verdict, confidence, logs, chat context.

Answers are ``(query_id, answer)``; hits are ranked top-k lists with ``title``,
``clause_ref`` and ``score``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.functions import fixed
from clausegrid.functions.text import citations, once, sigmoid
from clausegrid.operators.ordered import BLOCK_ROWS, with_neighbours


def cited(answers: DataFrame) -> DataFrame:
    """(query_id, pos, title, clause_ref), one row per citation, repeats kept."""
    return answers.select("query_id", F.posexplode_outer(citations(F.col("answer"))).alias("pos", "c")).filter("c is not null").select(
        "query_id", "pos", F.col("c.title").alias("title"), F.col("c.clause_ref").alias("clause_ref"))


def _valid_pairs(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "title", F.coalesce("clause_ref", F.lit("N/A")).alias("clause_ref")).distinct()


def checked_citations(answers: DataFrame, hits: DataFrame) -> DataFrame:
    """Citations with ``valid``: the pair is among the retrieved ones."""
    return cited(answers).join(_valid_pairs(hits).withColumn("_hit", F.lit(True)), ["query_id", "title", "clause_ref"], "left").select(
        "query_id", "pos", "title", "clause_ref", F.col("_hit").isNotNull().alias("valid"))


def confidence(top_score: Column, n_hits: Column, found: Column, valid: Column, insufficient: Column) -> Column:
    """Weighted score, coverage and availability in percent, one decimal, half even."""
    score = F.when(n_hits > 0, sigmoid(F.coalesce(top_score, F.lit(0.0)))).otherwise(0.0)
    coverage = F.when(found > 0, valid / found).when(insufficient, 1.0).otherwise(0.0)
    share = F.least(n_hits / 3.0, F.lit(1.0))
    total = score * fixed.WEIGHT_SCORE + coverage * fixed.WEIGHT_COVERAGE + share * fixed.WEIGHT_CHUNKS
    return F.bround(total * 100, 1)


def judge_answers(questions: DataFrame, answers: DataFrame, hits: DataFrame, strict: bool = False) -> DataFrame:
    """One row per question: validity and message, verdict, confidence, state.

    No hits is a failure: abstained, confidence 0, state 'abstained'. An answer that fails
    verification is abstained too, but its state is 'done'. ``strict`` also abstains an
    answer without a citation.
    """
    # A question has at most k hits, so its citations meet them within one row. The window takes one
    # sort, where an aggregation to lists would sort before its shuffle too.
    ranked = Window.partitionBy("query_id").orderBy("rank")
    pair = F.struct("title", F.coalesce("clause_ref", F.lit("N/A")).alias("clause_ref"))
    pool = hits.select("query_id", "rank", F.struct("score", pair.alias("pair")).alias("hit")).select(
        "query_id", F.collect_list("hit").over(ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("met"),
        F.row_number().over(ranked).alias("n")).filter("n = 1").drop("n")
    met = questions.select("query_id").join(answers.select("query_id", "answer"), "query_id", "left").join(pool, "query_id", "left")
    read = once(met, cites=citations(F.col("answer")))
    read = once(read, bads=F.filter("cites", lambda c: ~F.coalesce(F.array_contains("met.pair", c), F.lit(False))))
    wide = read.select(
        "query_id", "answer", F.get("met", F.lit(0))["score"].alias("top_score"), F.coalesce(F.array_size("met"), F.lit(0)).alias("n_hits"),
        F.get("bads", F.lit(0)).alias("bad"),
        F.coalesce(F.array_size("cites"), F.lit(0)).alias("found"), F.coalesce(F.array_size("cites") - F.array_size("bads"), F.lit(0)).alias("valid"))
    failed = (F.col("n_hits") == 0) | F.col("answer").isNull()
    insufficient = F.coalesce(F.col("answer"), F.lit("")).contains(fixed.ABSTAIN_WORD)
    ok = F.col("bad").isNull()
    uncited = (F.col("found") == 0) & ~insufficient if strict else F.lit(False)
    message = F.when(ok, "All citations verified.").otherwise(
        F.concat_ws(" ", F.lit("Invalid citation found:"), "bad.title", "bad.clause_ref"))
    return wide.select(
        "query_id", F.when(failed, "").otherwise(F.col("answer")).alias("answer"),
        F.when(~failed, ok).alias("is_valid"), F.when(~failed, message).alias("message"),
        F.when(failed | ~ok | insufficient | uncited, "abstained").otherwise("clear").alias("verdict"),
        F.when(failed, 0.0).otherwise(confidence(
            F.col("top_score"), F.col("n_hits"), F.col("found"), F.col("valid"), insufficient)).alias("confidence"),
        failed.alias("abstained"), F.when(failed, "abstained").otherwise("done").alias("state"),
        F.when(F.col("n_hits") == 0, "No relevant policy clauses found").alias("error"),
    )


def latency_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps, cut, not rounded."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / 1000).cast("long")


def citation_rows(hits: DataFrame) -> DataFrame:
    """P20: one citation row per retrieved chunk, cited in the answer or not."""
    return hits.select(
        F.concat(F.lit("a"), F.col("query_id").cast("string")).alias("answer_id"), "chunk_id", "document_id", "clause_ref",
        F.coalesce("score", F.lit(0.0)).alias("score"))


def log_rows(questions: DataFrame, judged: DataFrame, hits: DataFrame, model_version: str) -> dict[str, DataFrame]:
    """Rows to append to queries, answers, citations and audit_log.

    ``questions`` carries user_id, level, dept, question, intent, started, finished.
    """
    wide = questions.join(judged, "query_id")
    answer_id = F.concat(F.lit("a"), F.col("query_id").cast("string")).alias("answer_id")
    return {
        "queries": questions.select(
            "query_id", "user_id", F.concat(F.lit("level_"), F.col("level").cast("string")).alias("role"), "dept", "question", "intent",
            F.col("started").alias("created_at")),
        "answers": wide.select(
            answer_id, "query_id", "answer", "verdict", "confidence", "abstained",
            latency_ms(F.col("started"), F.col("finished")).alias("latency_ms"), F.lit(model_version).alias("model_version"),
            F.col("finished").alias("created_at")),
        "citations": citation_rows(hits),
        "audit_log": wide.select(
            F.col("user_id").alias("actor"), F.lit("query").alias("action"),
            F.to_json(F.struct(F.substring("question", 1, 100).alias("question"), "verdict", "confidence", "intent")).alias("payload"),
            F.col("finished").alias("ts")),
    }


def chat_questions(
    turns: DataFrame, key: str = "conversation_id", keep: int = 5, user: str = "User", assistant: str = "Assistant",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each question with the last ``keep`` earlier question/answer pairs of its
    conversation in front; the first question of a conversation stays as it is.

    ``turns`` is ``(conversation_id, ord, question, answer)``.
    """
    near = with_neighbours(turns, [key], "ord", ["question", "answer"], keep, 0, block_rows)
    lines = F.transform("prev", lambda t: F.concat(
        F.lit(f"{user}: "), t["question"], F.lit(f"\n{assistant}: "), F.coalesce(t["answer"], F.lit(""))))
    told = F.concat(F.lit("Conversation History:\n"), F.array_join(lines, "\n"), F.lit("\n\nQuestion: "), "question")
    return near.select(key, "ord", F.when(F.size("prev") > 0, told).otherwise(F.col("question")).alias("full_question"))
