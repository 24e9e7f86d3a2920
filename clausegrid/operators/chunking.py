"""Sections to clauses to chunks (D10-D16) and their statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.fixed import MAX_CLAUSE_WORDS, OVERLAP_WORDS
from clausegrid.functions.stages import stored
from clausegrid.functions.text import is_blank, json_block, once, strict_json, strip, word_count, words
from clausegrid.operators.ordered import BLOCK_ROWS, running

SENTENCE_END = r"(?<=[.!?])[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def reply_clauses(reply: Column) -> Column:
    """Non-blank strings of the JSON list in a reply, stripped; null if there is none."""
    parsed = strict_json(json_block(reply, "[", "]"))
    items = F.when(F.schema_of_variant(parsed).startswith("ARRAY"), parsed.cast("array<variant>"))
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: v.cast("string"))
    kept = F.transform(F.filter(texts, lambda t: ~is_blank(t)), strip)
    return bind(kept, lambda k: F.when(F.size(k) > 0, k))


def section_clauses(sections: DataFrame, replies: DataFrame | None = None) -> DataFrame:
    """Content sections with ``clauses``; headings and blank sections give none.

    ``replies`` is ``(document_id, ord, reply)``; without a usable reply the section is
    one clause.
    """
    content = sections.filter(~F.col("is_heading") & ~is_blank(F.col("content")))
    whole = F.array("content")
    if replies is None:
        return content.withColumn("clauses", whole)
    joined = content.join(replies.select("document_id", "ord", "reply"), ["document_id", "ord"], "left")
    return once(joined, clauses=F.coalesce(reply_clauses(F.col("reply")), whole)).drop("reply")


def bind(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def tail_of(text: Column, overlap: int) -> Column:
    """Last ``overlap`` words, or the text as it is when it has no more than that."""
    return bind(
        words(text),
        lambda w: F.when(F.size(w) > overlap, F.array_join(F.slice(w, -overlap, overlap), " ")).otherwise(text),
    )


def overlapped(clauses: Column, overlap: int = OVERLAP_WORDS) -> Column:
    """Every clause but the first is prefixed with the tail of the one before it."""

    def step(state, clause):
        prefixed = F.when(F.size(state["done"]) == 0, clause).otherwise(F.concat(state["tail"], F.lit(" "), clause))
        return bind(
            prefixed,
            lambda t: F.struct(F.concat(state["done"], F.array(t)).alias("done"), tail_of(t, overlap).alias("tail")),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("tail"))
    many = F.aggregate(clauses, start, step, lambda s: s["done"])
    return F.when(F.size(clauses) <= 1, clauses).otherwise(many)


def split_long(text: Column, limit: int = MAX_CLAUSE_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Sentences packed greedily into pieces of at most ``limit`` words.

    After a cut every later sentence starts with the tail of the last sentence before the
    cut; the sentence that causes a cut still starts with the older tail. A sentence
    above the limit stays whole.
    """
    sentences = F.split(strip(text), SENTENCE_END)

    def step(state, sentence):
        prefixed = F.when(state["tail"] != "", F.concat(state["tail"], F.lit(" "), sentence)).otherwise(sentence)
        return bind(prefixed, lambda own: bind(word_count(own), lambda size: packed(state, own, size)))

    def packed(state, own, size):
        cut = (state["size"] + size > limit) & (state["last"] != "")
        return F.when(
            cut,
            F.struct(
                F.concat(state["done"], F.array(state["open"])).alias("done"), own.alias("open"), own.alias("last"),
                size.alias("size"), tail_of(state["last"], overlap).alias("tail"),
            ),
        ).otherwise(
            F.struct(
                state["done"].alias("done"),
                F.when(state["last"] == "", own).otherwise(F.concat(state["open"], F.lit(" "), own)).alias("open"),
                own.alias("last"), (state["size"] + size).alias("size"), state["tail"].alias("tail"),
            )
        )

    start = F.struct(
        F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit("").alias("last"),
        F.lit(0).alias("size"), F.lit("").alias("tail"),
    )
    return F.aggregate(sentences, start, step, lambda s: F.concat(s["done"], F.array(s["open"])))


def chunk_sections(
    sections: DataFrame,
    replies: DataFrame | None = None,
    max_words: int = MAX_CLAUSE_WORDS,
    overlap: int = OVERLAP_WORDS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Chunks ``(document_id, ord, piece, section_path, clause_ref, ...)``.

    Clause numbers run on per (document, path). A clause that is split uses one number
    itself and one per piece.
    """
    cut = once(section_clauses(sections, replies).withColumnRenamed("clauses", "_own"), clauses=overlapped(F.col("_own"), overlap))

    def pieces(clause: Column) -> Column:
        return bind(word_count(clause) > max_words, lambda long: F.struct(
            long.alias("long"), F.when(long, split_long(clause, max_words, overlap)).otherwise(F.array(clause)).alias("texts")))

    def used(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda n, p: n + F.when(p["long"], 1 + F.size(p["texts"])).otherwise(1))

    # The texts are cut once and stored, as the numbering reads their counts twice.
    cut = once(once(cut, parts=F.transform("clauses", pieces)), _used=used(F.col("parts")))
    cut = stored(cut.select("document_id", "ord", "section_path", "heading_hierarchy", "page", "is_table", "parts", "_used"), "pieces")
    numbered = running(cut, ["document_id", "section_path"], "ord", sums={"_upto": F.col("_used")}, block_rows=block_rows)
    placed = F.transform("parts", lambda p, i: F.struct(
        (used(F.slice("parts", F.lit(1), i)) + F.when(p["long"], 1).otherwise(0)).alias("before"), p["texts"].alias("texts")))
    clauses = numbered.select(
        "document_id", "ord", "section_path", "heading_hierarchy", "page", "is_table",
        (F.col("_upto") - F.col("_used")).alias("_base"), F.posexplode_outer(placed).alias("clause_no", "p"),
    )
    chunks = clauses.select(
        "document_id", "ord", "clause_no", "section_path", "heading_hierarchy", "page", "is_table",
        (F.col("_base") + F.col("p.before")).alias("_before"), F.posexplode_outer("p.texts").alias("piece", "text"),
    )
    number = (F.col("_before") + F.col("piece") + 1).cast("long")
    hierarchy = F.when(F.size("heading_hierarchy") > 0, F.array_join("heading_hierarchy", " > ")).otherwise("Content")
    return chunks.select(
        "document_id", "ord", "clause_no", "piece", "section_path",
        F.concat("section_path", F.lit(" "), hierarchy, F.lit(" > Rule "), number.cast("string")).alias("clause_ref"),
        "heading_hierarchy", "text", word_count(F.col("text")).alias("token_count"), "page",
        number.alias("clause_number"), "is_table",
    )


def chunk_statistics(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and sizes of chunks, overall or per ``by``; zeros on empty input."""
    size = F.length("text")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return chunks.groupBy(*(by or [])).agg(
        F.count("*").alias("total_chunks"), zero(F.avg(size)).alias("avg_chunk_size"),
        zero(F.min(size)).cast("long").alias("min_chunk_size"), zero(F.max(size)).cast("long").alias("max_chunk_size"),
        zero(F.sum("token_count")).cast("long").alias("total_tokens"), F.countDistinct("section_path").alias("unique_sections"),
        zero(F.avg("token_count")).alias("avg_tokens"), zero(F.min("token_count")).cast("long").alias("min_tokens"),
        zero(F.max("token_count")).cast("long").alias("max_tokens"),
    )


def clause_statistics(clauses: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and word totals of clauses ``(clause)``; zeros on empty input."""
    n = word_count(F.col("clause"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return clauses.groupBy(*(by or [])).agg(
        F.count("*").alias("total_clauses"), zero(F.avg(n)).alias("avg_tokens"), zero(F.min(n)).cast("long").alias("min_tokens"),
        zero(F.max(n)).cast("long").alias("max_tokens"), zero(F.sum(n)).cast("long").alias("total_tokens"),
    )
