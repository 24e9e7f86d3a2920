"""Document structure (D1-D9): headings, section numbers, hierarchy, tables, full text.

Input is a lines table ``(document_id, ord, page, style, text, format)`` with unique
(document_id, ord); ``format`` is 'docx' (styled lines) or 'pdf' (plain lines).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.fixed import HEADING_LEVELS
from clausegrid.functions.text import is_title, is_upper, strip, word_count
from clausegrid.operators.ordered import BLOCK, BLOCK_ROWS, earlier_blocks, inside, running, with_block

LEVELS = range(1, HEADING_LEVELS + 1)


def styled_level(style: Column) -> Column:
    """Level of a styled heading, null for content. No number means 1; capped at 5."""
    number = F.regexp_extract(style, r"Heading (\d+)", 1).try_cast("int")
    return F.when(
        style.contains("Heading"), F.greatest(F.least(F.coalesce(number, F.lit(1)), F.lit(HEADING_LEVELS)), F.lit(1))
    )


def plain_level(line: Column) -> Column:
    """Level of a heading among plain lines (already stripped), null for content."""
    candidate = (F.length(line) < 80) & ~line.endswith(".")
    numbered = line.rlike(r"^\p{Nd}+\.?\s+[A-Z]")
    dots = F.length(line) - F.length(F.replace(line, F.lit("."), F.lit("")))
    shouted = is_upper(line) | (is_title(line) & (word_count(line) <= 5))
    return F.when(candidate & numbered, F.least(dots + 1, F.lit(HEADING_LEVELS))).when(candidate & shouted, F.lit(1))


def mark_headings(lines: DataFrame) -> DataFrame:
    """Stripped non-blank lines with ``level`` (null for content)."""
    clean = lines.withColumn("text", strip(F.col("text"))).filter("text <> ''")
    return clean.withColumn(
        "level", F.when(F.col("format") == "docx", styled_level(F.col("style"))).otherwise(plain_level(F.col("text")))
    )


def number_sections(marked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Section path, hierarchy and level of every line.

    Counter k at a line is the number of level-k headings so far, less that number at the
    last heading of a smaller level. Entry k of the heading stack is the last heading of
    level <= k, if its level is exactly k. Both are running values, computed inside
    blocks of a document and completed by what the earlier blocks carry in.
    """
    keys, level = ["document_id"], F.col("level")
    within, before = inside(keys, "ord"), earlier_blocks(keys)
    local = with_block(marked, "ord", block_rows)
    local = local.withColumns({f"t{k}": F.count_if(level == k).over(within) for k in LEVELS})
    local = local.withColumns({
        **{f"b{k}": F.max(F.when(level < k, F.col(f"t{k}"))).over(within) for k in LEVELS},
        **{f"s{k}": F.last(F.when(level <= k, F.struct("level", "text")), ignorenulls=True).over(within) for k in LEVELS},
    })
    names = [f"{c}{k}" for k in LEVELS for c in "tbs"]
    ends = local.groupBy("document_id", BLOCK).agg(F.max_by(F.struct(*names), "ord").alias("e"))
    # Counts before each block, then the resets seen in earlier blocks as absolute counts.
    offsets = ends.withColumns({f"o{k}": F.coalesce(F.sum(f"e.t{k}").over(before), F.lit(0)) for k in LEVELS})
    carry = offsets.select(
        "document_id", BLOCK, *[f"o{k}" for k in LEVELS], F.count("*").over(before).alias("_blocks"),
        *[F.max(F.col(f"o{k}") + F.col(f"e.b{k}")).over(before).alias(f"pb{k}") for k in LEVELS],
        *[F.last(f"e.s{k}", ignorenulls=True).over(before).alias(f"ps{k}") for k in LEVELS],
    ).filter("_blocks > 0").drop("_blocks")
    whole = local.join(carry, ["document_id", BLOCK], "left")

    def counter(k: int) -> Column:
        offset = F.coalesce(F.col(f"o{k}"), F.lit(0))
        reset = F.coalesce(F.greatest(offset + F.col(f"b{k}"), F.col(f"pb{k}")), F.lit(0))
        return offset + F.col(f"t{k}") - reset

    def entry(k: int) -> Column:
        last = F.coalesce(F.col(f"s{k}"), F.col(f"ps{k}"))
        return F.when(last["level"] == k, last["text"])

    counters = F.filter(F.array(*[counter(k) for k in LEVELS]), lambda c: c > 0)
    out = whole.withColumns({
        "section_path": F.array_join(counters.cast("array<string>"), "."),
        "heading_hierarchy": F.array_compact(F.array(*[entry(k) for k in LEVELS])),
    })
    headless = (F.size("heading_hierarchy") == 0) & (F.col("format") == "docx")
    return out.select(
        "document_id", "ord",
        F.when(headless, "0").otherwise(F.col("section_path")).alias("section_path"),
        F.when(headless, F.array(F.lit("Document Header"))).otherwise(F.col("heading_hierarchy")).alias("heading_hierarchy"),
        F.col("text").alias("content"),
        F.coalesce(level, F.size("heading_hierarchy")).alias("section_level"),
        level.isNotNull().alias("is_heading"),
        F.lit(False).alias("is_table"),
        F.when(F.col("format") == "pdf", F.col("page")).alias("page"),
        "format",
    )


def table_text(rows: Column) -> Column:
    """Rows (array of arrays of cells) as text: cells stripped, ' | ', newlines."""
    return F.array_join(F.transform(rows, lambda cells: F.array_join(F.transform(cells, strip), " | ")), "\n")


def append_tables(sections: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables ``(document_id, table_no, rows)`` follow all lines of their document and
    carry its last path and hierarchy; blank ones are dropped.

    ``ord`` of a table is shifted above every line, so order stays (document_id, ord).
    """
    end = sections.groupBy("document_id").agg(
        F.max_by(F.struct("section_path", "heading_hierarchy", "section_level", "is_heading"), "ord").alias("e"),
    )
    text = tables.withColumn("content", table_text(F.col("rows"))).filter(strip(F.col("content")) != "")
    placed = text.join(end, "document_id", "left").select(
        "document_id", (F.col("table_no") + F.lit(1 << 40)).alias("ord"),
        F.coalesce("e.section_path", F.lit("0")).alias("section_path"),
        F.coalesce("e.heading_hierarchy", F.array(F.lit("Document Header"))).alias("heading_hierarchy"),
        "content",
        F.when(F.col("e.section_path").isNull() | (F.col("e.section_path") == "0"), 0)
        .otherwise(F.size("e.heading_hierarchy")).alias("section_level"),
        F.lit(False).alias("is_heading"), F.lit(True).alias("is_table"),
        F.lit(None).cast("int").alias("page"), F.lit("docx").alias("format"),
    )
    return sections.unionByName(placed)


def parse_structure(lines: DataFrame, tables: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The sections table of all documents."""
    sections = number_sections(mark_headings(lines), block_rows)
    return sections if tables is None else append_tables(sections, tables)


def full_text(sections: DataFrame, part_span: int = 1000) -> DataFrame:
    """Contents joined by newline in document order, as (document_id, part, text).

    A part holds the sections whose ``ord`` lies in its span of ``part_span`` numbers,
    whatever the size of the document, so no row has to hold all of a long one. Joining the
    parts in order by newline gives the text.
    """
    lines = F.array_sort(F.collect_list(F.struct("ord", "content")))
    return sections.groupBy("document_id", F.floor(F.col("ord") / part_span).cast("long").alias("part")).agg(
        F.array_join(F.transform(lines, lambda s: s["content"]), "\n").alias("text")
    )
