"""Entity extraction by pattern (X1-X5) over sections ``(document_id, ord, content)``."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegrid.functions import fixed
from clausegrid.functions.sizes import small_side
from clausegrid.functions.stages import materialise
from clausegrid.functions.text import words
from clausegrid.operators.ordered import BLOCK_ROWS, running, with_neighbours

ATTRS = ("struct<amount:double,currency:string,authority:string,days:bigint,"
         "requirement:string,original_text:string>")
TYPES = ["threshold", "approval", "deadline", "requirement"]

# A line that may leave a match open: it ends in the beginning of one of the patterns.
OPEN_END = (
    r"(?iU)(NGN|USD|EUR|GBP|₦|\$|€|£|Manager|Director|CFO|CEO|VP|Head of|Lead"
    r"|(every|within|after|before)(\s+\d+)?|(must|required|mandatory|shall)(\s+\w+)?)\s*\z"
)
OPEN_CHARACTER = r"(?U)[\w\s₦$€£]"
ONE_WORD = r"(?U)^\s*\w+\s*\z"
GOES_ON = r"(?U)^\s*[\w,]"


def text_runs(sections: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(document_id, ord, text): the document text cut where no match can cross.

    The patterns are meant for the whole text with lines joined by newline, so a match may
    span lines. Almost every line break is safe: the line does not end in an opening of a
    pattern, or the next one cannot continue it. Lines around unsafe breaks are joined;
    all others stand alone, so no document is ever put together in one place.
    """
    text = F.col("content")
    # The cheap test first: most lines end in a full stop.
    opens = F.substring(text, -1, 1).rlike(OPEN_CHARACTER) & (text.rlike(OPEN_END) | text.rlike(ONE_WORD))
    marks = sections.select("document_id", "ord", F.coalesce(opens, F.lit(False)).alias("opens"), F.coalesce(text.rlike(GOES_ON), F.lit(False)).alias("goes"))
    near = with_neighbours(marks, ["document_id"], "ord", ["opens", "goes"], 1, 1, block_rows)

    def neighbour(side: str, mark: str) -> Column:
        return F.coalesce(F.get(F.col(side), 0)[mark], F.lit(False))

    flagged = near.select(
        "document_id", "ord", (neighbour("prev", "opens") & F.col("goes")).alias("joined"),
        (F.col("opens") & neighbour("next", "goes")).alias("goes_on"),
    ).filter("joined or goes_on")
    linked = running(
        flagged, ["document_id"], "ord", lasts={"run": F.when(~F.col("joined"), F.col("ord"))}, block_rows=block_rows,
    )
    # Few lines are linked, so the texts of the others are not shuffled for them.
    linked = materialise(linked.select(F.col("document_id").alias("_d"), F.col("ord").alias("_o"), "run"))
    few = small_side(linked, F.lit(60))
    same = F.col("document_id").eqNullSafe(F.col("_d")) & (F.col("ord") == F.col("_o"))
    rows = sections.select("document_id", "ord", "content")
    alone = rows.join(few, same, "left_anti").select("document_id", "ord", F.col("content").alias("text"))
    linked = rows.join(few, same)
    lines = F.array_sort(F.collect_list(F.struct("ord", "content")))
    together = linked.groupBy("document_id", "run").agg(
        F.array_join(F.transform(lines, lambda s: s["content"]), "\n").alias("text")
    )
    return alone.unionByName(together.select("document_id", F.col("run").alias("ord"), "text"))


def matches(text: Column, pattern: str, ignore_case: bool = True) -> Column:
    return F.regexp_extract_all(text, F.lit(("(?iU)" if ignore_case else "(?U)") + pattern), F.lit(1))


def _typed(number: int, found: Column) -> Column:
    return F.transform(found, lambda m, i: F.struct(F.lit(number).alias("type_no"), i.alias("pos"), m.alias("match")))


def _attributes() -> Column:
    kind, match = F.col("type_no"), F.col("match")
    naira = match.contains("NGN") | match.contains("₦")
    return F.struct(
        F.when(kind == 0, F.regexp_replace(match, r"(?U)[^\d.]", "").try_cast("double")).alias("amount"),
        F.when(kind == 0, F.when(naira, "NGN").otherwise("USD")).alias("currency"),
        F.when(kind == 1, F.get(words(match), 0)).alias("authority"),
        F.when(kind == 2, match.try_cast("long")).alias("days"),
        F.when(kind == 3, match).alias("requirement"),
        match.alias("original_text"),
    ).cast(ATTRS)


def extract_entities(
    sections: DataFrame, per_document: int = fixed.REQUIREMENTS_PER_DOCUMENT, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """(entity_id, type, name, document_id, attrs, seq); ``seq`` orders entities as
    the scan finds them: document, type, place."""
    runs = text_runs(sections, block_rows)
    text = F.col("text")
    # The outer generators keep the pattern work in the generator: an inner one would have
    # a size filter pushed below it that runs every pattern a second time. Rows without a
    # match, and thresholds without a digit, go in the filters.
    first_three = F.concat(
        _typed(0, matches(text, fixed.THRESHOLD, ignore_case=False)),
        _typed(1, matches(text, fixed.APPROVAL)),
        _typed(2, matches(text, fixed.DEADLINE)),
    )
    found = runs.select("document_id", "ord", F.inline_outer(first_three)).filter(
        (F.col("type_no") != 0) | F.col("match").rlike(r"(?U)\d")
    )
    # The first few of each document: no run can give more than that many.
    some = F.slice(matches(text, fixed.REQUIREMENT), 1, per_document)
    place = Window.partitionBy("document_id").orderBy("ord", "pos")
    required = (
        runs.select("document_id", "ord", F.inline_outer(_typed(3, some))).filter("match is not null")
        .withColumn("_n", F.row_number().over(place)).filter(F.col("_n") <= per_document).drop("_n")
    )
    names = F.array(*[F.lit(t) for t in TYPES])
    labels = F.array(F.lit("Monetary Threshold: "), F.lit("Approval Authority: "), F.lit("Time Deadline: "), F.lit("Requirement: "))
    kind = names[F.col("type_no")]
    return found.unionByName(required).select(
        F.concat_ws(":", F.col("document_id").cast("string"), kind, F.col("ord").cast("string"), F.col("pos").cast("string")).alias("entity_id"),
        kind.alias("type"),
        F.concat(labels[F.col("type_no")], "match", F.when(F.col("type_no") == 2, " days").otherwise("")).alias("name"),
        "document_id", _attributes().alias("attrs"),
        F.struct("document_id", "type_no", "ord", "pos").alias("seq"),
    )
