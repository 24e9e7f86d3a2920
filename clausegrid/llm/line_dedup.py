"""Removal of boilerplate lines that many sites share.

The spread of a line is the number of distinct sites that hold it. Only lines that occur at
least as often as the threshold can reach it, so one count per line hash leaves few. Each of
those has a HyperLogLog sketch of its sites, merged by the aggregation; where the estimate
lies within the sketch's error of the threshold, the sites are counted exactly. A line at or
above the threshold is boilerplate: the first document that holds it keeps it, all others
lose it. First means the smallest id, null ids last.

With ``long_sites``, lines of at least ``LONG_WORDS`` words have that lower threshold: a long
passage does not recur by chance, and where one source holds many of the rows its copies
reach few sites.

A line is compared as it stands; lines without a word never count. A null site is no site.
Null text has no lines and stays null. Rows with the same id and text are one document, and
all stay or change alike. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.storage import stored

MIN_SITES = 10
#: Threshold of long lines in the pipeline, and the words from which a line is long.
LONG_SITES = 5
LONG_WORDS = 50
SKETCH_BITS = 12
WORD = r"[^ \t\n\x0B\f\r]"


def _lines(docs: DataFrame, min_sites: int, long_sites: int | None) -> DataFrame:
    """``(_id, _key, _site, pos, h1, h2, least)`` of every line with a word; ``least`` is its threshold."""
    long = (F.length("line") >= 2 * LONG_WORDS - 1) & (F.regexp_count("line", F.lit(WORD + "+")) >= LONG_WORDS)
    least = F.lit(min_sites) if long_sites is None else F.when(long, long_sites).otherwise(min_sites)
    lines = docs.select("_id", "_key", "_site", F.posexplode(F.split("_text", "\n")).alias("pos", "line")).filter(F.col("line").rlike(WORD))
    return lines.select("_id", "_key", "_site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), least.alias("least"))


def boilerplate(occurrences: DataFrame, bits: int = SKETCH_BITS) -> DataFrame:
    """``(h1, h2, first)`` of the lines on at least ``least`` distinct sites."""
    line = ["h1", "h2"]
    order = F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("i"), F.col("_key").alias("k"))
    spread = occurrences.groupBy(*line).agg(
        F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(F.col("_site").cast("string"), bits)), F.lit(0)).alias("sites"), F.min(order).alias("first"), F.min("least").alias("least"))
    margin = F.ceil(F.lit(4 * 1.04 / math.sqrt(1 << bits)) * F.col("least")) + 1
    near = spread.filter(F.abs(F.col("sites") - F.col("least")) <= margin).select(*line)
    exact = occurrences.join(near, line, "left_semi").groupBy(*line).agg(F.countDistinct("_site").alias("exact"))
    return spread.join(exact, line, "left").filter(F.coalesce("exact", "sites") >= F.col("least")).select(*line, "first")


def remove_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES,
    long_sites: int | None = None,
) -> DataFrame:
    """``docs`` with all its columns, the shortened text, and ``n_lines_removed``.

    Without ``long_sites`` long lines have the threshold of all others. A column of that name in ``docs`` is replaced.
    """
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    rows = docs.select(F.col(id_col).alias("_id"), key.alias("_key"), F.col(site_col).alias("_site"), F.col(text_col).alias("_text")).filter("_text is not null")
    lines = _lines(rows, min_sites, long_sites)
    frequent = stored(lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("least").alias("least")).filter("n >= least").select("h1", "h2"), "frequent")
    occurrences = stored(lines.join(frequent, ["h1", "h2"], "left_semi"), "lines")
    shared = stored(boilerplate(occurrences), "boilerplate")  # so that the join can split a hot line
    is_first = F.col("first.k").eqNullSafe(F.col("_key")) & F.col("first.i").eqNullSafe(F.col("_id"))
    lost = (
        occurrences.join(shared, ["h1", "h2"]).filter(~is_first)
        .groupBy("_id", "_key").agg(F.sort_array(F.collect_set("pos")).alias("_at"))
    )
    # One byte per line up to the last lost one, so that each line is looked up at its place.
    gap = lambda i: F.col("_at")[i] - F.coalesce(F.get("_at", i - 1), F.lit(-1)) - 1
    marks = F.transform(F.sequence(F.lit(0), F.size("_at") - 1), lambda i: F.concat(F.repeat(F.lit("0"), gap(i)), F.lit("1")))
    lost = lost.select("_id", "_key", F.size("_at").cast("long").alias("_lost"), F.array_join(marks, "").cast("binary").alias("_marks"))
    out = docs.drop("n_lines_removed").select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), key.alias("_k"))
    joined = out.join(lost, F.col("_k").eqNullSafe(F.col("_key")) & F.col("_i").eqNullSafe(F.col("_id")), "left")
    left = F.filter(F.split(F.col(f"_row.{text_col}"), "\n"), lambda line, i: F.substring("_marks", i + 1, F.lit(1)) != F.lit(b"1"))
    text = F.when(F.col("_lost").isNull(), F.col(f"_row.{text_col}")).otherwise(F.array_join(left, "\n"))
    columns = [text.alias(c) if c == text_col else F.col("_row").getField(c).alias(c) for c in docs.drop("n_lines_removed").columns]
    return joined.select(*columns, F.coalesce("_lost", F.lit(0)).cast("long").alias("n_lines_removed"))


SQL = f"""with l as (select doc_id, source, lines, unnest(range(1, len(lines) + 1)) as i from (select doc_id, source, string_split(text, chr(10)) as lines from documents)),
w as (select doc_id, source, i, lines[i] as line, regexp_matches(lines[i], '[^ \\t\\n\\x0B\\f\\r]') as word from l),
b as (select line, min(doc_id) as first from w where word group by line having count(distinct source) >= {MIN_SITES}),
r as (select w.doc_id, w.i, w.line, b.line is not null and w.doc_id <> b.first as lost from w left join b on w.word and w.line = b.line)
select doc_id, count(*) filter (lost) as n_lines_removed, coalesce(string_agg(line, chr(10) order by i) filter (not lost), '') as text from r group by doc_id"""
