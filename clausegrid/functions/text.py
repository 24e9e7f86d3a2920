"""Text expressions. Every function takes and returns Columns and stays in the JVM."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.fixed import CITATION, NOT_SPACE, NOT_TOKEN, SPACE, SPACE_CHARACTERS

# Letters with case, as the title-case and upper-case tests see them.
UPPER = r"\p{IsUppercase}"
LOWER = r"\p{IsLowercase}"
TITLE = r"\p{Lt}"


def tokens(text: Column) -> Column:
    """Lower-cased ASCII letter/digit runs; no stop words are removed."""
    return F.array_remove(F.split(F.lower(text), NOT_TOKEN), "")


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(NOT_SPACE)


def words(text: Column) -> Column:
    """Whitespace-separated words. A split is many times faster here than counting or
    extracting matches of a pattern."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def is_upper(text: Column) -> Column:
    return text.rlike(f"[{UPPER}]") & ~text.rlike(f"[{LOWER}{TITLE}]")


def is_title(text: Column) -> Column:
    """Capitals only after uncased characters, small letters only after cased ones."""
    return (
        text.rlike(f"[{UPPER}{TITLE}]")
        & ~text.rlike(f"(^|[^{UPPER}{LOWER}{TITLE}])[{LOWER}]")
        & ~text.rlike(f"[{UPPER}{LOWER}{TITLE}][{UPPER}{TITLE}]")
    )


def title_case(text: Column) -> Column:
    """Capitalise each run of letters, also after '-' and an apostrophe.

    ``initcap`` only looks at spaces, so the runs are cut out first.
    """
    runs = F.regexp_extract_all(text, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.initcap(r)), "")


def strip_policy_suffix(title: Column) -> Column:
    """Title without a trailing 'policy'; the title itself if nothing is left."""
    bare = strip(F.regexp_replace(title, r"(?i)\s*policy\s*$", ""))
    return F.when(bare == "", title).otherwise(bare)


def preview(text: Column, limit: int = 500) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def parse_number(text: Column) -> Column:
    """Number with thousands commas removed; null when it does not parse."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def contains_any(text: Column, needles: list[str]) -> Column:
    hit = F.lit(False)
    for needle in needles:
        hit = hit | text.contains(needle)
    return hit


def citations(answer: Column) -> Column:
    """Array of (title, clause_ref) cited as ``[Doc: .., Clause: ..]``, in text order."""
    pattern = F.lit(CITATION)
    return F.arrays_zip(
        F.regexp_extract_all(answer, pattern, F.lit(1)).alias("title"),
        F.regexp_extract_all(answer, pattern, F.lit(2)).alias("clause_ref"),
    )


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as the output of a generator, so that filters and projections above use
    their values. Plain columns would be inlined into every filter pushed below them and
    computed again for each use, which hurts when they parse text."""
    row = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*df.columns, F.inline_outer(F.array(row)))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def json_block(reply: Column, opening: str, closing: str) -> Column:
    """The text from the first ``opening`` to the last ``closing`` bracket, '' if none."""
    return F.regexp_extract(reply, rf"(?s)(\{opening}.*\{closing})", 1)


def strict_json(block: Column) -> Column:
    """VARIANT of a JSON text, null when malformed or followed by anything else.

    The parser ignores what follows the first value, so the text is parsed as the only
    element of a list.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), block, F.lit("]")))
    alone = F.try_variant_get(wrapped, "$[1]", "variant").isNull() & (block != "")
    return F.when(alone, F.try_variant_get(wrapped, "$[0]", "variant"))


def iso(ts: Column) -> Column:
    """ISO timestamp; the fraction appears only when it is not zero."""
    fraction = F.date_format(ts, "SSSSSS")
    return F.when(fraction == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    )
