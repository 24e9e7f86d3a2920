"""Jobs around a model (L1-L6): prompt tables out, reply tables in. No model is called."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.text import json_block, once, strict_json, strip, title_case

FIELDS = ["role", "department", "process", "threshold", "regulation", "obligation"]
CONFLICT_TEXT_BUILD, CONFLICT_TEXT_ASK, RISK_TEXT, RISK_CHUNKS = 300, 400, 500, 3

# Default wordings; each prompt function takes its own template instead.
SPLIT_TEMPLATE = "List the separate rules of this section as a JSON array of strings, in its own words.\n\n%s"
EXTRACT_TEMPLATE = ("Give the role, department, process, threshold, regulation and obligation of this clause as one "
                    "JSON object, null where absent.\n\n%s")
CONFLICT_TEMPLATE = "Do these two clauses contradict each other? Answer yes or no.\n\nFIRST: %s\nSECOND: %s"
RISK_TEMPLATE = "Answer with one word, clear, conditional or violation.\n\nQuestion: %s\n\nContext:\n%s"
ANSWER_TEMPLATE = "Context:\n%s\n\nQuestion: %s"


def split_prompts(sections: DataFrame, template: str = SPLIT_TEMPLATE) -> DataFrame:
    """L1: one clause-split prompt per content section."""
    return sections.filter("not is_heading").select("document_id", "ord", F.format_string(template, "content").alias("prompt"))


def extraction_prompts(clauses: DataFrame, template: str = EXTRACT_TEMPLATE, min_length: int = 20) -> DataFrame:
    """One extraction prompt per clause of at least ``min_length`` characters."""
    return clauses.filter(F.length("text") >= min_length).select("clause_id", F.format_string(template, "text").alias("prompt"))


def conflict_prompts(pairs: DataFrame, cut: int = CONFLICT_TEXT_BUILD, template: str = CONFLICT_TEMPLATE) -> DataFrame:
    """L1: one prompt per pair ``(clause_a, clause_b, text_a, text_b)``, texts cut."""
    keys = [c for c in pairs.columns if c not in ("text_a", "text_b")]
    return pairs.select(*keys, F.format_string(
        template, F.substring("text_a", 1, cut), F.substring("text_b", 1, cut)).alias("prompt"))


def context_blocks(hits: DataFrame, line: Column, max_rank: int | None = None) -> DataFrame:
    """(query_id, context): ``line`` of each hit in rank order. Hits are a ranked top-k
    list, so a question has at most k of them."""
    top = hits if max_rank is None else hits.filter(F.col("rank") <= max_rank)
    rows = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return top.groupBy("query_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n\n").alias("context"))


def risk_prompts(questions: DataFrame, hits: DataFrame, template: str = RISK_TEMPLATE) -> DataFrame:
    """L1: question with its first three hits, texts cut to 500."""
    line = F.concat(F.lit("[Clause "), F.coalesce("clause_ref", F.lit("N/A")), F.lit("]: "), F.substring("text", 1, RISK_TEXT))
    return questions.join(context_blocks(hits, line, RISK_CHUNKS), "query_id").select(
        "query_id", F.format_string(template, "question", "context").alias("prompt"))


def answer_prompts(questions: DataFrame, hits: DataFrame, template: str = ANSWER_TEMPLATE) -> DataFrame:
    """L1: question with all its hits as citable blocks, texts whole."""
    line = F.concat(F.lit("[Doc: "), "title", F.lit(", Clause: "), F.coalesce("clause_ref", F.lit("N/A")), F.lit("]: "), "text")
    return questions.join(context_blocks(hits, line), "query_id").select(
        "query_id", F.format_string(template, "context", "question").alias("prompt"))


def parse_entity_replies(replies: DataFrame) -> DataFrame:
    """Adds ``parsed`` (VARIANT) and ``fields`` (top-level values as text), both null
    unless the reply holds valid JSON, and the failure columns."""
    blocks = once(replies, _block=json_block(F.col("reply"), "{", "}"))
    parsed = once(blocks, parsed=strict_json(F.col("_block")), _fields=F.from_json("_block", "map<string,string>"))
    return parsed.select(
        *replies.columns, "parsed", F.when(F.col("parsed").isNotNull(), F.col("_fields")).alias("fields"),
        ((F.col("_block") == "") | F.col("parsed").isNotNull()).alias("success"),
        F.when((F.col("_block") != "") & F.col("parsed").isNull(), "reply holds no valid JSON").alias("error"),
    )


def _taken(field: str, kind: Column, whole: Column) -> Column:
    of_list = F.try_variant_get("parsed", f"$.{field}[0]", "variant")
    of_dict = F.get(F.map_values(F.from_json(F.col("fields")[field], "map<string,variant>")), 0)
    return F.when(kind.startswith("ARRAY"), of_list).when(kind.startswith("OBJECT"), of_dict).otherwise(whole)


def _text(field: str, kind: Column, taken: Column) -> Column:
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    return F.when(nested, F.try_variant_get(taken, "$", "string")).otherwise(F.col("fields")[field])


def _unless_falsy(taken: Column, inner: Column, text: Column) -> Column:
    number = F.try_variant_get(taken, "$", "double")
    falsy = (
        ((inner == "STRING") & (text == "")) | ((inner == "BOOLEAN") & ~F.try_variant_get(taken, "$", "boolean"))
        | (~inner.isin("STRING", "BOOLEAN") & (number == 0)) | inner.isin("VOID", "ARRAY<VOID>", "OBJECT<>")
    )
    return F.when(~F.coalesce(falsy, F.lit(False)), text)


def first_value(field: str) -> Column:
    """Of a parsed reply field: a list gives its first element, a dict its first
    value in written order, anything else itself; as text, null when absent or falsy by its
    type: empty text, the number 0, false, an empty list or dict."""
    whole = F.try_variant_get("parsed", f"$.{field}", "variant")
    kind = F.schema_of_variant(whole)
    taken = _taken(field, kind, whole)
    return _unless_falsy(taken, F.schema_of_variant(taken), _text(field, kind, taken))


def first_values(parsed: DataFrame, fields: list[str]) -> DataFrame:
    """``parsed`` with ``first_value`` of each field as column ``_first_<field>``. Each step is a
    generator, so what the steps after it use several times is computed once."""
    of = lambda step, field: F.col(f"_{step}_{field}")
    rows = parsed
    for step, value in (
        ("whole", lambda f: F.try_variant_get("parsed", f"$.{f}", "variant")),
        ("kind", lambda f: F.schema_of_variant(of("whole", f))),
        ("taken", lambda f: _taken(f, of("kind", f), of("whole", f))),
        ("inner", lambda f: F.schema_of_variant(of("taken", f))),
        ("text", lambda f: _text(f, of("kind", f), of("taken", f))),
        ("first", lambda f: _unless_falsy(of("taken", f), of("inner", f), of("text", f))),
    ):
        rows = once(rows, **{f"_{step}_{f}": value(f) for f in fields})
    return rows.select(*parsed.columns, *[of("first", f) for f in fields])


def _obligation() -> Column:
    """Of ``first_values``: only text, or a dict's first value."""
    kinds = [F.schema_of_variant(F.try_variant_get("parsed", path, "variant")) for path in ("$.obligation[0]", "$.obligation")]
    textual = F.coalesce(*kinds)
    return F.when((textual == "STRING") | textual.startswith("OBJECT"), F.col("_first_obligation"))


def reply_obligations(replies: DataFrame) -> DataFrame:
    """``replies`` with the ``obligation`` of ``entity_fields``, for steps that need no other field."""
    parsed = first_values(parse_entity_replies(replies), ["obligation"])
    return once(parsed, obligation=_obligation()).select(*replies.columns, "obligation")


def entity_fields(replies: DataFrame, accept_dict: bool = False) -> DataFrame:
    """The normalised fields of each reply.

    A threshold counts only as a list whose first element is a dict; ``accept_dict`` also
    takes a plain dict. ``bad_amount`` marks an amount that is there but is no number.
    """
    parsed = first_values(parse_entity_replies(replies), ["role", "department", "process", "regulation", "obligation"])

    def kind(path: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("parsed", path, "variant"))

    listed = kind("$.threshold[0]").startswith("OBJECT")
    plain = kind("$.threshold").startswith("OBJECT") if accept_dict else F.lit(False)
    present = F.when(listed, F.try_variant_get("parsed", "$.threshold[0].amount", "variant").isNotNull()).when(
        plain, F.try_variant_get("parsed", "$.threshold.amount", "variant").isNotNull())

    def part(name: str) -> Column:
        return F.when(listed, F.try_variant_get("parsed", f"$.threshold[0].{name}", "string")).when(
            plain, F.try_variant_get("parsed", f"$.threshold.{name}", "string"))

    plain_fields = once(
        parsed,
        role=title_case(F.col("_first_role")),
        department=title_case(F.col("_first_department")),
        process=title_case(F.col("_first_process")),
        regulation=strip(F.upper("_first_regulation")),
        obligation=_obligation(),
        amount=part("amount").try_cast("double"),
        _currency=part("currency"),
        _present=F.coalesce(present, F.lit(False)),
    )
    return plain_fields.select(
        *replies.columns, "success", "error", "role", "department", "process", "regulation", "obligation", "amount",
        F.when(F.col("amount").isNotNull(), F.coalesce("_currency", F.lit("USD"))).alias("currency"),
        (F.col("_present") & F.col("amount").isNull()).alias("bad_amount"),
    )


def said_yes(reply: Column) -> Column:
    """L3: contains 'yes' in any case; a missing reply is a no."""
    return F.coalesce(F.lower(reply).contains("yes"), F.lit(False))


def risk_verdict(reply: Column) -> Column:
    """L4: exactly one of three words after strip and lower, else 'clear'."""
    word = F.lower(strip(reply))
    return F.when(word.isin("clear", "conditional", "violation"), word).otherwise("clear")
