"""Questions: intent, routing, approval lookup, conflicts, compliance risk.

Questions are ``(query_id, question)``; hits are ranked top-k lists
``(query_id, rank, chunk_id, document_id, clause_ref, text)``.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions import fixed
from clausegrid.functions.text import contains_any, once, parse_number, title_case
from clausegrid.operators.replies import said_yes

STEPS = {
    "approval": ["retrieve", "approval", "reason", "verify"],
    "conflict": ["retrieve", "conflict", "reason", "verify"],
    "compliance": ["retrieve", "risk", "reason", "verify"],
    "procedure": ["retrieve", "reason", "verify"],
    "general": ["retrieve", "reason", "verify"],
}


def classify(question: Column) -> Column:
    """Struct (intent, confidence): the first intent with a keyword in the text."""
    return _intent_of(F.lower(question))


def _intent_of(lowered: Column) -> Column:
    result = None
    for name, confidence, keywords in fixed.INTENTS:
        value = F.struct(F.lit(name).alias("intent"), F.lit(confidence).alias("confidence"))
        hit = contains_any(lowered, keywords)
        result = F.when(hit, value) if result is None else result.when(hit, value)
    name, confidence = fixed.OTHER_INTENT
    return result.otherwise(F.struct(F.lit(name).alias("intent"), F.lit(confidence).alias("confidence")))


def classified(questions: DataFrame) -> DataFrame:
    """Questions with ``intent`` and ``intent_confidence``. The text is lowered once and read
    once, whatever filters and joins stand above."""
    read = once(once(questions, _low=F.lower("question")), _found=_intent_of(F.col("_low")))
    return read.select(*questions.columns, F.col("_found.intent").alias("intent"), F.col("_found.confidence").alias("intent_confidence"))


def steps(intent: Column) -> Column:
    """Array of the steps of an intent."""
    result = None
    for name, parts in STEPS.items():
        value = F.array(*[F.lit(p) for p in parts])
        result = F.when(intent == name, value) if result is None else result.when(intent == name, value)
    return result.otherwise(F.array(*[F.lit(p) for p in STEPS["general"]]))


def routed(questions: DataFrame, hits: DataFrame, intent: str) -> tuple[DataFrame, DataFrame]:
    """(questions, hits) that the step of an intent gets: only those of that intent, and
    only questions with hits, as a question without any stops at its retrieval. Questions are
    ``classified``; hits carry the ``intent`` of their question."""
    met = hits.filter(F.col("intent") == intent).drop("intent")
    return questions.filter(F.col("intent") == intent).join(met.select("query_id").distinct(), "query_id", "left_semi"), met


def answered_questions(questions: DataFrame, judged: DataFrame, approvals: DataFrame, conflicts: DataFrame, risks: DataFrame) -> DataFrame:
    """One record per ``classified`` question, from its intent to its state. ``approvals``,
    ``conflicts`` and ``risks`` come from steps that got their ``routed`` questions; a step
    that did not run leaves its column null, a conflict step without finds leaves 0."""
    counted = conflicts.groupBy("query_id").agg(F.count("*").alias("found"))
    wide = (
        questions.select("query_id", "intent", "intent_confidence")
        .join(judged.select("query_id", "verdict", "confidence", "state", "error"), "query_id")
        .join(approvals.select("query_id", F.col("answer_text").alias("approval")), "query_id", "left")
        .join(counted, "query_id", "left").join(risks.select("query_id", "risk_level"), "query_id", "left")
    )
    ran = F.when(F.col("error").isNotNull(), F.array(F.lit("retrieve"))).otherwise(steps(F.col("intent")))
    n = F.when((F.col("intent") == "conflict") & F.col("error").isNull(), F.coalesce("found", F.lit(0)))
    return wide.select("query_id", "intent", "intent_confidence", ran.alias("ran"), "approval", n.alias("n_conflicts"), "risk_level", "verdict", "confidence", "state")


def run_until_failure(planned: Column, failed_step: Column) -> Column:
    """The steps that run: up to and including the first one that fails."""
    at = F.array_position(planned, failed_step)
    return F.when(failed_step.isNull() | (at == 0), planned).otherwise(F.slice(planned, F.lit(1), at.cast("int")))


def process_of(question: Column) -> Column:
    """Process of the first listed word found in the question, null if none."""
    q, result = F.lower(question), None
    for word, process in fixed.PROCESS_WORDS:
        result = F.when(q.contains(word), process) if result is None else result.when(q.contains(word), process)
    return result


def amount_of(question: Column) -> Column:
    """P5: the first of four patterns whose first match parses as a number."""
    found = [parse_number(F.regexp_extract(question, "(?iU)" + p, 1)) for p in fixed.AMOUNTS]
    return F.coalesce(*found)


def wanted_processes(questions: DataFrame, hits: DataFrame) -> DataFrame:
    """Questions with ``process`` (null: undetermined) and ``amount``.

    Only questions that name no process look at their first three hits, which carry their ``text``
    or, in its place, whether it ``tells`` of approval.
    """
    read = questions.withColumns({"named": process_of(F.col("question")), "amount": amount_of(F.col("question"))})
    tells = F.col("tells") if "tells" in hits.columns else tells_approval(F.col("text"))
    hint = hits.filter("rank <= 3").groupBy("query_id").agg(F.bool_or(tells).alias("hint"))
    return read.join(hint, "query_id", "left").select(
        *questions.columns, F.coalesce("named", F.when(F.col("hint"), fixed.FALLBACK_PROCESS)).alias("process"), "amount"
    )


def tells_approval(text: Column) -> Column:
    """Whether a clause speaks of approval."""
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), ["approval", "approve"])


def approval_records(approvers: DataFrame) -> DataFrame:
    """(wanted, role, process): CAN_APPROVE pairs whose process name contains the
    wanted name, whatever the case.

    A question can only want one of a fixed list of names, so the substring match is an
    expression over that list on each pair, not a join.
    """
    names = sorted({p for _, p in fixed.PROCESS_WORDS} | {fixed.FALLBACK_PROCESS})
    held = F.array_compact(F.array(*[F.when(F.lower("process").contains(n.lower()), n) for n in names]))
    return approvers.select(F.explode_outer(held).alias("wanted"), "role", "process").filter("wanted is not null")


def resolve_approvals(questions: DataFrame, records: DataFrame, repeat_roles: bool = True) -> DataFrame:
    """Roles, user_can_approve and answer text per question of ``wanted_processes``
    (plus the asker's ``role``).

    A role is listed once per record, as often as it occurs. Records are counted per
    (wanted, role) before that; with ``repeat_roles=False`` a process name held by millions
    of pairs lists each role once.
    """
    per_role = records.groupBy("wanted", "role").agg(F.count("*").alias("n"))
    listed = per_role.groupBy("wanted").agg(
        F.array_sort(F.collect_list(F.struct("role", "n"))).alias("found"), F.sum("n").alias("n_records"))
    roles = F.transform("found", lambda r: r["role"])
    if repeat_roles:
        roles = F.flatten(F.transform("found", lambda r: F.array_repeat(r["role"], r["n"].cast("int"))))
    listed = listed.select("wanted", roles.alias("roles"), "n_records")
    asked = questions.withColumn("wanted", F.col("process")).join(listed, "wanted", "left")
    user = F.coalesce("role", F.lit("Employee"))
    may = F.coalesce(F.array_contains("roles", user) | F.array_contains("roles", title_case(user)), F.lit(False))
    found = F.size(F.coalesce("roles", F.array().cast("array<string>"))) > 0
    first = F.when(
        found, F.concat(F.lit("Approval authority for '"), "process", F.lit("': "), F.array_join("roles", ", "))
    ).otherwise(F.concat(F.lit("No specific approval authority found for '"), "process", F.lit("' in the knowledge graph.")))
    second = F.when(F.col("amount") != 0, F.concat(F.lit("Requested amount: $"), F.format_number("amount", 2)))
    known = F.col("process").isNotNull()
    return asked.select(
        "query_id", "process", "amount", "roles", F.coalesce("n_records", F.lit(0)).alias("n_records"),
        F.when(known, may).alias("user_can_approve"),
        F.when(known, F.concat_ws("; ", first, second)).alias("answer_text"),
        F.when(~known, "Could not determine the process from the question").alias("error"),
    )


def approval_lists(records: DataFrame) -> DataFrame:
    """(wanted, roles, matching_processes, n_records), one row for each of the fixed names
    that a question can want; questions point to it by their ``process``."""
    return records.groupBy("wanted").agg(
        F.array_sort(F.collect_list("role")).alias("roles"), F.array_sort(F.collect_set("process")).alias("matching_processes"),
        F.count("*").alias("n_records"))


def least_authority(questions: DataFrame, records: DataFrame, limits: DataFrame) -> DataFrame:
    """Per question the role with the smallest sufficient limit for its process.

    The roles of a wanted process come as one short sorted list per process, so a question
    meets one row, not every role.
    """
    roles = records.select("wanted", "role").distinct().join(limits, "role").groupBy("wanted").agg(
        F.array_sort(F.collect_list(F.struct("max_amount", "role"))).alias("ladder"))
    asked = questions.filter("amount is not null").join(roles, questions["process"] == roles["wanted"])
    enough = F.get(F.filter("ladder", lambda r: r["max_amount"] >= F.col("amount")), 0)
    return asked.select("query_id", "process", "amount", enough["role"].alias("authority"),
                        enough["max_amount"].alias("limit")).filter("authority is not null")


CONFLICT = ["query_id", "clause_a", "clause_b", "ref", "source"]


def stored_conflicts(hits: DataFrame, edges: DataFrame, clauses: DataFrame) -> DataFrame:
    """CONFLICTS_WITH edges out of the retrieved clauses, with the other's reference."""
    out = edges.filter("type = 'CONFLICTS_WITH'").select(F.col("src").alias("clause_a"), F.col("dst").alias("clause_b"))
    refs = clauses.select(F.col("clause_id").cast("string").alias("clause_b"), F.col("clause_ref").alias("ref"))
    met = hits.select("query_id", F.col("chunk_id").cast("string").alias("clause_a")).join(out, "clause_a")
    return met.join(refs, "clause_b").withColumn("source", F.lit("graph")).select(*CONFLICT)


def version_conflicts(hits: DataFrame) -> DataFrame:
    """Two hits of one question from one document under the same clause reference.

    A question has at most k hits; their pairs are made inside one row.
    """
    grouped = hits.filter("clause_ref <> ''").groupBy("query_id", "document_id", "clause_ref").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("h")
    ).filter(F.size("h") > 1)
    first = grouped.select("query_id", "clause_ref", "h", F.posexplode("h").alias("i", "a"))
    pair = first.select("query_id", "clause_ref", "a", F.explode(F.slice("h", F.col("i") + 2, F.size("h"))).alias("b"))
    return pair.select(
        "query_id", F.col("a.chunk_id").cast("string").alias("clause_a"), F.col("b.chunk_id").cast("string").alias("clause_b"),
        F.col("clause_ref").alias("ref"), F.lit("version_check").alias("source"))


def judge_pairs(hits: DataFrame, cut: int = 400, shortest: int = 50, limit: int = 5) -> DataFrame:
    """P10: (query_id, pair_no, clause_a, clause_b, text_a, text_b): pairs (i, j), i < 5,
    i < j < 6 in order, both texts long enough, the first five per question."""
    top = hits.filter("rank <= 6").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id", F.substring(F.coalesce("text", F.lit("")), 1, cut).alias("text")))).alias("h"))
    kept = _first_pairs(lambda hit: F.length(hit["text"]) >= shortest, limit)
    return top.select("query_id", F.posexplode_outer(kept).alias("n", "p")).filter("p is not null").select(
        "query_id", (F.col("n") + 1).alias("pair_no"), F.col("p.a.chunk_id").alias("clause_a"), F.col("p.b.chunk_id").alias("clause_b"),
        F.col("p.a.text").alias("text_a"), F.col("p.b.text").alias("text_b"))


def _first_pairs(long_enough: Callable[[Column], Column], limit: int) -> Column:
    """The first pairs (a, b) of the array ``h`` of hits in rank order."""
    pairs = F.flatten(F.transform(F.slice("h", 1, 5), lambda a, i: F.transform(
        F.slice("h", i + 2, F.lit(6)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return F.slice(F.filter(pairs, lambda p: long_enough(p["a"]) & long_enough(p["b"])), 1, limit)


def pairs_judged_before(hits: DataFrame, cut: int = 400, shortest: int = 50, limit: int = 5) -> DataFrame:
    """P10: (query_id, clause_a, clause_b) of ``judge_pairs``, where a judge has replied already and
    hits carry the length ``n_chars`` of their text in its place, so that no text is moved."""
    long = F.least("n_chars", F.lit(cut)) >= shortest
    top = hits.filter("rank <= 6").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", long.alias("long")))).alias("h"))
    return top.select("query_id", F.posexplode_outer(_first_pairs(lambda hit: hit["long"], limit)).alias("n", "p")).filter("p is not null").select(
        "query_id", F.col("p.a.chunk_id").alias("clause_a"), F.col("p.b.chunk_id").alias("clause_b"))


def judged_conflicts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """P10: pairs whose verdict ``(query_id, clause_a, clause_b, reply)`` says yes."""
    key = ["query_id", "clause_a", "clause_b"]
    yes = verdicts.filter(said_yes(F.col("reply"))).select(*key)
    return conflict_rows(pairs.select(*key).join(yes, key, "left_semi"))


def conflict_rows(judged: DataFrame) -> DataFrame:
    """P10: the conflicts of judged pairs ``(query_id, clause_a, clause_b)``."""
    return judged.select(
        "query_id", F.col("clause_a").cast("string").alias("clause_a"), F.col("clause_b").cast("string").alias("clause_b"),
        F.lit("").alias("ref"), F.lit("model").alias("source"))


def all_conflicts(hits: DataFrame, edges: DataFrame, clauses: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Stored, version and judged conflicts, tagged, duplicates kept."""
    return found_conflicts(hits, edges, clauses, judged_conflicts(judge_pairs(hits), verdicts))


def found_conflicts(hits: DataFrame, edges: DataFrame, clauses: DataFrame, judged: DataFrame) -> DataFrame:
    """P11 with the conflicts of the judge at hand, whose pairs need not be made again."""
    return stored_conflicts(hits, edges, clauses).unionByName(version_conflicts(hits)).unionByName(judged)


def regulations_of_hits(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct (query_id, regulation) of the retrieved documents."""
    mapped = edges.filter("type = 'MAPS_TO'").select(F.col("src").alias("document"), F.col("dst").alias("regulation"))
    documents = hits.select("query_id", F.col("document_id").cast("string").alias("document")).distinct()
    return documents.join(mapped, "document").select("query_id", "regulation").distinct()


def obligations_of_hits(hits: DataFrame, obligations: DataFrame) -> DataFrame:
    """(query_id, chunk_id, obligation) of the retrieved clauses."""
    return hits.select("query_id", "chunk_id").join(
        obligations.select(F.col("clause_id").alias("chunk_id"), "obligation"), "chunk_id").select("query_id", "chunk_id", "obligation")


def mandatory_of_hits(hits: DataFrame, obligations: DataFrame) -> DataFrame:
    """(query_id, mandatory): how many mandatory obligations the retrieved clauses carry."""
    return obligations_of_hits(hits, obligations).groupBy("query_id").agg(F.count_if(F.col("obligation") == "mandatory").alias("mandatory"))


def risk_levels(questions: DataFrame, hits: DataFrame, obligations: DataFrame) -> DataFrame:
    """(query_id, risk_level) of questions ``(query_id, risk_verdict)`` that have hits, as in
    ``assess_risk``, whose regulations and recommendations do not bear on the level."""
    wide = questions.select("query_id", "risk_verdict").join(mandatory_of_hits(hits, obligations), "query_id", "left")
    return wide.select("query_id", risk_level(F.col("risk_verdict"), F.coalesce("mandatory", F.lit(0))).alias("risk_level"))


def risk_level(verdict: Column, mandatory: Column) -> Column:
    """P14."""
    return F.when(verdict == "violation", "high").when((verdict == "conditional") | (mandatory > 2), "medium").otherwise("low")


def recommendations(verdict: Column, regulations: Column, mandatory: Column) -> Column:
    """Array of sentences; ``regulations`` is an array of names."""
    bad, open_ = verdict == "violation", verdict == "conditional"
    return F.array_compact(F.array(
        F.when(bad, fixed.REVIEW_VIOLATION)
        .when(open_, fixed.VERIFY_CONDITIONS)
        .otherwise(fixed.NO_CONCERNS),
        F.when(bad & (F.size(regulations) > 0), F.concat(F.lit(fixed.ENSURE_COMPLIANCE), F.array_join(regulations, ", ")))
        .when(open_, fixed.CHECK_APPROVALS),
        F.when(mandatory > 0, F.concat(mandatory.cast("string"), F.lit(fixed.OBLIGATIONS_APPLY))),
    ))


def assess_risk(questions: DataFrame, hits: DataFrame, edges: DataFrame, obligations: DataFrame) -> DataFrame:
    """P12-P15 per question ``(query_id, risk_verdict)``; regulations sorted by name. A
    question without hits is abstained with unknown risk."""
    per_question = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"))
    regs = regulations_of_hits(hits, edges).groupBy("query_id").agg(F.array_sort(F.collect_list("regulation")).alias("regs"))
    wide = (
        questions.select("query_id", "risk_verdict").join(per_question, "query_id", "left")
        .join(regs, "query_id", "left").join(mandatory_of_hits(hits, obligations), "query_id", "left")
        .withColumns({"regulations": F.coalesce("regs", F.array().cast("array<string>")), "mandatory": F.coalesce("mandatory", F.lit(0))})
    )
    none = F.col("n_hits").isNull()
    verdict, mandatory = F.col("risk_verdict"), F.col("mandatory")
    return wide.select(
        "query_id", F.when(none, "abstained").otherwise(verdict).alias("verdict"), "regulations", "mandatory",
        F.when(none, "unknown").otherwise(risk_level(verdict, mandatory)).alias("risk_level"),
        F.when(none, F.array(F.lit(fixed.NO_CLAUSES))).otherwise(
            recommendations(verdict, F.col("regulations"), mandatory)).alias("recommendations"),
    )
