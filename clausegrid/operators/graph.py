"""Property graph as node tables and one edge table.

Edges are ``(type, src_label, src, dst_label, dst)`` with string ends; node tables are
keyed by ``id`` or ``name``. Every edge set is distinct.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.functions.fixed import DEFAULT_PROCESS
from clausegrid.functions.text import strip_policy_suffix, title_case
from clausegrid.operators.ordered import BLOCK_ROWS, numbered, running, with_neighbours
from clausegrid.operators.replies import said_yes

EDGE = ["type", "src_label", "src", "dst_label", "dst"]
NEIGHBOURS = 4


def edge(kind: str, src_label: str, src: str | Column, dst_label: str, dst: str | Column) -> list[Column]:
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return [F.lit(kind).alias("type"), F.lit(src_label).alias("src_label"), col(src).alias("src"),
            F.lit(dst_label).alias("dst_label"), col(dst).alias("dst")]


def _or(column: str, default: str) -> Column:
    return F.when(F.coalesce(F.col(column), F.lit("")) == "", default).otherwise(F.col(column))


def policy_nodes(documents: DataFrame) -> DataFrame:
    """G1: documents ``(document_id, ord, title, version, status)`` with defaults filled."""
    title = F.coalesce("title", F.lit(""))
    return documents.select(
        "document_id", "ord", title.alias("title"), _or("version", "v1").alias("version"),
        _or("status", "active").alias("status"), strip_policy_suffix(title).alias("process_name"),
    )


def process_nodes(policies: DataFrame) -> DataFrame:
    """(name, source_policy): the title written last."""
    return policies.groupBy(F.col("process_name").alias("name")).agg(F.max_by("title", "ord").alias("source_policy"))


def clause_nodes(chunks: DataFrame) -> DataFrame:
    """Clauses ``(clause_id, document_id, clause_ref, section_path, text, version)``."""
    return chunks.select(
        "clause_id", "document_id", F.coalesce("clause_ref", F.lit("")).alias("clause_ref"),
        F.coalesce("section_path", F.lit("")).alias("section_path"),
        F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("text_ref"), _or("version", "v1").alias("version"),
    )


def clause_edges(clauses: DataFrame, policies: DataFrame) -> DataFrame:
    """PART_OF its policy and GOVERNS the policy's process, from one join."""
    met = clauses.select("clause_id", "document_id").join(policies.select("document_id", "process_name"), "document_id")
    both = F.array(
        F.struct(*edge("PART_OF", "Clause", "clause_id", "Policy", "document_id")),
        F.struct(*edge("GOVERNS", "Clause", "clause_id", "Process", "process_name")),
    )
    return met.select(F.inline(both))


def approvals(entities: DataFrame) -> DataFrame:
    """Distinct (document_id, role) of approval entities."""
    named = F.regexp_extract("name", r"(?iU):\s*(\w+)\s+approval", 1)
    authority = F.coalesce("attrs.authority", F.lit(""))
    role = title_case(F.when(authority != "", authority).otherwise(named))
    return (
        entities.filter(F.lower("type") == "approval").select("document_id", role.alias("role"))
        .filter("role <> ''").distinct()
    )


def role_nodes(found: DataFrame) -> DataFrame:
    """Role names; a role exists even when its process does not."""
    return found.select(F.col("role").alias("name")).distinct()


def can_approve(found: DataFrame, policies: DataFrame) -> DataFrame:
    """(role, process) with an existing process. Documents without a policy fall back
    to the general process, if some policy has created it."""
    process = F.coalesce("process_name", F.lit(DEFAULT_PROCESS))
    pairs = found.join(policies.select("document_id", "process_name"), "document_id", "left").select(
        "role", process.alias("process")).distinct()
    known = policies.select(F.col("process_name").alias("process")).distinct()
    return pairs.join(known, "process", "left_semi").select("role", "process")


def thresholds(entities: DataFrame) -> DataFrame:
    """(threshold_id, document_id, amount, currency, basis, seq) with amount > 0."""
    return entities.filter((F.lower("type") == "threshold") & (F.col("attrs.amount") > 0)).select(
        F.col("entity_id").alias("threshold_id"), "document_id", F.col("attrs.amount").alias("amount"),
        F.coalesce("attrs.currency", F.lit("USD")).alias("currency"), F.col("attrs.original_text").alias("basis"), "seq",
    )


def has_threshold(limits: DataFrame, policies: DataFrame) -> DataFrame:
    """HAS_THRESHOLD policy to threshold, for known policies."""
    met = limits.join(policies.select("document_id"), "document_id", "left_semi")
    return met.select(*edge("HAS_THRESHOLD", "Policy", "document_id", "Threshold", "threshold_id"))


def role_limits(pairs: DataFrame, policies: DataFrame, limits: DataFrame) -> DataFrame:
    """(role, max_amount, currency): the last threshold met by the role wins.

    Only the last threshold of a document, then of a process, can win, so the thresholds
    shrink to one row per process before they meet the roles.
    """
    value = F.struct("amount", "currency")
    per_document = limits.groupBy("document_id").agg(F.max_by(value, "seq").alias("v"), F.max("seq").alias("seq"))
    per_process = (
        per_document.join(policies.select("document_id", "process_name"), "document_id")
        .groupBy(F.col("process_name").alias("process")).agg(F.max_by("v", "seq").alias("v"), F.max("seq").alias("seq"))
    )
    last = pairs.join(per_process, "process").groupBy("role").agg(F.max_by("v", "seq").alias("v"))
    return last.select("role", F.col("v.amount").alias("max_amount"), F.col("v.currency").alias("currency"))


def supersedes(policies: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Same title, other version, larger id supersedes smaller; ids of any ordered type.

    One row per superseding policy: the nearest policy it supersedes and how many it
    supersedes in all. Where titles hold one policy per version this chain is the whole
    relation; for long lineages it stays linear, and ``superseded_by`` lists all pairs of
    the policies asked for.
    """
    key = ["title"]
    base = numbered(policies.select("document_id", "title", "version"), key, "document_id", "place")
    near = with_neighbours(base, key, "place", ["document_id", "version"], 1, 0, block_rows)
    previous = F.get("prev", 0)
    turned = near.select(
        "document_id", "title", "version", "place",
        F.when(previous["version"] != F.col("version"), previous["document_id"]).alias("turn"),
    )
    ranked = running(turned, key, "place", sums={"upto": F.lit(1)}, lasts={"nearest": F.col("turn")}, block_rows=block_rows)
    own = running(ranked, ["title", "version"], "place", sums={"same": F.lit(1)}, block_rows=block_rows)
    return own.filter("nearest is not null").select(
        F.col("document_id").alias("new_id"), F.col("nearest").alias("old_id"),
        (F.col("upto") - F.col("same")).alias("n_superseded"), "title",
    )


def superseded_by(policies: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every (new_id, old_id) of the policies listed in ``wanted (document_id)``."""
    new = policies.join(wanted.select("document_id"), "document_id", "left_semi").select(
        F.col("document_id").alias("new_id"), "title", F.col("version").alias("new_version"))
    old = policies.select(F.col("document_id").alias("old_id"), "title", F.col("version").alias("old_version"))
    return new.join(old, "title").filter("old_id < new_id and old_version <> new_version").select("new_id", "old_id")


def usable_facts(fields: DataFrame, clauses: DataFrame, min_length: int = 20) -> DataFrame:
    """Normalised replies of clauses that are long enough."""
    long = clauses.filter(F.length("text") >= min_length).select("clause_id", "document_id")
    return fields.drop("document_id").join(long, "clause_id")


def obligations(facts: DataFrame) -> DataFrame:
    """(clause_id, obligation)."""
    return facts.filter("obligation is not null").select("clause_id", "obligation")


def reply_edges(facts: DataFrame) -> DataFrame:
    """Edges that need a role, from one pass over the facts. A bad amount stops
    a clause before its GOVERNS edge."""
    process = F.coalesce("process", F.lit(DEFAULT_PROCESS))
    ok = ~F.col("bad_amount")

    def when(test: Column, *parts) -> Column:
        return F.when(test, F.struct(*edge(*parts)))

    made = F.array_compact(F.array(
        when(F.lit(True), "CAN_APPROVE", "Role", "role", "Process", process),
        when(F.col("department").isNotNull(), "BELONGS_TO", "Role", "role", "Department", "department"),
        when(F.col("amount") > 0, "REQUIRES_THRESHOLD", "Process", process, "Threshold",
             F.concat(F.lit("llm_"), F.col("clause_id").cast("string"))),
        when(ok, "GOVERNS", "Clause", "clause_id", "Process", process),
    ))
    return facts.filter("role is not null").select(F.inline(made)).distinct()


def reply_thresholds(facts: DataFrame) -> DataFrame:
    """Threshold nodes named after their clause."""
    return facts.filter("role is not null and amount > 0").select(
        F.concat(F.lit("llm_"), F.col("clause_id").cast("string")).alias("threshold_id"), "amount", "currency")


def reply_nodes(facts: DataFrame, policies: DataFrame) -> DataFrame:
    """Distinct (label, name) of the nodes that replies add: the ends of their
    edges that are no clause and no policy."""
    edges = reply_edges(facts).unionByName(maps_to(facts, policies))
    ends = F.array(F.struct(F.col("src_label").alias("label"), F.col("src").alias("name")), F.struct(F.col("dst_label").alias("label"), F.col("dst").alias("name")))
    return edges.select(F.inline(ends)).filter("label not in ('Clause', 'Policy')").distinct()


def maps_to(facts: DataFrame, policies: DataFrame) -> DataFrame:
    """Policy to regulation, whether or not the reply names a role."""
    stopped = F.col("role").isNotNull() & F.col("bad_amount")
    found = facts.filter(F.col("regulation").isNotNull() & ~stopped).select("document_id", "regulation").distinct()
    known = found.join(policies.select("document_id"), "document_id", "left_semi")
    return known.select(*edge("MAPS_TO", "Policy", "document_id", "Regulation", "regulation"))


def conflict_pairs(clauses: DataFrame, block_rows: int = BLOCK_ROWS, of: DataFrame | None = None) -> DataFrame:
    """(clause_a, clause_b) of ``conflict_candidates``, without moving their texts; with ``of
    (clause_id)`` only the pairs that start at these clauses."""
    long = clauses.filter(F.length("text") > 50).select(
        "document_id", "ord", "clause_id", F.split(F.coalesce("section_path", F.lit("")), ">")[0].alias("section"))
    near = with_neighbours(long, ["document_id"], "ord", ["clause_id", "section"], 0, NEIGHBOURS, block_rows)
    if of is not None:
        near = near.join(of, "clause_id", "left_semi")
    return near.select(F.col("clause_id").alias("clause_a"), "section", F.explode("next").alias("n")).filter("n.section = section").select(
        "clause_a", F.col("n.clause_id").alias("clause_b"))


def conflict_candidates(clauses: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Each clause longer than 50 characters with the next four of its document, if
    both lie in the same top section. Texts are cut to 300 characters."""
    long = clauses.filter(F.length("text") > 50).select(
        "document_id", "ord", "clause_id",
        F.split(F.coalesce("section_path", F.lit("")), ">")[0].alias("section"), F.substring("text", 1, 300).alias("text"),
    )
    near = with_neighbours(long, ["document_id"], "ord", ["clause_id", "section", "text"], 0, NEIGHBOURS, block_rows)
    return near.select("document_id", "clause_id", "section", "text", F.posexplode("next").alias("gap", "n")).filter(
        "n.section = section"
    ).select(
        "document_id", F.col("clause_id").alias("clause_a"), F.col("n.clause_id").alias("clause_b"),
        (F.col("gap") + 1).alias("gap"), F.col("text").alias("text_a"), F.col("n.text").alias("text_b"),
    )


def conflicts_with(candidates: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Candidates whose verdict ``(clause_a, clause_b, reply)`` says yes."""
    judged = candidates.select("clause_a", "clause_b").join(verdicts, ["clause_a", "clause_b"])
    return judged.filter(said_yes(F.col("reply"))).select(
        *edge("CONFLICTS_WITH", "Clause", "clause_a", "Clause", "clause_b")).distinct()


def edge_counts(edges: DataFrame, shared_types: list[str]) -> DataFrame:
    """(type, k): rows whose counts add up to the distinct edges of each type. Only edges of
    ``shared_types``, which several sources may give, are told apart; the labels of both ends
    follow from the type. Edges of other types are distinct already and collapse into one
    count per task."""
    pair = F.when(F.col("type").isin(shared_types), F.struct("src", "dst"))
    return edges.groupBy("type", pair.alias("pair")).agg(F.count("*").alias("n")).select(
        "type", F.when(F.col("pair").isNull(), F.col("n")).otherwise(F.lit(1)).cast("long").alias("k"))


def summary(things: DataFrame, column: str, weight: str | None = None) -> DataFrame:
    """Count per label or type and the total (null label), largest first. ``weight``
    names a column of counts, for rows that each stand for several things."""
    n = F.count("*") if weight is None else F.sum(weight)
    return things.rollup(column).agg(n.alias("n")).orderBy(F.col("n").desc(), F.col(column).asc_nulls_first())
