"""Secret scans over content-addressed texts, with DataFrame functions only.

Every version of a text is named by the hash of its content (its blob). A ledger holds the
pairs of blob and rule version that were scanned already; only the other pairs are scanned,
each once however many paths hold the blob, and the findings are joined back to all paths.
Cheap hints pick the few blobs in which a rule can match at all, so only their texts move.

Null text is the empty blob. Repeated rows are paths of the same blob and give repeated
rows; null ids are kept. An empty table gives no rows. Positions count code points, the end
is exclusive.
"""

from __future__ import annotations

import dataclasses
import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.llm.storage import stored


@dataclasses.dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int  # group 0: the whole match
    min_chars: int  # of that group; shorter matches are dropped
    hint: str  # SQL condition on ``text`` and ``lower_text``, true wherever the pattern matches
    base: bool = True

    @property
    def version(self) -> str:
        parts = (self.kind, self.pattern, self.group, self.min_chars)
        return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:16]


#: Fixed values. Runs shorter than the least length never count, so the pattern asks for it
#: where no shorter match can hide a longer one.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
RULES = (
    Rule("assign", ASSIGN, 2, 12, "contains(lower_text, 'passw') or contains(lower_text, 'secret') or contains(lower_text, 'token') or contains(lower_text, 'api_key') or contains(lower_text, 'apikey')"),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18, "contains(text, 'AKIA')"),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16, "text rlike '[0-9a-f]{16}'"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1, "contains(text, 'PRIVATE KEY-----')", base=False),
)
FINDING = "blob_id string, rule_version string, kind string, start long, end long"


def with_blobs(versions: DataFrame, text_col: str = "text") -> DataFrame:
    """``versions`` with the address of their content."""
    return versions.withColumn("blob_id", F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def scan(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Findings of ``(blob_id, text, unseen)``; ``unseen`` lists the rule versions to run, null for all.

    Rows of the same blob count once. A match's place follows from the lengths of the texts
    between the matches, so it costs one running sum per blob and rule.
    """
    asked = {r: F.col("unseen").isNull() | F.array_contains("unseen", r.version) for r in rules}
    hinted = blobs.filter(F.col("text").isNotNull()).select("blob_id", "text", "unseen", F.lower("text").alias("lower_text"))
    any_hint = F.lit(False)
    for r in rules:
        any_hint = any_hint | (asked[r] & F.expr(f"({r.hint})"))
    once = hinted.filter(any_hint).drop("lower_text").dropDuplicates(["blob_id"])
    tries = F.array(*[
        F.when(asked[r], F.struct(
            F.lit(r.version).alias("rule_version"), F.lit(r.kind).alias("kind"), F.lit(r.min_chars).alias("least"),
            F.split("text", r.pattern, -1).alias("between"), F.regexp_extract_all("text", F.lit(r.pattern), 0).alias("whole"),
            F.regexp_extract_all("text", F.lit(r.pattern), r.group).alias("part"),
        )) for r in rules
    ])
    per_rule = once.select("blob_id", F.explode(tries).alias("t")).filter("size(t.whole) > 0")
    matches = per_rule.select(
        "blob_id", "t.rule_version", "t.kind", "t.least",
        F.posexplode(F.arrays_zip(F.col("t.between").alias("between"), F.col("t.whole").alias("whole"), F.col("t.part").alias("part"))).alias("nth", "m"),
    ).filter("m.whole is not null")
    so_far = Window.partitionBy("blob_id", "rule_version").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    length = F.length("m.whole").cast("long")
    placed = matches.withColumn("end", F.sum(F.length("m.between") + length).over(so_far)).withColumn("start", F.col("end") - length)
    return placed.filter(F.length("m.part") >= F.col("least")).select("blob_id", "rule_version", "kind", "start", "end")


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def update_ledger(versions: DataFrame, folder: str, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """Scan what the ledger in ``folder`` has not seen, store it, and return all its findings.

    Findings are stored before the pairs that produced them: a run that breaks off in between
    scans those pairs again, and the findings are read as a set.
    """
    spark = versions.sparkSession
    seen_path, found_path = f"{folder}/seen", f"{folder}/findings"
    pair = "blob_id string, rule_version string"
    blobs = with_blobs(versions.select(F.col(text_col).alias("text")))
    pairs = blobs.select("blob_id").distinct().select("blob_id", F.explode(F.array(*[F.lit(r.version) for r in rules])).alias("rule_version"))
    unseen = pairs.join(_stored(spark, seen_path, pair), ["blob_id", "rule_version"], "left_anti")
    todo = unseen.groupBy("blob_id").agg(F.collect_set("rule_version").alias("unseen"))
    scan(blobs.join(todo, "blob_id"), rules).write.mode("append").parquet(found_path)
    unseen.write.mode("append").parquet(seen_path)
    return _stored(spark, found_path, FINDING).distinct()


def findings_by_path(versions: DataFrame, findings: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per path and finding: the columns of ``versions`` without the text, then the finding."""
    return with_blobs(versions, text_col).drop(text_col).join(findings, "blob_id")


def digest(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", findings: DataFrame | None = None) -> DataFrame:
    """``(id, n_<kind>..., base_sha256, spans)`` of every row; ``findings`` defaults to a scan of everything."""
    rows = with_blobs(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")))
    if findings is None:
        findings = scan(rows.select("blob_id", "text", F.lit(None).cast("array<string>").alias("unseen")), rules)
    order = F.array_position(F.array(*[F.lit(r.kind) for r in rules]), F.col("kind"))
    base = [r.kind for r in rules if r.base]
    per_blob = findings.select("blob_id", F.struct("start", order.alias("nth"), "end", "kind").alias("f")).groupBy("blob_id").agg(
        F.sort_array(F.collect_list("f")).alias("all"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def of_kind(k):
        return lambda f: f["kind"] == k

    is_base = F.array(*[F.lit(k) for k in base])
    facts = stored(per_blob.select(
        "blob_id", joined("all").alias("spans"), joined(F.filter("all", lambda f: F.array_contains(is_base, f["kind"]))).alias("base"),
        *[F.size(F.filter("all", of_kind(k))).cast("long").alias(f"n_{k}") for k in base],
    ), "findings")  # stored, so that the join below meets two plain tables and a hot blob can be split
    out = rows.select("_id", "blob_id").join(facts, "blob_id", "left")
    return out.select(
        F.col("_id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in base],
        F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
    )


def _sql_kind(kind: str, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""select doc_id, '{kind}' as kind, list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) as s, length(m[i]) as n
    from (select doc_id, m, p, g, unnest(range(1, len(m) + 1)) as i from (
      select doc_id, regexp_extract_all(text, '{quoted}') as m, string_split_regex(text, '{quoted}') as p, regexp_extract_all(text, '{quoted}', {group}) as g
      from documents where text is not null)) where length(g[i]) >= {least}"""


SQL = "with f as (" + " union all ".join(_sql_kind(r.kind, r.pattern, r.group, r.min_chars) for r in RULES) + """),
o as (select doc_id, kind, s, kind || ':' || cast(cast(s as bigint) as varchar) || ':' || cast(cast(s + n as bigint) as varchar) as span, list_position(['assign', 'access', 'hex', 'private_key'], kind) as k from f),
a as (select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
  string_agg(span, ',' order by s, k) as spans, string_agg(span, ',' order by s, k) filter (k <= 3) as base from o group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join a on d.doc_id = a.doc_id"""
