"""URL filters: block and allow rules first, boosted trees on lexical features for the rest.

DataFrame functions and the JVM's own gradient-boosted trees only. A verdict depends on the
URL alone, so each distinct URL is judged once and the verdicts are joined back to all pages.

A null URL or one without ``://`` has an empty host and path, fits no rule and goes to the
trees like any other. Repeated rows give repeated rows. Without labelled URLs of both
verdicts there are no trees and URLs without a rule are allowed.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.llm.storage import stored

#: Fixed values: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The trees are fitted on at most this many labelled URLs, chosen by a hash.
FIT_URLS = 20_000
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "marks", "secure", "suffix_rate", "domain_rate"]
SMOOTHING = 20.0


def with_parts(urls: DataFrame) -> DataFrame:
    """Adds ``host`` and ``path`` to a table with the column ``_url``."""
    rest = F.coalesce(F.expr("case when instr(_url, '://') > 0 then substring(_url, instr(_url, '://') + 3) end"), F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return urls.withColumn("host", lowered).withColumn("path", path)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, rule_host string, rule_path string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``(_url, rule, rule_verdict)`` of the distinct URLs that a rule fits; the longest rule
    wins, of equal length the one with the longer host, then the last in the alphabet."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    each = urls.filter("host != ''").select("_url", "path", F.explode(suffixes).alias("rule_host"))
    fits = each.join(rules, "rule_host").filter("startswith(path, rule_path)")
    text = F.concat("rule_host", "rule_path")
    best = F.max_by(F.struct(text.alias("rule"), "verdict"), F.struct(F.length(text), F.length("rule_host"), "rule_host", "verdict"))
    return fits.groupBy("_url").agg(best.alias("b")).select("_url", F.col("b.rule").alias("rule"), F.col("b.verdict").alias("rule_verdict"))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    chars = F.split(text, "")
    n = F.greatest(F.size(chars), F.lit(1))
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    return -F.aggregate(F.transform(F.array_distinct(chars), lambda c: share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x)


def lexical(urls: DataFrame) -> DataFrame:
    """Features that need nothing but the URL, and its public suffix and domain."""
    url = F.coalesce(F.col("_url"), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    length = F.length(url)
    return urls.select(
        "*", length.cast("double").alias("length"), F.length("host").cast("double").alias("host_length"), F.length("path").cast("double").alias("path_length"),
        F.length(F.regexp_replace("path", "[^/]", "")).cast("double").alias("depth"), F.size(F.split("host", r"\.")).cast("double").alias("labels"),
        (digits / F.greatest(length, F.lit(1))).alias("digit_ratio"), _entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")).alias("parameters"),
        F.length(F.regexp_replace(url, "[^-_~%@=]", "")).cast("double").alias("marks"),
        F.startswith(F.lower(url), F.lit("https://")).cast("double").alias("secure"),
        F.substring_index("host", ".", -1).alias("suffix"), F.substring_index("host", ".", -2).alias("domain"),
    )


def with_suffix_rates(urls: DataFrame, labelled: DataFrame) -> DataFrame:
    """Smoothed share of blocked URLs among the labelled ones of the same suffix and domain."""
    for key, name in (("suffix", "suffix_rate"), ("domain", "domain_rate")):
        rates = labelled.groupBy(key).agg(((F.sum("label") + SMOOTHING / 2) / (F.count("*") + SMOOTHING)).alias(name))
        urls = urls.join(rates, key, "left").withColumn(name, F.coalesce(name, F.lit(0.5)))
    return urls


def fit(labelled: DataFrame, trees: int = 20, depth: int = 4, limit: int = FIT_URLS) -> Model | None:
    """Trees for rows with the features and ``label`` (1 blocked), on at most ``limit`` rows, half of
    them of each label; None unless both labels occur."""
    halves = [labelled.filter(F.col("label") == y).orderBy(F.xxhash64("_url"), "_url").limit(max(1, limit // 2)) for y in (0, 1)]
    sample = halves[0].unionByName(halves[1]).select(*FEATURES, F.col("label").cast("double").alias("label"))
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    total = sum(sizes.values())
    weight = F.when(F.col("label") == 1.0, total / (2.0 * sizes[1.0])).otherwise(total / (2.0 * sizes[0.0]))
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.withColumn("weight", weight))
    return GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=7).fit(vectors)


def judge(pages: DataFrame, rules: DataFrame | None = None, labelled: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``pages``.

    ``labelled`` is a table ``(url, label)``, 1 for blocked. By default the rules label the URLs:
    1 where a rule blocks, else 0, so the trees carry the block rules on to what looks like it.
    """
    rules = rule_table(pages.sparkSession) if rules is None else rules
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    urls = with_parts(rows.select("_url").distinct())
    ruled = match_rules(urls, rules)
    known = urls.join(ruled, "_url", "left")
    features = stored(lexical(known), "features")  # the rates, the fit and the scores read it
    if labelled is None:
        marked = features.withColumn("label", F.col("rule_verdict").eqNullSafe("block").cast("int"))
    else:
        given = labelled.select(F.col("url").alias("_url"), F.col("label").cast("int").alias("label")).filter("_url is not null and label in (0, 1)")
        marked = stored(lexical(with_parts(given)), "labelled")
    model = fit(with_suffix_rates(marked, marked))
    if model is None:
        judged = features.withColumn("verdict", F.coalesce("rule_verdict", F.lit("allow")))
    else:
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_suffix_rates(features, marked))
        scored = model.transform(vectors)
        judged = scored.withColumn("verdict", F.coalesce("rule_verdict", F.when(F.col("prediction") == 1.0, "block").otherwise("allow")))
    judged = judged.select(F.col("_url").alias("_key"), "host", "path", "rule", "verdict")
    out = rows.join(judged, F.col("_url").eqNullSafe(F.col("_key")), "left")
    return out.select(F.col("_id").alias(id_col), "host", "path", "rule", "verdict")
