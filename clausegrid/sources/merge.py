"""MERGE into a stored table that is laid out in hash buckets of its key.

A merge finds the buckets of the incoming keys and rewrites those alone; the files of every
other bucket stay as they are. The new buckets are written beside the old ones and count once
the version of the merge is written, which names the place of every bucket. A merge that
broke off leaves the table as it was, and the same merge again replaces what it left.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.functions.stages import materialise

BUCKETS = 256
PLACES = "bucket int, place string, version long"


def bucket_of(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")


def _places(spark: SparkSession, folder: str) -> tuple[int, dict[int, str]]:
    """(version, place of each bucket that has rows); at most one row per bucket."""
    try:
        rows = spark.read.schema(PLACES).parquet(f"{folder}/versions")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    newest = rows.agg(F.max("version")).first()[0] or 0
    return newest, {r["bucket"]: r["place"] for r in rows.filter(F.col("version") == newest).collect() if r["bucket"] is not None}


def stored_table(spark: SparkSession, folder: str, schema, buckets: list[int] | None = None) -> DataFrame:
    """The table's rows, of ``buckets`` alone if they are named; ``schema`` is that of the rows."""
    places = _places(spark, folder)[1]
    paths = [f"{folder}/data/{place}/_bucket={b}" for b, place in sorted(places.items()) if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge(incoming: DataFrame, folder: str, key: list[str], seq: str | None = None, buckets: int = BUCKETS) -> list[int]:
    """Merge ``incoming`` and return the rewritten buckets.

    With ``seq`` the last write of a key wins and replaces the stored row (S12); of equal numbers
    the greatest row. Without it only keys that are not stored are added, one row each, the
    least (S11). ``seq`` is not stored. Keys with nulls are keys like any other.
    """
    spark = incoming.sparkSession
    columns = [c for c in incoming.columns if c != seq]
    rest = [c for c in columns if c not in key]
    rows = incoming.withColumn("_bucket", bucket_of(key, buckets))
    row = F.struct(*rest)
    # ``max_by`` and ``min`` combine on the map side, so a key that is written often is no hot spot.
    chosen = F.max_by(row, F.struct(F.col(seq), row)) if seq else F.min(row)
    new = materialise(rows.groupBy("_bucket", *key).agg(chosen.alias("_row")))
    touched = sorted(r["_bucket"] for r in new.select("_bucket").distinct().collect())  # at most ``buckets`` numbers
    if not touched:
        return []
    version, places = _places(spark, folder)
    schema = incoming.select(*columns).schema
    old = stored_table(spark, folder, schema, touched).withColumn("_bucket", bucket_of(key, buckets))
    old = old.select("_bucket", *key, row.alias("_row"), F.lit(not seq).alias("_wins"))
    both = old.unionByName(new.withColumn("_wins", F.lit(bool(seq))))
    merged = both.groupBy("_bucket", *key).agg(F.max_by("_row", "_wins").alias("_row"))
    if not seq:  # buckets that would get no new key stay as they are
        had = old.select(*key).withColumn("_had", F.lit(True))
        joined = new.alias("n").join(had.alias("h"), [F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}")) for c in key], "left_anti")
        touched = sorted(r["_bucket"] for r in joined.select("_bucket").distinct().collect())
        if not touched:
            return []
        merged = merged.filter(F.col("_bucket").isin(touched))
    place = f"v{version + 1:08d}"
    merged.select("_bucket", *key, "_row.*").select("_bucket", *columns).hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/data/{place}")
    now = {**places, **{b: place for b in touched}}
    spark.createDataFrame([(b, p, version + 1) for b, p in sorted(now.items())], PLACES).coalesce(1).write.mode("append").parquet(f"{folder}/versions")
    return touched
