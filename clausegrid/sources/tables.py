"""Table scans (S6, S7) and parquet sinks."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH_COLUMNS = {
    "documents": ["id", "title", "version", "status", "effective_date"],
    "chunks": ["id", "document_id", "section_path", "clause_ref", "text", "version"],
    "entities": ["id", "type", "name", "document_id", "attrs"],
}


ROWS_PER_TASK = 250_000  # of a given table, at most


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table. One that comes in fewer splits than there are cores, or in splits of many
    short rows, is spread, so that text work on it does not run in few or long tasks; a large
    one of long rows is left as it is. The rows are counted from the files' footers."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    wanted = max(spark.sparkContext.defaultParallelism, -(-df.count() // ROWS_PER_TASK))
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def load_for_graph(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three full loads, each reading only the columns the graph uses."""
    return {t: spark.read.parquet(f"{folder}/{t}").select(*c) for t, c in GRAPH_COLUMNS.items()}


def active_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of active documents with the title. The join picks its own strategy:
    the document side grows with the corpus, so it is not forced to broadcast."""
    active = documents.filter("status = 'active'").select("document_id", "title")
    return chunks.join(active, "document_id")


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_whole_documents(
    chunks: DataFrame, entities: DataFrame, rejected: DataFrame, folder: str, batch: str
) -> None:
    """Add a batch of chunks and entities of documents without a violation; a rejected
    document contributes nothing to either table.

    A batch has folders of its own and counts once its mark is written, after both tables,
    so readers see both or neither. Writing the same batch again replaces it.
    """
    bad = rejected.select("document_id").distinct()
    for name, rows in (("chunks", chunks), ("entities", entities)):
        rows.join(bad, "document_id", "left_anti").write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")
    mark = chunks.sparkSession.createDataFrame([(batch,)], "batch string")
    mark.write.mode("overwrite").parquet(f"{folder}/published/of={batch}")


def published(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The rows of all complete batches."""
    complete = spark.read.parquet(f"{folder}/published").select("batch")
    rows = spark.read.parquet(f"{folder}/{name}").withColumn("batch", F.col("batch").cast("string"))
    return rows.join(complete, "batch", "left_semi").drop("batch")


def rebuild(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Full rebuild."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def new_edges(edges: DataFrame, existing: DataFrame) -> DataFrame:
    """Edges that are not stored yet (incremental mode adds, never clears)."""
    key = ["type", "src_label", "src", "dst_label", "dst"]
    return edges.dropDuplicates(key).join(existing.select(*key), key, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], seq: str) -> DataFrame:
    """The last write per key wins; ``existing`` rows count as older than any write.

    ``max_by`` combines on the map side, so a key written by many rows is no hot spot.
    """
    columns = [c for c in existing.columns if c not in key]
    old = existing.select(*key, F.struct(*columns).alias("row"), F.lit(None).cast("long").alias("seq"))
    new = incoming.select(*key, F.struct(*columns).alias("row"), F.col(seq).cast("long").alias("seq"))
    latest = old.unionByName(new).groupBy(*key).agg(
        F.max_by("row", F.struct(F.col("seq").isNotNull(), F.coalesce("seq", F.lit(0)))).alias("row")
    )
    return latest.select(*key, "row.*")


def audit_rows(df: DataFrame, actor: Column, action: Column, payload: Column, ts: Column) -> DataFrame:
    """Audit rows; ``payload`` is a struct Column, stored as JSON text."""
    return df.select(
        actor.cast("string").alias("actor"), action.alias("action"), F.to_json(payload).alias("payload"), ts.alias("ts")
    )
