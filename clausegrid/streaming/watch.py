"""A watched folder and a running audit count (S1, S9) with Structured Streaming.

Each micro-batch of new files becomes one marked batch of chunks, named after the micro-batch.
A batch that is delivered again after a restart replaces itself, so the stored chunks are those
of a batch run over the same files.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from clausegrid.sources.lines import line_chunks
from clausegrid.sources.tables import append_whole_documents

NO_ENTITIES = "document_id {0}, entity_id string"
NO_REJECTS = "document_id {0}"


def new_documents(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """Rows of the parquet files that arrive in ``path``; a micro-batch takes at most ``max_files``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def watch_documents(documents: DataFrame, folder: str, checkpoint: str, doc_id: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Chunk the documents that have arrived and store them as marked batches in ``folder``;
    ends when all are stored. ``tables.published`` reads them."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def store(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        chunks = line_chunks(batch, doc_id, text).select("chunk_id", "document_id", "line_no", "text")
        append_whole_documents(chunks, spark.createDataFrame([], NO_ENTITIES.format(kind)), spark.createDataFrame([], NO_REJECTS.format(kind)), folder, str(number))

    return documents.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_actions(log: DataFrame, folder: str, checkpoint: str, window: str = "1 day", delay: str = "1 day") -> StreamingQuery:
    """Rows of the log ``(ts, action)`` per window and action. A window is written once, when
    the watermark, ``delay`` behind the newest row, has passed its end; later rows for it
    are dropped, so the state holds open windows only."""
    counts = log.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "action").agg(F.count("*").alias("n"))
    rows = counts.select(F.col("w.start").alias("start"), "action", "n")
    return rows.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
