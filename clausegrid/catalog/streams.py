"""Streams over the given tables, run until all their files are taken."""

from pyspark.sql import functions as F

from clausegrid.catalog.registry import query, with_ctes
from clausegrid.catalog.retrieval import LINES
from clausegrid.functions.stages import new_folder
from clausegrid.sources.tables import published
from clausegrid.streaming import watch as W


def arrivals(spark, sf, name):
    """A given table is one file or a folder of files; a glob takes both."""
    return W.new_documents(spark, f"{sf}/{name}.parque[t]", spark.read.parquet(f"{sf}/{name}.parquet").schema)


@query("watched_documents", with_ctes(LINES, select="select document_id || ':' || ord as chunk_id, document_id, ord as line_no, text from lines"))
def watched_documents(spark, sf):
    folder, checkpoint = new_folder(spark, "watched"), new_folder(spark, "watch-state")
    W.watch_documents(arrivals(spark, sf, "documents"), folder, checkpoint).awaitTermination()
    return published(spark, folder, "chunks")


@query("streamed_action_counts", with_ctes("""days as (select date_trunc('day', ts)::timestamp as start, event_type as action, count(*) as n from events group by all)""", select="""
  select start, action, n from days where start + interval 1 day <= (select max(ts) - interval 1 day from events)"""))
def streamed_action_counts(spark, sf):
    folder, checkpoint = new_folder(spark, "counts"), new_folder(spark, "count-state")
    log = arrivals(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("action"))
    W.count_actions(log, folder, checkpoint).awaitTermination()
    return spark.read.schema("start timestamp, action string, n long").parquet(folder)
