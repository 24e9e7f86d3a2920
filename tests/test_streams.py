"""Watched folders beside a batch run, restarts included."""

import datetime

import pytest

from clausegrid.sources.lines import line_chunks
from clausegrid.sources.tables import published
from clausegrid.streaming import watch as W

DOCS = "doc_id long, text string"


def batch_rows(spark, rows):
    return sorted(map(tuple, line_chunks(spark.createDataFrame(rows, DOCS)).select("chunk_id", "document_id", "line_no", "text").collect()))


def test_watched_folder_and_restart(spark, tmp_path, monkeypatch):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    first, second = [(1, "a\n\nb"), (2, None), (3, " x ")], [(4, "later\nlines"), (5, "")]
    spark.createDataFrame(first, DOCS).coalesce(1).write.parquet(source)

    def run():
        W.watch_documents(W.new_documents(spark, source, DOCS, 1), out, state).awaitTermination()

    run()
    assert sorted(map(tuple, published(spark, out, "chunks").select("chunk_id", "document_id", "line_no", "text").collect())) == batch_rows(spark, first)
    run()  # nothing new
    spark.createDataFrame(second, DOCS).repartition(2).write.mode("append").parquet(source)
    real = W.append_whole_documents

    def breaks(chunks, entities, rejected, folder, batch):
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch}")  # and no mark
        raise RuntimeError("lost")

    monkeypatch.setattr(W, "append_whole_documents", breaks)
    with pytest.raises(Exception):
        run()
    assert sorted(map(tuple, published(spark, out, "chunks").select("chunk_id", "document_id", "line_no", "text").collect())) == batch_rows(spark, first)
    monkeypatch.setattr(W, "append_whole_documents", real)
    run()
    assert sorted(map(tuple, published(spark, out, "chunks").select("chunk_id", "document_id", "line_no", "text").collect())) == batch_rows(spark, first + second)


def test_windows_are_written_once_they_are_closed(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    day = lambda d, h=1: datetime.datetime(2024, 1, d, h)

    def arrive(rows):
        spark.createDataFrame(rows, "ts timestamp, action string").coalesce(1).write.mode("append").parquet(source)
        W.count_actions(W.new_documents(spark, source, "ts timestamp, action string"), out, state).awaitTermination()
        return sorted((r.start.day, r.action, r.n) for r in spark.read.schema("start timestamp, action string, n long").parquet(out).collect())

    assert arrive([(day(1), "read"), (day(1), "read"), (day(1, 5), "edit"), (day(2), "read")]) == []
    assert arrive([(day(1), "read"), (day(3, 2), "edit")]) == [(1, "edit", 1), (1, "read", 3)]
    assert arrive([(day(1), "read"), (day(9), "edit")]) == [(1, "edit", 1), (1, "read", 3), (2, "read", 1), (3, "edit", 1)]
