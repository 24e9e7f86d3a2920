"""Token counts: batch encoding in Arrow functions that return lengths only.

Arrow batches are cut again into runs of about equal bytes, so one run never holds many
long texts, and a long text is encoded in pieces cut at safe boundaries. Nothing is
shuffled. Null text counts as empty: 0 bytes, 0 tokens. Every input row gives one row,
repeated rows and null ids included; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm import vocab

RUN_BYTES = 4 << 20
DEFAULT_VOCABULARY = "byte_bpe_50k.json"


def byte_runs(batches: Iterator[pa.RecordBatch], column: str, run_bytes: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``run_bytes`` of text each; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + size > run_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)


def token_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY,
    limit: int = 1024, path: str | None = None,
) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for each row of ``docs``.

    ``vocabulary`` names a public file; ``path`` gives another file that all executors can read.
    """
    file = path or vocab.public(vocabulary)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocab.load(file)
        for run in byte_runs(batches, "_text"):
            texts = run.column(1)
            n_bytes = pc.cast(pc.binary_length(texts), pa.int64())
            n_tokens = pa.array([v.count(t) for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([run.column(0), n_bytes, n_tokens], names=["id", "n_bytes", "n_tokens"])

    counted = rows.mapInArrow(count, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
