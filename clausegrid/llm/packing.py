"""Best-fit-decreasing packing of tokenised documents into sequences of bounded length.

Each task encodes its documents and cuts the long ones into pieces; only the lengths are
shuffled. The pieces are dealt out evenly by their place in the input, not by a key, into
groups of about ``GROUP_BYTES`` of text and rows, and each group is packed by itself: longest piece
first, each into the open sequence with the least room that still holds it. A segment tree
over the possible remaining rooms finds that sequence in logarithmic time. A group leaves at
most a few sequences partly filled, so the split costs a handful out of tens of thousands.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm import vocab
from clausegrid.llm.tokens import DEFAULT_VOCABULARY, byte_runs

GROUP_BYTES = 64 << 20
ROW_BYTES = 256  # what a row counts besides its text, so that empty texts fill groups too
OUT_ROWS = 20_000


class OpenBins:
    """Open bins by remaining room, with a segment tree over the rooms 0..capacity."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        node = room + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take_tightest(self, need: int) -> tuple[int, int] | None:
        """(room, bin) with the least room of at least ``need``; None if no bin holds it."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if count[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; equal lengths in the order given. Lengths are 0..capacity."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened, n = OpenBins(capacity), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        found = opened.take_tightest(length) if length < capacity else None
        if found is None:
            room, number, n = capacity, n, n + 1
        else:
            room, number = found
        bins[i], offsets[i] = number, capacity - room
        if room > length:
            opened.put(room - length, number)
    return bins, offsets


def cut_points(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of ``n`` tokens: a first piece with the remainder, then full ones."""
    first = n % capacity or min(n, capacity)
    return [0, *range(first, n, capacity)]


def token_pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int, end_id: int | None, file: str, with_ids: bool) -> DataFrame:
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "place"] + ["ids"] * with_ids
    types = [None, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, place = vocab.load(file), TaskContext.get().partitionId() << 40
        end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        columns: list[list] = [[] for _ in names]

        def flush():
            arrays = [pa.array(c, t) for c, t in zip(columns, [id_type, *types[1:]])]
            for c in columns:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for run in byte_runs(batches, "_text"):
            id_type = run.column(0).type
            for key, text in zip(run.column(0).to_pylist(), run.column(1).to_pylist()):
                data = v.encoded(text) + end
                n = len(data) // 4
                starts = cut_points(n, capacity)
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    part = data[4 * a : 4 * b]
                    for c, x in zip(columns, (key, k, a, b - a, zlib.crc32(part), place, part)):
                        c.append(x)
                    place += 1
            if len(columns[0]) >= OUT_ROWS or with_ids:
                yield flush()
        if columns[0]:
            yield flush()

    return rows.mapInArrow(pieces, f"id {kind}, piece int, start long, length long, ids_crc32 long, place long" + ", ids binary" * with_ids)


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int | None = 2,
    vocabulary: str = DEFAULT_VOCABULARY, path: str | None = None, with_ids: bool = False, group_bytes: int = GROUP_BYTES,
) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset[, ids])``, one row per piece.

    Null text is empty; a document without any token (empty, ``end_id=None``) is one piece of
    length 0. Repeated rows are packed as often as they come; null ids are kept. An empty
    table gives no rows. ``with_ids`` adds the ids as little-endian unsigned 32-bit numbers.
    Sequence ids are unique and may have gaps.
    """
    file = path or vocab.public(vocabulary)
    total = docs.select(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long") + ROW_BYTES)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    found = token_pieces(docs, id_col, text_col, capacity, end_id, file, with_ids)
    columns = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    dealt = found.select(*columns, "place", F.pmod(F.xxhash64("place"), F.lit(groups)).alias("_group"))
    kind = found.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long{', ids binary' * with_ids}, sequence_id long, offset long"

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("place", "ascending")])
        bins, offsets = best_fit_decreasing(table.column("length").to_numpy(), capacity)
        group = table.column("_group")[0].as_py()
        out = table.select(columns)
        return out.append_column("sequence_id", pa.array((group << 40) + bins)).append_column("offset", pa.array(offsets))

    packed = dealt.groupBy("_group").applyInArrow(fill, schema)
    return packed.withColumnRenamed("id", id_col)


def sequences(pieces: DataFrame) -> DataFrame:
    """``(sequence_id, length, ids)``: the filled sequences, from ``pack(with_ids=True)``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")
    )
