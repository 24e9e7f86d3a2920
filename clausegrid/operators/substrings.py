"""Substring matching by q-grams: a join with any table of names (P6), and a stored trigram
index for searches (B7).

A text that contains a name contains each of its q-grams, so rows meet on one gram and
``contains`` decides. Nothing is compared with everything.
"""

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegrid.functions.sizes import BROADCAST_BYTES, is_small
from clausegrid.functions.stages import materialise, stored

Q = 3
BLOCK_BITS = 12


def grams(text: Column, q: int) -> Column:
    """The distinct runs of ``q`` characters; none in a shorter text."""
    return F.array_distinct(F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - q + 1, F.lit(1))), lambda i: i + q - 1 <= F.length(text)),
        lambda i: F.substring(text, i, F.lit(q))))


def contained_names(names: DataFrame, texts: DataFrame, name: str, text: str) -> DataFrame:
    """Distinct pairs ``(name, text)`` where the text contains the name, whatever the case.

    A name is looked up by the one of its q-grams that the fewest texts hold; a gram that no
    text holds rules the name out. Names shorter than q are looked up whole among the runs of
    their length. The empty name is in every text. Nulls match nothing.
    """
    wanted = names.select(F.col(name).alias("_name"), F.lower(name).alias("_n")).filter("_name is not null").distinct()
    held = texts.select(F.col(text).alias("_text"), F.lower(text).alias("_t")).filter("_text is not null").distinct()
    found = None
    for q in range(1, Q):
        short = wanted.filter(F.length("_n") == q)
        pairs = held.select("_text", F.explode(grams(F.col("_t"), q)).alias("_n")).join(short, "_n").select("_name", "_text")
        found = pairs if found is None else found.unionByName(pairs)
    of_name = wanted.filter(F.length("_n") >= Q).select("_name", "_n", F.explode(grams(F.col("_n"), Q)).alias("_g"))
    of_text = held.select("_text", "_t", F.explode(grams(F.col("_t"), Q)).alias("_g"))
    used = of_text.join(of_name.select("_g").distinct(), "_g", "left_semi").groupBy("_g").agg(F.count("*").alias("_held"))
    rarest = of_name.join(used, "_g", "left").groupBy("_name", "_n").agg(
        F.min(F.struct(F.coalesce("_held", F.lit(0)).alias("h"), "_g")).alias("_least")).filter("_least.h > 0")
    near = of_text.join(rarest.select("_name", "_n", F.col("_least._g").alias("_g")), "_g")
    found = found.unionByName(near.filter(F.contains("_t", "_n")).select("_name", "_text"))
    empty = wanted.filter("_n = ''").agg(F.count("*") > 0).scalar()
    found = found.unionByName(held.filter(empty).select(F.lit("").alias("_name"), "_text"))
    return found.select(F.col("_name").alias(name), F.col("_text").alias(text))


def approval_records_for(names: DataFrame, approvers: DataFrame, wanted: str = "wanted") -> DataFrame:
    """(wanted, role, process) for any table of wanted names; the approvers' pairs are as in
    ``questions.approval_records``."""
    pairs = contained_names(names.select(wanted), approvers.select("process"), wanted, "process")
    return approvers.select("role", "process").join(pairs, "process").select(wanted, "role", "process")


# --- Search ---------------------------------------------------------------------------------

def literals(pattern: str) -> list[str]:
    """The literal parts of a LIKE pattern, in lower case; ``\\`` makes a wildcard literal."""
    parts = re.split(r"(?:(?<=^)|(?<=[^\\])|(?<=\\\\))[%_]", pattern)
    return [p for p in (re.sub(r"\\(.)", r"\1", part).lower() for part in parts) if p]


def needed_grams(pattern: str) -> list[str]:
    """The trigrams that every match holds; few where the literal parts are short."""
    return sorted({part[i : i + Q] for part in literals(pattern) for i in range(len(part) - Q + 1)})


def _postings(fields: list[str], bits: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The grams of each run of rows of one block, with the sorted numbers of the rows that hold them."""
        for batch in batches:
            nums = batch.column("_num").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(nums >> bits)) + 1, [len(nums)]])
            for start, end in zip(edges[:-1], edges[1:]):
                for field in fields if end > start else ():
                    texts = batch.column(field).slice(start, end - start)
                    grams, held, n = _held(texts)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(nums[start + held]))
                    same = lambda v, t: pa.array(np.full(len(grams), v), t)
                    yield pa.RecordBatch.from_pydict({
                        "gram": pa.array(grams, pa.string()), "field": pa.array([field] * len(grams), pa.string()),
                        "_block": same(nums[start] >> bits, pa.int64()), "_part": same(nums[start], pa.int64()), "nums": lists})

    return cut


def _held(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct grams, the rows that hold each, one gram after the other, and how many they are)."""
    length = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    points = np.frombuffer("".join(t for t in texts.to_pylist() if t).encode("utf-32-le"), np.uint32)
    if len(points) < Q:
        return [], np.zeros(0, int), np.zeros(0, int)
    met = np.zeros(int(points.max()) + 1, bool)
    met[points] = True
    known, code = np.flatnonzero(met), (np.cumsum(met) - 1)[points]
    row = np.repeat(np.arange(len(length)), length)
    gram = np.zeros(len(points) - Q + 1, np.int64)
    for i in range(Q):
        gram = gram * len(known) + code[i : len(points) - Q + 1 + i]
    inside = row[: len(gram)] == row[Q - 1 :]
    gram, row, found = gram[inside], row[: len(inside)][inside], None
    if len(known) ** Q * len(length) >= 1 << 62:  # then gram and row do not fit one number
        found, gram = np.unique(gram, return_inverse=True)
    pair = np.sort(gram * np.int64(len(length)) + row)
    gram, held = np.divmod(pair[np.diff(pair, prepend=-1) > 0], len(length))
    starts = np.flatnonzero(np.diff(gram, prepend=-1) > 0)
    found, n = gram[starts] if found is None else found, np.diff(starts, append=len(gram))
    places = [found // len(known) ** i % len(known) for i in reversed(range(Q))]
    letters = known[np.stack(places, axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    return [letters[i : i + Q] for i in range(0, len(letters), Q)], held, n


def build_trigrams(chunks: DataFrame, folder: str, fields: list[str]) -> None:
    """Store the chunks, numbered as they come in their tasks, and the postings of each field's
    trigrams: per gram and run of rows of one block the sorted numbers of the chunks that hold it.
    A run is what a task reads of a block at once, so postings are made where the texts are read
    and not shuffled; a row has at most as many numbers as a block has chunks."""
    spark = chunks.sparkSession
    rows = chunks.withColumn("_num", F.monotonically_increasing_id()).withColumn("_block", F.shiftright("_num", BLOCK_BITS))
    rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/chunks")
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/chunks").select("_num", *[F.lower(f).alias(f) for f in fields])
    posts = stored.mapInArrow(_postings(fields, BLOCK_BITS), "gram string, field string, _block long, _part long, nums array<bigint>")
    posts.sortWithinPartitions("gram").write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/postings")


class Matches(NamedTuple):
    rows: DataFrame  # all matches, with their columns
    candidates: DataFrame | None  # (_block, _num) of the texts that were read; None: all of them


def search_trigrams(spark: SparkSession, folder: str, search: str, fields: list[str]) -> Matches:
    """Chunks of which a field matches ``%search%`` (case ignored, wildcards work).

    The lists of the needed grams are intersected run by run of a block, and only the chunks left
    are compared: their bitmaps, one row per 64 chunks, meet the texts without moving them. A search without a literal part of three characters reads all.
    """
    stored = spark.read.parquet(f"{folder}/chunks")
    matches = F.lit(False)
    for f in fields:
        matches = matches | F.coalesce(F.col(f).ilike(f"%{search}%"), F.lit(False))
    asked = needed_grams(f"%{search}%")
    if not asked:
        return Matches(stored.filter(matches).drop("_num", "_block"), None)
    lists = spark.read.parquet(f"{folder}/postings").filter(F.col("gram").isin(asked) & F.col("field").isin(fields))
    met = lists.groupBy("field", "_block", "_part").agg(F.collect_list("nums").alias("l")).filter(F.size("l") == len(asked))
    both = met.select("_block", F.explode(F.aggregate(F.slice("l", 2, len(asked)), F.col("l")[0], F.array_intersect)).alias("_num"))
    candidates = both.distinct()
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_num").bitwiseAND(63).cast("int"))
    masks = materialise(candidates.groupBy(F.shiftright("_num", 6).alias("_word")).agg(F.bit_or(bit).alias("_mask")))
    masks = F.broadcast(masks) if is_small(masks, F.lit(40), BROADCAST_BYTES // 40) else masks
    near = stored.withColumn("_word", F.shiftright("_num", 6)).join(masks, "_word").filter(F.getbit("_mask", F.col("_num").bitwiseAND(63).cast("int")) == 1)
    return Matches(near.filter(matches).drop("_num", "_block", "_word", "_mask"), candidates)


def page(matches: Matches, order: list[str], limit: int | None = 50, offset: int = 0) -> DataFrame:
    """One page in the order given, and the ``total`` of all matches. The matches are stored
    first, so both come from one pass over the candidates."""
    found = stored(matches.rows, "matches")
    total = found.agg(F.count("*").alias("n")).scalar()
    rows = found.orderBy(*order).offset(offset)
    rows = rows if limit is None else rows.limit(limit)
    return rows.withColumn("total", total)
