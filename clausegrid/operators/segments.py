"""A lexical index in immutable segments, searched by block-max pruning.

A segment holds the postings of one batch of chunks. The chunks of a task are numbered as they
come and cut into blocks of at most ``1 << BLOCK_BITS``; a row of ``blocks`` is one block: its
chunks, and for each of its terms the postings and the peaks, the least chunk length of each term
frequency. The greatest impact of a term in a block follows from the peaks alone and stays exact
when the mean length, k1 or b change. As a block is one row, it is made, bounded and scored in the
task that reads it, and no posting is shuffled.

Adding a batch writes a segment, deleting chunks writes tombstones with the document
frequencies they take away, and merging writes one segment in place of several small ones;
nothing else is touched. A block also holds, per access tag, a bitmap of the chunks
with that tag; a search for given tags looks at no block without a bit. A change counts once its
version of the manifest is written, so a reader or a run that broke off sees the index before or
after it.
"""

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausegrid.functions import fixed
from clausegrid.functions.sizes import BROADCAST_BYTES, BROADCAST_ROWS, is_small, small_side
from clausegrid.functions.stages import materialise
from clausegrid.functions.text import once, tokens
from clausegrid.operators import retrieval as R

BLOCK_BITS = 4  # at most 6, as the bitmap of a block is one integer
TASK_BITS = 32  # block numbers of one task
TIER = 4  # segments of the same size class, a power of TIER, are merged
SLACK = 1e-7  # sums in another order may differ by less
MANIFEST = "kind string, name string, n long, total long, version long"
HEADS = ("terms", "peak_ns", "peak_tfs", "peak_lens")  # what bounds need of a block
POSTS = ("ns", "places", "tfs", "lens", "ids", "ords")  # what scores need besides


class Segments(NamedTuple):
    """The live state of an index: postings, tombstones and term counts."""

    blocks: DataFrame | None  # segment, block, ids, ords, lens, terms, ns, places, tfs, peaks, tags, masks
    counts: DataFrame  # term, df without the deleted chunks
    dead: DataFrame | None  # segment, num
    n_chunks: int
    avg_len: float
    names: list[str]


def _manifest(spark: SparkSession, folder: str) -> tuple[int, list]:
    """(version, rows) of the newest complete version; a version is one row per part."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, []
    newest = rows.agg(F.max("version")).first()[0] or 0
    return newest, [r for r in rows.filter(F.col("version") == newest).collect() if r["kind"] != "none"]


def _publish(spark: SparkSession, folder: str, version: int, parts: list[tuple]) -> None:
    rows = [(*p, version) for p in parts] or [("none", "", 0, 0, version)]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def _next_name(version: int) -> str:
    """Parts of a change are named after its version: a repeated change replaces what a broken one left."""
    return f"v{version + 1:08d}"


def _lists(values, counts: np.ndarray) -> pa.ListArray:
    """Lists of the given lengths, one after the other, over ``values``."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class _Words(NamedTuple):
    """Chunks (``ids``, ``ords``, ``tags``) and their words: chunk ``row``, ``code`` of the term
    in ``terms`` and ``tf``."""

    ids: pa.Array
    ords: pa.Array
    tags: pa.Array
    terms: pa.Array
    row: np.ndarray
    code: np.ndarray
    tf: np.ndarray


def _flat(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(all elements, lengths) of a list column."""
    lists = column.combine_chunks()
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _counted(table: pa.Table) -> _Words:
    """The words of chunks ``(chunk_id, ord, t, tags)``, ``t`` as they come in the text."""
    words, n = _flat(table.column("t"))
    words = words.dictionary_encode()
    row = np.repeat(np.arange(len(n)), n)
    key, tf = np.unique(row * len(words.dictionary) + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    row, code = np.divmod(key, max(1, len(words.dictionary)))
    return _Words(table.column("chunk_id").combine_chunks(), table.column("ord").combine_chunks(), table.column("tags").combine_chunks(), words.dictionary, row, code, tf)


def _places_of(table: pa.Table, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each chunk of block rows; a block is never longer than ``1 << bits``."""
    n = pc.list_value_length(table.column("lens").combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _unpacked(table: pa.Table, bits: int) -> _Words:
    """The chunks of block rows whose bit is set in ``mask``, with their words."""
    mask = table.column("mask").to_numpy()
    row, place = _places_of(table, bits)
    kept = np.flatnonzero(mask[row] >> place & 1)
    number = np.full(table.num_rows << bits, -1)
    number[(row[kept] << bits) + place[kept]] = np.arange(len(kept))
    terms, n_terms = _flat(table.column("terms"))
    terms = terms.dictionary_encode()
    ns, places, tfs = (_flat(table.column(c))[0].to_numpy(zero_copy_only=False) for c in ("ns", "places", "tfs"))
    at = number[np.repeat(np.repeat(np.arange(table.num_rows) << bits, n_terms), ns) + places]
    code, live = np.repeat(terms.indices.to_numpy(zero_copy_only=False), ns), at >= 0
    tags, n_tags = _flat(table.column("tags"))
    masks, of = _flat(table.column("masks"))[0].to_numpy(zero_copy_only=False), np.repeat(np.arange(table.num_rows), n_tags)
    tag, chunk = [], []
    for i in range(1 << bits):
        has = np.flatnonzero(masks >> i & 1)
        here = number[(of[has] << bits) + i]
        tag.append(has[here >= 0])
        chunk.append(here[here >= 0])
    tag, chunk = np.concatenate(tag), np.concatenate(chunk)
    order = np.argsort(chunk, kind="stable")
    held = _lists(tags.take(pa.array(tag[order], pa.int64())), np.bincount(chunk, minlength=len(kept)))
    take = pa.array(kept, pa.int64())
    return _Words(_flat(table.column("ids"))[0].take(take), _flat(table.column("ords"))[0].take(take), held, terms.dictionary, at[live], code[live], tfs[live])


def _packed(words: _Words, bits: int, first: int) -> pa.RecordBatch:
    """Block rows, numbered from ``first``, of chunks and their words."""
    n = len(words.ids)
    blocks = -(-n >> bits)
    sizes = np.bincount(np.arange(n) >> bits, minlength=blocks)
    length = np.bincount(words.row, words.tf, minlength=n).astype(np.int32)
    block = words.row >> bits
    order = np.argsort(block * max(1, len(words.terms)) + words.code, kind="stable")
    b, code, row, tf = block[order], words.code[order], words.row[order], words.tf[order]
    at = _starts(b, code)
    per_term = np.diff(at, append=len(b))
    term = np.repeat(np.arange(len(at)), per_term)  # terms of blocks, in order
    by_tf = np.argsort(term * (tf.max(initial=0) + 1) + tf, kind="stable")
    ptf, pterm = tf[by_tf], term[by_tf]
    peaks = _starts(pterm, ptf)
    plen = np.minimum.reduceat(length[row][by_tf], peaks) if len(peaks) else np.zeros(0, np.int32)
    per_peaks = np.bincount(pterm[peaks], minlength=len(at))
    n_terms = np.bincount(b[at], minlength=blocks)
    n_posts, n_peaks = np.bincount(b, minlength=blocks), np.bincount(b[at][pterm[peaks]], minlength=blocks)
    tags, n_tags = words.tags.flatten(), pc.list_value_length(words.tags).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    tags, tagged = tags.dictionary_encode(), np.repeat(np.arange(n), n_tags)
    tag = tags.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.flatnonzero(tag >= 0)
    known = known[np.lexsort((tag[known], tagged[known] >> bits))]
    tb, tag, bit = tagged[known] >> bits, tag[known], np.left_shift(np.int64(1), tagged[known] & ((1 << bits) - 1))
    of_tag = _starts(tb, tag)
    masks = np.bitwise_or.reduceat(bit, of_tag) if len(of_tag) else np.zeros(0, np.int64)
    int_ = lambda x: pa.array(x, pa.int32())
    columns = {
        "block": pa.array(first + np.arange(blocks), pa.int64()), "ids": _lists(words.ids, sizes), "ords": _lists(words.ords, sizes), "lens": _lists(int_(length), sizes),
        "terms": _lists(words.terms.take(int_(code[at])), n_terms), "ns": _lists(int_(per_term), n_terms),
        "places": _lists(int_(row & ((1 << bits) - 1)), n_posts), "tfs": _lists(int_(tf), n_posts),
        "peak_ns": _lists(int_(per_peaks), n_terms), "peak_tfs": _lists(int_(ptf[peaks]), n_peaks), "peak_lens": _lists(int_(plen), n_peaks),
        "tags": _lists(tags.dictionary.take(int_(tag[of_tag])), np.bincount(tb[of_tag], minlength=blocks)), "masks": _lists(pa.array(masks, pa.int64()), np.bincount(tb[of_tag], minlength=blocks)),
    }
    return pa.RecordBatch.from_pydict(columns)


def _block_rows(words_of, bits: int):
    """Arrow batches to block rows. Blocks are filled within a batch, so the last one of a batch
    may be short, and nothing is held from one batch to the next."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << TASK_BITS
        for batch in batches:
            words = words_of(pa.Table.from_batches([batch]))
            if len(words.ids):
                rows = _packed(words, bits, first)
                first += rows.num_rows
                yield rows

    return pack


def _schema(chunk_id: str, ord: str) -> str:
    ints = ", ".join(f"{c} array<int>" for c in ("ns", "places", "tfs", "peak_ns", "peak_tfs", "peak_lens"))
    return f"block long, ids array<{chunk_id}>, ords array<{ord}>, lens array<int>, terms array<string>, {ints}, tags array<string>, masks array<bigint>"


def _write_segment(spark: SparkSession, folder: str, name: str, blocks: DataFrame) -> tuple:
    """Block rows as a segment, and the counts of its terms."""
    path = f"{folder}/segments/{name}"
    named = blocks.withColumn("segment", F.lit(name))
    named.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/blocks")
    stored = spark.read.schema(named.schema).parquet(f"{path}/blocks")
    each = stored.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("ns").alias("n"))))
    each.groupBy("term").agg(F.sum("n").alias("df")).withColumn("segment", F.lit(name)).write.mode("overwrite").parquet(f"{path}/counts")
    total = F.aggregate("lens", F.lit(0).cast("long"), lambda n, x: n + x)
    size = stored.agg(F.coalesce(F.sum(F.size("lens")), F.lit(0)).alias("n"), F.coalesce(F.sum(total), F.lit(0)).alias("total")).first()
    return ("segment", name, size["n"], size["total"])


def add(chunks: DataFrame, folder: str) -> str:
    """Add a batch of chunks ``(chunk_id, ord, text)`` and, if there, ``access_tags``; ids must not
    be in the index. Chunks without tags are seen by searches without an access filter only. The
    batch's texts are read once, and no other segment is."""
    spark = chunks.sparkSession
    version, parts = _manifest(spark, folder)
    name = _next_name(version)
    tags = F.col("access_tags") if "access_tags" in chunks.columns else F.array().cast("array<string>")
    # An outer generator, so that the words are cut once, before the filter.
    cut = once(chunks.select("chunk_id", "ord", "text", tags.alias("tags")), t=tokens(F.col("text"))).filter(F.size("t") > 0).select("chunk_id", "ord", "t", "tags")
    schema = _schema(*(cut.schema[c].dataType.simpleString() for c in ("chunk_id", "ord")))
    part = _write_segment(spark, folder, name, cut.mapInArrow(_block_rows(_counted, BLOCK_BITS), schema))
    _publish(spark, folder, version + 1, [*_kept(parts), part])
    return name


def _kept(parts: list, without: set = frozenset()) -> list[tuple]:
    return [(r["kind"], r["name"], r["n"], r["total"]) for r in parts if r["name"] not in without]


def _read(spark: SparkSession, folder: str, names: list[str], table: str) -> DataFrame | None:
    return spark.read.parquet(*[f"{folder}/segments/{n}/{table}" for n in names]) if names else None


def _deleted(spark: SparkSession, folder: str, parts: list, table: str) -> DataFrame | None:
    """Tombstones, or the counts they take away, of the live segments."""
    names = [r["name"] for r in parts if r["kind"] == "delete"]
    live = [r["name"] for r in parts if r["kind"] == "segment"]
    if not names or not live:
        return None
    return spark.read.parquet(*[f"{folder}/deletes/{n}/{table}" for n in names]).filter(F.col("segment").isin(live))


def _chunk_rows(blocks: DataFrame) -> DataFrame:
    """(segment, num, chunk_id, len) of the chunks of block rows."""
    each = blocks.select("segment", "block", F.posexplode(F.arrays_zip(F.col("ids").alias("id"), F.col("lens").alias("len"))).alias("place", "c"))
    first = F.call_function("shiftleft", F.col("block"), F.lit(BLOCK_BITS))
    return each.select("segment", (first + F.col("place")).alias("num"), F.col("c.id").alias("chunk_id"), F.col("c.len").alias("len"))


def _with_masks(blocks: DataFrame, dead: DataFrame | None, allowed_tags: list[str] | None = None) -> DataFrame:
    """Block rows with ``mask``, the bits of their live chunks, and with ``allowed_tags`` only those
    with one of the tags. Blocks without a bit go. There is one narrow row per block with a dead
    chunk, which meets the blocks without moving them."""
    every = F.when(F.size("lens") == 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.size("lens")) - 1)
    if allowed_tags is not None:
        pairs = F.filter(F.arrays_zip(F.col("tags").alias("t"), F.col("masks").alias("m")), lambda x: x["t"].isin(list(allowed_tags)))
        every = F.aggregate(pairs, F.lit(0).cast("long"), lambda m, x: m.bitwiseOR(x["m"]))
    masked = blocks.withColumn("mask", every)
    if dead is not None:
        masked = masked.join(_narrow(_masks(dead)), ["segment", "block"], "left")
        masked = masked.withColumn("mask", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("gone", F.lit(0).cast("long"))))).drop("gone")
    return masked.filter("mask <> 0")


def _masks(dead: DataFrame) -> DataFrame:
    """(segment, block, gone) of chunks ``(segment, num)``."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("num").bitwiseAND((1 << BLOCK_BITS) - 1).cast("int"))
    return dead.groupBy("segment", F.shiftright("num", BLOCK_BITS).alias("block")).agg(F.bit_or(bit).alias("gone"))


def _narrow(rows: DataFrame) -> DataFrame:
    """Rows of a few numbers, broadcast up to the same number of bytes as others."""
    rows = materialise(rows)
    return F.broadcast(rows) if is_small(rows, F.lit(40), BROADCAST_BYTES // 40) else rows


def _lost(bits: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(segment, term, df): in how many chunks that go, the bits of ``gone``, a term is."""
        for batch in batches:
            table = pa.Table.from_batches([batch])
            terms, n_terms = _flat(table.column("terms"))
            ns, places = (_flat(table.column(c))[0].to_numpy(zero_copy_only=False) for c in ("ns", "places"))
            of = np.repeat(np.arange(table.num_rows), n_terms)
            hit = table.column("gone").to_numpy()[np.repeat(of, ns)] >> places & 1
            df = np.bincount(np.repeat(np.arange(len(of)), ns), hit, minlength=len(of)).astype(np.int64)
            lost = np.flatnonzero(df)
            rows = pa.table({"segment": table.column("segment").take(pa.array(of[lost], pa.int64())), "term": terms.take(pa.array(lost, pa.int64())), "df": pa.array(df[lost])})
            yield from rows.group_by(["segment", "term"]).aggregate([("df", "sum")]).rename_columns(["segment", "term", "df"]).to_batches()

    return count


def delete(chunk_ids: DataFrame, folder: str) -> str | None:
    """Write tombstones for the live chunks named in ``chunk_ids (chunk_id)``; others are ignored.
    Only blocks that hold such a chunk are decoded, for the frequencies that go."""
    spark = chunk_ids.sparkSession
    version, parts = _manifest(spark, folder)
    names = [r["name"] for r in parts if r["kind"] == "segment"]
    blocks = _read(spark, folder, names, "blocks")
    if blocks is None:
        return None
    name = _next_name(version)
    gone = _chunk_rows(blocks).join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").select("segment", "num", "len")
    before = _deleted(spark, folder, parts, "dead")
    if before is not None:
        gone = gone.join(before, ["segment", "num"], "left_anti")
    path = f"{folder}/deletes/{name}"
    gone.write.mode("overwrite").parquet(f"{path}/dead")
    gone = spark.read.schema(gone.schema).parquet(f"{path}/dead")
    hit = blocks.select("segment", "block", "terms", "ns", "places").join(_narrow(_masks(gone)), ["segment", "block"])
    lost = hit.select("segment", "terms", "ns", "places", "gone").mapInArrow(_lost(BLOCK_BITS), "segment string, term string, df long")
    lost.groupBy("segment", "term").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(f"{path}/counts")
    size = gone.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
    _publish(spark, folder, version + 1, [*_kept(parts), ("delete", name, size["n"], size["total"])])
    return name


def to_merge(sizes: dict[str, int], tier: int = TIER) -> list[str]:
    """The segments of the smallest size class that holds at least two of them. Classes are
    powers of ``tier``, so a chunk is rewritten a logarithmic number of times."""
    classes: dict[int, list[str]] = {}
    for name, n in sizes.items():
        level = 0
        while n >= tier:
            n, level = n // tier, level + 1
        classes.setdefault(level, []).append(name)
    many = [level for level, names in classes.items() if len(names) > 1]
    return sorted(classes[min(many)]) if many else []


def merge(spark: SparkSession, folder: str, names: list[str] | None = None, tier: int = TIER) -> str | None:
    """Write one segment in place of ``names``, by default those that ``to_merge`` picks, without
    their deleted chunks. No text is read and no other segment, and a block is cut anew in the task
    that reads it."""
    version, parts = _manifest(spark, folder)
    sizes = {r["name"]: r["n"] for r in parts if r["kind"] == "segment"}
    names = to_merge(sizes, tier) if names is None else [n for n in names if n in sizes]
    if len(names) < 2:
        return None
    name = _next_name(version)
    blocks = _read(spark, folder, names, "blocks")
    kinds = (blocks.schema[c].dataType.elementType.simpleString() for c in ("ids", "ords"))
    bits = BLOCK_BITS
    masked = _with_masks(blocks, _deleted(spark, folder, parts, "dead"))
    masked = masked.select("ids", "ords", "lens", "terms", "ns", "places", "tfs", "tags", "masks", "mask")
    part = _write_segment(spark, folder, name, masked.mapInArrow(_block_rows(lambda t: _unpacked(t, bits), bits), _schema(*kinds)))
    left = set(sizes) - set(names)
    keep = _kept(parts, set(names))
    if not left:  # every tombstone was for a merged segment
        keep = [p for p in keep if p[0] != "delete"]
    _publish(spark, folder, version + 1, [*keep, part])
    return name


def load(spark: SparkSession, folder: str) -> Segments:
    """The newest state. Document frequencies and lengths are sums over the live segments,
    less what their tombstones take away."""
    _, parts = _manifest(spark, folder)
    names = [r["name"] for r in parts if r["kind"] == "segment"]
    counts, dead, gone = _read(spark, folder, names, "counts"), _deleted(spark, folder, parts, "dead"), _deleted(spark, folder, parts, "counts")
    n = sum(r["n"] for r in parts if r["kind"] == "segment")
    total = sum(r["total"] for r in parts if r["kind"] == "segment")
    if counts is None:
        return Segments(None, spark.createDataFrame([], "term string, df long"), None, 0, 1.0, [])
    if gone is not None:
        counts = counts.select("term", "df").unionByName(gone.select("term", (-F.col("df")).alias("df")))
        less = dead.agg(F.count("*").alias("n"), F.coalesce(F.sum("len"), F.lit(0)).alias("total")).first()
        n, total = n - less["n"], total - less["total"]
    counts = counts.groupBy("term").agg(F.sum("df").alias("df")).filter("df > 0")
    return Segments(_read(spark, folder, names, "blocks"), counts, None if dead is None else dead.select("segment", "num"), n, total / n if n else 1.0, names)


class Hits(NamedTuple):
    """``hits`` as of ``retrieval.bm25_top_k``; ``read`` holds the postings blocks that were
    decoded, ``(query_id, segment, block, term)``."""

    hits: DataFrame
    read: DataFrame


class _Blocks:
    """Bounds and scores of block rows for questions ``(query_id, term, weight, last)``."""

    def __init__(self, asked: pa.Table, k: int, k1: float, b: float, avg_len: float, zero_fill: bool, bits: int):
        self.scorer = R.Scorer(asked, k, k1, b, avg_len, zero_fill)
        self.ids, self.terms = self.scorer.ids, self.scorer.terms
        self.k, self.k1, self.b, self.avg_len, self.zero_fill, self.bits = k, k1, b, avg_len, zero_fill, bits
        self.last = set()
        if "last" in asked.column_names:
            q, t = (pc.index_in(asked.column(c).combine_chunks(), value_set=v).to_numpy(zero_copy_only=False) for c, v in (("query_id", self.ids), ("term", self.terms)))
            put = np.flatnonzero(asked.column("last").to_numpy(zero_copy_only=False))
            self.last = set(zip(q[put].tolist(), t[put].tolist()))

    def impact(self, tf, length):
        return tf * (self.k1 + 1.0) / (tf + self.k1 * (1.0 - self.b + self.b * length / self.avg_len))

    def heads(self, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, code, greatest impact, place in the list of terms) of the asked terms of each block."""
        terms, n_terms = _flat(table.column("terms"))
        peak_ns, tfs, lens = (_flat(table.column(c))[0].to_numpy(zero_copy_only=False) for c in HEADS[1:])
        code = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        peak = np.maximum.reduceat(self.impact(tfs, lens), np.cumsum(peak_ns) - peak_ns) if len(terms) else np.zeros(0)
        known = np.flatnonzero(code >= 0)
        return np.repeat(np.arange(table.num_rows), n_terms)[known], code[known], peak[known], known

    def weights(self, one) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice of questions: (columns of the codes, matrix of weights, matrix of those put last)."""
        start, end, used, at, question, weight = one
        column = np.full(len(self.terms), -1)
        column[used] = np.arange(len(used))
        lead, rest = np.zeros((len(used), end - start)), np.zeros((len(used), end - start))
        put = np.array([(q + start, used[a]) in self.last for q, a in zip(question.tolist(), at.tolist())], bool) if self.last else np.zeros(len(at), bool)
        lead[at[~put], question[~put]] = weight[~put]
        rest[at[put], question[put]] = weight[put]
        asks = np.zeros(lead.shape, np.float32)
        asks[at, question] = 1
        return column, lead, rest, asks

    def bounds(self, heads, n: int, column: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The bound of each block (row) for each question: positive weights times greatest impacts."""
        row, code, peak, _ = heads
        out, step = np.zeros((n, weights.shape[1])), max(1, R.CELLS // max(1, weights.shape[0]))
        positive = np.maximum(weights, 0.0)
        for first in range(0, n, step):
            here = slice(*np.searchsorted(row, [first, first + step]))
            col = column[code[here]]
            values = np.zeros((min(step, n - first), weights.shape[0]))
            values[row[here][col >= 0] - first, col[col >= 0]] = peak[here][col >= 0]
            out[first : first + step] = values @ positive
        return out

    def best_bounds(self, batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
        """The blocks of the greatest bounds of each question in this task, ``(q, segment, block, bound)``,
        and of each term its greatest impact and number of blocks, ``(term, bound, n)``."""
        reach, seen = np.zeros(len(self.terms)), np.zeros(len(self.terms), np.int64)
        slices = [(one, *self.weights(one)) for one in self.scorer.slices]
        held = None
        kind = pa.schema([("q", self.ids.type), ("segment", pa.string()), ("block", pa.int64()), ("term", pa.string()), ("bound", pa.float64()), ("n", pa.int64())])
        for batch in batches:
            table = pa.Table.from_batches([batch])
            heads = self.heads(table)
            np.maximum.at(reach, heads[1], heads[2])
            seen += np.bincount(heads[1], minlength=len(seen))
            q, at, bound = [], [], []
            for one, column, lead, _, _ in slices:
                found = self.bounds(heads, table.num_rows, column, lead).T
                keep, _ = R.first_k(found, most)
                i, j = np.nonzero(keep & (found > 0))
                q.append(i + one[0])
                at.append(j)
                bound.append(found[i, j])
            q, at, bound = (np.concatenate(x) if x else np.zeros(0, int) for x in (q, at, bound))
            rows = pa.table({"q": pa.array(q, pa.int64()), "segment": table.column("segment").take(pa.array(at, pa.int64())), "block": table.column("block").take(pa.array(at, pa.int64())), "bound": pa.array(bound, pa.float64())})
            held = rows if held is None else pa.concat_tables([held, rows])
            order = np.lexsort((-held.column("bound").to_numpy(), held.column("q").to_numpy()))
            of = held.column("q").to_numpy()[order]
            first = _starts(of)
            nth = np.arange(len(of)) - np.repeat(first, np.diff(first, append=len(of)))
            held = held.take(pa.array(order[nth < most], pa.int64()))
        if held is not None:
            none = lambda t, n: pa.nulls(n, t)
            n, met = held.num_rows, np.flatnonzero(seen)
            yield from pa.table([self.ids.take(held.column("q").combine_chunks()), held.column("segment"), held.column("block"), none(pa.string(), n), held.column("bound"), none(pa.int64(), n)], schema=kind).to_batches()
            yield from pa.table([none(self.ids.type, len(met)), none(pa.string(), len(met)), none(pa.int64(), len(met)), self.terms.take(pa.array(met, pa.int64())), pa.array(reach[met]), pa.array(seen[met])], schema=kind).to_batches()

    def best(self, batches: Iterator[pa.RecordBatch], kth: np.ndarray | None, first: dict | None, reads: bool) -> Iterator[pa.RecordBatch]:
        """The chunks of this task that can be among the best k of each question, ``(q, c, o, s)``.

        With ``first``, only these blocks of each question count, ``{(segment, block): questions}``,
        and only positive scores. Otherwise a question looks at the blocks whose bound reaches its
        ``kth``, and at all blocks and chunks where that is minus infinity. ``reads``: the postings
        looked at, ``(q, segment, block, term)``, in place of the scores."""
        slices = [(one, *self.weights(one)) for one in self.scorer.slices]
        floor = np.full(len(self.ids), 0.0 if first is not None else -np.inf) if kth is None else kth.copy()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            heads = self.heads(table)
            given = None
            if first is not None:
                keys = zip(table.column("segment").to_pylist(), table.column("block").to_pylist())
                given = [(r, q) for r, key in enumerate(keys) for q in first.get(key, ())]
            posts = None
            for one, column, lead, rest, asks in slices:
                start, end = one[0], one[1]
                if given is not None:
                    open_ = np.zeros((table.num_rows, end - start), bool)
                    for r, q in given:
                        if start <= q < end:
                            open_[r, q - start] = True
                else:
                    bound = self.bounds(heads, table.num_rows, column, lead + rest)
                    open_ = (bound >= kth[None, start:end]) | np.isneginf(kth[start:end])[None]
                some = np.flatnonzero(open_.any(1))
                if not len(some):
                    continue
                posts = posts or self.posts(table, heads)
                yield from self.scored(table, posts, heads, one, column, lead, rest, asks, open_, some, floor, first is not None, reads)

    def posts(self, table: pa.Table, heads):
        """Chunks in corpus order ``(row, place, index)`` and the postings of asked terms, sorted by block."""
        row, place = _places_of(table, self.bits)
        mask = table.column("mask").to_numpy()
        ords = table.column("ords").combine_chunks().flatten()
        lens = _flat(table.column("lens"))[0].to_numpy(zero_copy_only=False)
        order = R.corpus_order(pa.chunked_array([ords]))
        order = order[(mask[row] >> place & 1)[order] == 1]
        number = np.full(table.num_rows << self.bits, -1)
        number[(row << self.bits) + place] = np.arange(len(row))
        ns, places, tfs = (_flat(table.column(c))[0].to_numpy(zero_copy_only=False) for c in ("ns", "places", "tfs"))
        begin, n = (np.cumsum(ns) - ns)[heads[3]], ns[heads[3]].astype(np.int64)
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        chunk = number[(np.repeat(heads[0], n) << self.bits) + places[at]]
        value = self.impact(tfs[at].astype(np.float64), lens[chunk])
        return row, order, chunk, np.repeat(heads[1], n), value

    def scored(self, table, posts, heads, one, column, lead, rest, asks, open_, some, floor, positive: bool, reads: bool) -> Iterator[pa.RecordBatch]:
        start, end, used = one[0], one[1], one[2]
        row, order, chunk, code, value = posts
        wanted = np.zeros(table.num_rows, bool)
        wanted[some] = True
        cand = order[wanted[row[order]]]  # chunks in corpus order
        place = np.full(len(row), -1)
        place[cand] = np.arange(len(cand))
        col, at = column[code], place[chunk]
        use = np.flatnonzero((col >= 0) & (at >= 0))
        use = use[np.argsort(at[use], kind="stable")]
        at, col, value = at[use], col[use], value[use]
        later = rest.any()
        more = self.bounds(heads, table.num_rows, column, rest) if later else None
        step = max(1, R.CELLS // max(len(used), end - start))
        deep = np.zeros(open_.shape, bool)
        q, c, s = [], [], []
        for a in range(0, len(cand), step):
            z = min(a + step, len(cand))
            here = slice(*np.searchsorted(at, [a, z]))
            values = np.zeros((z - a, len(used)))
            values[at[here] - a, col[here]] = value[here]
            rows = row[cand[a:z]]
            sim, near = values @ lead, open_[rows]
            if later:
                # Words that cannot reach the threshold together are only looked at for what is near it.
                near = near & (sim + more[rows] >= floor[None, start:end] - SLACK)
                some_near = np.flatnonzero(near.any(1))
                sim[some_near] += values[some_near] @ rest
                np.logical_or.at(deep, rows, near)
            sim = np.rint(sim.T * 10.0**R.SCORE_DIGITS) / 10.0**R.SCORE_DIGITS
            near = near.T
            if not self.zero_fill:
                near = near & (((values > 0).astype(np.float32) @ asks).T > 0)
            if positive:
                near = near & (sim > 0)
            sim[~near] = -np.inf
            keep, least = R.first_k(sim, self.k)
            keep &= near & (sim >= floor[start:end, None])
            if not reads:
                floor[start:end] = np.maximum(floor[start:end], least)
            i, j = np.nonzero(keep)
            q.append(i + start)
            c.append(cand[a + j])
            s.append(sim[i, j])
        if reads:
            yield from self.looked_at(table, heads, one, column, lead, rest, open_, deep, asks).to_batches()
            return
        q, c, s = (np.concatenate(x) if x else np.zeros(0, int) for x in (q, c, s))
        c = pa.array(c, pa.int64())
        yield from pa.table({"q": self.ids.take(pa.array(q, pa.int64())), "c": table.column("ids").combine_chunks().flatten().take(c),
                             "o": table.column("ords").combine_chunks().flatten().take(c), "s": pa.array(s, pa.float64())}).to_batches()

    def looked_at(self, table, heads, one, column, lead, rest, open_, deep, asks) -> pa.Table:
        """(q, segment, block, term) of the postings that the scores above were made from."""
        row, code, _, _ = heads
        col = column[code]
        row, code, col = row[col >= 0], code[col >= 0], col[col >= 0]
        put = rest != 0
        i, j = np.nonzero((asks[col] > 0) & np.where(put[col], deep[row], open_[row]))
        at = pa.array(row[i], pa.int64())
        return pa.table({"q": self.ids.take(pa.array(j + one[0], pa.int64())), "segment": table.column("segment").take(at),
                         "block": table.column("block").take(at), "term": self.terms.take(pa.array(code[i], pa.int64()))})


def search(
    questions: DataFrame, index: Segments, k: int = fixed.TOP_K_RETRIEVAL, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B,
    epsilon: float = fixed.BM25_EPSILON, zero_fill: bool = True, first_blocks: int | None = None,
    allowed_tags: list[str] | None = None,
) -> Hits:
    """R4 with the rows of ``bm25_top_k``, decoding only postings that can matter for the best k.

    The bound of a word in a block is its weight times the block's greatest impact. Each
    question first scores the ``first_blocks`` blocks (twice k) with the greatest sums of bounds,
    and the k-th score found is its threshold. Words that together cannot reach it are left for last: chunks are found
    by the other words, in blocks whose bound reaches the threshold, and only for chunks whose
    score so far and bounds of the rest still reach it are the blocks of the common words read.
    A question without k positive scores has no threshold and reads everything.

    ``allowed_tags`` (R10): only chunks with one of these tags are hits; the statistics stay those
    of the whole corpus. The bitmaps of the tags are united, what tombstones took is cleared, and
    blocks without a bit left are neither bounded nor decoded.

    Each step is one pass over the blocks; the task that reads a block bounds and scores it for all
    questions and sends its best blocks or chunks of each question. Question sets too large to
    broadcast are asked in parts, and the index is read for each.
    """
    spark = questions.sparkSession
    kind = questions.schema["query_id"].dataType.simpleString()
    if index.blocks is None:
        none = spark.createDataFrame([], f"query_id {kind}, rank long, chunk_id string, score double")
        return Hits(none, none.select("query_id"))
    counted = materialise(index.counts)
    size = R.Index(None, counted, None, index.n_chunks, index.avg_len)
    weight = F.coalesce(F.col("qtf") * F.col("idf"), F.lit(0.0))
    words = R.query_terms(questions).join(R.term_weights(size, epsilon), "term", "left")
    asked = materialise(words.select("query_id", "term", weight.alias("weight")))
    held = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("term") + 24), F.lit(0)).alias("b")).first()
    parts = max(1, -(-held["n"] // BROADCAST_ROWS), -(-held["b"] // BROADCAST_BYTES))
    blocks = _with_masks(index.blocks, index.dead, allowed_tags)
    found = None
    for part in range(parts):
        mine = asked if parts == 1 else asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part)
        one = _search(mine, kind, blocks, k, (k1, b, index.avg_len, zero_fill, BLOCK_BITS), first_blocks or 2 * k)
        found = one if found is None else Hits(found.hits.unionByName(one.hits), found.read.unionByName(one.read))
    return found


def _search(asked: DataFrame, kind: str, blocks: DataFrame, k: int, settings: tuple, most: int) -> Hits:
    context = blocks.sparkSession.sparkContext
    words = context.broadcast(asked.toArrow())
    heads = blocks.select("segment", "block", *HEADS)
    tops = lambda batches: _Blocks(words.value, k, *settings).best_bounds(batches, most)
    bounds = materialise(heads.mapInArrow(tops, f"q {kind}, segment string, block long, term string, bound double, n long"))
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.col("bound").desc(), "segment", "block"))
    first = materialise(bounds.filter("term is null").withColumn("_nth", nth).filter(F.col("_nth") <= most).select(F.col("q").alias("query_id"), "segment", "block"))
    picked = context.broadcast(first.toArrow())
    whole = ["segment", "block", "mask", *HEADS, *POSTS]
    here = blocks.join(small_side(first.select("segment", "block").distinct(), F.lit(40)), ["segment", "block"], "left_semi").select(*whole)
    hit = f"q {kind}, c {blocks.schema['ids'].dataType.elementType.simpleString()}, o {blocks.schema['ords'].dataType.elementType.simpleString()}, s double"
    looked = f"q {kind}, segment string, block long, term string"

    def of_first(batches, reads=False):
        one = _Blocks(words.value, k, *settings)
        q = pc.index_in(picked.value.column("query_id").combine_chunks(), value_set=one.ids).to_pylist()
        at: dict = {}
        for n, segment, block in zip(q, picked.value.column("segment").to_pylist(), picked.value.column("block").to_pylist()):
            at.setdefault((segment, block), []).append(n)
        yield from one.best(batches, None, at, reads)

    best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    scores = here.mapInArrow(of_first, hit).select(F.col("q").alias("query_id"), F.col("s").alias("score"))
    kth = scores.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == k).select("query_id", (F.col("score") - SLACK).alias("kth"))
    # The words with the most blocks for their reach, as long as their sum stays below the threshold.
    peaks = bounds.filter("term is not null").groupBy("term").agg(F.max("bound").alias("peak"), F.sum("n").alias("blocks"))
    reach = asked.join(peaks, "term", "left").withColumn("reach", F.greatest("weight", F.lit(0.0)) * F.coalesce("peak", F.lit(0.0)))
    summed = F.sum("reach").over(Window.partitionBy("query_id").orderBy(F.col("reach") / F.coalesce("blocks", F.lit(1)), "term").rowsBetween(Window.unboundedPreceding, 0))
    last = (F.col("weight") > 0) & F.coalesce(summed < F.col("kth"), F.lit(False))
    parted = reach.join(kth, "query_id", "left").withColumn("last", last)
    parted = context.broadcast(parted.select("query_id", "term", "weight", "kth", "last").toArrow())

    def of_all(batches, reads=False):
        one = _Blocks(parted.value, k, *settings)
        kth = np.full(len(one.ids), -np.inf)
        known = pc.is_valid(parted.value.column("kth")).to_numpy(zero_copy_only=False)
        q = pc.index_in(parted.value.column("query_id").combine_chunks(), value_set=one.ids).to_numpy(zero_copy_only=False)
        kth[q[known]] = parted.value.column("kth").to_numpy(zero_copy_only=False)[known]
        yield from one.best(batches, kth, None, reads)

    ranked = R.top_k(blocks.select(*whole).mapInArrow(of_all, hit).withColumnsRenamed({"q": "query_id", "c": "chunk_id", "o": "ord", "s": "score"}), k)
    read = here.mapInArrow(lambda x: of_first(x, True), looked).unionByName(blocks.select(*whole).mapInArrow(lambda x: of_all(x, True), looked))
    return Hits(ranked.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score"), read.withColumnRenamed("q", "query_id"))
