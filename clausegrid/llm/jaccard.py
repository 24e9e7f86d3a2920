"""Similarity join of word-shingle sets: Jaccard similarity of at least 4/5, by partitioning
the universe of shingles.

Sets are put into bands by size. Each band has its own number of segments; a shingle's hash
gives its segment, so a band cuts every set into parts. Two sets of similarity 4/5 and sizes
s and t differ in at most (s + t) / 9 shingles. A set with more non-empty segments than that
shares at least one whole segment with every set it is similar to; the code of a segment's
content is its signature. Each set has the signatures of its own band, and those of the band
below where a similar set may lie in it.

- A set with too few non-empty segments in a band also gives its one-deletion
  neighbourhoods, where a segment counts for two differences, and, should that still be too
  few, the same under further hashes. Two sets that both lack segments meet there; if one of
  them does not lack any, they meet among the whole segments.
- Allocation by cost: signatures that no other set has cost nothing and count first. A set
  with enough of them has no similar set and drops out. The others take just as many of their
  signatures as the bound asks for, the rarest first.

Sets are compared exactly, by their 64-bit shingle codes. Equal sets are one class from the
start. Each class is first compared with one other that it shares most signatures with, which
joins most of them. Where members of a signature are still apart, all members of the
signatures that have the same first member are compared with each other inside tasks, in
blocks, and only links that connect components come out. So the pairs of a large group are
never listed, and no link between different texts is lost for the components.

Null and empty texts, and texts without words, have no shingles and are linked with nothing,
each a component of its own. Rows with the same id and text are the same document. A null id
counts as no id for the component's number; a component without any id has a null number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clausegrid.functions.sizes import is_small
from clausegrid.llm.components import components
from clausegrid.llm.storage import stored
from clausegrid.llm.tokens import byte_runs
from clausegrid.llm.words import WordCodes, mix, windows

SHINGLE = 5
LEAST_SIZE = 4  # smaller sets are only similar to equal ones
GROWTH = 1.5
MAX_BANDS = 60
BUCKET_SIGNATURES = 500_000
FLUSH_SIGNATURES = 1_500_000
#: Most sets and shingles of a block of sets that are compared all with all.
BLOCK_SETS = 1500
BLOCK_CODES = 2_000_000
SHORT_RUN = 8  # shingles of more sets of a block than that are counted by a matrix product


def band_edges() -> list[int]:
    """Least size of each band, and of the one after the last."""
    edges = [LEAST_SIZE]
    while len(edges) <= MAX_BANDS:
        edges.append(int(edges[-1] * GROWTH))
    return edges


EDGES = band_edges()
_EDGES = np.array(EDGES)


def segments_of(band: int) -> int:
    """Segments of a band: one more than two similar sets can differ in, and some that may stay empty."""
    most = EDGES[band + 1] - 1
    return most // 4 + 3 + -(-most // 50)


def differences(size: int, band: int, below_only: bool) -> int:
    """Most differences of a set of this size and a similar one that meet in ``band``; with
    ``below_only`` the other set is not larger."""
    most = EDGES[band + 1] - 1
    if size > most:
        return (size + most) // 9
    return 2 * size // 9 if below_only else size // 4


def shingle_codes(text: bytes, codes: WordCodes) -> np.ndarray:
    """Sorted distinct codes of the shingles of a text; of all its words if they are fewer."""
    words = text.lower().split()  # both treat ASCII only
    if not words:
        return np.empty(0, np.uint64)
    w = codes.of(words)
    out = windows(w, SHINGLE) if len(words) >= SHINGLE else windows(np.r_[w, np.uint64(len(words))], len(words) + 1)
    return np.unique(out)


def class_of(codes: np.ndarray) -> int:
    """Number of a set, the same for equal sets."""
    return int(np.uint64(xxhash.xxh64_intdigest(codes.tobytes())).astype(np.int64))


def bands_of(size: int) -> list[int]:
    """The band of a size, and the one below if sets in it can be similar."""
    own = int(np.searchsorted(_EDGES, size, "right")) - 1
    return [own, own - 1] if own > 0 and 4 * size <= 5 * (EDGES[own] - 1) else [own]


def _cut(codes: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """(number, start) of the non-empty segments of sorted codes."""
    segment = ((codes >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
    return segment[starts], starts


def whole_segments(codes: np.ndarray, band: int) -> int:
    return len(_cut(codes, segments_of(band))[0])


def _signed(content: np.ndarray, segment: np.ndarray, band: int, level: int) -> np.ndarray:
    mark = mix(segment + np.uint64((band << 48) | (level << 32)))
    low = np.uint64((band << 1) | (level > 0))
    return (mix(content ^ mark) & ~np.uint64(127)) | low


def signatures(codes: np.ndarray) -> np.ndarray:
    """All signatures of a set, with the band and the level in their low bits."""
    out = []
    for band in bands_of(len(codes)):
        segments, need = segments_of(band), differences(len(codes), band, False) + 1
        number, starts = _cut(codes, segments)
        out.append(_signed(np.add.reduceat(mix(codes), starts), number, band, 0))
        held, level, own = len(number), 0, codes
        while held < need:
            level += 1
            if level > 1:
                own = np.sort(mix(codes + np.uint64(level)))
                number, starts = _cut(own, segments)
            spread = mix(own)
            sums = np.add.reduceat(spread, starts)
            sizes = np.diff(np.r_[starts, len(own)])
            each = np.repeat(np.arange(len(starts)), sizes)
            several = sizes[each] > 1
            out.append(_signed(sums, number, band, level))
            out.append(_signed((sums[each] - spread)[several], number[each][several], band, level))
            held = int(np.minimum(sizes, 2).sum())
    return np.concatenate(out)


def _sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_code, n_shingles, class, whole_own, whole_below)`` of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_code"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordCodes()
        for run in byte_runs(batches, "_text"):
            found = []
            for text in pc.cast(run.column(2), pa.binary()).to_pylist():
                codes = shingle_codes(text, words)
                whole = [whole_segments(codes, b) for b in bands_of(len(codes))] if len(codes) >= LEAST_SIZE else []
                found.append((len(codes), class_of(codes) if len(codes) else None, *[*whole, None, None][:2]))
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            arrays = [pa.array(c, t) for c, t in zip(zip(*found), types)]
            yield pa.RecordBatch.from_arrays([run.column(0), run.column(1), *arrays], names=["id", "text_code", "n_shingles", "class", "whole_own", "whole_below"])

    return rows.mapInArrow(work, f"id {kind}, text_code long, n_shingles long, class long, whole_own int, whole_below int")


def _dealt_signatures(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """``(bucket, codes, classes)``: packed signatures and their sets, once per task and set."""
    rows = docs.select(F.col(text_col).alias("_text")).filter("_text is not null")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, held, owners, n = WordCodes(), set(), [], [], 0

        def flush():
            codes = np.concatenate(held)
            owner = np.repeat(np.array([c for c, _ in owners], np.int64), [k for _, k in owners])
            bucket = ((codes >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, codes, owner = bucket[order], codes[order], owner[order]
            at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            ends = np.r_[at[1:], len(bucket)]
            held.clear()
            owners.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(bucket[at]), pa.array([codes[a:b].tobytes() for a, b in zip(at, ends)]), pa.array([owner[a:b].tobytes() for a, b in zip(at, ends)])],
                names=["bucket", "codes", "classes"])

        for run in byte_runs(batches, "_text"):
            for text in pc.cast(run.column(0), pa.binary()).to_pylist():
                codes = shingle_codes(text, words)
                if len(codes) < LEAST_SIZE or (c := class_of(codes)) in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(c)
                found = signatures(codes)
                held.append(found)
                owners.append((c, len(found)))
                n += len(found)
            if n >= FLUSH_SIGNATURES:
                yield flush()
                n = 0
        if held:
            yield flush()

    return rows.mapInArrow(work, "bucket long, codes binary, classes binary")


def _shared_in_bucket(table: pa.Table) -> pa.Table:
    """``(class, signature, sets, leader)`` of the signatures that several sets have."""
    codes = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("codes").to_pylist()])
    owner = np.concatenate([np.frombuffer(b, np.int64) for b in table.column("classes").to_pylist()])
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    same = codes[1:] == codes[:-1]
    several = np.r_[False, same] | np.r_[same, False]
    codes, owner = codes[several], owner[several]
    order = np.lexsort((owner, codes))
    codes, owner = codes[order], owner[order]
    new = np.r_[True, (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])][: len(codes)]
    codes, owner = codes[new], owner[new]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]][: len(codes)])
    n = np.diff(np.r_[starts, len(codes)])
    sets, leader = np.repeat(n, n), np.repeat(owner[starts], n)
    keep = sets > 1
    return pa.table({"class": owner[keep], "signature": codes[keep].astype(np.int64), "sets": sets[keep], "leader": leader[keep]})


def _probes(shared: DataFrame, classes: DataFrame) -> DataFrame:
    """The signatures that a set takes to find the similar sets that are not larger."""
    known = shared.join(classes.select("class", "n_shingles", "whole_own", "whole_below"), "class")
    band = F.shiftright("signature", 1).bitwiseAND(63).cast("int")
    most = F.element_at(F.array(*[F.lit(e - 1) for e in EDGES]), band + 2)
    own = F.col("n_shingles") <= most
    whole = F.when(own, F.col("whole_own")).otherwise(F.col("whole_below"))
    need = F.floor(F.when(own, 2 * F.col("n_shingles")).otherwise(F.col("n_shingles") + most) / 9) + 1
    level = F.col("signature").bitwiseAND(1)
    per_set = Window.partitionBy("class", "_band", "_level")
    ranked = known.withColumns({"_band": band, "_level": level, "_spare": whole - need}).withColumns(
        {"_n": F.count("*").over(per_set), "_rank": F.row_number().over(per_set.orderBy("sets", "signature"))})
    # ``whole - n`` signatures are the set's alone; a set short of segments, or at a further level, takes all it has.
    taken = (F.col("_level") == 1) | (F.col("_spare") < 0) | (F.col("_rank") <= F.col("_n") - F.col("_spare"))
    return ranked.filter(taken).select("class", "n_shingles", "signature", "leader", "sets")


def _similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct pairs ``(a, b)`` whose sets are similar."""
    sizes = sets.select("class", "n")
    fit = (
        pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
        .join(sizes.withColumnsRenamed({"class": "a", "n": "n_a"}), "a").join(sizes.withColumnsRenamed({"class": "b", "n": "n_b"}), "b")
        .filter("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)").select("a", "b")
    )
    met = fit.join(sets.select(F.col("class").alias("a"), F.col("codes").alias("x")), "a").join(sets.select(F.col("class").alias("b"), F.col("codes").alias("y")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int(np.count_nonzero(q[at] == p))
                keep.append(100 * common >= 80 * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")


def _compare_block(table: pa.Table) -> pa.Table:
    """Links between sets of different components, as few as connect what is similar here."""
    side, component, member = (table.column(c).to_numpy() for c in ("side", "component", "class"))
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in table.column("codes").chunks for x in c]
    n, both = len(sets), table.column("i")[0] != table.column("j")[0]
    size = np.array([len(x) for x in sets])
    codes, owner = np.concatenate(sets), np.repeat(np.arange(n), size)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    runs = np.diff(np.r_[starts, len(codes)])
    common = np.zeros(n * n, np.float32)
    for length in range(2, SHORT_RUN + 1):
        at = starts[runs == length]
        for p in range(length - 1):
            for q in range(p + 1, length):
                np.add.at(common, owner[at + p] * n + owner[at + q], 1)
    common = common.reshape(n, n)
    long = np.flatnonzero(runs > SHORT_RUN)
    for part in np.array_split(long, max(1, len(long) // 1024)):
        width = runs[part]
        held = np.zeros((n, len(part)), np.float32)
        column = np.repeat(np.arange(len(part)), width)
        at = np.repeat(starts[part] - (np.cumsum(width) - width), width) + np.arange(width.sum())
        held[owner[at], column] = 1
        common += held @ held.T
    a, b = np.nonzero(np.triu(180 * common >= 80 * (size[:, None] + size[None, :]), 1))
    wanted = (component[a] != component[b]) & ((side[a] != side[b]) | (not both))
    a, b = a[wanted], b[wanted]
    root = {c: c for c in set(component.tolist())}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist()):
        u, v = find(component[x]), find(component[y])
        if u != v:
            root[u] = v
            out.append((member[x], member[y]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _links_in_groups(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """Compare the sets of every group ``(leader, class, component)``, in blocks of bounded
    size: a group above it is dealt out, and each pair of its blocks is a task of its own."""
    sized = groups.join(sets.select("class", "n"), "class")
    parts = stored(sized.groupBy("leader").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_CODES)).cast("int").alias("parts")), "parts")
    mine = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = groups.join(parts, "leader").select("leader", "class", "component", mine.alias("side"), other.alias("other"))
    dealt = dealt.select("leader", "class", "component", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    met = dealt.join(sets.select("class", "codes"), "class")
    return met.groupBy("leader", "i", "j").applyInArrow(_compare_block, "a long, b long")


def _codes_of(docs: DataFrame, needed: DataFrame, text_col: str) -> DataFrame:
    """``(class, n, codes)`` of the needed classes, from one text of each."""
    texts = docs.select(F.col(text_col).alias("_text"), F.xxhash64(F.col(text_col)).alias("text_code")).filter("_text is not null")
    side = F.broadcast(needed) if is_small(needed, F.lit(16)) else needed
    rows = texts.join(side, "text_code").select("class", "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen = WordCodes(), set()
        for run in byte_runs(batches, "_text"):
            out = []
            for c, text in zip(run.column(0).to_pylist(), pc.cast(run.column(1), pa.binary()).to_pylist()):
                if c in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                codes = shingle_codes(text, words)
                seen.add(c)
                if class_of(codes) == c:
                    out.append((c, len(codes), codes.tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=["class", "n", "codes"])

    return rows.mapInArrow(work, "class long, n long, codes binary").dropDuplicates(["class"])


def linked_classes(docs: DataFrame, classes: DataFrame, text_col: str = "text") -> DataFrame | None:
    """``(class, component)`` of the classes that are similar to another one."""
    total = classes.agg(F.sum(F.coalesce("whole_own", F.lit(0)) + F.coalesce("whole_below", F.lit(0)))).first()[0] or 0
    if not total:
        return None
    buckets = max(1, -(-total // BUCKET_SIGNATURES))
    dealt = _dealt_signatures(docs, text_col, buckets)
    shared = stored(dealt.groupBy("bucket").applyInArrow(
        _shared_in_bucket, "class long, signature long, sets long, leader long"), "signatures")
    probes = stored(_probes(shared, classes), "probes")
    # A taken signature's members, as far as somebody takes it.
    members = shared.join(probes.select("signature").distinct(), "signature", "left_semi").select("class", "signature")
    asked = probes.select("class").unionByName(members.select("class")).distinct()
    needed = stored(classes.join(asked, "class", "left_semi").select("text_code", "class"), "needed")
    sets = stored(_codes_of(docs, needed, text_col), "sets")
    leaders = probes.filter("class <> leader").groupBy("class", "leader").agg(F.count("*").alias("n"))
    pairs = leaders.groupBy("class").agg(F.max_by("leader", F.struct("n", "leader")).alias("b")).select(F.col("class").alias("a"), "b")
    links = stored(_similar(pairs, sets), "similar")
    label = stored(components(links).withColumnRenamed("node", "class"), "component")
    # Signatures whose members are still apart; all members of those with the same first member meet.
    known = _labelled(members, label)
    mixed = known.groupBy("signature").agg((F.min("component") < F.max("component")).alias("mixed")).filter("mixed").select("signature")
    leader = probes.select("signature", "leader").distinct().join(mixed, "signature", "left_semi")
    groups = stored(known.join(leader, "signature").select("leader", "class", "component").distinct(), "groups")
    links = links.unionByName(_links_in_groups(groups, sets))
    return components(links).withColumnRenamed("node", "class")


def _labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    return rows.join(label, "class", "left").withColumn("component", F.coalesce("component", "class"))


def _with_components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, text_code, n_shingles, class, component, component_id)`` of every row."""
    found = stored(_sets(docs, id_col, text_col), "shingle-sets")
    classes = stored(found.filter("class is not null").groupBy("class").agg(
        F.min("id").alias("least"), F.first("n_shingles").alias("n_shingles"), F.min("text_code").alias("text_code"),
        F.first("whole_own").alias("whole_own"), F.first("whole_below").alias("whole_below")), "classes")
    linked = linked_classes(docs, classes, text_col)
    known = classes.select("class", "least")
    labelled = _labelled(known, linked) if linked is not None else known.withColumn("component", F.col("class"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    numbers = stored(labelled.join(least, "component").select("class", "component", "component_id"), "numbers")
    return found.join(numbers, "class", "left")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)`` for every row of ``docs``."""
    number = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return _with_components(docs, id_col, text_col).select(F.col("id").alias(id_col), "n_shingles", number.alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, but of each component only one row: of the document with
    the least id, null ids last. Where several rows have that id and text, the row with the
    least hash of all columns stays. Documents without shingles all stay."""
    found = _with_components(docs, id_col, text_col).filter("class is not null").select("id", "text_code", "component")
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("text_code").alias("c"))
    first = stored(found.groupBy("component").agg(F.min(order).alias("first")), "first")
    ahead = F.col("id").eqNullSafe(F.col("first.i")) & F.col("text_code").eqNullSafe(F.col("first.c"))
    pairs = found.join(first, "component").groupBy("id", "text_code", "component").agg(F.count("*").alias("n"), F.first(ahead).alias("ahead"))
    # What does not simply stay: pairs that go, and kept pairs with several rows.
    marked = stored(pairs.filter("not ahead or n > 1").select("id", "text_code", "component", "ahead"), "marked")
    same = F.col("_i").eqNullSafe(F.col("id")) & F.col("_c").eqNullSafe(F.col("text_code"))
    rows = docs.select(F.struct("*").alias("_row"), F.col(id_col).alias("_i"), F.xxhash64(F.col(text_col)).alias("_c"))
    alone = rows.join(marked, same, "left_anti").select("_row.*")
    # Not grouped by the join's keys, so that copies meet in their own tasks first and the join can split a hot pair.
    repeated = rows.join(stored(marked.filter("ahead").drop("ahead"), "repeated"), same)
    one = repeated.groupBy("component").agg(F.min_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row"))
    return alone.unionByName(one.select("_row.*"))
