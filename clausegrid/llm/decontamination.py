"""Benchmark decontamination by the q-gram lemma and banded alignment.

A passage of m characters found in a text with at most k edits shares at least
m - q + 1 - k q of its q-grams with the text, all within a band of diagonals no wider than the
edits allow. A task counts shared q-grams in overlapping bands of diagonals, keeps the bands
that meet that bound, and aligns the passage with the text inside the band. Texts are compared
in lower case with single spaces, as UTF-8 bytes. q is 8, and less for passages so short that
their edits would leave no shared gram of 8.

Shared q-grams are counted in slices of the text, and a band is decided as soon as the text has
passed it, so memory is bounded by a slice and the open bands however often grams repeat.

The passages of one block travel to the tasks; more passages mean more blocks and one more
pass over the texts for each, never a larger broadcast. Nothing is shuffled.

Null texts and null passages match nothing. A passage shorter than ``SHORTEST`` is no evidence and
is not searched. Equal passages are reported for each of their items; repeated rows of ``docs``
give repeated rows; null ids are kept. Of regions of one passage that overlap, the one with the
fewest edits is reported, the first of equal ones.
"""

from __future__ import annotations

import bisect
import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.tokens import byte_runs

SHORTEST = 8
GRAMS = (8, 4, 2, 1)  # the first that leaves a shared gram after all edits is taken
BUDGET = 0.08  # edits per character of the passage
BLOCK_CHARS = 2_000_000
SLICE = 1 << 20  # shared q-grams counted at once
CELLS = 1 << 20  # cells of alignments computed at once
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"\S+")
_OFFSET = 1 << 40  # of half-bands in keys, as diagonals may be negative


def normal(text: str) -> bytes:
    return " ".join(text.lower().split()).encode("utf-8", "replace")


def grams(data: bytes, q: int) -> np.ndarray:
    """All q-grams as numbers, without collisions as q is 8 bytes at most."""
    n = len(data) - q + 1
    return np.ndarray((n,), f"<u{q}", data, strides=(1,)).astype("<u8") if n > 0 else np.empty(0, "<u8")


@dataclasses.dataclass
class Passages:
    """The q-gram index of distinct passages with the same q."""

    q: int
    items: list[list]  # the items of each passage
    texts: list[bytes]
    lengths: np.ndarray
    edits: np.ndarray
    least: np.ndarray  # shared q-grams that each passage needs
    codes: np.ndarray  # distinct q-grams, sorted
    starts: np.ndarray  # postings of code i: starts[i] to starts[i + 1]
    item_at: np.ndarray
    place_at: np.ndarray
    window: int
    window_hits: int
    table: np.ndarray
    shift: np.uint64


def gram_size(m: int, k: int) -> int:
    """The greatest q for which ``k`` edits in ``m`` bytes leave a shared q-gram."""
    return next(q for q in GRAMS if m - q + 1 - k * q >= 1)


def index(rows: list[tuple], budget: float = BUDGET) -> list[Passages]:
    """Indexes of ``(item_id, text)`` rows, one for each q; none if no passage can be searched."""
    items: dict[bytes, list] = {}
    for i, t in rows:
        if t is not None and len(data := normal(t)) >= SHORTEST:
            items.setdefault(data, []).append(i)
    sizes: dict[int, list[bytes]] = {}
    for t in items:
        sizes.setdefault(gram_size(len(t), min(int(budget * len(t)), len(t) - 1)), []).append(t)
    return [_index(q, [items[t] for t in texts], texts, budget) for q, texts in sorted(sizes.items())]


def _index(q: int, items: list[list], texts: list[bytes], budget: float) -> Passages:
    m = np.array([len(t) for t in texts])
    k = np.minimum((budget * m).astype(int), m - 1)
    least = m - q + 1 - k * q
    all_codes = np.concatenate([grams(t, q) for t in texts])
    item = np.repeat(np.arange(len(texts)), m - q + 1)
    place = np.concatenate([np.arange(n) for n in m - q + 1])
    order = np.argsort(all_codes, kind="stable")
    codes, first = np.unique(all_codes[order], return_index=True)
    # Some window of this length holds that many hits in every region that is to be found.
    span = m + k - q + 1
    window = int(span.min())
    hits = int(np.min(-(-least // -(-span // window))))
    bits = max(12, int(16 * len(codes)).bit_length())
    shift = np.uint64(64 - bits)
    table = np.zeros(1 << bits, bool)
    table[(codes * _SPREAD) >> shift] = True
    return Passages(q, items, texts, m, k, least, codes, np.r_[first, len(all_codes)], item[order], place[order], window, hits, table, shift)


def banded_distances(passage: np.ndarray, text: np.ndarray, low: np.ndarray, width: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of ``low``, (least edits, end in ``text``) of ``passage`` started on one of the
    diagonals ``low`` to ``low + width - 1`` and staying within ``most`` of them; more than
    ``most`` edits are given as ``most + 1``."""
    far, rows = most + 1, max(1, CELLS // (width + 2 * most))
    costs, ends = np.full(len(low), far), np.zeros(len(low), np.int64)
    steps = np.arange(width + 2 * most, dtype=np.int32)
    for a in range(0, len(low), rows):
        which = np.arange(a, min(a + rows, len(low)))
        first = low[which, None] - most
        # Diagonals to the right of the starts are reached by skipping text, those to the left later.
        cost = np.repeat(np.where(steps < most, far, np.maximum(0, steps - most - width + 1))[None], len(which), 0)
        for i, c in enumerate(passage.tolist()):
            at = first + i + steps
            if at[:, 0].min() >= 0 and at[:, -1].max() < len(text):
                new = cost + (text[at] != c)
            else:
                inside = (at >= 0) & (at < len(text))
                new = np.where(inside, cost + (text[np.clip(at, 0, len(text) - 1)] != c), np.int32(far))
            np.minimum(new[:, :-1], cost[:, 1:] + 1, out=new[:, :-1])
            new -= steps
            cost = np.minimum.accumulate(new, axis=1, dtype=np.int32) + steps
            alive = cost.min(axis=1) <= most
            if not alive.all():
                which, first, cost = which[alive], first[alive], cost[alive]
                if not len(which):
                    break
        if len(which):
            end = first + len(passage) + steps
            cost[(end < 0) | (end > len(text))] = far
            best = cost.argmin(axis=1)
            line = np.arange(len(which))
            costs[which], ends[which] = np.minimum(cost[line, best], far), end[line, best]
    return costs, ends


def _dense(data: bytes, p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """(places in the text, index of their gram) of the q-grams of passages in stretches that hold
    as many as any passage needs."""
    none = np.empty(0, np.int64), np.empty(0, np.int64)
    codes = grams(data, p.q)
    if len(codes) < p.window_hits:
        return none
    hit = p.table[(codes * _SPREAD) >> p.shift]
    if np.count_nonzero(hit) < p.window_hits:
        return none
    total = np.r_[0, np.cumsum(hit)]
    w = min(p.window, len(codes))
    dense = np.flatnonzero(total[w:] - total[:-w] >= p.window_hits)
    if not len(dense):
        return none
    edge = np.zeros(len(codes) + 1, np.int64)
    reach = int(p.lengths.max())  # the other windows of such a region lie this near
    np.add.at(edge, np.maximum(dense - reach, 0), 1)
    np.add.at(edge, np.minimum(dense + w + reach, len(codes)), -1)
    at = np.flatnonzero(hit & (np.cumsum(edge[:-1]) > 0))
    slot = np.minimum(np.searchsorted(p.codes, codes[at]), len(p.codes) - 1)
    real = p.codes[slot] == codes[at]
    return at[real], slot[real]


def _half_counts(at: np.ndarray, slot: np.ndarray, p: Passages) -> tuple[np.ndarray, np.ndarray]:
    """(key, count) of the q-grams that passages share with these places, by half-band of diagonals."""
    n = p.starts[slot + 1] - p.starts[slot]
    posting = np.repeat(p.starts[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    item = p.item_at[posting]
    half = (np.repeat(at, n) - p.place_at[posting]) // (2 * p.edits[item] + 1)
    # The half-bands that each passage can have here; counted in place where they are few.
    met = np.flatnonzero(np.bincount(item, minlength=len(p.texts)))
    low = (at[0] - (p.lengths[met] - p.q)) // (2 * p.edits[met] + 1)
    base = np.cumsum(at[-1] // (2 * p.edits[met] + 1) - low + 1)
    if base[-1] > 2 * len(item):
        return np.unique(item * (2 * _OFFSET) + half + _OFFSET, return_counts=True)
    shift = np.zeros(len(p.texts), np.int64)
    shift[met] = np.r_[0, base[:-1]] - low
    count = np.bincount(shift[item] + half, minlength=base[-1])
    place = np.flatnonzero(count)
    owner = met[np.searchsorted(base, place, "right")]
    return owner * (2 * _OFFSET) + place - shift[owner] + _OFFSET, count[place]


def bands(at: np.ndarray, slot: np.ndarray, p: Passages) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(passages, bands) that share enough q-grams. Band b of a passage are its half-bands b and
    b + 1, each of 2 k + 1 diagonals. A band is decided in the slice after which the text has
    passed its last diagonal, and what no open band needs is forgotten."""
    ahead = np.cumsum(p.starts[slot + 1] - p.starts[slot])
    keys, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    here = 0
    passed = -_OFFSET

    def last(item, half):  # the last place in the text that can add to a half-band
        return (half + 1) * (2 * p.edits[item] + 1) - 1 + p.lengths[item] - p.q

    while here < len(at):
        done = ahead[here - 1] if here else 0
        upto = max(here + 1, int(np.searchsorted(ahead, done + SLICE, "right")))
        more, n = _half_counts(at[here:upto], slot[here:upto], p)
        if len(keys):
            keys, back = np.unique(np.r_[keys, more], return_inverse=True)
            counts = np.bincount(back, np.r_[counts, n], len(keys)).astype(np.int64)
        else:
            keys, counts = more, n
        here = upto
        now = int(at[here]) if here < len(at) else _OFFSET
        strong = keys[2 * counts >= p.least[keys // (2 * _OFFSET)]]  # one half of every band that meets its bound
        candidates = np.unique(np.r_[strong, strong - 1])
        item, band = candidates // (2 * _OFFSET), candidates % (2 * _OFFSET) - _OFFSET
        end = last(item, band + 1)
        ready = (end >= passed) & (end < now)
        item, band, candidates = item[ready], band[ready], candidates[ready]
        shared = np.zeros(len(candidates), np.int64)
        for k in (candidates, candidates + 1):
            spot = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            shared += np.where(keys[spot] == k, counts[spot], 0)
        enough = shared >= p.least[item]
        yield item[enough], band[enough]
        if here == len(at):
            return
        open_ = last(keys // (2 * _OFFSET), keys % (2 * _OFFSET) - _OFFSET + 1) >= now
        keys, counts, passed = keys[open_], counts[open_], now


def _aligned(data: bytes, text: np.ndarray, i: int, found: np.ndarray, p: Passages) -> list[tuple[int, int, int]]:
    """(edits, start, end) of passage ``i`` in the bands ``found``, where it is within its budget."""
    k, passage = int(p.edits[i]), p.texts[i]
    half, out, rest = 2 * k + 1, [], []
    for b in found.tolist():
        start = data.find(passage, max(0, b * half), max(0, (b + 2) * half) + len(passage))
        if start >= 0:
            out.append((0, start, start + len(passage)))
        else:
            rest.append(b * half)
    if rest and k:
        letters = np.frombuffer(passage, np.uint8)
        cost, end = banded_distances(letters, text, np.array(rest), 2 * half, k)
        cost, end = cost[cost <= k], end[cost <= k]
        if len(cost):
            back, begin = banded_distances(letters[::-1], text[::-1], len(text) - end, 1, k)
            start = np.where(back <= k, len(text) - begin, np.maximum(0, end - len(passage)))
            out += zip(cost.tolist(), start.tolist(), end.tolist())
    return out


def _apart(regions: set[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The regions with the fewest edits, the first of equal ones, that overlap no better one."""
    kept: list[tuple[int, int, int]] = []  # by start
    for cost, start, end in sorted(regions):
        j = bisect.bisect_left(kept, (start,))
        if (j == 0 or kept[j - 1][1] <= start) and (j == len(kept) or kept[j][0] >= end):
            kept.insert(j, (start, end, cost))
    return [(c, a, b) for a, b, c in kept]


def find(data: bytes, indexes: list[Passages]) -> list[tuple]:
    """(item, edits, start, end) of every region of ``data`` within a passage's budget."""
    out, text = [], np.frombuffer(data, np.uint8)
    for p in indexes:
        regions: dict[int, set] = {}
        for item, band in bands(*_dense(data, p), p):
            for i in np.unique(item).tolist():
                regions.setdefault(i, set()).update(_aligned(data, text, i, band[item == i], p))
        for i, met in sorted(regions.items()):
            out += [(item, *r) for r in _apart(met) for item in p.items[i]]
    return out


def _spans(text: str, data: bytes, regions: list[tuple]) -> list[tuple[int, int]]:
    """Code points of ``text`` from the first to the last word that each region touches."""
    words = [m.span() for m in _WORD.finditer(text)]
    blanks = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    out = []
    for _, _, start, end in regions:
        a, b = np.searchsorted(blanks, start, "right" if data[start : start + 1] == b" " else "left"), np.searchsorted(blanks, end - 1)
        out.append((words[min(a, len(words) - 1)][0], words[min(b, len(words) - 1)][1]))
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int):
    """Blocks of distinct (item, text) rows of about ``block_chars``, collected one at a time."""
    rows = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).filter("text is not null").distinct()
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for b in range(n):
        yield [(r["item"], r["text"]) for r in rows.filter(F.pmod(F.xxhash64("text", "item"), F.lit(n)) == b).orderBy("item", "text").collect()]


def matches(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", budget: float = BUDGET, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``(id, item_id, edits, start, end)`` of every passage found; clean documents give no row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).filter("_text is not null")
    kind, item_kind = rows.schema[0].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, edits int, start long, end long"
    out = None
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        passages = index(block, budget)
        if not passages:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            p = shared.value
            for run in byte_runs(batches, "_text"):
                found = []
                for i, text in enumerate(run.column(1).to_pylist()):
                    data = normal(text)
                    regions = find(data, p)
                    if regions:
                        found += [(i, r[0], r[1], a, b) for r, (a, b) in zip(regions, _spans(text, data, regions))]
                if found:
                    row, *rest = zip(*found)
                    arrays = [run.column(0).take(pa.array(row)), *(pa.array(c) for c in rest)]
                    yield pa.RecordBatch.from_arrays([arrays[0], arrays[1], arrays[2].cast(pa.int32()), *arrays[3:]], names=["id", "item", "edits", "start", "end"])

        part = rows.mapInArrow(work, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
          budget: float = BUDGET, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no passage, with all their columns."""
    schema = docs.schema
    for block in _blocks(benchmark, item_col, item_text_col, block_chars):
        passages = index(block, budget)
        if not passages:
            continue
        shared = docs.sparkSession.sparkContext.broadcast(passages)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for run in byte_runs(batches, text_col):
                yield run.filter(pa.array([t is None or not find(normal(t), shared.value) for t in run.column(text_col).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(work, schema)
    return docs
