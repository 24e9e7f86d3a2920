"""Byte-level BPE encoding and decoding by the ranks of a public vocabulary file.

A text is split into pre-tokens. The distinct pre-tokens of a run of texts are looked up in
two tiers: a minimal perfect hash over the vocabulary resolves those that are a token
themselves; the others are merged pair by pair, by a heap of ranks over a linked list of
their bytes, so a pre-token of n bytes costs O(n log n) whatever it holds. Runs are of about
equal bytes, and long texts are split while they are matched, so memory follows the run and
the longest text. Nothing is shuffled.

Null text is empty: no ids, and no bytes after decoding. Every input row gives one row,
repeated rows and null ids included; an empty table gives no rows; other columns are not
read. Null ids decode to no bytes, an id outside of the vocabulary to null.
"""

from __future__ import annotations

import base64
import functools
import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegrid.llm import vocab
from clausegrid.llm.tokens import byte_runs

DEFAULT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CHUNK = 1 << 17  # pre-tokens held at once of one text
MEMO = 800_000  # pre-tokens remembered by a worker

#: Letters and digits that came with Unicode 17. The rank files' library splits
#: by Unicode 16, where these code points are neither; ``regex`` knows them already.
LATER = (
    "\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f"
)
_LATER = re.compile(f"[{LATER}]")
_SCRIPTS = re.compile("[\u0558-\u1fff\u2080-\U0010ffff]")  # all of them, and quick to search for


_WORD, _STEP, _MIX = (1 << 64) - 1, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


class PerfectHash:
    """Minimal perfect hash of distinct byte strings onto 0..n-1, by hash and displace.

    A key's bucket names the displacement that sends all keys of the bucket to free slots;
    a bucket of one key names its slot. Other strings get some slot too, so a lookup
    compares the key that the slot holds.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n = n = len(keys)
        self.buckets = n // 2 + 1
        numbers = self._hashes(keys).tolist()
        grouped: dict[int, list[int]] = {}
        for i, h in enumerate(numbers):
            grouped.setdefault(h % self.buckets, []).append(i)
        self.moves = np.zeros(self.buckets, np.int64)
        slot_of, taken = np.zeros(n, np.int64), bytearray(n)
        alone = []
        for b, members in sorted(grouped.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                alone.append((b, members[0]))
                continue
            own = [numbers[i] for i in members]
            for move in itertools.count(1):
                step = move * _STEP & _WORD
                slots = [(((h ^ step) * _MIX & _WORD) >> 32) % n for h in own]
                if not any(taken[s] for s in slots) and len(set(slots)) == len(slots):
                    break
            self.moves[b] = move
            for i, s in zip(members, slots):
                slot_of[i], taken[s] = s, 1
        free = (s for s in range(n) if not taken[s])
        for b, i in alone:
            slot_of[i] = s = next(free)
            self.moves[b] = -s - 1
        self.keys: list[bytes] = [b""] * n
        self.values = [0] * n
        for i, s in enumerate(slot_of.tolist()):
            self.keys[s], self.values[s] = keys[i], values[i]

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _slots(self, hashes: np.ndarray, moves: np.ndarray) -> np.ndarray:
        mixed = (hashes ^ (moves.astype(np.uint64) * np.uint64(_STEP))) * np.uint64(_MIX)
        return ((mixed >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> list[int | None]:
        """Value of each key, None for strings outside of the set."""
        if not keys or not self.n:
            return [None] * len(keys)
        hashes = self._hashes(keys)
        moves = self.moves[(hashes % np.uint64(self.buckets)).astype(np.int64)]
        slots = np.where(moves < 0, -moves - 1, self._slots(hashes, np.maximum(moves, 0))).tolist()
        held, values = self.keys, self.values
        return [values[s] if held[s] == k else None for s, k in zip(slots, keys)]


class ByteBpe:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.longest = max(map(len, self.ranks), default=0)
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self._memo: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a pre-token: the pair of least rank is merged first, the leftmost of equals."""
        n, ranks, longest = len(piece), self.ranks, self.longest
        after = list(range(1, n + 2))  # start of the next part
        before = list(range(-1, n))
        alive = bytearray(b"\1" * n)
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (middle := after[i]) >= n or after[middle] != end:
                continue
            alive[middle] = 0
            after[i] = end
            if end < n:
                before[end] = i
                far = after[end]
                if far - i <= longest and (r := ranks.get(piece[i:far])) is not None:
                    heapq.heappush(heap, (r, i, far))
            if (j := before[i]) >= 0 and end - j <= longest and (r := ranks.get(piece[j:end])) is not None:
                heapq.heappush(heap, (r, j, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def pretokens(self, text: str) -> Iterator[list[str]]:
        """The pre-tokens of ``text`` in order, in lists of bounded length."""
        if not text.isascii() and _SCRIPTS.search(text) and _LATER.search(text):
            seen_as = _LATER.sub("\x00", text)
            spans = (text[m.start() : m.end()] for m in self.pattern.finditer(seen_as))
        elif len(text) <= CHUNK:
            yield self.pattern.findall(text)
            return
        else:
            spans = (m.group() for m in self.pattern.finditer(text))
        while part := list(itertools.islice(spans, CHUNK)):
            yield part

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        memo = self._memo
        new = [p for p in pieces if p not in memo]
        if len(memo) + len(new) > MEMO:
            memo.clear()
            new = list(pieces)
        raw = [p.encode() for p in new]
        for piece, data, rank in zip(new, raw, self.whole.find(raw)):
            ids = [rank] if rank is not None else self.merged(data)
            memo[piece] = np.array(ids, "<u4").tobytes()
        return memo

    def encoded(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        held: list[tuple[int, list[str]]] = []
        out: list[list[bytes]] = [[] for _ in texts]
        count = 0

        def flush():
            codes = self._learn(set().union(*(part for _, part in held)))
            for k, part in held:
                out[k].append(b"".join(map(codes.__getitem__, part)))
            held.clear()

        for k, text in enumerate(texts):
            for part in self.pretokens(text):
                held.append((k, part))
                count += len(part)
                if count > CHUNK:
                    flush()
                    count = 0
        flush()
        return [b"".join(parts) for parts in out]

    def decoded(self, ids: bytes) -> bytes | None:
        """The bytes that ``ids`` stand for; None if an id is not in the vocabulary."""
        try:
            return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        except KeyError:
            return None


@functools.lru_cache(maxsize=2)
def load(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _file_and_pattern(vocabulary: str, path: str | None, pattern: str | None) -> tuple[str, str]:
    return path or vocab.public(vocabulary), pattern or vocab.SPLIT


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY,
    path: str | None = None, pattern: str | None = None,
) -> DataFrame:
    """``(id, n_tokens, ids)``: the ids of each text as little-endian unsigned 32-bit numbers.

    ``vocabulary`` names a public rank file, ``path`` another one that all executors can read.
    """
    file, split = _file_and_pattern(vocabulary, path, pattern)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file, split)
        for run in byte_runs(batches, "_text"):
            ids = bpe.encoded(run.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [run.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["id", "n_tokens", "ids"])

    return rows.mapInArrow(work, f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def decode(
    encoded: DataFrame, id_col: str = "doc_id", vocabulary: str = DEFAULT_VOCABULARY, path: str | None = None, keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(id, *keep, decoded)`` from the ``ids`` of each row; ``keep`` names further columns to carry."""
    file, split = _file_and_pattern(vocabulary, path, None)
    rows = encoded.select(F.col(id_col).alias("_id"), *keep, F.coalesce("ids", F.lit(b"")).alias("_ids"))
    kinds = [f"_id {rows.schema[0].dataType.simpleString()}", *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep], "decoded binary"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(file, split)
        for run in byte_runs(batches, "_ids"):
            texts = pa.array([bpe.decoded(x) for x in run.column(run.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*run.columns[:-1], texts], names=["_id", *keep, "decoded"])

    return rows.mapInArrow(work, ", ".join(kinds)).withColumnRenamed("_id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` of every text, encoded and decoded again."""
    both = decode(encode(docs, id_col, text_col), id_col, keep=("n_tokens", "ids"))
    return both.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
