"""Repair of conversation structure by the cheapest edits, with a square-root checkpointed DP.

A row is kept, given another role, deleted, or preceded by an inserted row; the roles that
stay must read system?, then user and assistant in turns, ending with the assistant. Rows
are dealt out by ranges of their order, so no task holds a whole conversation's texts. Each
row becomes one hexadecimal digit (initial of its role, fault), digits are joined per block
of 4,096 rows before they move, and only digits meet per conversation. There the program
goes backward over them, storing the vector of least costs per state at every square root
of their number only, and then forward, recomputing one block of vectors at a time and
taking the ASCII-least edit that keeps the cost least. The edits go back to the texts block
by block, and the repaired text is hashed as it streams by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegrid.llm.ordinals import in_order

BLOCK_BITS = 12
OUT_ROWS = 20_000
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role in a state; a role that is not named is not allowed there.
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLE = ("user", "user", "assistant", "user")  # what an insertion or a new role must be
INITIALS, FAULTS = "suax", ("none", "truncated", "blank", "duplicate")
SPACE = r"[\x20\x09-\x0D]"
_END = (0, 6, 3, 0)  # cost of the insertions that complete a state


def _options(digit: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state as (initial, cost, next state), ASCII-least first."""
    initial, fault = INITIALS[digit >> 2], FAULTS[digit & 3]
    out = [("D", DELETE, state)]
    if fault in ("none", "truncated"):
        more = TRUNCATED if fault == "truncated" else 0
        if initial in AFTER[state]:
            out.append(("K", more, AFTER[state][initial]))
        out.append(("R", REROLE + more, AFTER[state][ROLE[state][0]]))
    return out


EDITS = [[_options(digit, state) for state in range(4)] for digit in range(16)]
_NEXT = tuple(AFTER[state][ROLE[state][0]] for state in range(4))


def _earlier(costs: tuple, digit: int) -> tuple:
    """Least costs per state before a row, from those after it."""
    least = [min(cost + costs[to] for _, cost, to in EDITS[digit][state]) for state in range(4)]
    user = min(least[USER], INSERT + least[ASSISTANT])
    return tuple(user if s == USER else min(least[s], INSERT + user) for s in range(4))


def cheapest_edits(digits: bytes) -> tuple[int, Iterator[str]]:
    """(cost, edits of each row): the insertions before it and its own edit; the last item holds
    the insertions at the end. Of all cheapest edits the ASCII-least; memory grows with the
    square root of the number of rows."""
    n = len(digits)
    step = max(1, isqrt(n))
    held = {n: _END}  # vectors at the ends of the blocks only
    costs = _END
    for i in range(n - 1, -1, -1):
        costs = _earlier(costs, digits[i])
        if i % step == 0:
            held[i] = costs

    def forward() -> Iterator[str]:
        state = START
        for first in range(0, n, step):
            last = min(first + step, n)
            block = [held[last]]
            for i in range(last - 1, first - 1, -1):
                block.append(_earlier(block[-1], digits[i]))
            block.reverse()
            for i in range(first, last):
                here, after, edits = block[i - first], block[i - first + 1], ""
                while True:
                    tight = {e: to for e, cost, to in EDITS[digits[i]][state] if cost + after[to] == here[state]}
                    if "D" not in tight and INSERT + here[_NEXT[state]] == here[state]:
                        edits, state = edits + "I", _NEXT[state]
                        continue
                    edit = min(tight)
                    state = tight[edit]
                    break
                yield edits + edit
        edits = ""
        while _END[state]:
            edits, state = edits + "I", _NEXT[state]
        yield edits

    return costs[START], forward()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that the hash of conversation and turn names: 0 drops a row,
    1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user. Null
    role or text, and null ids in the hash, are one space."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_key"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name.cast("binary")) % 20).alias("_kind"))
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.filter("_kind <> 0").select("_key", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copies"))
    return kept.select("_key", "turn", "role", "text", F.explode("_copies").alias("_copy")).drop("_copy")


def _digits(rows: DataFrame) -> DataFrame:
    """``(_key, _block, digits)`` from numbered rows: one row per block."""
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    last = F.regexp_extract("text", rf"(?s)([^\x20\x09-\x0D]){SPACE}*\z", 1)
    narrow = rows.select("_key", "_at", kind.alias("_initial"), (last == "").alias("_blank"), (~last.isin(".", "!", "?")).alias("_cut"), "_mark")
    # Of equal rows of a conversation all but the first are duplicates.
    seen = narrow.groupBy("_key", "_mark").agg(F.min("_at").alias("_at"))
    marked = narrow.join(seen.select("_key", "_at", F.lit(True).alias("_new")), ["_key", "_at"], "left")
    fault = F.when(F.col("_blank"), 2).when(F.col("_new").isNull(), 3).when(F.col("_cut"), 1).otherwise(0)
    digit = F.lower(F.hex((F.col("_initial") * 4 + fault).cast("long")))
    in_block = F.sort_array(F.collect_list(F.struct("_at", digit.alias("d"))))
    return marked.groupBy("_key", F.shiftright("_at", BLOCK_BITS).alias("_block")).agg(
        F.array_join(F.transform(in_block, lambda x: x["d"]), "").alias("digits"))


_EDITED = "_key string, _block long, blank long, duplicate long, truncated long, illegal long, cost long, edits string"
_VALUE = {ord(c): i for i, c in enumerate("0123456789abcdef")}
_LEGAL = {"su", "ua", "au"}


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each block of the conversations, whose blocks come together and in order; the
    counts stand in the row of the first block."""
    key, blocks, out = None, [], []
    names = [c.split()[0] for c in _EDITED.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in _EDITED.split(", ")]

    def finish():
        digits = bytes(_VALUE[ord(d)] for _, text in blocks for d in text)
        faults = [sum((d & 3) == k for d in digits) for k in (2, 3, 1)]
        illegal = sum(INITIALS[a >> 2] + INITIALS[b >> 2] not in _LEGAL for a, b in zip(digits, digits[1:]))
        cost, edits = cheapest_edits(digits)
        for at, (block, text) in enumerate(blocks):
            part = "".join(next(edits) for _ in text)
            if at == len(blocks) - 1:
                part += next(edits)
            counts = (*faults, illegal, cost) if at == 0 else (0, 0, 0, 0, 0)
            out.append((key, block, *counts, part))

    def batch():
        columns = list(zip(*out)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    for rows in batches:
        for name, block, text in zip(*(c.to_pylist() for c in rows.columns)):
            if name != key:
                if key is not None:
                    finish()
                    if len(out) >= OUT_ROWS:
                        yield batch()
                key, blocks = name, []
            blocks.append((block, text))
    if key is not None:
        finish()
    yield batch()


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per conversation the sums, the edits joined, and the hash of the repaired rows. A block's
    edits come before its rows, in order; no text is held."""
    out: list[tuple] = []
    names = ["_key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    types = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string()]

    def batch():
        columns = list(zip(*out)) or [()] * len(names)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    key, counts, audit, digest, state, todo, place, any_row = None, None, None, None, START, "", 0, False

    def write(role: str, text: str):
        nonlocal any_row
        digest.update((("\n" if any_row else "") + role + ":" + text).encode())
        any_row = True

    def insert():
        nonlocal state, place
        while place < len(todo) and todo[place] == "I":
            write(ROLE[state], "")
            state, place = _NEXT[state], place + 1

    def close():
        insert()
        out.append((key, *counts, "".join(audit), digest.hexdigest()))

    for rows in batches:
        for name, edits, role, text, *sums in zip(*(c.to_pylist() for c in rows.columns)):
            if name != key:
                if key is not None:
                    close()
                key, counts, audit, digest, state, any_row = name, sums, [], hashlib.sha256(), START, False
            if edits is not None:
                todo, place = edits, 0
                audit.append(edits)
                continue
            insert()
            edit, place = todo[place], place + 1
            if edit == "K":
                write(role, text)
                state = AFTER[state][role[0]]
            elif edit == "R":
                write(ROLE[state], text)
                state = _NEXT[state]
        if len(out) >= OUT_ROWS:
            yield batch()
    if key is not None:
        close()
    yield batch()


def repair(rows: DataFrame) -> DataFrame:
    """``(_key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` per
    conversation of ``rows (_key, turn, role, text)`` without nulls but in ``turn``."""
    mark = F.sha2(F.concat_ws("", F.char_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    rows = in_order(rows.withColumn("_mark", mark), ["_key", "turn", "_mark"], "_at", "rows")
    blocks = _digits(rows).repartition("_key").sortWithinPartitions("_key", "_block")
    edited = blocks.select("_key", "_block", "digits").mapInArrow(_edit, _EDITED)
    block = F.shiftright("_at", BLOCK_BITS)
    none = F.lit(None).cast("long")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    stream = edited.select("_key", "_block", F.lit(-1).cast("long").alias("_at"), "edits", F.lit("").alias("role"), F.lit("").alias("text"), *counts).unionByName(
        rows.select("_key", block.alias("_block"), "_at", F.lit(None).cast("string").alias("edits"), "role", "text", *[none.alias(c) for c in counts]))
    stream = stream.repartition("_key").sortWithinPartitions("_key", "_block", "_at").select("_key", "edits", "role", "text", *counts)
    rebuilt = stream.mapInArrow(_rebuild, "_key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    turns = rows.groupBy("_key", "turn").agg(F.lit(1).alias("one")).groupBy("_key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    return rebuilt.join(turns, "_key").select("_key", "gaps", *counts, "audit", "repaired_sha256")


def audit(conversations: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``conversations``, damaged and repaired.

    Rows are ordered by turn, nulls first, and rows of one turn by a hash of role and text,
    which is an arbitrary but fixed order; repeated rows follow each other and are duplicates. Rows with a null ``conv_id`` are one conversation. A
    conversation without rows after the damage has zeros, no edits and the hash of nothing.
    A role counts by its first character, whatever follows; an empty role has none. An empty
    table gives no rows; other columns are not read.
    """
    found = repair(damaged(conversations))
    every = conversations.select("conv_id", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_key")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, "_key", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
