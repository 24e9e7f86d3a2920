"""Prefix trie of conversations: adaptive radix trees over fixed-width turn ids.

A turn (role, text) becomes an id of 20 bytes: 16 of a hash, then the code points of its
text as a big-endian number. A conversation is the string of its turns' ids, cut into
segments of 64 turns; the root of a later segment is the sum of the hashes of those before
it, so neither a key nor a tree grows with the longest conversation. Equal segments are
counted first. The distinct ones are dealt out by ranges; each task inserts its range into
adaptive radix trees (node layouts of 4, 16, 48 and 256 children, compressed paths), and
every turn-aligned byte depth of a path emits a node. Trees of a bounded number of keys hold
partial counts of the nodes at their edges; one sum per node completes them.

Subtree sums need no walk over levels: every node belongs to its least member, the nodes of
a member are the lower end of its path, and a member adds what it owns to each node above.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from clausegrid.llm.ordinals import in_order, part, starts
from clausegrid.llm.storage import stored
from clausegrid.operators.ordered import running

ID_BYTES = 20
SEGMENT = 64  # turns
TREE_KEYS = 50_000
OUT_ROWS = 20_000
ENDS_BLOCK = 1 << 16  # conversation ids joined in one row
GROUP = 100  # conversations that share a first one
MAX_SHARED = 6


class Node:
    """A node of the tree: a compressed path, sums over the keys below it, and children by byte
    in the smallest layout that holds them."""

    __slots__ = ("path", "n", "least", "kind", "bytes", "children")

    def __init__(self, path: bytes, n: int, least: int):
        self.path, self.n, self.least = path, n, least
        self.kind, self.bytes, self.children = 4, bytearray(), []

    def child(self, byte: int) -> "Node | None":
        if self.kind == 256:
            return self.children[byte]
        if self.kind == 48:
            at = self.bytes[byte]
            return self.children[at - 1] if at else None
        at = bisect_left(self.bytes, byte)
        return self.children[at] if at < len(self.bytes) and self.bytes[at] == byte else None

    def put(self, byte: int, node: "Node") -> None:
        """Add a child, or replace the one under ``byte``; a full layout grows to the next."""
        if self.kind == 256:
            self.children[byte] = node
            return
        if self.kind == 48:
            at = self.bytes[byte]
            if at:
                self.children[at - 1] = node
            elif len(self.children) < 48:
                self.children.append(node)
                self.bytes[byte] = len(self.children)
            else:
                spread = [None] * 256
                for b, at in enumerate(self.bytes):
                    if at:
                        spread[b] = self.children[at - 1]
                spread[byte] = node
                self.kind, self.bytes, self.children = 256, bytearray(), spread
            return
        at = bisect_left(self.bytes, byte)
        if at < len(self.bytes) and self.bytes[at] == byte:
            self.children[at] = node
        elif len(self.bytes) < self.kind:
            self.bytes.insert(at, byte)
            self.children.insert(at, node)
        elif self.kind == 4:
            self.kind = 16
            self.put(byte, node)
        else:
            index = bytearray(256)
            for i, b in enumerate(self.bytes):
                index[b] = i + 1
            self.kind, self.bytes = 48, index
            self.put(byte, node)

    def ordered(self) -> list["Node"]:
        if self.kind == 256:
            return [c for c in self.children if c is not None]
        if self.kind == 48:
            return [self.children[at - 1] for at in self.bytes if at]
        return self.children


class RadixTree:
    """Adaptive radix tree of byte strings with a count and a least member for every prefix.
    A string may be a prefix of another one: a node needs no children to end a key."""

    def __init__(self):
        self.root = Node(b"", 0, None)
        self.keys = 0

    def add(self, key: bytes, n: int, least: int) -> None:
        self.keys += 1
        node, at = self.root, 0
        node.n, node.least = node.n + n, least if node.least is None else min(node.least, least)
        while at < len(key):
            below = node.child(key[at])
            if below is None:
                node.put(key[at], Node(key[at:], n, least))
                return
            path = below.path
            same = _common(path, key, at)
            if same < len(path):  # the key leaves the compressed path: cut it there
                upper = Node(path[:same], below.n, below.least)
                below.path = path[same:]
                upper.put(below.path[0], below)
                node.put(key[at], upper)
                below = upper
            below.n, below.least = below.n + n, min(below.least, least)
            node, at = below, at + same

    def aligned(self, width: int) -> Iterator[tuple[bytes, int, int]]:
        """``(prefix, n, least)`` of every prefix whose length is a multiple of ``width``."""
        yield b"", self.root.n, self.root.least
        left = [(child, b"") for child in reversed(self.root.ordered())]
        while left:
            node, above = left.pop()
            whole = above + node.path
            for end in range(len(above) // width * width + width, len(whole) + 1, width):
                yield whole[:end], node.n, node.least
            left += [(child, whole) for child in reversed(node.ordered())]


def _common(path: bytes, key: bytes, at: int) -> int:
    """How many bytes ``path`` shares with ``key`` from ``at`` on."""
    if key.startswith(path, at):
        return len(path)
    n, lo = min(len(path), len(key) - at), 0
    while lo < n and path[lo] == key[at + lo]:
        lo += 1
    return lo


def _lanes(seg: int, key: bytes) -> tuple[int, int]:
    mark = hashlib.md5(b"%d:" % seg + key).hexdigest()
    return int(mark[:15], 16), int(mark[15:30], 16)


def _lane(which: int) -> Column:
    mark = F.md5(F.concat(F.concat(F.col("seg").cast("string"), F.lit(":")).cast("binary"), F.col("key")))
    return F.conv(F.substring(mark, 1 + 15 * which, 15), 16, 10).cast("decimal(38,0)")


def _root(a: Column, b: Column) -> Column:
    return F.concat_ws(":", a.cast("string"), b.cast("string"))


def _node(root: Column, prefix: Column) -> Column:
    return F.unhex(F.md5(F.concat(root.cast("binary"), prefix)))


def turn_id(role: Column, text: Column) -> Column:
    mark = F.sha2(F.concat_ws("", F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    return F.unhex(F.concat(F.substring(mark, 1, 32), F.lpad(F.hex(F.char_length(text)), 8, "0")))


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return F.crc32(conv.cast("string").cast("binary")) % MAX_SHARED


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``(conv_id, idx, tid, turns)`` of the rebuilt conversations; each also has a row with
    ``idx`` -1 and an empty id, so that one without turns is there."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    narrow = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_id(role, text).alias("tid"))
    rows = in_order(narrow, ["conv_id", "turn", "tid"], "_at", "turns")
    heads = starts(rows, "conv_id", "_at").withColumn("h", shared_turns(F.col("conv_id"))).withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP)))
    # Only the first of a hundred lends turns, and never more than the hash can ask for.
    lent = heads.filter("conv_id = base and _before < 5").select("conv_id", "_part", "_first", "_before")
    first = (
        rows.filter(F.pmod("conv_id", F.lit(GROUP)) == 0).withColumn("_part", part("_at")).join(lent, ["conv_id", "_part"])
        .select(F.col("conv_id").alias("base"), (F.col("_at") - F.col("_first") + F.col("_before")).alias("idx"), "tid").filter(F.col("idx") < MAX_SHARED - 1)
    )
    held = heads.filter("conv_id = base").groupBy("base").agg(F.max("_all").alias("_lends"))
    heads = heads.join(held, "base", "left").withColumn("b", F.least("h", F.coalesce("_lends", F.lit(0))))
    heads = heads.withColumn("turns", F.col("b") + F.greatest(F.col("_all") - F.col("h"), F.lit(0)))
    own = (
        rows.withColumn("_part", part("_at")).join(heads.select("conv_id", "_part", "_first", "_before", "h", "b", "turns"), ["conv_id", "_part"])
        .withColumn("_pos", F.col("_at") - F.col("_first") + F.col("_before")).filter("_pos >= h")
        .select("conv_id", (F.col("_pos") - F.col("h") + F.col("b")).alias("idx"), "tid", "turns")
    )
    each = heads.filter("_before = 0").select("conv_id", "base", "h", "turns")
    prefix = each.join(first, "base").filter("idx < h").select("conv_id", "idx", "tid", "turns")
    empty = each.select("conv_id", F.lit(-1).cast("long").alias("idx"), F.lit(b"").alias("tid"), "turns")
    return own.unionByName(prefix).unionByName(empty)


def segments(turns: DataFrame) -> DataFrame:
    """``(conv_id, seg, key, turns, root, end)``; ``end`` is the node at which the segment ends."""
    seg = F.floor(F.greatest("idx", F.lit(0)) / SEGMENT).cast("long").alias("seg")
    ids = F.transform(F.sort_array(F.collect_list(F.struct("idx", F.hex("tid").alias("x")))), lambda t: t["x"])
    segs = turns.groupBy("conv_id", seg).agg(F.unhex(F.array_join(ids, "")).alias("key"), F.max("turns").alias("turns"))
    segs = stored(segs.withColumns({"own_a": _lane(0), "own_b": _lane(1)}), "segments")
    before = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    later = segs.filter(F.col("turns") > SEGMENT).select("conv_id", "seg", F.sum("own_a").over(before).alias("a"), F.sum("own_b").over(before).alias("b")).filter("seg > 0")
    zero = F.lit(0).cast("decimal(38,0)")
    rooted = segs.join(later, ["conv_id", "seg"], "left").withColumns({"a": F.coalesce("a", zero).cast("decimal(38,0)"), "b": F.coalesce("b", zero).cast("decimal(38,0)")})
    full = F.octet_length("key") == SEGMENT * ID_BYTES
    after = _node(_root(F.col("a") + F.col("own_a"), F.col("b") + F.col("own_b")), F.lit(b""))
    root = _root(F.col("a"), F.col("b"))
    return rooted.select("conv_id", "seg", "key", "turns", root.alias("root"), F.when(full, after).otherwise(_node(root, F.col("key"))).alias("end"))


_PARTIAL = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("chars", pa.int64()), ("conv_id", pa.int64()), ("n", pa.int64())])


def _grow_trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the keys of each root, which come together; a full tree is emitted and left."""
    tree, of, out = RadixTree(), None, []

    def emit():
        root, seg = of
        a, b = map(int, root.split(":"))
        for prefix, n, least in tree.aligned(ID_BYTES):
            j = len(prefix) // ID_BYTES
            if j == 0:
                if seg == 0:
                    out.append((hashlib.md5(root.encode()).digest(), None, 0, 0, least, n))
                continue
            if j == SEGMENT:
                x, y = _lanes(seg, prefix)
                node = hashlib.md5(b"%d:%d" % (a + x, b + y)).digest()
            else:
                node = hashlib.md5(root.encode() + prefix).digest()
            parent = hashlib.md5(root.encode() + prefix[:-ID_BYTES]).digest()
            out.append((node, parent, seg * SEGMENT + j, int.from_bytes(prefix[-4:], "big"), least, n))
            if len(out) >= OUT_ROWS:
                yield batch()

    def batch():
        columns = list(zip(*out)) or [()] * len(_PARTIAL)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PARTIAL)], schema=_PARTIAL)

    for rows in batches:
        for root, seg, key, n, least in zip(*(c.to_pylist() for c in rows.columns)):
            if of != (root, seg) or tree.keys >= TREE_KEYS:
                if of is not None:
                    yield from emit()
                tree, of = RadixTree(), (root, seg)
            tree.add(key, n, least)
    if of is not None:
        yield from emit()
    yield batch()


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the id lists of each node, whose blocks come in order; none is held whole."""
    node, running_hash, out = None, None, []

    def batch():
        columns = list(zip(*out)) or [(), ()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], names=["node", "ends_sha256"])

    for rows in batches:
        for key, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            if key != node:
                if node is not None:
                    out.append((node, running_hash.hexdigest()))
                node, running_hash = key, hashlib.sha256(ids.encode())
            else:
                running_hash.update(b"," + ids.encode())
        if len(out) >= OUT_ROWS:
            yield batch()
    if node is not None:
        out.append((node, running_hash.hexdigest()))
    yield batch()


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations:
    ``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.

    Rows are ordered by turn, nulls first, and rows of one turn by their turn ids, which is
    an arbitrary but fixed order; a repeated row is a turn of its own. Null role or text is
    empty. Rows without ``conv_id`` belong to no conversation and are left out. An empty table
    gives no rows. Other columns are not read.
    """
    segs = stored(segments(rebuilt(conversations)), "rooted")
    keys = segs.groupBy("root", "seg", "key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    dealt = keys.repartitionByRange("root", "key").sortWithinPartitions("root", "key")
    partial = dealt.mapInArrow(_grow_trees, "node binary, parent binary, depth long, chars long, conv_id long, n long")
    whole = partial.groupBy("node").agg(*[F.max(c).alias(c) for c in ("parent", "depth", "chars")], F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    nodes = stored(whole, "nodes")
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    saved, leaf = (F.col("n") - 1) * F.col("chars"), (F.col("n_children") == 0).cast("long")
    nodes = running(nodes.withColumn("_up", -F.col("depth")), ["conv_id"], "_up", sums={"saved": saved, "leaves": leaf})
    nodes = stored(nodes, "sums")
    # What each member owns, and from which depth on.
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("f"), F.max("saved").alias("saved"), F.max("leaves").alias("leaves"))
    above = segs.join(owned.filter("f > 0"), "conv_id").withColumn("_to", F.least(
        F.col("f") - 1 - F.col("seg") * SEGMENT, F.floor(F.octet_length("key") / ID_BYTES), F.lit(SEGMENT - 1)).cast("int")).filter("_to >= 0")
    above = above.select("root", "key", "saved", "leaves", F.explode(F.sequence(F.lit(0), "_to")).alias("j"))
    prefix = F.expr(f"substring(key, 1, {ID_BYTES} * j)")
    added = above.groupBy(_node(F.col("root"), prefix).alias("node")).agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    # The parent of a node belongs to the same member, but for the first node that a member owns.
    top = nodes.join(owned.select("conv_id", "f"), "conv_id").filter("depth = f and depth > 0").select("node", "parent", "depth")
    of_root = nodes.filter("depth = 0").agg(F.min("conv_id")).scalar()
    parents = top.filter("depth > 1").join(nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("_p")), "parent").select("node", "_p")
    parents = parents.unionByName(top.filter("depth = 1").select("node", of_root.alias("_p")))
    last = F.col("seg") == F.floor(F.greatest(F.col("turns") - 1, F.lit(0)) / SEGMENT)
    ends = segs.filter(last).groupBy(F.col("end").alias("node"), F.floor(F.col("conv_id") / ENDS_BLOCK).alias("_block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = ends.repartition("node").sortWithinPartitions("node", "_block").select("node", "ids").mapInArrow(_hash_ends, "node binary, ends_sha256 string")
    out = nodes.join(added, "node", "left").join(parents, "node", "left").join(ends, "node", "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("_p", "conv_id"))
    return out.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).cast("long").alias("n_leaves"),
        (F.col("saved") + F.coalesce("more_saved", F.lit(0))).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
