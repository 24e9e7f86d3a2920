"""Prefix trie and structure repair of conversations beside brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from clausegrid.llm import prefix_trie, turn_repair
from clausegrid.llm.turn_repair import cheapest_edits

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for conv in [*range(0, 40), *range(100, 130), 207, 208, 305, 1_000_000_007, 1_000_000_000]:
        for turn in range(rng.randrange(1, 9)):
            text = rng.choice(["Yes.", "No!", "A longer answer, cut", "", " \n", "Été…", "x" * 50]) + rng.choice(["", "", "."])
            out.append((conv, turn, ("system" if turn == 0 and conv % 5 == 0 else "user" if rng.random() < 0.5 else "assistant"), text))
    out += [(3, 2, None, None), (5, None, "user", "first of all."), (5, None, "user", "first of all."), (6, 900, "tool", "late?"), (7, 901, "", ""),
            (None, 0, "user", "nobody."), (None, 1, "assistant", None), (None, None, None, None)]
    out += [(400, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 150}.") for t in range(150)]  # over several segments
    out += [(401 + k, t, "user" if t % 2 == 0 else "assistant", f"turn {t}." if t < 64 + 20 * k else f"other {k} {t}") for k in range(5) for t in range(64 * k + 10 * (k > 1))]
    out += [(500 + k, 0, "user", "the same first turn.") for k in range(60)]
    return out


@pytest.fixture(scope="module")
def conversations(spark, rows):
    """With columns named as the operators name their own."""
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return frame.selectExpr("*", *[f"'extra' as {c}" for c in ("tid", "idx", "_at", "_key", "node", "seg", "key", "_part", "n", "depth", "audit")])


def trie_by_hand(rows, tie):
    """Nodes from all prefixes of all conversations."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), tie(role or "", text or ""), role or "", text or ""))
    turns = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 6
        path = tuple(turns.get(c - c % 100, [])[:h] + turns[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    below = collections.defaultdict(list)
    for p in members:
        for d in range(len(p) + 1):
            below[p[:d]].append(p)
    children = collections.Counter(p[:-1] for p in members if p)
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below[p]),
         sum((len(members[q]) - 1) * len(q[-1][1]) for q in below[p] if q), hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest())
        for p, m in members.items())


def turn_order(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16] + len(text).to_bytes(4, "big")


def test_trie(rows, conversations):
    got = sorted(map(tuple, prefix_trie.trie(conversations).collect()))
    assert got == trie_by_hand(rows, turn_order)


def test_small_trees_give_the_same_nodes(rows, conversations, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ENDS_BLOCK", 7)
    segs = prefix_trie.segments(prefix_trie.rebuilt(conversations))
    keys = sorted({(r["root"], r["seg"], bytes(r["key"])) for r in segs.collect()})
    monkeypatch.setattr(prefix_trie, "TREE_KEYS", 3)
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"root": [k[0] for k in keys], "seg": [k[1] for k in keys], "key": [k[2] for k in keys], "n": [1] * len(keys), "least": list(range(len(keys)))})
    small = collections.Counter()
    for out in prefix_trie._grow_trees(iter([batch])):
        for node, n in zip(out.column("node").to_pylist(), out.column("n").to_pylist()):
            small[node] += n
    monkeypatch.setattr(prefix_trie, "TREE_KEYS", 10_000)
    whole = {node: n for out in prefix_trie._grow_trees(iter([batch])) for node, n in zip(out.column("node").to_pylist(), out.column("n").to_pylist())}
    assert small == whole
    got = sorted(map(tuple, prefix_trie.trie(conversations).collect()))
    assert got == trie_by_hand(rows, turn_order)


@pytest.mark.parametrize("fan", [1, 4, 5, 16, 17, 48, 49, 256])
def test_node_layouts(fan):
    rng = random.Random(fan)
    firsts = rng.sample(range(256), fan)
    keys = [bytes([a, *rng.choices(range(3), k=3)]) * rng.randrange(1, 4) for a in firsts for _ in range(4)] + [b""]
    tree = prefix_trie.RadixTree()
    for i, key in enumerate(keys):
        tree.add(key, i + 1, 100 - i)
    want = {}
    for i, key in enumerate(keys):
        for d in range(0, len(key) + 1, 4):
            n, least = want.get(key[:d], (0, 1000))
            want[key[:d]] = (n + i + 1, min(least, 100 - i))
    found = list(tree.aligned(4))
    assert {p: (n, least) for p, n, least in found} == want and len(found) == len(want)
    assert [p for p, *_ in found] == sorted(want)
    kinds = {4: 4, 1: 4, 5: 16, 16: 16, 17: 48, 48: 48, 49: 256, 256: 256}
    assert tree.root.kind == kinds[fan]


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).collect() == []


# --- Repair --------------------------------------------------------------------------

INITIAL = {0: "s", 1: "u", 2: "a", 3: "x"}


def edits_by_hand(digits):
    """Least (cost, audit) by trying every edit; states are the accepted texts so far."""
    best = {"": (0, "")}

    def insertions(states):
        states = dict(states)
        while True:
            more = dict(states)
            for kind, (cost, audit) in states.items():
                for role in "ua":
                    nxt = follow(kind, role)
                    if nxt is not None and (nxt not in more or (cost + 3, audit + "I") < more[nxt]):
                        more[nxt] = (cost + 3, audit + "I")
            if more == states:
                return states
            states = more

    def follow(kind, role):
        """The pattern only asks what came last: nothing, s, u or a."""
        return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((kind, role))

    for d in digits:
        initial, fault = INITIAL[d >> 2], d & 3
        after = {}
        for kind, (cost, audit) in insertions(best).items():
            options = [("D", 4, kind)]
            if fault < 2:
                options += [("K", 3 * fault, follow(kind, initial))] + [("R", 3 + 3 * fault, follow(kind, role)) for role in "ua"]
            for edit, more, nxt in options:
                if nxt is not None and (nxt not in after or (cost + more, audit + edit) < after[nxt]):
                    after[nxt] = (cost + more, audit + edit)
        best = after
    best = insertions(best)
    return min(best[k] for k in ("", "a") if k in best)


def exhaustive(digits, longest):
    """Every edit sequence up to a length, checked against the pattern itself."""
    best = None
    for n in range(len(digits), longest + 1):
        for word in itertools.product("DIKR", repeat=n):
            if sum(e != "I" for e in word) != len(digits):
                continue
            cost, i, roles = 0, 0, [""]
            for e in word:
                if e == "I":
                    cost, roles = cost + 3, [r + x for r in roles for x in "ua"]
                    continue
                initial, fault = INITIAL[digits[i] >> 2], digits[i] & 3
                i += 1
                if e == "D":
                    cost += 4
                elif fault >= 2:
                    roles = []
                else:
                    cost += 3 * fault + 3 * (e == "R")
                    roles = [r + x for r in roles for x in ("ua" if e == "R" else initial)]
            if any(re.fullmatch("(s?(ua)+)?", r) for r in roles):
                best = min(filter(None, [best, (cost, "".join(word))]))
    return best


def test_edits_against_every_sequence():
    rng = random.Random(5)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            digits = bytes(rng.choices(range(16), k=n))
            cost, edits = cheapest_edits(digits)
            assert (cost, "".join(edits)) == exhaustive(digits, n + 3)


def test_edits_against_all_states():
    """Long ones beside a forward search with whole audits; a prefix that is least for a state
    stays least, as every continuation is the same."""
    rng = random.Random(6)
    for n in [*range(1, 40), 200, 1001]:
        digits = bytes(rng.choices([0, 4, 4, 4, 8, 8, 8, 5, 9, 12, 6, 11], k=n))
        cost, edits = cheapest_edits(digits)
        edits = list(edits)
        assert len(edits) == n + 1
        got, want = (cost, "".join(edits)), edits_by_hand(digits)
        assert got[0] == want[0]
        if n < 40:
            assert got == want


def repair_by_hand(rows):
    own, out = collections.defaultdict(list), {}
    for conv, turn, role, text in rows:
        own[conv]
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
        own[conv] += [((turn is not None, turn or 0), mark, turn, role, text)] * (2 if kind == 3 else 1)
    for conv, found in own.items():
        found.sort(key=lambda r: r[:2])
        seen, digits, faults = set(), [], collections.Counter()
        for _, _, turn, role, text in found:
            shown = text.strip(SPACES)
            fault = 2 if not shown else 3 if (role, text) in seen else 1 if shown[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            digits.append({"s": 0, "u": 1, "a": 2}.get(role[:1], 3) * 4 + fault)
        cost, audit = edits_by_hand(bytes(digits)) if found else (0, "")
        texts, i, said = [], 0, ""
        for e in audit:
            want = "a" if said[-1:] == "u" else "u"
            if e == "I":
                said += want
                texts.append({"u": "user", "a": "assistant"}[want] + ":")
                continue
            role, text = found[i][3:]
            i += 1
            if e == "R":
                said += want
                texts.append({"u": "user", "a": "assistant"}[want] + ":" + text)
            elif e == "K":
                said += role[0]
                texts.append(role + ":" + text)
        turns = [r[2] for r in found if r[2] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[3][:1] + b[3][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        out[conv] = (conv, gaps, faults[2], faults[3], faults[1], illegal, cost, audit, hashlib.sha256("\n".join(texts).encode()).hexdigest())
    return out


def test_repair(rows, conversations):
    got = {r[0]: tuple(r) for r in turn_repair.audit(conversations).collect()}
    assert got == repair_by_hand(rows)


def test_repair_in_small_blocks(rows, conversations, monkeypatch):
    monkeypatch.setattr(turn_repair, "BLOCK_BITS", 2)
    got = {r[0]: tuple(r) for r in turn_repair.audit(conversations).collect()}
    assert got == repair_by_hand(rows)


def test_repair_of_nothing(spark):
    assert turn_repair.audit(spark.createDataFrame([], SCHEMA)).collect() == []
