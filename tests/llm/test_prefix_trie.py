import hashlib
import random
import zlib

import pytest

from strandloom.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(conversations):
    """Rows of the contract from ``{conv_id: [(role, text), ...]}``, in plain Python."""
    nodes = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, totals = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        kids.setdefault(path, 0)
        own = (len(nodes[path]) - 1) * len(path[-1][1].encode()) if path else 0
        leaves, saved = totals.get(path, (0, 0))
        leaves, saved = leaves + (not kids[path]), saved + own
        totals[path] = leaves, saved
        if path:
            up = path[:-1]
            kids[up] = kids.get(up, 0) + 1
            a, b = totals.get(up, (0, 0))
            totals[up] = a + leaves, b + saved
    for path, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(conversations[c]) == len(path))))
        parent = min(nodes[path[:-1]]) if path else None
        yield min(members), len(path), parent, len(members), kids[path], *totals[path], hashlib.sha256(ends.encode()).hexdigest()


def grouped(rows):
    found = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in found.items()}


def rebuilt(conversations):
    out = {}
    for c, turns in conversations.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = conversations.get(c - c % 5, [])[:h] + turns[h:]
    return out


def _same(df, want, **sizes):
    got = sorted(map(tuple, T.prefix_trie(df, **sizes).collect()), key=str)
    assert got == sorted(brute(want), key=str)


def _rows(seed, n, alphabet, longest):
    r = random.Random(seed)
    return [(c, t, r.choice("ua"), r.choice(alphabet)) for c in range(n) for t in range(r.randint(1, longest))]


@pytest.mark.parametrize(("shard", "merge", "room"), [(1, 2, 1), (5, 2, 2), (40, 3, 8), (8192, 64, 1 << 17)])
def test_same_as_brute_force(spark, shard, merge, room):
    rows = _rows(shard, 150, ["a", "b ä", ""], 7)
    _same(T.whole(T.turns(spark.createDataFrame(rows, SCHEMA))), grouped(rows), shard=shard, merge=merge, room=room)


def test_rebuilt(spark):
    rows = [r for r in _rows(1, 120, ["x", "y"], 12) if r[0] % 15 != 10]
    _same(T.branched(T.turns(spark.createDataFrame(rows, SCHEMA))), rebuilt(grouped(rows)), shard=30, merge=2)


def test_deep_and_hot(spark):
    """One long conversation, branches from each of its turns, and many copies."""
    long = [("u", f"turn {i}") for i in range(300)]
    talks = {0: long} | {i: long[: 3 * i] + [("a", f"own {i}")] for i in range(1, 90)} | {i: long[:2] for i in range(100, 400)}
    rows = [(c, t, *x) for c, turns in talks.items() for t, x in enumerate(turns)]
    df = T.whole(T.turns(spark.createDataFrame(rows, SCHEMA)))
    _same(df, talks, shard=25, merge=2, room=4)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", "x" * 200_000), (1, 0, "u", "x"), (2, 0, "u", ""), (2, 0, "u", ""), (None, 0, "u", "lost"), (3, None, "", ""), (-7, 1, "u", "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS key", "2 AS depth", "3 AS `a.b`")
    _same(T.whole(T.turns(df)), grouped(rows), shard=2, merge=2)
    assert T.prefix_trie(T.branched(T.turns(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_queue_spills_in_order():
    q, r = T.SpillingQueue(5), random.Random(3)
    items = [(r.randrange(50), i) for i in range(200)]
    out = []
    for i, x in enumerate(items):
        q.push(x)
        if i % 3 == 0:
            assert q.top() is not None
    while q.top() is not None:
        out.append(q.pop())
    assert out == sorted(items) and q.runs == []
