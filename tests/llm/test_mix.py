from collections import defaultdict

import pytest
from cases import docs, empty, odd

from strandloom.llm import source_mix as M


def test_targets():
    assert M.targets([10, 10, 10, 10]) == [40 / 7, 80 / 7, 120 / 7, 40 / 7]
    assert M.targets([100, 1, 1]) == [96.0, 3.0, 3.0]
    assert M.targets([]) == [] and M.targets([0, 0]) == [0.0, 0.0]
    for sizes in ([5, 900, 3, 0, 77, 1000], [1, 1, 1], [1000, 1, 1, 1, 1, 50]):
        t = M.targets(sizes)
        assert sum(t) == pytest.approx(sum(sizes)) and all(x <= 3 * n + 1e-9 for x, n in zip(t, sizes))


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (i % 17 + 1), None, ["b", "a", None, "tiny"][min(i % 7, 3) if i % 50 == 3 else i % 3]) for i in range(900)]
    m = M.mix(docs(spark, rows), slots=1 << 10)
    out = M.taken(m).collect()
    assert len(out) == 900 and all(r["taken"] <= 3 * r["size"] for r in out)
    got, goal = defaultdict(int), {}
    for r in out:
        got[r["source"]] += r["taken"]
        goal[r["source"]] = r["target"]
    assert all(abs(got[s] - goal[s]) <= 1 for s in goal)
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, M.taken(M.mix(docs(spark, rows), slots=1 << 10)).collect()), key=str)
    # The pieces of a slot hold one source's block; blocks of a source are equal to within one word.
    blocks = defaultdict(int)
    for p in m.pieces.collect():
        blocks[p["src"], p["slot"]] += p["n_words"]
    for s in {k[0] for k in blocks}:
        sizes = {n for k, n in blocks.items() if k[0] == s}
        assert max(sizes) - min(sizes) <= 1
    # Any stretch of the schedule is close to the weights.
    order = sorted(k[::-1] for k in blocks)
    half = [s for _, s in order[: len(order) // 2]]
    for s in set(half):
        assert abs(half.count(s) - sum(1 for _, x in order if x == s) / 2) <= 8


def test_odd_rows(spark):
    out = M.taken(M.mix(odd(spark))).collect()
    assert len(out) == 10 and all(r["taken"] == 0 for r in out if r["size"] == 0)
    assert M.taken(M.mix(empty(spark))).count() == 0
    assert [r["taken"] for r in M.taken(M.mix(docs(spark, [(1, None), (1, "")]))).collect()] == [0, 0]
