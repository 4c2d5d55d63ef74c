import hashlib

import numpy as np
import pytest
from cases import docs, empty, odd
from pyspark.sql import functions as F

from strandloom.llm import merkle as M


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, text):
    values = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
    return _h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _path(levels, i):
    for row in levels[:-1]:
        a = i - i % 16
        yield row[a:i], row[i + 1 : a + 16]
        i //= 16


def brute(rows, tamper):
    """Rows of the contract, in plain Python."""
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in names:
        groups[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r, r["text"])))
        trees.append(_levels([_leaf(r, r["text"]) for r in groups[s]]))
    top = _levels([t[-1][0] for t in trees])
    for j, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            path = [*_path(trees[j], i), *_path(top, j)]
            end = _leaf(r, tamper(r)) if tamper(r) is not None else trees[j][0][i]
            for before, after in path:
                end = _h(*before, end, *after)
            yield r["doc_id"], trees[j][0][i], trees[j][-1][0], top[-1][0], _h(*[x for b, a in path for x in (*b, *a)]), end, end == top[-1][0]


def _same(df, column, tamper, height):
    got = sorted(map(tuple, M.verify(M.manifest(df, column, height)).collect()), key=str)
    assert got == sorted(brute(df.collect(), tamper), key=str)


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_addresses_are_a_permutation(levels):
    found = np.concatenate([M.address(d, np.arange(M.FAN**d), levels) for d in range(levels)])
    assert np.array_equal(np.sort(found), np.arange(M.n_nodes(levels)))
    if levels == 4:  # upper half first, then each subtree below it
        assert M.address(0, 0, 4) == 0 and M.address(2, 1, 4) == 17 + 17 and M.address(3, 16, 4) == 17 + 17 + 1


@pytest.mark.parametrize("height", [1, 2, 3])
def test_same_as_brute_force(spark, height):
    sizes = {None: 300, "b": 1, "a": 17, "B": 16, "ä": 257, "": 2}
    rows, at = [], 0
    for s, n in sizes.items():
        rows += [((at + i) * 7 % 1009, f"Text {i} ÄÖ" if i % 9 else None, "en" if i % 2 else None, s) for i in range(n)]
        at += n
    df = docs(spark, rows)
    _same(df, F.when(F.col("doc_id") % 3 == 0, F.lower("text")), lambda r: r["text"].lower() if r["doc_id"] % 3 == 0 and r["text"] else None, height)


def test_many_groups_and_one(spark):
    df = docs(spark, [(i, "Word", None, f"host{i}") for i in range(300)])
    _same(df, None, lambda r: None, 1)
    _same(docs(spark, [(1, "Word", None, "s")]), F.lit("word"), lambda r: "word", 3)


def test_odd_rows(spark):
    _same(odd(spark), None, lambda r: None, 1)
    assert M.verify(M.manifest(empty(spark))).count() == 0
    same = docs(spark, [(1, "again", None, "s")] * 40 + [(None, "again", None, "s")] * 40)
    _same(same, None, lambda r: None, 1)
