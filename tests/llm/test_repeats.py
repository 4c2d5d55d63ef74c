import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import docs, empty, odd

from strandloom.llm import repeat_removal as R


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), len(d) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (30, 60, 45, 200)]
    out = []
    for _ in range(40):
        parts = [text(rng.choice([0, 3, 40, 120]))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), text(rng.choice([1, 10, 50]))]
        out.append(rng.choice(["", " "]).join(parts))
    whole = out[5]
    out += [whole, whole, whole[:300] + "X" + whole[301:], "z" * 201, "ab" * 300, "z" * 150, "y" * 200, "y" * 200, shared[3][:200], shared[3][1:200], None, ""]
    at = len(out[7]) // 2
    return [*out, out[7][:at] + "#" + out[7][at:] + out[7][:at]]


@pytest.mark.parametrize("seed,group", [(1, 100_000), (2, 3)])
def test_same_as_all_windows(spark, seed, group, monkeypatch):
    monkeypatch.setattr(R, "GROUP", group)  # 3: most grams go by the shuffle of windows
    texts = corpus(seed)
    got = R.digest(R.remove_repeats(docs(spark, list(enumerate(texts))))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts)


def test_sliding_min_and_rolling():
    rng = np.random.default_rng(1)
    for n in (169, 170, 337, 338, 1000):
        v = rng.integers(0, 2**63, n, dtype=np.uint64)
        assert (R.sliding_min(v, 169) == [v[i : i + 169].min() for i in range(n - 168)]).all()
    a = np.frombuffer(b"abcabcabcabc", np.uint8)
    h = R.rolling(a, 3)
    assert h[0] == h[3] == h[6] and len({int(x) for x in h}) == 3


def test_long_texts_cross_pieces(spark, monkeypatch):
    monkeypatch.setattr(R, "_PIECE", 1000)
    rng = random.Random(7)
    a, b, c = ("".join(rng.choices("abcdefgh", k=n)) for n in (3500, 900, 700))
    texts = [a + b, c + a[100:3400], b + a[:1500]]
    got = R.digest(R.remove_repeats(docs(spark, list(enumerate(texts))))).orderBy("doc_id").collect()
    # The setting reaches tasks only with the function, so compare the parts as well.
    assert [tuple(r)[1:] for r in got] == brute(texts)
    for t in texts:
        g, _, f, n = R.anchors(t.encode())
        assert f[0] == 0 and (f[1:] == (f + n)[:-1]).all() and (f + n)[-1] == len(t) - 199


def test_odd_rows(spark):
    df = odd(spark)
    got = {(r["doc_id"], r["n_bytes"], r["n_removed"]) for r in R.digest(R.remove_repeats(df)).collect()}
    assert {(1, 0, 0), (2, 0, 0), (6, 300_000, 300_000), (7, 220_000, 220_000), (8, 0, 0)} <= got and len(got) == 9
    assert R.digest(R.remove_repeats(empty(spark))).count() == 0
