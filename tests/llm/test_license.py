import random
import re

from cases import docs, empty, odd

from strandloom.llm import license_scan as S


def brute(text):
    def shingles(t):
        w = [x for x in re.split(r"[\W_]+", t.lower()) if x]
        return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}

    have = shingles(text or "")
    return {t for _, t in S.TEMPLATES if len(shingles(t) & have) >= S.CONTAINED * len(shingles(t))}


def test_same_as_containment(spark):
    rng = random.Random(1)
    words = ["license", "the", "under", "licensed", "version", "free", "word", "public", "general", "x1", "Übung"]
    rows = []
    for i in range(300):
        w = rng.choices(words, k=rng.randint(0, 40))
        if i % 2:
            t = rng.choice(S.TEMPLATES)[1].split()
            if i % 3 == 0:
                t[rng.randrange(len(t))] = "other"
            at = rng.randrange(len(w) + 1)
            w[at:at] = t
        rows.append((i, rng.choice([" ", "\n", " * "]).join(w)))
    got = {}
    for r in S.scan(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["template"])
    want = {i: b for i, t in rows if (b := brute(t))}
    assert got == want and len(want) > 80


def test_odd_rows(spark):
    assert S.scan(odd(spark)).count() == 0 and S.scan(empty(spark)).count() == 0
    t = "Released under the MIT License."
    assert S.scan(docs(spark, [(1, t), (1, t), (None, "x " * 50_000 + t)])).count() == 3
