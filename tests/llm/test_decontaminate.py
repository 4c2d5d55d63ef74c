import itertools
import random

from cases import docs, empty, odd
from pyspark.sql import functions as F

from strandloom.llm import decontaminate as D


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_masks_hit_all_pairs_of_substitutions():
    for n in (1, 2):
        for bad in itertools.combinations(range(D.OVERLAP), n):
            assert any(not {p + o for o in m} & set(bad) for m in D.MASKS for p in range(D.OVERLAP - m[-1]))


def test_planted_passages(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 8)))
    items = [[word() for _ in range(n)] for n in (14, 40, 9, 60, 5)]
    rows, want = [], {}
    for i in range(80):
        body = [word() for _ in range(rng.randint(5, 300))]
        if i % 2:
            k = rng.randrange(5)
            v = list(items[k])
            a, b = 0, len(v)
            if i % 3 == 0 and len(v) >= 26:
                a, b = 5, 5 + rng.randint(13, len(v) - 10)
            v = v[a:b]
            if len(v) >= 26 and i % 5 == 0:  # one word in nine is another
                for j in range(4, len(v), 9):
                    v[j] = "zzz"
            at = rng.randrange(len(body) + 1)
            body[at:at] = [x.upper() if i % 7 == 0 else x for x in v]
            want[i] = (k, a, len(v))
        else:  # less than an overlap is no leak
            body[2:2] = items[1][3:11]
        rows.append((i, " ".join(body)))
    b = bench(spark, [(i, " ".join(x)) for i, x in enumerate(items)] + [(9, None), (10, "")])
    got = {r["doc_id"]: r for r in D.leaks(docs(spark, rows), b).collect()}
    assert set(got) == set(want)
    for i, (k, a, n) in want.items():
        assert got[i]["item_id"] == k and abs(got[i]["item_word"] - a) <= 4 and got[i]["n_words"] >= 0.8 * n - 4
    kept = D.drop_leaky(docs(spark, rows), b)
    assert {r["doc_id"] for r in kept.collect()} == set(range(80)) - set(want) and kept.columns == docs(spark, rows).columns


def test_large_benchmarks_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_SENT", 3)
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    b = bench(spark, [(1, text), (1, text), (None, "nothing in common with any of those documents at all here")])
    got = D.leaks(docs(spark, [(1, "x y " + text + " z"), (2, "no such thing"), (1, "x y " + text + " z"), (None, text)]), b).collect()
    assert sorted(((r["doc_id"], r["item_id"], r["doc_word"], r["n_words"]) for r in got), key=str) == [(1, 1, 2, 14), (None, 1, 0, 14)]


def test_odd_rows(spark):
    b = bench(spark, [(1, "one two three four five six seven")])
    assert [tuple(r)[:2] for r in D.leaks(odd(spark), b).collect()] == [(4, 1)]
    assert D.leaks(empty(spark), b).count() == 0 and D.leaks(odd(spark), bench(spark, [])).count() == 0
    assert D.drop_leaky(odd(spark), bench(spark, [])).count() == 10


def test_short_items_and_clashing_columns(spark):
    b = bench(spark, [(1, "alpha beta gamma delta epsilon zeta"), (2, "just three words"), (3, "one")])
    rows = [
        (1, "so Alpha beta gamma delta epsilon ZETA it is"), (2, "alpha beta gamma delta other zeta"), (3, "just three words and more"),
        (4, "Just  three words"), (5, "one"), (6, "one two"), (7, None),
    ]
    frame = docs(spark, rows)
    for name in ("l_id", "L_ID_", "item_id", "w", "h"):
        frame = frame.withColumn(name, F.lit(0))
    assert sorted((r["doc_id"], r["item_id"]) for r in D.leaks(frame, b).collect()) == [(1, 1), (4, 2), (5, 3)]
    kept = D.drop_leaky(frame, b)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {2, 3, 6, 7}


def test_all_placements_of_substitutions(spark):
    items = {n: [f"w{n}x{i}" for i in range(n)] for n in range(D.OVERLAP, 21)}
    rows = []
    for n, v in items.items():
        for k in (1, 2):
            for bad in itertools.combinations(range(n), k):
                rows.append((len(rows), " ".join(["before"] * 9 + ["zzz" if i in bad else x for i, x in enumerate(v)] + ["after"] * 9)))
    rows += [(-n, " ".join(["before"] * 9 + v[:10] + ["after"] * 9)) for n, v in items.items()]  # ten words are no leak
    got = [r["doc_id"] for r in D.leaks(docs(spark, rows), bench(spark, [(n, " ".join(v)) for n, v in items.items()])).collect()]
    assert sorted(got) == list(range(len(rows) - len(items)))


def test_longest_stretch_against_all():
    rng = random.Random(3)
    for _ in range(300):
        same = [rng.random() < 0.75 for _ in range(rng.randint(1, 40))]
        fits = [(j - i, sum(same[i:j])) for i in range(len(same)) for j in range(i + 1, len(same) + 1) if 5 * sum(same[i:j]) >= 4 * (j - i)]
        s, e = D.longest_stretch(D.np.array(same))
        assert e - s == max(fits, default=(0, 0))[0] and 5 * sum(same[s:e]) >= 4 * (e - s)
