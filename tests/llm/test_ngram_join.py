import random
import re
from collections import Counter

import pytest
from cases import docs, empty, odd
from pyspark.sql import functions as F

from strandloom.llm import ngram_join as J

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """doc_id to (shingles, component) by comparing all pairs."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = SPACE.findall((t or "").translate(low))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            lowest[find(i)] = min(lowest.get(find(i), d), d)
    return sorted((d, len(sets[i]), lowest.get(find(i))) for i, (d, _) in enumerate(rows) if d is not None)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    passage = rng.choices(vocab, k=60)
    rows = []
    for _ in range(60):
        w = rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 20, 80, 200]))
        if rng.random() < 0.4:
            at = rng.randrange(len(w) + 1)
            w[at:at] = passage
        for _ in range(rng.choice([1, 1, 2, 6])):
            v = list(w)
            for _ in range(rng.choice([0, 0, 1, 2, len(w) // 30])):
                v[rng.randrange(len(v))] = rng.choice(vocab)
            if rng.random() < 0.2:
                v = v[: max(1, int(len(v) * rng.uniform(0.75, 1)))]
            rows.append(" ".join(x.upper() if rng.random() < 0.1 else x for x in v))
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,common", [(1, False), (2, True)])
def test_same_as_all_pairs(spark, seed, common, monkeypatch):
    if common:  # so that passages count as common and prefixes get longer
        monkeypatch.setattr(J, "LOCAL", 2)
        monkeypatch.setattr(J, "COMMON", 4)
    rows = corpus(seed)
    got = J.join_components(docs(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_near_copies_and_exact_threshold(spark):
    rng = random.Random(3)
    base = [f"x{i}" for i in range(120)]
    rows = []
    for i in range(150):  # one group of near copies, some of which link only through others
        v = list(base)
        for _ in range(i % 5):
            v[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        rows.append((i, " ".join(v)))
    # 8 of 10 shingles shared is a link, 7 of 10 is none.
    rows += [(500, "a b c d e f g h i j k l m"), (501, "a b c d e f g h i j k l q"), (600, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11 k12"), (601, "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10 k11 z")]
    got = J.join_components(docs(spark, rows))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_prefix_is_lossless():
    """Of sets that link, enough shared shingles lie in the prefixes, at places that the join's condition lets through."""
    import numpy as np

    rng = np.random.default_rng(5)
    common = np.unique(rng.integers(0, 1000, 100).astype(np.uint64))
    counts = rng.integers(32, 10_000, len(common))
    linked = 0
    for _ in range(800):
        a = np.unique(rng.integers(0, 1000, rng.integers(1, 120)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.93], rng.integers(0, 1000, rng.integers(0, 6)).astype(np.uint64)]))
        if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        linked += 1
        (pa, _, ma), (pb, _, mb) = J.prefix(a, common, counts), J.prefix(b, common, counts)
        m = min(ma, mb)
        at = {t: i for i, t in enumerate(pa.tolist())}
        most = [min(len(a) - at[t], len(b) - j) - 1 + m for j, t in enumerate(pb.tolist()) if t in at]
        assert sum(180 * x >= 80 * (len(a) + len(b)) for x in most) >= m
    assert linked > 200


def test_odd_rows_and_keep_one(spark):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.join_components(odd(spark)).collect()}
    assert {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 3, 4), (6, 1, 6), (8, 0, 8)} <= got
    kept = J.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 9
    assert J.join_components(empty(spark)).count() == 0 and J.keep_one(empty(spark)).count() == 0


def test_parity_bits_bound_the_intersection(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows, want = [], []
    for n in (5, 300, 512, 3000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        for share in (0.0, 0.5, 0.9, 1.0):
            b = np.concatenate([a[: int(n * share)], rng.integers(0, 2**63, int(n * 1.1) - int(n * share), dtype=np.uint64)])
            rows.append((len(rows), J.parity_bits(a).tolist(), J.parity_bits(b).tolist()))
            want.append(len(a) + len(b) - 2 * len(np.intersect1d(a, b)))
    frame = spark.createDataFrame(rows, "i int, x array<bigint>, y array<bigint>")
    got = frame.select("i", J.apart("x", "y").alias("h"), J.apart("y", "x").alias("g")).orderBy("i").collect()
    assert all(r["h"] == r["g"] <= w for r, w in zip(got, want))
    # Bits of very different sets saturate at half their number; near the threshold the bound is close.
    assert all(r["h"] >= 0.6 * w for r, w in zip(got, want) if r["i"] % 4 >= 2)


def test_sizes_over_bands(spark):
    base = [f"v{i}" for i in range(530)]
    rows = [(i, " ".join(base[:n])) for i, n in enumerate((500, 505, 512, 516, 517, 525, 530, 400, 424, 425, 426, 320, 321))]
    assert sorted(map(tuple, J.join_components(docs(spark, rows)).collect())) == brute(rows)


def test_group_around_the_threshold(spark):
    """Many near copies of similarity 0.7 to 0.9, so that links and no links lie side by side."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(200):
        v = list(base)
        for at in rng.sample(range(0, 100, 5), rng.choice([1, 2, 3, 4])):
            v[at] = f"e{i}_{at}"
        rows.append((i, " ".join(v)))
    assert sorted(map(tuple, J.join_components(docs(spark, rows)).collect())) == brute(rows)


@pytest.fixture
def moved(monkeypatch):
    """How many pairs of texts are brought together each time."""
    counts = []

    def counting(f):
        return lambda pairs, *rest: counts.append(pairs.count()) or f(pairs, *rest)

    for name in ("_linked", "_pivot_links"):
        monkeypatch.setattr(J, name, counting(getattr(J, name)))
    return counts


def near_copies(n, changes, first=0, words=200):
    """Texts of which each differs from one base text, that is not among them, in some words."""
    rng = random.Random(changes)
    base, rows = [f"b{changes}_{i}" for i in range(words)], []
    for i in range(n):
        v = list(base)
        for at in rng.sample(range(words), changes):
            v[at] = f"e{i}_{at}"
        rows.append((first + i, " ".join(v)))
    return rows


def test_pairs_moved_grow_with_the_groups(spark, moved):
    """Groups of similarities about 0.82, 0.74, 0.67 and 0.55: pairs that move are a few for each text, not all pairs."""
    each = []
    for n in (400, 800):
        groups = [near_copies(n, changes, changes * 1000) for changes in (2, 3, 4, 6)]
        moved.clear()
        got = sorted(map(tuple, J.join_components(docs(spark, [r for g in groups for r in g], extra=False)).collect()))
        assert got == sorted(r for g in groups for r in brute(g))
        each.append(sum(moved))
    assert each[1] <= 2.5 * each[0] and each[1] <= 4 * 4 * 800


def test_null_ids_string_ids_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (None, text), (None, text + " more"), (3, text + " more"), (None, "alone in the world"), (None, None)]
    frame = docs(spark, rows)
    for name in ("cls", "n_shingles", "component_id", "k", "k_id", "l_id", "root", "t", "copies", "w_id"):
        frame = frame.withColumn(name, F.lit("x"))
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in J.join_components(frame).collect())
    assert got == {(None, 36, 3): 2, (None, 37, 3): 1, (3, 37, 3): 1, (None, 1, None): 1, (None, 0, None): 1}
    kept = J.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == [(0, ""), (0, "alone in the world"), (3, text + " more")]
    named = frame.withColumn("doc_id", F.coalesce(F.concat(F.lit("d"), F.col("doc_id")), F.concat(F.lit("e"), F.length("text"))))
    assert J.join_components(named).schema["component_id"].dataType.simpleString() == "string"
    assert {r["component_id"] for r in J.join_components(named).where("n_shingles > 1").collect()} == {"d3"}


def test_repeated_rows_count_once_and_reruns_agree(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = docs(spark, [(5, text, "en", "a"), (5, text, "fr", "b"), (5, text + " more", "en", "c"), (9, text, "de", "d")], extra=False)
    first, again = (J.keep_one(frame.repartition(n)).collect() for n in (1, 5))
    assert first == again and len(first) == 1 and first[0]["doc_id"] == 5
