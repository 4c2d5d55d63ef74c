import random
import zlib

import numpy as np
from cases import docs, empty, odd

from strandloom.llm import language_id as L


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    got = L.identify(df).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    out = [r["lang_pred"] == truth[r["doc_id"]] for r in got if r["held_out"]]
    assert len(out) > 200 and np.mean(out) > 0.97


def test_trigrams_of_pieces(monkeypatch):
    text = "Ab  cd, éf!" * 9
    k, c = L.trigrams(text)
    monkeypatch.setattr(L, "_PIECE", 4)
    k2, c2 = L.trigrams(text)
    assert (k == k2).all() and (c == c2).all()
    # " a", "ab", ... : blanks at both ends and one for each run; a trigram for each place.
    s = " " + "".join(x if x.isalpha() else " " for x in text.lower())
    s = " ".join(s.split())
    assert c.sum() == len(f" {s} ") - 2


def test_binding_and_bundling():
    v = L.bundle("abc")
    assert abs(np.linalg.norm(v) - 1) < 1e-9
    assert L.bundle("abcabcabc") @ L.bundle("cabcab") > 0.7 > 0.3 > abs(L.bundle("abcdef") @ L.bundle("uvwxyz"))
    assert L.bundle(None) is None and L.bundle("12 !?") is None


def test_odd_rows(spark):
    rows = [*((i, "the cat sat on the mat and then it slept", "en") for i in range(100, 109)), *((i, "der hund und die katze schlafen nicht", "de") for i in range(110, 119))]
    both = docs(spark, rows).unionByName(odd(spark))
    got = {r["doc_id"]: r for r in L.identify(both).collect()}
    assert [got[i]["lang_pred"] for i in (100, 110, 1, 2, 3)] == ["en", "de", "und", "und", "und"] and got[2]["score"] == 0.0
    assert {r["lang_pred"] for r in L.identify(odd(spark)).collect()} == {"und"}
    assert L.identify(empty(spark)).count() == 0
    kept = L.keep_identified(both)
    assert kept.columns == both.columns and not {2, 3} & {r["doc_id"] for r in kept.collect()}


UNLEARNED = [
    "La mattina il sole illuminava le strade della vecchia citta e la gente usciva dalle case per andare al mercato, dove i contadini vendevano frutta.",
    "De volgende ochtend liepen wij langs het water naar de oude molen, waar een vriendelijke man ons vertelde hoe hij het graan van de boeren maalde.",
    "Seuraavana aamuna lahdimme kavelemaan jarven rantaa pitkin ja naimme monta lintua, jotka lensivat metsan ylitse kohti pohjoista.",
    "На следующее утро мы пошли к реке и долго смотрели, как рыбаки вытаскивают сети из холодной воды.",
    '<div class="row"><span id="x1"></span><img src="a.png"/><td colspan="2"></td></div>' * 4,
]


def test_texts_in_no_learned_language_go(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    bad = [*UNLEARNED, *(" ".join("".join(rng.choices(letters, k=6)) for _ in range(n)) for n in (6, 50, 500))]
    bad += ["".join(rng.choices(letters, k=300)), "".join(rng.choices(letters + letters.upper() + "0123456789+/", k=400))]
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    good = ["the", "the man", "Thank you very much.", "Yesterday morning we walked along the river to the old mill and then back to the house."]
    more = docs(spark, [(-1 - i, t) for i, t in enumerate(bad)] + [(-1001 - i, t) for i, t in enumerate(good)], extra=False)
    kept = {r["doc_id"] for r in L.keep_identified(df.unionByName(more)).select("doc_id").collect()}
    assert [i for i in range(len(bad)) if -1 - i in kept] == [] and all(-1001 - i in kept for i in range(len(good)))
    lettered = {r["doc_id"] for r in df.collect() if L.bundle(r["text"]) is not None}
    assert len(lettered - kept) <= 0.005 * len(lettered)
