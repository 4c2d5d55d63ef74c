"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; words under zeros may differ. Seeds of benchmark items and of documents
are joined by hash, and around each hit the item is laid over the document along the hit's diagonal: the longest stretch
with no negative score (+1 a match, -4 a mismatch, so at least 80 % of its words agree) is a leak if it has ``OVERLAP``
words or is as long as a shorter item. Substitutions count wherever they are, also at the ends; what is reported goes from
the first to the last equal word. The masks are chosen so that every stretch of 13 words with up to two substitutions has
a hit.

Documents are read once. Only positions whose seed is one of the benchmark's leave the scan, with the words around them.
Seeds of the benchmark go to all tasks if there are ``MAX_SENT`` at most (their number is checked); otherwise every
document seed takes part in the join.

Words are compared without case of A-Z. Items of 10 to 12 words may differ by two substitutions, of 8 and 9 by one (80 %); items
of 5 to 7 words must occur as they are; those of fewer words are phrases of any text and count where they are a whole document.
Defined cases: null or empty texts leak nothing, and neither does an empty benchmark; equal rows give one result; of equally long
leaks of one item the one with most equal words, then the first, is reported; ids may be null or of any type; other columns,
whatever their names, are not read (``drop_leaky`` passes them on).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .common import fresh, map_chunks, map_rows, materialised

#: Word positions under ones of each mask.
MASKS = ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 4, 6), (0, 2, 3, 5, 6), (0, 1, 4, 6, 7), (0, 1, 2, 5, 7))
OVERLAP = 13
#: Words under ones of a mask; items of fewer words than EXACT must occur as they are.
WEIGHT, EXACT = 5, 8
MISMATCH = -4
MAX_SENT = 1 << 21
_LOW = np.uint64((1 << 24) - 1)


def seeds(w: np.ndarray) -> list[np.ndarray]:
    """Per mask, the seed hash at each position."""
    return [words.combined(w, m) ^ words.mixed(np.array([i + 1], np.uint64)) for i, m in enumerate(MASKS)]


def whole(w: np.ndarray) -> np.ndarray:
    """The one seed of a text of fewer than WEIGHT words: all of them."""
    return words.combined(w, tuple(range(len(w)))) ^ words.mixed(np.array([len(MASKS) + len(w)], np.uint64))


def longest_stretch(same: np.ndarray) -> tuple[int, int]:
    """(start, end) of the longest stretch whose words agree to 80 % at least; of equal ones that with most matches, then the first."""
    sums = np.concatenate([[0], np.cumsum(np.where(same, 1, MISMATCH))])
    # The first start from which the sum up to an end is not negative: running minima never rise.
    starts = np.searchsorted(-np.minimum.accumulate(sums), -sums, side="left")
    sizes = np.arange(len(sums)) - starts
    end = int(np.lexsort((-np.arange(len(sums)), sums - sums[starts], sizes))[-1])
    return int(starts[end]), end


def _items(benchmark: DataFrame) -> DataFrame:
    """``ikey, item_id, w``: word hashes of the items that have words."""

    def one(item_id, text):
        w = words.word_hashes(words.lowered(text))
        if len(w):
            yield item_id, w.view(np.int64).tolist()

    kind = benchmark.schema["item_id"].dataType.simpleString()
    items = map_rows(benchmark, ["item_id", "text"], one, f"item_id {kind}, w array<bigint>").distinct()
    return materialised(items.withColumn("ikey", F.xxhash64("item_id", "w")))


def _item_seeds(items: DataFrame) -> DataFrame:
    def one(ikey, w):
        w = np.array(w, np.int64).view(np.uint64)
        for s in seeds(w) if len(w) >= WEIGHT else [whole(w)]:
            for at, h in enumerate(s.view(np.int64).tolist()):
                yield ikey, at, h

    return map_rows(items, ["ikey", "w"], one, "ikey bigint, item_at int, h bigint")


def _regions(docs: DataFrame, known: np.ndarray | None, longest: int) -> DataFrame:
    """``doc_id, start, w, hits``: stretches of documents around seeds that the benchmark has too."""
    spark = docs.sparkSession
    bits = None
    if known is not None:
        bits = np.zeros(1 << 24, bool)
        bits[(known & _LOW).astype(np.int64)] = True
    sent = spark.sparkContext.broadcast((known, bits))

    def chunk(ids, texts):
        data = [words.lowered(t) for t in texts]
        w = words.word_hashes(b"\n".join(data))
        sizes = np.array([len(d.split()) for d in data])
        ends = np.cumsum(sizes)
        known, bits = sent.value
        places, hashes = [], []
        for mask, s in zip(MASKS, seeds(w), strict=True):
            if known is None:
                at = np.arange(len(s))
            else:
                at = np.flatnonzero(bits[(s & _LOW).astype(np.int64)])
                near = np.minimum(np.searchsorted(known, s[at]), len(known) - 1)
                at = at[known[near] == s[at]]
            inside = at + mask[-1] < ends[np.searchsorted(ends, at, side="right")] if len(at) else np.zeros(0, bool)
            places.append(at[inside])
            hashes.append(s[at[inside]])
        for i in np.flatnonzero((sizes > 0) & (sizes < WEIGHT)).tolist():
            s = whole(w[ends[i] - sizes[i] : ends[i]])
            if known is None or (len(known) and known[min(np.searchsorted(known, s[0]), len(known) - 1)] == s[0]):
                places.append(ends[i : i + 1] - sizes[i])
                hashes.append(s)
        place, h = np.concatenate(places), np.concatenate(hashes).view(np.int64)
        order = np.argsort(place, kind="stable")
        place, h = place[order], h[order]
        # One part for each document, cut again where hits lie so far apart that their surroundings do not meet.
        who = np.searchsorted(ends, place, side="right")
        cuts = np.flatnonzero((np.diff(who) > 0) | (np.diff(place) > 2 * longest)) + 1
        for p, x in zip(np.split(place, cuts), np.split(h, cuts), strict=True):
            if len(p):
                i = int(np.searchsorted(ends, p[0], side="right"))
                begin = int(ends[i - 1]) if i else 0
                a, b = max(begin, int(p[0]) - longest), min(int(ends[i]), int(p[-1]) + longest)
                hits = [{"at": q, "h": y} for q, y in zip((p - begin).tolist(), x.tolist(), strict=True)]
                yield ids[i], a - begin, w[a:b].view(np.int64), hits

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_chunks(docs, ["doc_id", "text"], chunk, f"doc_id {kind}, start int, w array<bigint>, hits array<struct<at:int,h:bigint>>")


def _verify(batches):
    for b in batches:
        rows = []
        for doc_id, item_id, start, w, v, diagonal in zip(b["doc_id"], b["item_id"], b["start"], b["w"], b["v"], b["diagonal"], strict=True):
            # Word i of the item lies on word i + shift of the region.
            shift = diagonal - start
            lo, hi = max(0, -shift), min(len(v), len(w) - shift)
            same = v[lo:hi] == w[lo + shift : hi + shift]
            s, e = longest_stretch(same)
            if e - s >= min(OVERLAP, len(v)) and (len(v) >= EXACT or same[s:e].all()):
                equal = np.flatnonzero(same[s:e]) + s
                s, e = int(equal[0]), int(equal[-1]) + 1
                rows.append((doc_id, item_id, diagonal + lo + s, lo + s, e - s, len(equal)))
        yield pd.DataFrame(rows, columns=["doc_id", "item_id", "doc_word", "item_word", "n_words", "n_same"])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, doc_word, item_word, n_words, n_same``: the longest leak of each item in each document."""
    items = _items(benchmark)
    item_seeds = materialised(_item_seeds(items))
    small = item_seeds.count() <= MAX_SENT
    known = None
    if small:
        known = np.unique(item_seeds.select("h").distinct().toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    longest = items.agg(F.max(F.size("w"))).collect()[0][0] or 0
    regions = materialised(_regions(docs, known, longest).withColumn("rid", F.xxhash64("doc_id", "start", "w")))
    hits = regions.select("rid", F.explode("hits").alias("hit")).select("rid", "hit.at", "hit.h")
    met = hits.join(F.broadcast(item_seeds) if small else item_seeds, "h")
    laid = met.select("rid", "ikey", (F.col("at") - F.col("item_at")).alias("diagonal")).distinct()
    over = laid.join(regions.select("rid", "doc_id", "start", "w").dropDuplicates(["rid"]), "rid")
    named = items.select("ikey", "item_id", F.col("w").alias("v"))
    over = over.join(F.broadcast(named) if small else named, "ikey").select("doc_id", "item_id", "start", "w", "v", "diagonal")
    d, i = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    found = over.mapInPandas(_verify, f"doc_id {d}, item_id {i}, doc_word int, item_word int, n_words int, n_same int")
    best = F.max(F.struct("n_words", "n_same", (-F.col("doc_word")).alias("neg"), "item_word")).alias("m")
    return found.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("m.neg")).alias("doc_word"), "m.item_word", "m.n_words", "m.n_same"
    )


def drop_leaky(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a leak."""
    name = fresh(docs, "l_id")
    ids = leaks(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")
