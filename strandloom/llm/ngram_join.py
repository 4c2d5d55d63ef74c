"""N-gram Jaccard join with adaptive multi-match prefixes.

Documents with the same shingle set are one class. Shingles have one global order: rare ones by hash, then common ones by
count. Sets that link share ``alpha = ceil(0.8 / 1.8 * (n_a + n_b))`` shingles, so the l-th shingle that they share is one of
the first ``n - alpha + l`` of each. Each class takes the l of least estimated cost: with S the summed counts of the shingles
in the prefix for l, S rows are met in the join and at most S / l partners share l of them and must be verified. Its prefix
is that long, and a pair must share as many prefix shingles as the smaller l of the two before it is verified. A posting
carries the class's size and the shingle's place, which together bound the sizes of its partners: they are part of the join's
key (size bands) and, exactly, of its condition. Where a shingle has more than ``FEW`` classes, postings also carry their sets'
parity bits, which bound what two sets share.

Links are only needed to find components, so candidates are tried in two ways: first each class against one pivot class
of its prefix shingles, which joins groups of near copies with about one pair per member; then pairs of classes that share
prefix shingles and still lie in different components, in rounds that take each class's likeliest pair first and drop the pairs
that have come to lie in one component. No link between components can be missed. Pairs are kept as numbers; texts move only for
pairs that are tried.

Counts of common shingles cover all documents: every task sorts its shingles in runs of ``RUN`` and reports those that
occur ``LOCAL`` times in a run; the sums rank them. The order affects cost only, never results. The set of common
shingles is bounded by ``MAX_COMMON`` and sent to all tasks. A rare shingle makes up at most LOCAL / RUN or 1 / MAX_COMMON
of all shingles, so the windows over rare shingles have no hot partition.

Texts are compressed before they move, once for pivots and once for the classes of open pairs; besides, tables of ``SENT`` rows of numbers
at most are broadcast in rounds, larger ones are shuffled. Class names are 128-bit, shingles are compared as 64-bit hashes; tables of
the join carry a number in place of the name, and each is deleted once nothing reads it.

Defined cases: null, empty and blank texts have no shingles and are their own components; rows with equal ids are
separate rows; a null id is no candidate for the smallest id, and a component of null ids only has a null id; ids may have
any type that has an order; other columns of the input, whatever their names, are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .common import drop_table, fresh, is_small, map_chunks, materialised, quoted, type_of
from .components import components

SIZE = 5
#: Links: SHARED_PARTS * |intersection| >= UNION_PARTS * |union|, in whole numbers.
UNION_PARTS, SHARED_PARTS = 80, 100

CHUNK = 128
RUN = 1 << 22
LOCAL = 4
COMMON = 32
MAX_COMMON = 1 << 20
#: The most matches asked for, and what it costs to verify a pair, in rows of the join that finds it.
MAX_MATCHES, VERIFY = 12, 4
#: Bits of a set's parity filter, by the set's size between these powers of two.
BITS, MOST_BITS = 256, 2048
#: The same of the filter that a pair passes before it is verified, with so many bits for each shingle.
FINE, MOST_FINE = 4, 16_384
#: Rows of two or three numbers that a round sends to all tasks at most; larger tables are shuffled.
SENT = 1 << 18
#: Classes under one shingle beyond which their postings carry these bits.
FEW = 8
#: Size bands for each factor 1.25, the most by which the sizes of sets that link differ. A row asks one band more than that.
BANDS = 1


def normal(text: str | None) -> bytes:
    """Lower-cased words joined by one space."""
    return b" ".join(words.lowered(text).split())


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [np.unique(x) for x in words.shingle_lists(texts, SIZE)]


def class_of(s: np.ndarray) -> bytes:
    """128-bit name of a shingle set."""
    return hashlib.md5(s.tobytes()).digest()


def need(n: int) -> int:
    """Least intersection of a set of n with any set that it links to."""
    return -(-UNION_PARTS * n // SHARED_PARTS)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of common shingles and their counts, over all documents."""

    def count(batches):
        held, n = [], 0

        def flush():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"t": u[c >= LOCAL].view(np.int64), "c": c[c >= LOCAL]})

        for b in batches:
            texts = b["text"].tolist()
            for at in range(0, len(texts), CHUNK):
                found = words.shingle_lists([words.lowered(t) for t in texts[at : at + CHUNK]], SIZE)
                held += found
                n += sum(map(len, found))
                if n >= RUN:
                    yield flush()
                    held, n = [], 0
        if held:
            yield flush()

    counted = materialised(docs.select("text").mapInPandas(count, "t bigint, c bigint").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON))
    # The least power of two that leaves MAX_COMMON shingles or fewer.
    steps = counted.groupBy(F.floor(F.log2("c")).alias("e")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = COMMON, 0
    for r in sorted(steps, key=lambda r: -r["e"]):
        total += r["n"]
        if total > MAX_COMMON:
            least = 2 ** (r["e"] + 1)
            break
    rows = counted.where(F.col("c") >= least).toPandas()
    drop_table(counted)
    t = rows["t"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(t)
    return t[order], rows["c"].to_numpy(np.int64)[order]


def prefix(s: np.ndarray, common: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int, int]:
    """Prefix shingles of a set in the global order, how many of the set's are rare, and the matches that the prefix stands for."""
    n = len(s)
    base, most = n - need(n) + 1, min(MAX_MATCHES, need(n))
    at = np.searchsorted(common, s)
    at[at == len(common)] = 0
    heavy = common[at] == s if len(common) else np.zeros(n, bool)
    often = at[heavy]
    often = often[np.argsort(counts[often], kind="stable")]  # within equal counts, the set's own order by hash stays
    rare = s[~heavy]
    order = np.concatenate([rare, common[often]])[: base + most - 1]
    # Partners of the same size are met at the first n - alpha + l places.
    near = n - (2 * UNION_PARTS * n) // (SHARED_PARTS + UNION_PARTS)
    met = np.cumsum(np.concatenate([np.ones(len(rare)), counts[often]]))[near - 1 : near - 1 + most]
    best = int(np.argmin(met * (1 + VERIFY / np.arange(1, len(met) + 1)))) if len(met) else 0
    return order[: base + best], len(rare), best + 1


def parity_bits(s: np.ndarray, each: int = 1, most: int = MOST_BITS) -> np.ndarray:
    """A set's shingles hashed to bits, each bit the parity of those that meet in it, as 64-bit words.

    Sets whose bits differ in h places have h different shingles or more, hence |a| + |b| - 2 |a & b| >= h: a bound that
    drops no pair wrongly. There are ``each`` bits or more for each shingle, a power of two in all, BITS at least and ``most`` at most.
    """
    size = min(max(BITS, each << (len(s) - 1).bit_length()), most)
    odd = np.bincount((s >> np.uint64(20) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def apart(a: str, b: str) -> Column:
    """In how many places the parity bits in two columns differ. Sizes that may link differ by one power of two at most; the
    halves of the longer bits then meet."""

    def folded(bits: str, other: str) -> Column:
        half = F.floor(F.size(bits) / 2).cast("int")
        halves = F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(bits) > F.size(other), halves).otherwise(F.col(bits))

    differ = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(differ, F.lit(0), lambda total, x: total + x)


def _named(docs: DataFrame) -> DataFrame:
    """``doc_id, k, text``; the hash k tells texts of one id apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("k"), "text")


def _prefixes(docs: DataFrame) -> DataFrame:
    """``doc_id, k, name, n, rare, matches, p, bits``; name, the class's, is null without words."""
    common, counts = common_shingles(docs)
    sent = docs.sparkSession.sparkContext.broadcast((common, counts))

    def chunk(ids, ks, texts):
        for doc_id, k, s in zip(ids, ks, shingle_sets([normal(t) for t in texts]), strict=True):
            if len(s):
                p, rare, matches = prefix(s, *sent.value)
                yield doc_id, k, class_of(s), len(s), rare, matches, p.view(np.int64), parity_bits(s)
            else:
                yield doc_id, k, None, 0, 0, 0, None, None

    schema = f"doc_id {type_of(docs, 'doc_id')}, k bigint, name binary, n bigint, rare int, matches int, p array<bigint>, bits array<bigint>"
    return map_chunks(_named(docs), ["doc_id", "k", "text"], chunk, schema, rows=CHUNK)


def _texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (cls and other columns) with the name and the compressed text z of each class; texts leave the scan once."""
    ask = wanted.join(reps.select("cls", "name", F.col("one.doc_id").alias("w_id"), F.col("one.k").alias("w_k")), "cls")

    def pack(ids, ks, texts):
        z = zstandard.ZstdCompressor(level=3)
        for doc_id, k, t in zip(ids, ks, texts, strict=True):
            if t:
                yield doc_id, k, z.compress(normal(t))

    packed = map_chunks(_named(docs), ["doc_id", "k", "text"], pack, f"doc_id {type_of(docs, 'doc_id')}, k bigint, z binary")
    met = packed.join(ask, (F.col("k") == F.col("w_k")) & F.col("doc_id").eqNullSafe(F.col("w_id")))
    return met.select(*wanted.columns, "name", "z")


def _pivot_links(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b), one for each a, whose sets are similar enough; texts go from the scan to b."""
    ask = pairs.select(F.col("a").alias("cls"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("cls"), F.col("b").alias("to")).distinct())
    moved = materialised(_texts(docs, reps, ask))
    left = moved.where("cls <> to").select(F.col("cls").alias("a"), F.col("to").alias("b"), F.col("name").alias("name_a"), F.col("z").alias("z_a"))
    right = moved.where("cls = to").select(F.col("cls").alias("w"), F.col("name").alias("name_b"), F.col("z").alias("z_b"))
    out = _compared(left, right)
    drop_table(moved)
    return out


def _linked(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough. The text of a travels to b, where b's own text waits."""
    left = pairs.join(store, pairs["a"] == store["cls"]).select("a", "b", F.col("name").alias("name_a"), F.col("z").alias("z_a"))
    # Written, so that both sides of the join below come from an exchange; only then are hot partitions split.
    wanted = store.join(pairs.select(F.col("b").alias("cls")).distinct(), "cls", "left_semi")
    right = materialised(wanted.select(F.col("cls").alias("w"), F.col("name").alias("name_b"), F.col("z").alias("z_b")))
    out = _compared(left, right)
    drop_table(right)
    return out


def _compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of ``a, b, name_a, z_a`` and ``w, name_b, z_b``, with b = w, that link."""

    def compare(a, b, name_a, name_b, z_a, z_b):
        unzip = zstandard.ZstdDecompressor()
        new = [i for i in range(len(b)) if not i or b[i] != b[i - 1]]  # pairs of one b often follow each other
        sets = shingle_sets([unzip.decompress(z) for z in z_a] + [unzip.decompress(z_b[i]) for i in new])
        at = -1
        for i, s in enumerate(sets[: len(a)]):
            at += at + 1 < len(new) and new[at + 1] == i
            t = sets[len(a) + at]
            shared = len(np.intersect1d(s, t, assume_unique=True))
            if SHARED_PARTS * shared >= UNION_PARTS * (len(s) + len(t) - shared) and class_of(s) == name_a[i] and class_of(t) == name_b[i]:
                yield a[i], b[i]

    both = left.join(right, F.col("b") == F.col("w"))
    return materialised(map_chunks(both, ["a", "b", "name_a", "name_b", "z_a", "z_b"], compare, "a bigint, b bigint", rows=CHUNK))


def _fits(n: Column, m: Column) -> Column:
    """Whether two set sizes allow the similarity."""
    return (n * SHARED_PARTS >= m * UNION_PARTS) & (m * SHARED_PARTS >= n * UNION_PARTS)


def _postings(reps: DataFrame) -> DataFrame:
    """``t, cls, n, matches, i``: prefix shingles that several classes have, and the class's place for it.

    Common shingles may be in a third of all documents: their groups are summed before the shuffle, and the join back is one
    that adaptive execution splits.
    """
    each = reps.select("cls", "n", "matches", "rare", F.posexplode("p").alias("i", "t"))
    names = ("t", "cls", "n", "matches", "i")
    low = each.where("i < rare").select(*names, F.count(F.lit(1)).over(W.partitionBy("t")).alias("g")).where("g > 1").select(*names)
    often = each.where("i >= rare").select(*names)
    # Written, so that both sides of the join come from an exchange; only then are hot partitions split.
    groups = materialised(often.groupBy("t").agg(F.count(F.lit(1)).alias("g")).where("g > 1").select("t"))
    return low.unionByName(often.join(groups, "t").select(*names))


def _pivots(shared: DataFrame, reps: DataFrame) -> DataFrame:
    """``a, b``: each class with the pivot that it shares most prefix shingles with.

    The pivot of a shingle is the class with the fewest prefix shingles of its own, then the smallest: of near copies, the one
    that the others were made from.
    """
    met = shared.groupBy("cls").agg(F.count(F.lit(1)).alias("c"))
    alone = reps.select("cls", "places").join(met, "cls").select("cls", (F.col("places") - F.col("c")).alias("alone"))
    own = materialised(shared.join(alone, "cls").select("t", F.struct("alone", "n", "cls").alias("own")))
    lead = materialised(own.groupBy("t").agg(F.min("own").alias("pivot")))
    tried = own.join(lead, "t").where((F.col("own.cls") != F.col("pivot.cls")) & _fits(F.col("own.n"), F.col("pivot.n")))
    counted = tried.groupBy(F.col("own.cls").alias("a"), F.col("pivot.cls").alias("b")).agg(F.count(F.lit(1)).alias("c"))
    out = materialised(counted.groupBy("a").agg(F.max_by("b", F.struct("c", "b")).alias("b")))
    drop_table(own)
    drop_table(lead)
    return out


def _may_link(size: Column, differ: Column) -> Column:
    """Whether two sets of these sizes together may link if their parity bits differ in so many places."""
    return (size - differ) * (SHARED_PARTS + UNION_PARTS) >= size * 2 * UNION_PARTS


def _band(n: Column) -> Column:
    return F.floor(F.log(n) * (BANDS / math.log(SHARED_PARTS / UNION_PARTS)) + 1e-6).cast("int")


def _candidates(member: DataFrame, reps: DataFrame) -> DataFrame:
    """``a, b, h``: pairs of different components that share enough prefix shingles, from ``t, cls, n, matches, i, root``.

    h is the number of places in which their parity bits differ, 0 where a shingle has few classes.

    Of alpha shingles that two sets share with l matches asked, l lie where ``n - i - 1 + l >= alpha`` holds on both sides; as
    alpha grows with both sizes, this bounds a partner's size by ``most``. The larger set waits in its band, the smaller one
    asks all bands from its own to the one of its bound.
    """
    open_ = member.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("g")).where("lo <> hi").select("t", "g")
    reach = (F.col("n") - F.col("i") - 1 + F.col("matches")) * ((SHARED_PARTS + UNION_PARTS) / UNION_PARTS) - F.col("n")
    left = materialised(member.join(open_, "t").withColumn("most", F.least(F.floor(reach + 1e-6), F.floor(F.col("n") * (SHARED_PARTS / UNION_PARTS)))))
    names = ("cls", "n", "matches", "i", "root", "most")
    matches = F.least("matches_a", "matches_b")
    size = F.col("n_a") + F.col("n_b")

    def met(rows: DataFrame, names: tuple[str, ...], near: Column, h: Column) -> DataFrame:
        x = rows.select("t", _band(F.col("n")).alias("band"), *[F.col(c).alias(f"{c}_a") for c in names])
        bands = F.explode(F.sequence(_band(F.col("n")), _band(F.col("most"))))
        y = rows.where("most >= n").select("t", bands.alias("band"), *[F.col(c).alias(f"{c}_b") for c in names])
        larger = (F.col("n_a") > F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("cls_a") > F.col("cls_b")))
        sizes = larger & (F.col("n_a") <= F.col("most_b")) & (F.col("n_b") <= F.col("most_a"))
        both = F.least(F.col("n_a") - F.col("i_a"), F.col("n_b") - F.col("i_b")) - 1 + matches
        enough = both * (SHARED_PARTS + UNION_PARTS) >= size * UNION_PARTS
        pairs = x.join(y, ["t", "band"]).where(sizes & (F.col("root_a") != F.col("root_b")) & enough & near)
        return pairs.select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"), matches.alias("l"), h.alias("h"))

    few = met(left.where(F.col("g") <= FEW), names, F.lit(True), F.lit(0))
    h = apart("bits_a", "bits_b")
    many = met(left.where(F.col("g") > FEW).join(reps.select("cls", "bits"), "cls"), (*names, "bits"), _may_link(size, h), h)
    pairs = few.unionByName(many).groupBy("a", "b", "l").agg(F.count(F.lit(1)).alias("c"), F.max("h").alias("h"))
    out = materialised(pairs.where("c >= l").select("a", "b", "h"))
    drop_table(left)
    return out


def _classes(full: DataFrame) -> DataFrame:
    """``cls, name, one, n, rare, matches, p, bits``: the number of each class, one of its rows, and what its rows agree in."""
    same = [F.first(c).alias(c) for c in ("n", "rare", "matches", "p", "bits")]
    named = full.where("name is not null").groupBy("name").agg(F.min(F.struct("doc_id", "k")).alias("one"), *same)
    return named.withColumn("cls", F.monotonically_increasing_id())


def _sent(df: DataFrame) -> DataFrame:
    """A table for the small side of a join: sent to all tasks if it has no more than ``SENT`` rows, else shuffled."""
    return F.broadcast(df) if is_small(df, SENT) else df


def _joined(state: DataFrame, edges: DataFrame) -> DataFrame:
    """``cls, root`` with the components of the roots that edges (a, b) join."""
    more = components(edges).withColumnRenamed("root", "joined")
    new = materialised(state.join(more, state["root"] == more["node"], "left").select("cls", F.coalesce("joined", "root").alias("root")))
    drop_table(more)
    return new


def _rooted(pairs: DataFrame, state: DataFrame) -> DataFrame:
    """Pairs (a, b) with the roots of both sides, ``r_a`` and ``r_b``."""
    for x in "ab":
        side = _sent(state.select(F.col("cls").alias(f"c_{x}"), F.col("root").alias(f"r_{x}")))
        pairs = pairs.join(side, F.col(x) == F.col(f"c_{x}")).drop(f"c_{x}")
    return pairs


def _fine(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """The pairs (a, b) that longer parity bits let through."""
    for x in "ab":
        pairs = pairs.join(store.select(F.col("cls").alias(f"c_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}")), F.col(x) == F.col(f"c_{x}"))
    return pairs.where(_may_link(F.col("n_a") + F.col("n_b"), apart("bits_a", "bits_b"))).select("a", "b")


def _near(pairs: DataFrame, docs: DataFrame, reps: DataFrame) -> DataFrame:
    """``cls, name, z, n, bits`` of the classes in pairs (a, b), with longer parity bits."""

    def mark(cls, names, zs):
        unzip = zstandard.ZstdDecompressor()
        for c, name, z, s in zip(cls, names, zs, shingle_sets([unzip.decompress(z) for z in zs]), strict=True):
            yield c, name, z, len(s), parity_bits(s, FINE, MOST_FINE)

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    schema = "cls bigint, name binary, z binary, n bigint, bits array<bigint>"
    return materialised(map_chunks(_texts(docs, reps, wanted), ["cls", "name", "z"], mark, schema, rows=CHUNK))


def _rounds(pairs: DataFrame, state: DataFrame, docs: DataFrame, reps: DataFrame) -> list[DataFrame]:
    """Edges between roots (a, b) after which no pair (a, b, h) of different components is left that was not tried.

    A round tries, for each class, its likeliest open pair: that whose bits differ least. What it joins closes other pairs, which
    are dropped; so of a group of near copies that are joined in the end, about as many pairs move as it has members, not all of
    them. Each round takes four times as many pairs a class as the one before, so rounds are few where all fail. Only the state
    of classes in pairs takes part.
    """
    near, slots, found = _near(pairs, docs, reps), 1, []
    state = materialised(state.join(near.select("cls"), "cls", "left_semi"))
    while True:
        open_ = materialised(_rooted(pairs, state).where("r_a <> r_b").select("a", "b", "h"))
        drop_table(pairs)
        if open_.isEmpty():
            for t in (open_, near, state):
                drop_table(t)
            return found
        tried = open_.groupBy("a", F.pmod(F.xxhash64("b"), F.lit(slots)).alias("slot")).agg(F.min(F.struct("h", "b")).alias("m"))
        tried = materialised(tried.select("a", F.col("m.b").alias("b")))
        likely = materialised(_fine(tried, near))
        links = _linked(likely, near)
        did = _sent(tried.select(F.col("a").alias("t_a"), F.col("b").alias("t_b")))
        pairs = materialised(open_.join(did, (F.col("a") == F.col("t_a")) & (F.col("b") == F.col("t_b")), "left_anti"))
        if not links.isEmpty():
            found.append(materialised(_rooted(links, state).select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))))
            old, state = state, _joined(state, found[-1])
            drop_table(old)
        for t in (links, likely, tried, open_):
            drop_table(t)
        slots *= 4


def link_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rows, roots)``: doc_id, k, name, n of every row; name and root of every class, the root a number that linked classes share."""
    full = materialised(_prefixes(docs))
    wide = materialised(_classes(full))
    rows = materialised(full.select("doc_id", "k", "name", "n"))
    drop_table(full)
    shared = materialised(_postings(wide))
    reps = materialised(wide.select("cls", "name", "one", F.size("p").alias("places"), "bits"))
    drop_table(wide)

    best = _pivots(shared, reps)
    links = _pivot_links(best, docs, reps)
    alone = materialised(reps.select("cls", F.col("cls").alias("root")))
    state = _joined(alone, links)

    # What is left: pairs of different components.
    member = shared.join(state, "cls").select(*shared.columns, "root")
    again = _candidates(member, reps)
    drop_table(shared)
    edges = _rounds(again, state, docs, reps)
    final = _joined(state, reduce(DataFrame.unionByName, edges)) if edges else state
    named = materialised(reps.join(final, "cls").select("name", "root"))
    for t in (best, reps, links, alone, state, *edges):
        drop_table(t)
    return rows, named


def _placed(docs: DataFrame) -> DataFrame:
    """``doc_id, k, n, root`` of every row; root is null without words."""
    rows, roots = link_classes(docs)
    # One class may hold a third of all rows: the skew join of adaptive execution splits its side.
    return materialised(rows.join(roots, "name", "left").select("doc_id", "k", "n", "root"))


def join_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (doc_id, text)."""
    rows = _placed(docs)
    low = rows.where("root is not null").groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id"))
    out = rows.join(low, rows["root"] == low["r"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component: that of the smallest id, of equal ids the text with the smallest hash.

    A null id is kept only where a component has no other. Rows without words are components of their own and stay. Rows
    that repeat id and text count once: the one whose columns have the smallest hash stays.
    """
    ids, k, copies = fresh(docs, "doc_id"), fresh(docs, "k"), fresh(docs, "copies")
    own = [docs[quoted(c)] for c in docs.columns]
    rows = _placed(docs)
    sized = rows.where("root is not null").groupBy("root", "doc_id", "k").agg(F.count(F.lit(1)).alias("c"))
    first = sized.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k", "c")).alias("m"))
    kept = first.select(F.col("m.doc_id").alias(ids), F.col("m.k").alias(k), F.col("m.c").alias(copies))
    blank = rows.where("root is null").select(F.col("doc_id").alias(ids), F.col("k").alias(k)).distinct().withColumn(copies, F.lit(1).cast("bigint"))
    met = docs.join(kept.unionByName(blank), docs["doc_id"].eqNullSafe(F.col(ids)) & (F.xxhash64(docs["text"]) == F.col(k)))
    single = met.where(F.col(copies) == 1).select(*own)
    w = W.partitionBy(ids, k).orderBy(F.xxhash64(*own))
    repeated = met.where(F.col(copies) > 1).withColumn(copies, F.row_number().over(w)).where(F.col(copies) == 1)
    return single.unionByName(repeated.select(*[F.col(quoted(c)) for c in docs.columns]))
