"""Merkle dataset manifest: a hash tree of each group of records and one over the groups, kept as blocks in van Emde Boas order.

A leaf is the SHA-256 of a record's fields. Leaves of a group ascend by id; every ``FAN`` consecutive nodes, of the last run
perhaps fewer, become the hash of their digests, until one is left: the group's subroot. Subroots are the leaves of the tree
of groups. Digests enter a hash as lowercase hex.

The tree of a group is cut into aligned blocks of ``HEIGHT`` levels. A block is one row of a table: its nodes lie in van Emde
Boas order, the upper half of its levels first, then each subtree below, every one laid out likewise; ``address`` finds a node
by arithmetic, and a node's siblings lie close to it. Roots of blocks are the leaves of the next table of blocks. Proofs are
opened from the top down: a block's own path of siblings serves all its leaves, so a path leaves a table once per block.

Records are ranked in their groups by one range exchange: ids number the rows of a partition, and partitions are summed per
group. So a group of any size is spread over partitions, and tasks see a block at a time.

Defined cases: null fields are ``-``, so they differ from empty ones; a null group is a group and comes first; null ids come
first, and equal ids follow each other by leaf; repeated rows are leaves of their own; an empty table has no root and gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, materialised

FAN = 16
#: Levels between a block's leaves and its root: 4,096 leaves.
HEIGHT = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<before string, after string>>"
_ROW_BITS = 33  # of monotonically_increasing_id


# The layout of one block.


def n_nodes(levels: int) -> int:
    """Nodes of a complete tree of so many levels."""
    return (FAN**levels - 1) // (FAN - 1)


def address(depth: int, index, levels: int):
    """Where node ``index`` of a depth (root 0) lies in a tree of ``levels`` levels; ``index`` may be an array."""
    if levels == 1:
        return index * 0
    top = levels // 2
    if depth < top:
        return address(depth, index, top)
    below = FAN ** (depth - top)
    return n_nodes(top) + index // below * n_nodes(levels - top) + address(depth - top, index % below, levels - top)


def levels_above(n: int) -> int:
    """How often n nodes are joined in runs until one is left."""
    up = 0
    while n > 1:
        n, up = -(-n // FAN), up + 1
    return up


@dataclass
class Block:
    """``n`` leaves raised ``up`` levels; nodes as rows of 32 bytes in van Emde Boas order, without the unused end."""

    n: int
    up: int
    nodes: np.ndarray

    @classmethod
    def raised(cls, leaves: np.ndarray, up: int) -> Block:
        n = [-(-len(leaves) // FAN ** (up - d)) for d in range(up + 1)]
        used = 1 + max(int(address(d, n[d] - 1, up + 1)) for d in range(up + 1))
        block = cls(len(leaves), up, np.zeros((used, 32), np.uint8))
        block.nodes[address(up, np.arange(len(leaves)), up + 1)] = leaves
        for d in range(up, 0, -1):
            joined = [np.frombuffer(hashlib.sha256(block.run(d, r).encode()).digest(), np.uint8) for r in range(n[d - 1])]
            block.nodes[address(d - 1, np.arange(n[d - 1]), up + 1)] = joined
        return block

    def run(self, depth: int, r: int) -> str:
        """The digests of one run, as hex."""
        n = -(-self.n // FAN ** (self.up - depth))
        return self.nodes[address(depth, np.arange(FAN * r, min(FAN * r + FAN, n)), self.up + 1)].tobytes().hex()

    def root(self) -> bytes:
        return self.nodes[0].tobytes()

    def paths(self, above: list[tuple[str, str]]):
        """For each leaf, the hex of the siblings before and after it at every level, those above the block included."""
        found: dict[tuple[int, int], list[tuple[str, str]]] = {(0, 0): above}
        for d in range(1, self.up + 1):
            here = {}
            for r in range(-(-self.n // FAN ** (self.up - d + 1))):
                run, over = self.run(d, r), found[d - 1, r]
                for k in range(len(run) // 64):
                    here[d, FAN * r + k] = [(run[: 64 * k], run[64 * k + 64 :]), *over]
            found = here
        return [found[self.up, i] for i in range(self.n)]


def folded(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf has with these siblings."""
    for before, after in path:
        leaf = hashlib.sha256((before + leaf + after).encode()).hexdigest()
    return leaf


# Tables.


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """Digest of a record's fields, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]).cast("binary"), 256))


def _group(value: Column) -> Column:
    """A string that orders groups: null first, then by UTF-8 bytes."""
    return F.when(value.isNull(), "0").otherwise(F.concat(F.lit("1"), value.cast("string")))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``pos`` and ``total bigint``: place in its group ``g`` and the group's size, by one range exchange."""
    by = ["g", *order]
    placed = materialised(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", _ROW_BITS)
    parts = placed.groupBy(F.col("g").alias("pg"), part.alias("part")).agg(F.min("at").alias("lo"), F.count(F.lit(1)).alias("n"))
    upto, whole = W.partitionBy("pg").orderBy("part"), W.partitionBy("pg")
    firsts = parts.select("pg", "part", "lo", (F.sum("n").over(upto) - F.col("n")).alias("first"), F.sum("n").over(whole).alias("total"))
    met = placed.join(firsts, (placed["g"] == firsts["pg"]) & (F.shiftright(placed["at"], _ROW_BITS) == firsts["part"]))
    out = materialised(met.select(*rows.columns, (F.col("first") + F.col("at") - F.col("lo")).alias("pos"), "total"))
    drop_table(placed)
    return out


def _blocks_of(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("bigint")


def _raise(rows: DataFrame, height: int) -> DataFrame:
    """``g, block, blocks, n, nodes, root``: the blocks over ``g, pos, total, digest``."""
    size = FAN**height

    def build(key, t):
        t = t.sort_by("pos")
        leaves = np.frombuffer(b"".join(t["digest"].to_pylist()), np.uint8).reshape(-1, 32)
        blocks = t["blocks"][0].as_py()
        b = Block.raised(leaves, height if blocks > 1 else levels_above(len(leaves)))
        return pa.table({"g": [key[0].as_py()], "block": [key[1].as_py()], "blocks": [blocks], "n": [b.n], "up": pa.array([b.up], pa.int32()), "nodes": [b.nodes.tobytes()], "root": [b.root()]})

    at = rows.select("g", F.floor(F.col("pos") / size).cast("bigint").alias("block"), _blocks_of(F.col("total"), size).alias("blocks"), "pos", "digest")
    return at.groupBy("g", "block").applyInArrow(build, "g string, block bigint, blocks bigint, n bigint, up int, nodes binary, root binary")


def build(rows: DataFrame, height: int = HEIGHT) -> list[DataFrame]:
    """Tables of blocks over ``g, pos, total, digest``, from the leaves up; the last holds no group of several blocks."""
    levels = []
    while True:
        levels.append(materialised(_raise(rows, height)))
        rows = levels[-1].where("blocks > 1").select("g", F.col("block").alias("pos"), F.col("blocks").alias("total"), F.col("root").alias("digest"))
        if rows.isEmpty():
            return levels


def subroots(levels: list[DataFrame]) -> DataFrame:
    """``g, digest``: the root of each group."""
    tops = [t.where("blocks = 1").select("g", F.col("root").alias("digest")) for t in levels]
    out = tops[0]
    for t in tops[1:]:
        out = out.unionByName(t)
    return out


def _open(rows: DataFrame, blocks: DataFrame, paths: DataFrame, height: int, leaves: bool) -> DataFrame:
    """The paths of the leaves of one table of blocks, from the paths of the blocks (``g, block, subroot, path``).

    Leaves that are blocks themselves get ``g, block, subroot, path``; records get their proofs.
    """
    size = FAN**height
    at = F.floor(F.col("pos") / size).cast("bigint").alias("block")
    record = ["doc_id", "digest", "tampered"] if leaves else []
    kept = rows.select("g", at, F.col("pos"), *record)
    known = paths.select(F.col("g").alias("pg"), F.col("block").alias("pb"), "subroot", "path")
    held = blocks.join(known, (blocks["g"] == known["pg"]) & (blocks["block"] == known["pb"])).select("g", "block", "n", "up", "nodes", "subroot", "path")

    def opened(key, t, b):
        t = t.sort_by("pos")
        one = b.to_pylist()[0]
        block = Block(one["n"], one["up"], np.frombuffer(one["nodes"], np.uint8).reshape(-1, 32))
        return t, one, block.paths([(p["before"], p["after"]) for p in one["path"]])

    def down(key, t, b):
        t, one, found = opened(key, t, b)
        path = [[{"before": x, "after": y} for x, y in p] for p in found]
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        return pa.table({"g": [one["g"]] * len(path), "block": t["pos"], "subroot": pa.array([one["subroot"]] * len(path), pa.binary()), "path": pa.array(path, kind)})

    def prove(key, t, b):
        t, one, found = opened(key, t, b)
        proofs = [hashlib.sha256("".join(x + y for x, y in p).encode()).hexdigest() for p in found]
        own = [d.hex() for d in t["digest"].to_pylist()]
        held = [own[i] if d is None else d.hex() for i, d in enumerate(t["tampered"].to_pylist())]
        ends = [folded(d, p) for d, p in zip(held, found, strict=True)]
        return pa.table({"doc_id": t["doc_id"], "leaf": own, "subroot": [one["subroot"].hex()] * len(own), "proof_sha256": proofs, "folded_root": ends})

    both = kept.groupBy("g", "block").cogroup(held.groupBy("g", "block"))
    if not leaves:
        return both.applyInArrow(down, f"g string, block bigint, subroot binary, path {_PATH}")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return both.applyInArrow(prove, f"doc_id {kind}, leaf string, subroot string, proof_sha256 string, folded_root string")


def _descend(levels: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The paths of the lowest blocks; ``tops`` has ``g, subroot, path`` of every group."""
    paths = None
    for i in range(len(levels) - 1, -1, -1):
        one = levels[i].where("blocks = 1").select(F.col("g").alias("tg"), "block")
        own = one.join(tops, one["tg"] == tops["g"]).select("g", "block", "subroot", "path")
        paths = materialised(own if paths is None else own.unionByName(paths))
        if i:
            below = levels[i - 1].where("blocks > 1").select("g", F.col("block").alias("pos"))
            paths = _open(below, levels[i], paths, height, leaves=False)
    return paths


@dataclass
class Manifest:
    """``rows`` (g, doc_id, digest, tampered, pos, total), tables of blocks of all groups and of the tree of groups, and the root as hex."""

    rows: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    group_levels: list[DataFrame]
    root: str | None
    height: int


def manifest(docs: DataFrame, tampered: Column | None = None, height: int = HEIGHT) -> Manifest:
    """The manifest of ``docs`` (``FIELDS``). ``tampered``, where it is not null, is another text to be tried against it."""
    fields = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("binary") if tampered is None else F.when(tampered.isNotNull(), leaf(*fields[:-1], tampered))
    made = docs.select(_group(F.col("source")).alias("g"), "doc_id", leaf(*fields).alias("digest"), other.alias("tampered"), F.monotonically_increasing_id().alias("tie"))
    # Written first: a range exchange reads its input twice, and texts should be hashed once.
    leaves = materialised(made)
    rows = ranked(leaves, "doc_id", "digest", "tie")
    drop_table(leaves)
    levels = build(rows, height)
    groups = ranked(subroots(levels).select(F.lit("").alias("g"), F.col("g").alias("o"), "digest"), "o")
    group_levels = build(groups, height)
    top = subroots(group_levels).first()
    return Manifest(rows, levels, groups, group_levels, top["digest"].hex() if top else None, height)


def verify(m: Manifest) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of each record.

    The proof is the digest of its siblings up to the root; the folded root comes from the tampered text, if there is one, and
    those siblings.
    """
    start = m.groups.select("g").limit(1).select("g", F.lit(None).cast("binary").alias("subroot"), F.array().cast(_PATH).alias("path"))
    lowest = _descend(m.group_levels, start, m.height)
    places = m.groups.select("g", "pos")
    found = _open(places, m.group_levels[0], lowest, m.height, leaves=False).select(F.col("block").alias("p"), "path")
    tops = materialised(m.groups.join(found, m.groups["pos"] == found["p"]).select(F.col("o").alias("g"), F.col("digest").alias("subroot"), "path"))
    proofs = _open(m.rows, m.levels[0], _descend(m.levels, tops, m.height), m.height, leaves=True)
    root = F.lit(m.root).cast("string")
    return proofs.select("doc_id", "leaf", "subroot", root.alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))
