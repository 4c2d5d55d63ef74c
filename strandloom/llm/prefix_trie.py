"""Conversation prefix trie by time-forward processing.

A node stands for a distinct sequence of first turns; its name is a 128-bit hash chained over the turns' digests. Conversations
with the same turns are one path. Paths are sorted by their chains, which is the trie's depth-first order, and cut into shards
by one range exchange; a node belongs to the shard of its first path. Then

1. within a shard, nodes are sorted in reverse level order by Spark's external sort and streamed: a node takes the totals
   that its children have sent from a priority queue, which spills sorted runs, and sends its own to its parent. What is
   addressed to another shard leaves, summed by addressee. As a shard is a stretch of the depth-first order, all its
   addressees are ancestors of its first node: there are about as many as levels, however many children a node has;
2. across shards, the addressees form a tree themselves, whose totals are found in the same way, with ``MERGE`` shards in one,
   until nothing leaves a shard;
3. within shards again, with the totals from other shards in the queue, every node gets its own.

So no task sees more than a shard or the rows of one conversation, as a stream, and hot nodes (the root, a first turn that all
share) get one message from each shard. The lists of conversations that end at a node are written by range partitions in
chunks of ``CHUNK`` ids, and a node's digest streams over its chunks.

Results do not depend on shards. ``LEVELS`` levels of a path order it; beyond them, paths are cut into shards by hash, which
costs more messages. A queue spills to an unnamed file that only its task sees and that is gone when the task ends, as
Spark's own sorts do.

Defined cases: rows are ordered by turn (null first), then role and text, so ties and repeated rows have an order; null roles
and texts are empty; rows without a conversation id belong to no conversation and make no node; an empty table has no nodes;
long texts are hashed where they are read; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_table, materialised

ROOT = b"\0" * 16
#: Nodes of a shard, on average; shards that are one shard at the next level; messages that a queue holds in memory.
SHARD, MERGE, ROOM = 8192, 64, 1 << 17
LEVELS = 64
CHUNK = 4096
_OUT = 4096
_PART_BITS = 33  # of monotonically_increasing_id


class SpillingQueue:
    """A priority queue of tuples; beyond ``room`` items, those in memory are written as a sorted run."""

    def __init__(self, room: int = ROOM):
        self.room, self.heap, self.runs = room, [], []

    @staticmethod
    def _read(file):
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                file.close()
                return

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.room:
            file = tempfile.TemporaryFile()
            for x in sorted(self.heap):
                pickle.dump(x, file)
            file.seek(0)
            self.heap = []
            self._next(self._read(file), len(self.runs))

    def _next(self, run, i: int) -> None:
        head = next(run, None)
        if head is not None:
            heapq.heappush(self.runs, (head, i, run))

    def top(self) -> tuple | None:
        heads = [q[0] for q in (self.heap,) if q] + [q[0][0] for q in (self.runs,) if q]
        return min(heads, default=None)

    def pop(self) -> tuple:
        if self.runs and (not self.heap or self.runs[0][0] < self.heap[0]):
            head, i, run = heapq.heappop(self.runs)
            self._next(run, i)
            return head
        return heapq.heappop(self.heap)


def turns(rows: DataFrame) -> DataFrame:
    """``conv_id, t, x, n_bytes``: a conversation's turns numbered from 1, their digests and the bytes of their texts."""
    kept = rows.where("conv_id is not null").select("conv_id", "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    t = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).cast("bigint")
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return kept.select("conv_id", t.alias("t"), F.unhex(F.md5(both)).alias("x"), F.octet_length("text").cast("bigint").alias("n_bytes"))


def branched(rows: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """``conv_id, depth, x, n_bytes, size`` of conversations rebuilt as branches of every fifth one.

    Conversation c has the first h turns of ``c - c % every`` and then its own after its first h, with
    ``h = crc32(c) % most``. Depth 0 is a row of every conversation; size is its number of turns.
    """
    rows = materialised(rows)
    per = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % every
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    own = per.select("conv_id", "n", base.alias("base"), h.alias("h"))
    head = own.join(per.select(F.col("conv_id").alias("b"), F.col("n").alias("nb")), F.col("base") == F.col("b"), "left")
    taken = F.least("h", F.coalesce("nb", F.lit(0)))
    head = materialised(head.select("conv_id", "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("size")))
    t = rows.select(F.col("conv_id").alias("of"), "t", "x", "n_bytes")
    first = head.join(t.where(F.col("t") < most), (F.col("base") == F.col("of")) & (F.col("t") <= F.col("taken"))).select("conv_id", F.col("t").alias("depth"), "x", "n_bytes", "size")
    rest = head.join(t, (F.col("conv_id") == F.col("of")) & (F.col("t") > F.col("h"))).select("conv_id", (F.col("taken") + F.col("t") - F.col("h")).alias("depth"), "x", "n_bytes", "size")
    return first.unionByName(rest).unionByName(_roots(head))


def _roots(head: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return head.select("conv_id", zero.alias("depth"), F.lit(None).cast("binary").alias("x"), zero.alias("n_bytes"), "size")


def whole(rows: DataFrame) -> DataFrame:
    """``branched``'s columns for conversations as they are."""
    rows = materialised(rows)
    per = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    met = rows.join(per.select(F.col("conv_id").alias("of"), "size"), F.col("conv_id") == F.col("of"))
    return met.select("conv_id", F.col("t").alias("depth"), "x", "n_bytes", "size").unionByName(_roots(per))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _stream(df: DataFrame, fn, ddl: str) -> DataFrame:
    """``fn(iterator of row tuples) -> iterator of row tuples`` over each partition, in Arrow batches."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches):
        held = []
        for row in fn(r for b in batches for r in zip(*[c.to_pylist() for c in b.columns])):
            held.append(row)
            if len(held) >= _OUT:
                yield _table(held, schema)
                held = []
        if held:
            yield _table(held, schema)

    return df.mapInArrow(run, ddl)


def _chained(rows: DataFrame) -> DataFrame:
    """``conv_id, depth, key, parent, n_bytes, size, label``; label, a path's place in depth-first order, only at its end."""

    def chain(rows):
        key = label = ROOT
        for conv_id, depth, x, n_bytes, size in rows:
            if depth:
                parent, key = key, hashlib.blake2b(key + x, digest_size=16).digest()
                label += key[:8] if len(label) < 8 * LEVELS else b""
            else:
                parent, key, label = None, ROOT, b""
            yield conv_id, depth, key, parent, n_bytes, size, label if depth == size else None

    at = rows.repartition("conv_id").sortWithinPartitions("conv_id", "depth").select("conv_id", "depth", "x", "n_bytes", "size")
    return _stream(at, chain, "conv_id bigint, depth bigint, key binary, parent binary, n_bytes bigint, size bigint, label binary")


def _paths(ends: DataFrame, shard: int) -> DataFrame:
    """``one, copies, rank``: each distinct path by one of its conversations; the high bits of its rank are its shard."""
    same = ends.groupBy("key").agg(F.min("conv_id").alias("one"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("size").alias("size"))
    same = materialised(same)
    nodes = same.agg(F.sum(F.col("size") + 1)).first()[0] or 0
    cut = same.repartitionByRange(max(1, -(-nodes // shard)), "label", "key").sortWithinPartitions("label", "key")
    out = materialised(cut.select("one", "copies", F.monotonically_increasing_id().alias("rank")))
    drop_table(same)
    return out


def _nodes(chained: DataFrame, paths: DataFrame) -> DataFrame:
    """One row for every node: ``key, parent, depth, up, conv_id, n_convs, leaves, saved, shard``, with what is its own of the totals."""
    met = chained.join(paths, chained["conv_id"] == paths["one"])
    same = [F.first(c).alias(c) for c in ("parent", "depth", "n_bytes")]
    each = met.groupBy("key").agg(*same, F.sum("copies").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.min("rank").alias("rank"))
    return each.select(
        "key", "parent", "depth", (F.col("depth") - 1).alias("up"), "conv_id", "n_convs", (F.col("size") == F.col("depth")).cast("bigint").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), F.shiftright("rank", _PART_BITS).alias("shard"),
    )


_IN = ("shard", "depth", "key", "kind", "parent", "up", "conv_id", "leaves", "saved", "children")


def _in_order(rows: DataFrame) -> DataFrame:
    """Shards in reverse level order; at a node, what is known of it from other shards comes first."""
    return rows.repartition("shard").sortWithinPartitions("shard", F.desc("depth"), "key", F.desc("kind")).select(*_IN)


def _shards(rows):
    """Streams of one shard each."""
    row, end = next(rows, None), None

    def one(shard):
        nonlocal row
        while row is not None and row[0] == shard:
            yield row
            row = next(rows, end)

    while row is not None:
        shard = row[0]
        yield shard, one(shard)


def _forward(rows, room: int, sent):
    """Time-forward pass of one shard: yields its nodes with their totals; ``sent`` gets what is addressed elsewhere."""
    queue = SpillingQueue(room)

    def leave(until):
        while (x := queue.top()) is not None and (until is None or x[:2] < until):
            sent(queue.pop())

    for _, depth, key, kind, parent, up, conv_id, leaves, saved, children in rows:
        if kind:  # 1: what other shards send to this node; 2: who a parent elsewhere is
            if kind == 1:
                queue.push((-depth, key, leaves, saved, children))
            else:
                yield kind, depth, key, parent, up, conv_id, 0, 0, 0
            continue
        here = (-depth, key)
        leave(here)
        children = 0
        while (x := queue.top()) is not None and x[:2] == here:
            _, _, a, b, c = queue.pop()
            leaves, saved, children = leaves + a, saved + b, children + c
        if parent is not None:
            queue.push((-up, parent, leaves, saved, 1))
        yield kind, depth, key, parent, up, conv_id, leaves, saved, children
    leave(None)


def _sums(rows: DataFrame, room: int) -> tuple[DataFrame, DataFrame]:
    """``(messages, ups)``: what each shard sends to nodes elsewhere, and where what reaches a node leaves its shard."""

    def run(rows):
        for shard, stream in _shards(rows):
            out: dict[bytes, list] = {}

            def sent(x, out=out):
                at = out.setdefault(x[1], [-x[0], 0, 0, 0])
                for i in (1, 2, 3):
                    at[i] += x[i + 1]

            seen = [(key, parent, up) for _, _, key, parent, up, *_ in _forward(stream, room, sent)]
            for key, (depth, *totals) in out.items():
                yield shard, key, None, depth, *totals
            leaves: dict[bytes, tuple] = {}
            for key, parent, up in reversed(seen):  # parents first
                leaves[key] = leaves.get(parent, (parent, up))
                if leaves[key][0] is not None:
                    yield shard, key, *leaves[key], None, None, None

    ddl = "shard bigint, key binary, parent binary, up bigint, leaves bigint, saved bigint, children bigint"
    both = materialised(_stream(_in_order(rows), run, ddl))
    messages = both.where("leaves is not null").select("shard", "key", F.col("up").alias("depth"), "leaves", "saved", "children")
    return messages, both.where("leaves is null").select("key", "parent", "up")


def totals(nodes: DataFrame, room: int = ROOM, merge: int = MERGE) -> DataFrame:
    """``key, depth, conv_id, parent_conv_id, n_children, n_leaves, saved`` of ``key, parent, depth, up, conv_id, leaves, saved, shard``.

    ``up`` is the parent's depth; parents are nodes, or null.
    """
    none = F.lit(None)
    own = nodes.select("shard", "depth", "key", F.lit(0).alias("kind"), "parent", "up", "conv_id", "leaves", "saved", F.lit(0).cast("bigint").alias("children"))
    messages, ups = _sums(own, room)
    direct = materialised(messages.groupBy("key").agg(*[F.sum(c).alias(c) for c in ("leaves", "saved", "children")]))
    known = own
    if not direct.isEmpty():
        home = nodes.select(F.col("key").alias("k"), "depth", "conv_id", "shard")
        at = direct.join(home, direct["key"] == home["k"]).drop("k")
        leaving = ups.select(F.col("key").alias("k"), "parent", "up")
        ports = materialised(at.join(leaving, at["key"] == leaving["k"], "left").drop("k"))
        above = totals(ports.withColumn("shard", F.floor(F.col("shard") / merge).cast("bigint")), room, merge)
        full = above.select(F.col("key").alias("k"), "n_leaves", F.col("saved").alias("all"))
        arrived = ports.join(full, ports["key"] == full["k"]).select(
            "shard", "depth", "key", F.lit(1).alias("kind"), none.cast("binary").alias("parent"), none.cast("bigint").alias("up"), "conv_id",
            F.col("n_leaves").alias("leaves"), F.col("all").alias("saved"), "children",
        )
        who = ports.select(F.col("key").alias("k"), "conv_id")
        parents = messages.join(who, messages["key"] == who["k"]).select(
            "shard", "depth", "key", F.lit(2).alias("kind"), none.cast("binary").alias("parent"), none.cast("bigint").alias("up"), "conv_id",
            "leaves", "saved", "children",
        )
        known = own.unionByName(arrived).unionByName(parents)

    def run(rows):
        for _, stream in _shards(rows):
            seen = list(_forward(stream, room, lambda x: None))
            who = {key: conv_id for _, _, key, _, _, conv_id, *_ in seen}
            for kind, depth, key, parent, _, conv_id, leaves, saved, children in seen:
                if not kind:
                    yield key, depth, conv_id, who.get(parent), children, leaves, saved

    return materialised(_stream(_in_order(known), run, "key binary, depth bigint, conv_id bigint, parent_conv_id bigint, n_children bigint, n_leaves bigint, saved bigint"))


def _ends(ends: DataFrame) -> DataFrame:
    """``end, ends_sha256``: the digest of the ascending ids of the conversations that end at a node."""

    def chunks(rows):
        part, at = TaskContext.get().partitionId(), 0
        key, ids = None, []
        for k, conv_id in rows:
            if ids and (k != key or len(ids) == CHUNK):
                yield key, part, at, ",".join(ids)
                ids, at = [], at + 1
            key = k
            ids.append(str(conv_id))
        if ids:
            yield key, part, at, ",".join(ids)

    def digests(rows):
        key, h = None, None
        for k, _, _, ids in rows:
            if k != key:
                if h:
                    yield key, h.hexdigest()
                key, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(ids.encode())
        if h:
            yield key, h.hexdigest()

    dealt = ends.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    lists = _stream(dealt, chunks, "key binary, part int, at bigint, ids string")
    return _stream(lists.repartition("key").sortWithinPartitions("key", "part", "at"), digests, "end binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, shard: int = SHARD, room: int = ROOM, merge: int = MERGE) -> DataFrame:
    """The nodes of the trie of ``branched`` or ``whole`` conversations.

    ``conv_id`` is the smallest conversation that starts with the node's turns and ``parent_conv_id`` that of its parent;
    ``n_convs`` counts them, ``n_children`` and ``n_leaves`` count nodes, ``saved_tokens`` sums, over the node's subtree, the
    bytes of last texts that conversations share with an earlier one, and ``ends_sha256`` names those that end here.
    """
    chained = materialised(_chained(rows))
    ends = chained.where("label is not null")
    paths = _paths(ends, shard)
    nodes = materialised(_nodes(chained, paths))
    found = totals(nodes, room, merge)
    whole = found.join(nodes.select(F.col("key").alias("k"), "n_convs"), F.col("key") == F.col("k"))
    listed = whole.join(_ends(ends), F.col("key") == F.col("end"), "left")
    none: Column = F.sha2(F.lit("").cast("binary"), 256)
    return listed.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", none).alias("ends_sha256")
    )
