"""Removal of 200-byte strings that occur more than once, by sampled suffixes.

Every window of ``WINDOW`` bytes selects one suffix start inside itself, its anchor: the place of the smallest hash of
``GRAM`` bytes. The choice depends on the window's bytes alone, so equal windows select equal anchors at equal distances,
and about one position in 85 is an anchor. Only anchors are shuffled, as fixed-size tuples; what holds for the windows is
induced from them: windows before an anchor share its context (the bytes from the first to the end of the last window that
chose it).

1. Anchors whose gram occurs at no other place have no repeated window and end here.
2. Anchors whose whole context occurs elsewhere have repeated windows only.
3. Where one gram has different contexts, one copy of each context is brought together, externally sorted by gram, and
   windows are compared inside.

Equal texts are one class; a text that occurs twice and has ``WINDOW`` bytes is removed whole. All grouping is by hash
with map-side combination (smallest and largest place of a gram), so a gram or context that a third of all documents
share sends a few rows per task. A gram with more than ``GROUP`` different contexts is resolved by a shuffle on the
windows' hashes instead of in one task.

Equality is that of 64-bit hashes. Defined cases: null texts are empty; texts of fewer than ``WINDOW`` bytes lose
nothing; ids may repeat or be null; windows never cross texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, materialised, text_or_empty
from .words import mixed

WINDOW = 200
GRAM = 32
#: Different contexts of one gram that one task compares; a context has up to 369 bytes.
GROUP = 100_000
_U = np.uint64
_PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15
_BYTE = np.random.default_rng(33).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict = {}


def rolling(a: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all substrings of ``size`` bytes."""
    n = len(a) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if _powers.get("n", 0) < len(a) + 1:
        m = max(len(a) + 1, 1 << 16)
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(m, _U(base))
                p[0] = 1
                _powers[name] = np.cumprod(p)
        _powers["n"] = m
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[a] * _powers["up"][: len(a)])])
        return mixed((sums[size:] - sums[:-size]) * _powers["down"][:n])


def sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours: prefix and suffix minima of blocks of that width."""
    n = len(v) - width + 1
    padded = np.full(-(-len(v) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram, context, first, count) of each anchor: hashes, first window that chose it, number of windows."""
    out = []
    for s in range(0, max(len(data) - WINDOW + 1, 0), _PIECE):
        a = np.frombuffer(data, np.uint8)[s : s + _PIECE + WINDOW - 1]
        gram = rolling(a, GRAM)
        place = (gram & ~_U((1 << 20) - 1)) | np.arange(len(gram), dtype=np.uint64)
        at = (sliding_min(place, WINDOW - GRAM + 1) & _U((1 << 20) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        count = np.diff(np.append(first, len(at)))
        # The context's hash: its first and last window and what is between them.
        window = rolling(a, WINDOW)
        last = first + count - 1
        with np.errstate(over="ignore"):
            context = mixed(window[first] * _U(3) + window[last] * _U(5) + count.astype(np.uint64) * _U(7) + (at[first] - first).astype(np.uint64))
        out.append((gram[at[first]], context, first + s, count))
    if not out:
        e = np.empty(0, np.int64)
        return e.astype(np.uint64), e.astype(np.uint64), e, e
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _anchor_rows(texts: DataFrame) -> DataFrame:
    """``gram, context, cls, first, count, place``; place names (cls, first)."""
    fields = [("gram", pa.int64()), ("context", pa.int64()), ("cls", pa.int64()), ("first", pa.int64()), ("count", pa.int32()), ("place", pa.int64())]
    schema = pa.schema(fields)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = []
                for cls, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    g, c, f, n = anchors(text.encode("utf-8", "surrogatepass"))
                    if len(g):
                        with np.errstate(over="ignore"):
                            place = mixed(f.astype(np.uint64) + _U(cls & (1 << 64) - 1))
                        got.append((g.view(np.int64), c.view(np.int64), np.full(len(g), cls), f, n.astype(np.int32), place.view(np.int64)))
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t.type) for x, t in zip(zip(*got), schema)], schema=schema)

    return texts.select("cls", "text").mapInArrow(run, "gram bigint, context bigint, cls bigint, first bigint, count int, place bigint")


def _packed(docs: DataFrame) -> DataFrame:
    """``doc_id, cls, z``: texts compressed before they are shuffled."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(doc_id, cls, text):
        yield doc_id, cls, zstandard.ZstdCompressor(level=3).compress(text.encode("utf-8", "surrogatepass"))

    return map_rows(docs, ["doc_id", "cls", "text"], one, f"doc_id {kind}, cls bigint, z binary")


def unpacked(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def _contexts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram, context, many, body`` for the wanted contexts (cls, asked: array of context and many), each from one text."""
    one_row = docs.groupBy("cls").agg(F.min("doc_id").alias("one_id"))
    asked = wanted.join(one_row, "cls").select(F.col("cls").alias("w_cls"), "one_id", "asked")
    text = _packed(docs)
    met = text.join(asked, (F.col("cls") == F.col("w_cls")) & F.col("doc_id").eqNullSafe(F.col("one_id"))).select("z", "asked")

    def one(z, asked):
        data = unpacked(z)
        many = {x["context"]: x["many"] for x in asked}
        g, c, f, n = anchors(data)
        for gram, context, first, count in zip(g.view(np.int64).tolist(), c.view(np.int64).tolist(), f.tolist(), n.tolist(), strict=True):
            if (m := many.pop(context, None)) is not None:
                yield gram, context, m, data[first : first + count + WINDOW - 1]

    return map_rows(met, ["z", "asked"], one, "gram bigint, context bigint, many boolean, body binary")


def _window_hashes(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, body number, offset) of every window of the bodies."""
    sizes = np.array([len(x) for x in bodies])
    h = rolling(np.frombuffer(b"".join(bodies), np.uint8), WINDOW)
    counts = sizes - WINDOW + 1
    who = np.repeat(np.arange(len(bodies)), counts)
    offset = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    start = np.cumsum(sizes) - sizes
    return h[start[who] + offset], who, offset


def _runs(flags: np.ndarray) -> list[dict]:
    """Maximal runs of true values as start and end (exclusive)."""
    edge = np.flatnonzero(np.diff(flags, prepend=False, append=False))
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2])]


def _resolve(batches):
    """Rows sorted by gram: repeated windows of each context; groups over GROUP leave as single windows."""

    def solve(rows: list[tuple]) -> pd.DataFrame:
        h, who, offset = _window_hashes([r[3] for r in rows])
        weight = np.array([2 if r[2] else 1 for r in rows])[who]
        _, back = np.unique(h, return_inverse=True)
        dup = np.bincount(back, weight)[back] > 1
        ends = np.searchsorted(who, np.arange(len(rows) + 1))
        found = [(rows[i][1], _runs(dup[ends[i] : ends[i + 1]]), None, None, False) for i in range(len(rows))]
        return pd.DataFrame([x for x in found if x[1]], columns=COLUMNS)

    def single(rows: list[tuple]) -> pd.DataFrame:
        h, who, offset = _window_hashes([r[3] for r in rows])
        ids, many = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        return pd.DataFrame({"context": ids[who], "runs": None, "h": h.view(np.int64), "offset": offset, "many": many[who]}, columns=COLUMNS)

    held: list[tuple] = []  # whole groups and the open one
    group, start, large = None, 0, False
    for b in batches:
        for row in zip(b["gram"], b["context"], b["many"], b["body"], strict=True):
            if row[0] != group:
                if large:
                    yield single(held)
                    held, large = [], False
                elif len(held) >= 4096:
                    yield solve(held)
                    held = []
                group, start = row[0], len(held)
            held.append(row)
            if len(held) - start > GROUP or large and len(held) >= 4096:
                if start:
                    yield solve(held[:start])
                yield single(held[start:])
                held, start, large = [], 0, True
    if held:
        yield single(held) if large else solve(held)


COLUMNS = ["context", "runs", "h", "offset", "many"]
_RUNS = "array<struct<lo:int,hi:int>>"


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``cls, runs``: runs of repeated windows (first and end start positions) in the texts of each class.

    ``docs`` has doc_id, cls and text. Repeats between rows of one class are not looked at.
    """
    rows = _anchor_rows(docs)
    grams = rows.groupBy("gram").agg(
        F.min("place").alias("p0"), F.max("place").alias("p1"), F.min("context").alias("c0"), F.max("context").alias("c1")
    )
    # Written, so that both sides of the join come from an exchange; only then are hot partitions split.
    again = materialised(grams.where("p0 <> p1").select("gram", (F.col("c0") != F.col("c1")).alias("mixed")))
    found = materialised(rows.join(again, "gram").select("gram", "context", "cls", "first", "count", "place", "mixed"))
    contexts = found.where("mixed").groupBy("gram", "context").agg(
        F.min("cls").alias("cls"), (F.min("place") != F.max("place")).alias("many")
    )
    wanted = contexts.groupBy("cls").agg(F.collect_list(F.struct("context", "many")).alias("asked"))  # a text's own contexts
    bodies = _contexts(docs, wanted).repartition("gram").sortWithinPartitions("gram")
    solved = materialised(bodies.mapInPandas(_resolve, f"context bigint, runs {_RUNS}, h bigint, offset int, many boolean"))
    windows = solved.where("h is not null")
    often = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("m")).where("n > 1 or m").select("h")
    large = windows.join(often, "h", "left_semi").groupBy("context").agg(
        F.collect_list(F.struct(F.col("offset").alias("lo"), (F.col("offset") + 1).alias("hi"))).alias("runs")
    )  # a context has 169 windows at most
    runs = solved.where("runs is not null").select("context", "runs").unionByName(large)
    whole = found.where("not mixed").select("cls", "first", F.array(F.struct(F.lit(0).alias("lo"), F.col("count").alias("hi"))).alias("runs"))
    part = found.where("mixed").join(runs, "context").select("cls", "first", "runs")
    moved = F.transform("runs", lambda r: F.struct((F.col("first") + r["lo"]).alias("lo"), (F.col("first") + r["hi"]).alias("hi")))
    per = whole.unionByName(part).select("cls", F.explode(moved).alias("run")).distinct()
    return per.groupBy("cls").agg(F.collect_list("run").alias("runs"))  # a text's own runs


def cut(data: bytes, runs: list) -> tuple[bytes, int]:
    """What is left without the bytes of the windows in ``runs``, and the number of maximal removed runs."""
    if not runs:
        return data, 0
    gone = np.zeros(len(data) + 1, np.int64)
    for r in runs:
        gone[r["lo"]] += 1
        gone[r["hi"] + WINDOW - 1] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), len(_runs(gone))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_spans, kept`` for every row of ``docs`` (doc_id, text); kept is what is left, as bytes."""
    named = docs.select("doc_id", text_or_empty().alias("text")).withColumn("cls", F.xxhash64("text"))
    size = named.groupBy("cls").agg((F.count(F.lit(1)) > 1).alias("copied"))
    runs = repeated_windows(named)
    known = size.where("copied").join(runs, "cls", "full").select(F.col("cls").alias("k_cls"), F.coalesce("copied", F.lit(False)).alias("copied"), "runs")
    met = _packed(named).join(known, F.col("cls") == F.col("k_cls"), "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def one(doc_id, z, copied, runs):
        data = unpacked(z)
        if copied and len(data) >= WINDOW:
            yield doc_id, len(data), 1, b""
        else:
            kept, n = cut(data, [] if copied else runs or [])
            yield doc_id, len(data), n, kept

    return map_rows(met, ["doc_id", "z", "copied", "runs"], one, f"doc_id {kind}, n_bytes bigint, n_spans bigint, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    """The contract's columns."""
    return removed.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"), "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"),
    )
