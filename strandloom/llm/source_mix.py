"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots. Slot i maps the golden-ratio point ``frac((i + 1) * phi)`` through the cumulative targets
of the sources, so any stretch of the mix is close to the weights. The r-th slot of a source takes the r-th block of that
source's documents in shuffled order; the blocks of a source hold equally many words (to within one), and a source is
read again from its start, up to three times, when its target exceeds its size.

Sources are taken by code point, a null source last, with weights 1, 2, 3, 1, ...; together they get as many words as the
input has. Targets stop at three times a source's size and the excess goes to the others by weight.

Skew: sources are cut into 65,536 hash buckets, whose word counts are summed before anything is ordered, so a source with
a third of all rows is ordered bucket by bucket. What is sent to the driver or to all tasks has one row per source.

Defined cases: null texts have size 0 and are taken 0 words; equal rows are separate rows; an input without words gets an
empty schedule; a source whose target is less than one point of the schedule gets one slot at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialised, text_or_empty

GOLDEN = 0.6180339887498949
#: Slots of a schedule at most; a block has total words / SLOTS words.
SLOTS = 1 << 17
CYCLE = 3
MAX_REPEATS = 3
#: Sources up to which their small table is sent to all tasks.
BROADCAST_SOURCES = 50_000


@dataclass(frozen=True)
class Mix:
    """What ``mix`` returns: sized rows with target, and the pieces of the schedule."""

    rows: DataFrame
    pieces: DataFrame


def targets(sizes: list[int]) -> list[float]:
    """Target words of sources in order, by weights 1, 2, 3, ..., capped at three times their sizes."""
    weights = [i % CYCLE + 1 for i in range(len(sizes))]
    open_, left, out = set(range(len(sizes))), sum(sizes), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > MAX_REPEATS * sizes[i] * total}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(MAX_REPEATS * sizes[i])
        left -= sum(MAX_REPEATS * sizes[i] for i in over)
        open_ -= over
    return out


def _schedule(spark, quotas: list[int], n: int) -> DataFrame:
    """``slot, src, rank``: n low-discrepancy slots and one more for each source that they miss."""
    edges = np.cumsum(np.array(quotas, dtype=float)) / max(sum(quotas), 1)

    def pick(batches):
        for b in batches:
            u = np.modf((b["slot"].to_numpy() + 1) * GOLDEN)[0]
            src = np.searchsorted(edges, u, side="right")
            yield pd.DataFrame({"slot": b["slot"], "src": np.minimum(src, len(edges) - 1)})

    slots = spark.range(n).withColumnRenamed("id", "slot").mapInPandas(pick, "slot bigint, src int")
    hit = {r["src"] for r in slots.select("src").distinct().collect()}
    missed = [(n + j, i) for j, i in enumerate(i for i, q in enumerate(quotas) if q and i not in hit)]
    if missed:
        slots = slots.unionByName(spark.createDataFrame(missed, "slot bigint, src int"))
    # At most SLOTS rows and one per source are ordered here, whatever the input.
    return slots.withColumn("rank", (F.row_number().over(W.partitionBy("src").orderBy("slot")) - 1).cast("bigint"))


def mix(docs: DataFrame, slots: int = SLOTS) -> Mix:
    """Schedule ``docs`` (doc_id, text, source).

    ``rows``: src, bucket, pos (together the row's key), doc_id, source, size, source_size, target.
    ``pieces``: slot, the row's key and doc_id, first_word (0-based in the document) and n_words.
    """
    spark = docs.sparkSession
    sized = materialised(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("bigint").alias("size"))
    )
    per = [(r["source"], r["n"]) for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    per.sort(key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in per])
    quotas = [round(g) for g in goal]
    n_slots = min(slots, sum(quotas))
    scheduled = materialised(_schedule(spark, quotas, n_slots)) if n_slots else spark.createDataFrame([], "slot bigint, src int, rank bigint")
    counts = {r["src"]: r["n"] for r in scheduled.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
    info = spark.createDataFrame(
        [(s, i, n, g, q, counts.get(i, 0)) for i, ((s, n), g, q) in enumerate(zip(per, goal, quotas, strict=True))],
        "s_source string, src int, source_size bigint, target double, quota bigint, n_slots bigint",
    )
    info = F.broadcast(info) if len(per) <= BROADCAST_SOURCES else info
    known = sized.join(info, F.col("source").eqNullSafe(F.col("s_source"))).drop("s_source")
    shuffled = known.withColumn("key", F.md5(F.col("doc_id").cast("string"))).withColumn("bucket", F.coalesce(F.substring("key", 1, 4), F.lit("")))
    sums = shuffled.groupBy("src", "bucket").agg(F.sum("size").alias("n"))
    before = sums.select(
        "src", "bucket", (F.sum("n").over(W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before")
    )
    inside = W.partitionBy("src", "bucket").orderBy("key", "doc_id", "size")
    running = F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.col("size")
    placed = shuffled.withColumn("pos", F.row_number().over(inside)).withColumn("inside", running)
    rows = placed.join(before, ["src", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "key")
    rows = materialised(rows)

    # Each reading of a row within the source's quota, cut where blocks of the source end.
    turn = rows.where("size > 0 and quota > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1))))
    turn = turn.withColumn("a", F.col("turn") * F.col("source_size") + F.col("start")).where("a < quota")
    turn = turn.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("quota")))
    rank_of = "cast(({x} * n_slots - 1) div quota as bigint)"
    ranks = F.sequence(F.expr(rank_of.format(x="(a + 1)")), F.expr(rank_of.format(x="b")))
    cut = turn.withColumn("rank", F.explode(ranks))
    lo = F.greatest("a", F.expr("rank * quota div n_slots"))
    hi = F.least("b", F.expr("(rank + 1) * quota div n_slots"))
    parts = cut.withColumn("lo", lo).withColumn("n_words", hi - F.col("lo")).where("n_words > 0")
    pieces = parts.join(scheduled, ["src", "rank"]).select(
        "slot", "src", "bucket", "pos", "doc_id", (F.col("lo") - F.col("a")).alias("first_word"), "n_words"
    )
    return Mix(rows, pieces)


def taken(m: Mix) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``: one row per input row."""
    key = ["src", "bucket", "pos"]
    got = m.pieces.groupBy(*key).agg(F.sum("n_words").alias("taken"))
    return m.rows.join(got, key, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken")
    )
