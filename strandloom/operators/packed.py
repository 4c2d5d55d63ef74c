"""Windows as packed words: the keys of a count are ``bigint`` columns from the window on, never strings.

A tile of a run is packed once into 64-bit words, 32 bases each; a window's words are then cut out of the tile's by shifts. So
a window costs a few integer operations whatever k is, the aggregation has fixed-width keys, and a row of the shuffle
holds ``8 * ceil(k / 32)`` key bytes in place of k. Words are kept as signed integers with the bits of the packed format; all of it
runs inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec
from .extract import WINDOWS, tasks_of, tiles, valid_runs

#: Windows of a packed tile.
PACKED_TILE = 128


def word_names(k: int) -> list[str]:
    return [f"w{i}" for i in range(codec.n_words(k))]


def _tile_words(tile: Column, n: int) -> Column:
    """The n words of a tile, and a zero; words past the tile's end are zero."""
    size = codec.BASES_PER_WORD
    words = [F.when(F.length(tile) > size * i, codec.pack(F.substring(tile, size * i + 1, size))).otherwise(F.lit(0).cast("bigint")) for i in range(n)]
    return F.array(*words, F.lit(0).cast("bigint"))


def _cut(words: Column, first: Column, k: int) -> list[Column]:
    """The words of the window that starts at base ``first`` (from 0) of a packed tile."""
    size, out = codec.BASES_PER_WORD, []
    at, bits = F.shiftright(first, 5), F.shiftleft(F.col("p").bitwiseAND(F.lit(size - 1)), 1)
    for i in range(codec.n_words(k)):
        # Two shifts on the right: a shift by 64 would be one by 0.
        low = F.call_function("shiftrightunsigned", F.shiftrightunsigned(F.get(words, at + i + 1), 1), F.lit(2 * size - 1) - bits)
        word = F.call_function("shiftleft", F.get(words, at + i), bits).bitwiseOR(low)
        left = min(size, k - size * i)
        mask = -1 << 2 * (size - left)
        out.append(word if left == size else word.bitwiseAND(F.lit(mask).cast("bigint")))
    return out


def packed_windows(df: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """``keep..., w0, w1, ...``: the words of every valid window, as ``extract.kmer_positions`` finds them."""
    return _windows(tiles(valid_runs(df, seq, *keep, min_length=k), k, *keep), k, *keep)


def _windows(long: DataFrame, k: int, *keep: str) -> DataFrame:
    names = word_names(k)
    short = tiles(long.withColumnRenamed("tile", "run"), k, *keep, size=PACKED_TILE)
    n = -(-(PACKED_TILE + k - 1) // codec.BASES_PER_WORD)
    packed = short.select(*keep, (F.length("tile") - k).alias("last"), _tile_words(F.col("tile"), n).alias("tile_words"))
    at = packed.select(*keep, "tile_words", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("p"))
    return at.select(*keep, *[w.alias(c) for c, w in zip(names, _cut(F.col("tile_words"), F.col("p"), k), strict=True)])


def count_packed(df: DataFrame, seq: str, k: int) -> DataFrame:
    """``w0, w1, ..., cnt bigint``: counts of all windows under packed keys."""
    names = word_names(k)
    # Few keys stay few in a task's table, however much it reads.
    tasks = 1 if 4**k <= WINDOWS else tasks_of(df, seq, k)
    if tasks == 1:
        return packed_windows(df, seq, k).groupBy(*names).agg(F.count(F.lit(1)).alias("cnt"))
    parts = task_counts(df, seq, k, tasks).repartition(tasks, *names)
    return parts.groupBy(*names).agg(F.sum("cnt").cast("bigint").alias("cnt"))


def task_counts(df: DataFrame, seq: str, k: int, tasks: int) -> DataFrame:
    """``w0, w1, ..., cnt``: the counts of each of so many tasks, to be summed by key.

    A caller's exchange then has as many partitions as the windows need, where that of a plain aggregation has
    ``spark.sql.shuffle.partitions``, whatever the number of keys. Reads are dealt out first, so that copies of one read part;
    then their pieces, since a read may be long. A piece's task is known from what it holds and where it lies, so that a repeated task deals
    alike; Spark knows that a task's keys are in one place, so nothing is shuffled between windows and counts.
    """
    runs = valid_runs(df.repartition(tasks), seq, min_length=k)
    pieces = tiles(runs, k, "run_no")
    task = F.pmod(F.xxhash64("tile", "tile_start", "run_no", F.spark_partition_id()), F.lit(tasks)).cast("int")
    dealt = pieces.select("tile", task.alias("_task")).repartitionById(tasks, "_task")
    names = word_names(k)
    return _windows(dealt, k, "_task").groupBy("_task", *names).agg(F.count(F.lit(1)).alias("cnt")).drop("_task")


def merge_packed_counts(*tables: DataFrame) -> DataFrame:
    """Sum the counts of equal packed keys; all tables have the same words."""
    rows = tables[0]
    for t in tables[1:]:
        rows = rows.unionByName(t)
    return rows.groupBy(*[c for c in rows.columns if c != "cnt"]).agg(F.sum("cnt").cast("bigint").alias("cnt"))


def unpacked(counts: DataFrame, k: int) -> DataFrame:
    """``kmer string`` in place of the words."""
    letters = [codec.word_letters(F.col(w)) for w in word_names(k)]
    rest = [c for c in counts.columns if c not in word_names(k)]
    return counts.select(F.substring(F.concat(*letters), 1, k).alias("kmer"), *rest)


def order_of(k: int) -> list[Column]:
    """Sort keys that put packed words in the order of their letters: words are unsigned, so the sign bit is turned."""
    return [F.col(w).bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")) for w in word_names(k)]
