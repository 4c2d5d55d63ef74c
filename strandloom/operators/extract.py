"""From sequences to k-mers: one Generate per step, all inside whole-stage codegen.

Only upper-case A, C, G and T are bases; anything else (lower case, N, ``\\r``) ends a run. Windows never cross a run
or a read. Null or empty sequences emit nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec

NOT_BASE = "[^ACGT]+"
#: Windows per tile of a run; ``substring`` rescans its string, so long runs are cut before windows are taken.
TILE = 1024
#: Windows of a task after ``spread``, about.
WINDOWS = 1 << 20


def base_validity(df: DataFrame, seq: str, *keep: str) -> DataFrame:
    """Count valid and invalid characters of each sequence."""
    total = F.length(F.coalesce(F.col(seq), F.lit("")))
    valid = F.length(F.regexp_replace(F.coalesce(F.col(seq), F.lit("")), NOT_BASE, ""))
    return df.select(*keep, valid.cast("bigint").alias("n_valid"), (total - valid).cast("bigint").alias("n_invalid"))


def valid_runs(df: DataFrame, seq: str, *keep: str, min_length: int = 1) -> DataFrame:
    """``keep..., run_no bigint, run``: maximal runs of bases of ``min_length`` or more; run_no counts kept and dropped pieces."""
    runs = df.select(*keep, F.posexplode(F.split(F.col(seq), NOT_BASE)).alias("run_no", "run"))
    return runs.where(F.length("run") >= min_length).withColumn("run_no", F.col("run_no").cast("bigint"))


def tiles(runs: DataFrame, k: int, *keep: str, size: int = TILE) -> DataFrame:
    """``keep..., tile_start, tile``: pieces of ``run`` that overlap by k - 1 letters, so that each window lies in one."""
    starts = F.explode(F.sequence(F.lit(1), F.length("run") - F.lit(k) + 1, F.lit(size))).alias("tile_start")
    cut = runs.select(*keep, "run", starts)
    return cut.select(*keep, "tile_start", F.substring(F.col("run"), F.col("tile_start"), F.lit(size + k - 1)).alias("tile"))


def tasks_of(df: DataFrame, seq: str, k: int, size: int | None = None) -> int:
    """Tasks of about ``size`` windows each that the sequences need: they are read once more to count their windows. One for a stream."""
    if df.isStreaming:
        return 1
    n = df.agg(F.sum(codec.windows_bound(F.col(seq), k))).first()[0] or 0
    return max(1, -(-n // (size or WINDOWS)))


def spread(df: DataFrame, seq: str, k: int, *by: str, size: int | None = None) -> DataFrame:
    """The same rows, dealt out (by columns, if any are named) so that a task makes about ``size`` windows.

    Sequences are small beside their windows, so a table of few bytes has few tasks, each with far more windows than its memory
    takes. The windows are counted first, which reads the table once more. A stream is left as it is.
    """
    tasks = tasks_of(df, seq, k, size)
    return df.repartition(tasks, *by) if tasks > 1 else df


def kmer_positions(df: DataFrame, seq: str, k: int, *keep: str) -> DataFrame:
    """``keep..., run_no, pos bigint (1-based in the run), kmer`` for every valid window."""
    if k < 1:
        raise ValueError(f"k must be 1 or more, not {k}")
    cut = tiles(valid_runs(df, seq, *keep, min_length=k), k, *keep, "run_no")
    at = cut.select("*", F.explode(F.sequence(F.lit(1), F.length("tile") - F.lit(k) + 1)).alias("p"))
    return at.select(
        *keep,
        "run_no",
        (F.col("tile_start") + F.col("p") - 1).cast("bigint").alias("pos"),
        F.substring(F.col("tile"), F.col("p"), F.lit(k)).alias("kmer"),
    )


def extract_kmers(df: DataFrame, seq: str, k: int) -> DataFrame:
    """``kmer``: one row for every valid window of every sequence."""
    return kmer_positions(df, seq, k).select("kmer")


def is_kmer(col: Column) -> Column:
    """Whether a string holds bases only; ``\\z`` because Java's ``$`` also matches before a final newline."""
    return col.rlike("\\A[ACGT]+\\z")
