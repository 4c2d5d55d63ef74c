"""Distinct k-mers without counting them: sketches that add up.

A HyperLogLog sketch of a file's windows takes ``2 ** size`` bytes or less and is made in the scan's stage. Sketches of files, folders
or days are stored and merged; nothing is read again for a union. The standard error is ``1.04 / 2 ** (size / 2)``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .packed import packed_windows, word_names

SIZE = 14


def standard_error(size: int = SIZE) -> float:
    return 1.04 / 2 ** (size / 2)


def sketch_kmers(df: DataFrame, seq: str, k: int, *by: str, size: int = SIZE) -> DataFrame:
    """``by..., sketch, n_total``: a sketch of the windows of each group, and how many there are."""
    windows = packed_windows(df, seq, k, *by)
    key = F.col("w0") if k <= 32 else F.xxhash64(*word_names(k))
    return windows.groupBy(*by).agg(F.hll_sketch_agg(key, size).alias("sketch"), F.count(F.lit(1)).alias("n_total"))


def merge_sketches(*tables: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``by..., sketch, n_total`` of all rows of tables of sketches of the same k."""
    rows = reduce(DataFrame.unionByName, [t.select(*by, "sketch", "n_total") for t in tables])
    return rows.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.coalesce(F.sum("n_total"), F.lit(0)).cast("bigint").alias("n_total"))


def estimate(sketch: str = "sketch") -> Column:
    """The number of distinct k-mers that a sketch stands for."""
    return F.hll_sketch_estimate(sketch)
