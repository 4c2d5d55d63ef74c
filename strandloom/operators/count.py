"""Counting, reducing, sorting and merging k-mer tables.

Every count is one hash aggregation: a partial one in the scan's stage, one shuffle on the k-mer, a final one. Partial
aggregation absorbs frequent k-mers (poly-A) before the shuffle, so no key makes a hot partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .extract import WINDOWS, extract_kmers
from .packed import count_packed, unpacked


def count_kmers(df: DataFrame, seq: str, k: int) -> DataFrame:
    """``kmer string, cnt bigint`` over all sequences, in no order; empty if every sequence is shorter than k.

    Many possible keys are packed: a row of the shuffle is shorter, and the letters are written out once for each distinct k-mer.
    """
    if 4**k > WINDOWS:
        return unpacked(count_packed(df, seq, k), k)
    return extract_kmers(df, seq, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


def distinct_kmers(df: DataFrame, seq: str, k: int) -> DataFrame:
    """One row ``n_distinct bigint, n_total bigint``."""
    return count_kmers(df, seq, k).agg(
        F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum("cnt"), F.lit(0)).cast("bigint").alias("n_total")
    )


def merge_counts(*tables: DataFrame) -> DataFrame:
    """Sum the counts of equal k-mers over any number of ``kmer, cnt`` tables."""
    if not tables:
        raise ValueError("merge_counts needs one table or more")
    rows = reduce(DataFrame.unionByName, [t.select("kmer", "cnt") for t in tables])
    return rows.groupBy("kmer").agg(F.sum("cnt").cast("bigint").alias("cnt"))


def sort_kmers(counts: DataFrame) -> DataFrame:
    """In ascending order of k-mers, by one range exchange."""
    return counts.orderBy("kmer")


def rank_kmers(counts: DataFrame, prefix: int = 8) -> DataFrame:
    """``kmer, cnt, rank bigint``: 1-based position in the sorted table.

    Ranks inside a prefix come from a window over that prefix, those before it from the prefix totals, at most
    ``4 ** prefix`` rows, so no task sees the whole table: 65,536 groups, each as large as the distinct k-mers of one prefix.
    """
    keyed = counts.withColumn("_p", F.substring("kmer", 1, prefix))
    sizes = keyed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(
        "_p", (F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before")
    )
    ranked = keyed.withColumn("_r", F.row_number().over(W.partitionBy("_p").orderBy("kmer")))
    return ranked.join(F.broadcast(before), "_p").select(
        "kmer", "cnt", (F.col("_before") + F.col("_r")).cast("bigint").alias("rank")
    )


def nonzero(counts: DataFrame) -> DataFrame:
    """Drop records whose count is zero or null (padding of foreign files)."""
    return counts.where(F.col("cnt") > 0)


def reduce_adjacent(rows: DataFrame, group: list[str], order: list[str], key: str = "kmer") -> DataFrame:
    """Collapse neighbours with equal keys: ``group..., island bigint, key, cnt``.

    Neighbourhood is ``order`` within ``group``; an island number counts the changes of key before it.
    """
    w = W.partitionBy(*group).orderBy(*order)
    changed = F.when(F.col(key).eqNullSafe(F.lag(key).over(w)), 0).otherwise(1)
    marked = rows.withColumn("_changed", changed)
    islands = marked.withColumn("island", F.sum("_changed").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return islands.groupBy(*group, F.col("island").cast("bigint").alias("island"), key).agg(
        F.count(F.lit(1)).alias("cnt")
    )
