"""``python -m strandloom.jobs.kmers count IN OUT -k 31`` or ``print IN OUT -k 31``."""

from __future__ import annotations

import argparse
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators.count import merge_counts, nonzero, sort_kmers
from ..operators.packed import count_packed, unpacked
from ..operators.runs import count_sorted
from ..sources.fastq import read_fastq
from ..sources.kmer_file import is_sorted, merge_sorted, print_lines, read_kmer_file, write_kmer_file, write_words


@dataclass(frozen=True)
class Options:
    """What a run needs; memory, temporary folders and merge fan-in are Spark settings."""

    mode: str
    source: str
    target: str
    k: int = 32
    form: str = "parquet"
    ordered: bool = False
    pad: bool = False


def _merged(spark: SparkSession, paths: list[str], o: Options) -> DataFrame:
    """Sorted folders by their slices, without a shuffle; others by an aggregation."""
    if all(is_sorted(p) for p in paths):
        return nonzero(merge_sorted(spark, paths, o.k))
    counts = nonzero(merge_counts(*[read_kmer_file(spark, p, o.k) for p in paths]))
    return sort_kmers(counts) if o.ordered else counts


def run(spark: SparkSession, o: Options) -> None:
    """Count a FASTQ folder, merge packed folders (comma-separated), or print a packed folder as text."""
    if o.mode == "print":
        print_lines(read_kmer_file(spark, o.source, o.k), o.k, o.pad).write.mode("overwrite").text(o.target)
    elif o.mode == "merge":
        counts = _merged(spark, o.source.split(","), o)
        if o.form == "packed":
            write_kmer_file(counts, o.target, o.k)
        else:
            counts.write.mode("overwrite").parquet(o.target)
    else:
        counts = (count_sorted if o.ordered else count_packed)(read_fastq(spark, o.source), "seq", o.k)
        if o.form == "packed":
            write_words(counts, o.target, o.k)
        else:
            unpacked(counts, o.k).write.mode("overwrite").parquet(o.target)


def parse(argv: list[str] | None = None) -> Options:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("mode", choices=["count", "merge", "print"])
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("-k", type=int, default=32)
    p.add_argument("--form", choices=["parquet", "packed"], default="parquet")
    p.add_argument("--ordered", action="store_true")
    p.add_argument("--pad", action="store_true")
    return Options(**vars(p.parse_args(argv)))


if __name__ == "__main__":
    session = SparkSession.builder.appName("kmers").getOrCreate()
    run(session, parse())
    session.stop()
