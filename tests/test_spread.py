"""Windows are spread over tasks, and words of packed keys are read without strings."""

import random
import tracemalloc

import numpy as np
import pytest
from oracle import assert_same
from pyspark.sql import functions as F
from test_kmers import brute, counted, frame

from strandloom.functions import codec
from strandloom.jobs import registry
from strandloom.operators import count as C
from strandloom.operators import extract as X
from strandloom.operators import packed as P
from strandloom.sources import fastq as FQ


@pytest.fixture
def small_tasks(monkeypatch):
    for module in (X, P, C):
        monkeypatch.setattr(module, "WINDOWS", 1000)


def reads(n=80, size=160):
    r = random.Random(11)
    return ["".join(r.choices("ACGT", k=size)) for _ in range(n)]


@pytest.mark.parametrize("count", [C.count_kmers, lambda df, seq, k: P.unpacked(P.count_packed(df, seq, k), k)])
@pytest.mark.parametrize("k", [20, 33, 128])
def test_one_partition_is_spread(spark, small_tasks, count, k):
    """A table in one partition: no task takes all of its windows."""
    df = frame(spark, [*reads(), None, "A" * 30_000]).coalesce(1)
    found = count(df, "seq", k)
    assert counted(found) == brute([*reads(), "A" * 30_000], k)
    assert "RoundRobinPartitioning" in found._jdf.queryExecution().toString()


def test_spread_is_even_and_whole(spark):
    df = frame(spark, reads()).coalesce(1)
    out = X.spread(df, "seq", 41, size=1200)
    per = [x["n"] for x in out.groupBy(F.spark_partition_id()).agg((F.count(F.lit(1)) * 120).alias("n")).collect()]
    assert len(per) == 8 and max(per) <= 2400
    assert sorted(x["seq"] for x in out.collect()) == sorted(reads())
    assert X.spread(df, "seq", 200, size=1).rdd.getNumPartitions() == 1


def test_reduce_adjacent_shuffles_reads(spark, sf_dir, small_tasks):
    """One exchange, of reads and not of their letters."""
    found = registry.reduce_adjacent(spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("Generate") < plan.index("Exchange") < plan.index("orders")
    assert_same(found, sf_dir, registry.ORACLE_SQL["reduce_adjacent"])


def test_fastq_pieces_take_little_memory():
    """Cutting a buffer takes a few bytes for each of its own, not dozens."""
    r = np.random.default_rng(1)
    record = lambda n: b"@r\n" + bytes(r.choice(list(b"ACGT"), n).astype(np.uint8)) + b"\n+\n" + b"I" * n + b"\n"
    data = np.frombuffer(b"".join(record(n) for n in (0, 1, 0, 7, 90)) + b"@\nAC\r\n+\nII\r\n" + record(1_000_000), np.uint8)
    starts, ends = FQ._lines(data)
    tracemalloc.start()
    found = FQ._strings(data, starts[1::4], ends[1::4])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    lines = data.tobytes().split(b"\n")[1::4]
    assert found.to_pylist() == [x.rstrip(b"\r").decode() for x in lines]
    assert peak < 4 * len(data)


def test_words_without_strings(spark):
    for k in (3, 32, 33, 70):
        letters = [x[:k] for x in reads()] + ["T" * k, "A" * k]
        df = spark.createDataFrame([(x,) for x in letters], "kmer string")
        words = [w.alias(f"w{i}") for i, w in enumerate(codec.words(F.col("kmer"), k))]
        old = [codec.encode_words(F.col("kmer"), k).alias("b"), *[h.alias(f"h{i}") for i, h in enumerate(codec.word_halves(F.col("kmer"), k))]]
        rows = df.select("kmer", *words, *old)
        cols = [F.col(f"w{i}") for i in range(codec.n_words(k))]
        new = [codec.binary_of(*cols), *[h for w in cols for h in codec.halves_of(w)]]
        same = [F.col(c) == n for c, n in zip(["b", *[f"h{i}" for i in range(2 * len(cols))]], new, strict=True)]
        back = codec.decode_words(F.col("b"), k) == F.col("kmer")
        assert rows.select(F.every(back), *[F.every(s) for s in same]).first() == (True,) * (2 + 2 * len(cols))
        assert [x[0] for x in P.unpacked(rows.drop("kmer"), k).select("kmer").collect()] == letters
