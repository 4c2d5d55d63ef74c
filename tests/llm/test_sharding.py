import zlib
from collections import Counter

import pytest
from cases import docs, empty, odd
from pyspark.sql import functions as F

from strandloom.llm import sharding as S


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _check(df, out, shards):
    """Every row once, counts one apart at most, slots gapless."""
    rows = out.collect()
    assert Counter(tuple(r)[: len(df.columns)] for r in rows) == Counter(map(tuple, df.collect()))
    shard, slot = out.columns[-2:]
    per = {s: sorted(r[slot] for r in rows if r[shard] == s) for s in range(shards)}
    assert all(v == list(range(len(v))) for v in per.values())
    assert max(map(len, per.values())) - min(map(len, per.values())) <= 1


@pytest.mark.parametrize(("n", "shards", "size"), [(1000, 40, 500), (7, 40, 16), (997, 3, 1 << 20), (40, 1, 64)])
def test_law(spark, n, shards, size):
    df = docs(spark, [(i, f"text {i % 50} " * (i % 9)) for i in range(n)])
    _check(df, S.shuffled(df, shards, bucket_bytes=size), shards)


def test_same_whatever_the_partitions(spark):
    rows = [(i, f"text {i} " * (i % 9)) for i in range(600)] + [(5, "again")] * 300
    df = docs(spark, rows)
    want = _rows(S.shuffled(df, 8, bucket_bytes=400))
    assert _rows(S.shuffled(df.repartition(7), 8, bucket_bytes=400)) == want
    assert _rows(S.shuffled(df.coalesce(1).orderBy(F.desc("text")), 8, bucket_bytes=400)) == want
    assert _rows(S.shuffled(df, 8, seed=21, bucket_bytes=400)) != want
    _check(df, S.shuffled(df, 8, bucket_bytes=400), 8)


def test_uniform(spark):
    """Each record reaches each shard about equally often, and neighbours are parted."""
    df = docs(spark, [(i, "same text") for i in range(800)], extra=False)
    seen = Counter()
    for seed in (0, 10, 20):
        seen.update((r["doc_id"] // 200, r["shard"]) for r in S.shuffled(df, 4, seed=seed, bucket_bytes=4000).collect())
    assert all(abs(seen[g, s] - 3 * 50) < 60 for g in range(4) for s in range(4))


def test_copies_scatter(spark):
    df = docs(spark, [(1, "one row, many times")] * 2000 + [(i, "other") for i in range(500)], extra=False)
    out = S.shuffled(df, 10, bucket_bytes=2000)
    _check(df, out, 10)
    per = Counter(r["shard"] for r in out.where("doc_id = 1").collect())
    assert all(120 < per[s] <= 250 for s in range(10))


def test_written_in_order(spark, tmp_path):
    df = docs(spark, [(i, f"text {i}") for i in range(500)]).withColumn("shard", F.lit("mine")).withColumn("a.b", F.lit(2))
    out = S.write_shards(df, f"file://{tmp_path}/s", 5, bucket_bytes=1000)
    assert out.columns == [*df.columns, "shard_", "slot"]
    _check(df, out, 5)
    for s in range(5):
        files = sorted((tmp_path / "s" / f"shard_={s}").glob("*.parquet"))
        slots = [r["slot"] for f in files for r in spark.read.parquet(f"file://{f}").select("slot").collect()]
        assert len(files) > 1 and slots == list(range(100))


def test_odd_rows(spark):
    df = odd(spark)
    _check(df, S.shuffled(df, 4), 4)
    assert S.shuffled(empty(spark)).count() == 0
    out = {r["doc_id"]: r for r in S.digest(S.shuffled(df, 4)).collect()}
    assert (out[1]["size"], out[1]["text_crc32"], out[2]["size"]) == (16, 0, 16)
    text = "ünïcödé word \U0001f600 and more words here please".encode()
    assert (out[5]["size"], out[5]["text_crc32"]) == (len(text) + 16, zlib.crc32(text))
    nulls = spark.createDataFrame([(None, None), (None, "a"), ("a", None)], "x string, y string")
    _check(nulls, S.shuffled(nulls, 2), 2)


def test_no_python_in_the_plan(spark):
    plan = S.shuffled(docs(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
