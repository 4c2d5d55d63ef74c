"""The stored table of a stream: touched buckets, restarts, repeated batches."""

import random

from pyspark.sql import functions as F
from test_kmers import brute, counted

from strandloom.sources.folders import shared_folder
from strandloom.streaming import count_stream as S


def test_two_batches_and_a_restart(spark, tmp_path):
    r = random.Random(1)
    first = ["".join(r.choices("ACGT", k=60)) for _ in range(200)]
    second = ["ACGTA", "ACGTA", "NNN"]
    src, k = str(tmp_path / "in"), 5

    def add(reads):
        spark.createDataFrame([(x,) for x in reads], "seq string").coalesce(1).write.mode("append").parquet(src)

    add(first)
    name = f"two-{r.random()}"
    at = f"{shared_folder(spark)}/{name}"

    def run():
        return S.run_available(spark.readStream.schema("seq string").parquet(src), "seq", k, name, buckets=16)

    assert counted(run()) == brute(first, k)
    before = S._versions(spark, at)
    assert len(before) == 16 and set(before.values()) == {0}
    add(second)
    assert counted(run()) == brute(first + second, k)  # a new query that goes on from the checkpoint
    after = S._versions(spark, at)
    assert sorted(after.values()) == [0] * 15 + [1]  # the second batch has one k-mer, so one bucket was written
    fs, root = S.open_at(at)
    assert [f.base_name for f in fs.get_file_info(S.pafs.FileSelector(f"{root}/data/batch=1")) if f.base_name.startswith("bucket")] == [f"bucket={max(after, key=after.get)}"]
    state = [f.base_name for f in fs.get_file_info(S.pafs.FileSelector(f"{root}/state/state", recursive=True))]
    assert any(f.endswith((".zip", ".changelog", ".sst")) for f in state)  # RocksDB's files
    assert counted(run()) == brute(first + second, k)  # nothing new


def test_repeated_batch_and_vacuum(spark, tmp_path):
    at = f"file://{tmp_path}/t"
    spark.createDataFrame([], S._CURRENT).write.parquet(f"{at}/current/batch=-1")

    def batch(i, rows):
        S.merge_batch(spark.createDataFrame(rows, S._ROWS), i, at, buckets=4)

    assert S.stored_counts(spark, at).count() == 0
    batch(0, [("A", 1), ("C", 2), ("G", 1)])
    for _ in range(2):  # as after a crash between the data and the checkpoint
        batch(1, [("A", 5), ("T", 1)])
        assert counted(S.stored_counts(spark, at)) == {"A": 5, "C": 2, "G": 1, "T": 1}
    batch(2, [])
    batch(3, [("C", 9)])
    want = {"A": 5, "C": 9, "G": 1, "T": 1}
    assert counted(S.stored_counts(spark, at)) == want
    assert S.vacuum(spark, at, keep=1) > 0
    assert counted(S.stored_counts(spark, at)) == want and S.vacuum(spark, at, keep=1) == 0


def test_empty_stream(spark, tmp_path):
    spark.createDataFrame([], "seq string").write.parquet(str(tmp_path / "in"))
    out = S.run_available(spark.readStream.schema("seq string").parquet(str(tmp_path / "in")), "seq", 3)
    assert out.agg(F.count(F.lit(1))).first()[0] == 0
