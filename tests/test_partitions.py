"""The tasks of a count follow its windows, whatever ``spark.sql.shuffle.partitions`` is."""

import random
import uuid

import pytest
from oracle import assert_same
from pyspark.sql import functions as F
from test_kmers import brute, counted, frame

from strandloom.jobs import registry
from strandloom.operators import count as C
from strandloom.operators import extract as X
from strandloom.operators import packed as P
from strandloom.operators import runs


@pytest.fixture
def small_tasks(monkeypatch):
    for module in (X, P, C, runs):
        monkeypatch.setattr(module, "WINDOWS", 1000, raising=False)


def reads(n=80, size=160):
    r = random.Random(5)
    return ["".join(r.choices("ACGT", k=size)) for _ in range(n)]


def rows_by_task(df):
    return {r[0]: r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()}


@pytest.mark.parametrize("count", [C.count_kmers, P.count_packed])
@pytest.mark.parametrize("k", [21, 33, 64, 96, 128])
def test_keys_of_a_task_are_bounded(spark, small_tasks, count, k):
    """Final tasks hold about WINDOWS keys each; there were as many as the setting says before."""
    found = count(frame(spark, reads()).coalesce(1), "seq", k)
    per = rows_by_task(found)
    assert len(per) == -(-80 * (161 - k) // 1000) and max(per.values()) < 1300
    assert counted(found if count is C.count_kmers else P.unpacked(found, k)) == brute(reads(), k)


def test_frequent_keys_and_copies_part(spark, small_tasks):
    """Copies of one read are dealt to several tasks, and each sends a key once."""
    df = frame(spark, ["A" * 160] * 100).coalesce(1)
    per = rows_by_task(P.task_counts(df, "seq", 64, 10))
    assert len(per) > 3 and set(per.values()) == {1}
    assert counted(C.count_kmers(df, "seq", 64)) == {"A" * 64: 9700}


@pytest.mark.parametrize("k", [33, 40, 64])
def test_sorted_counts_take_one_exchange_of_keys(spark, small_tasks, k):
    """Ranges are as many as the windows need, in unsigned order, and keys are summed in them."""
    texts = [*reads(), "T" * 160, "A" * 160, "A" * 160]
    found = runs.count_sorted(frame(spark, texts).coalesce(1), "seq", k)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and " hashpartitioning" not in plan
    want = brute(texts, k)
    assert [(r["kmer"], r["cnt"]) for r in P.unpacked(found, k).collect()] == sorted(want.items())
    per = rows_by_task(found)
    assert len(per) > 5 and max(per.values()) < 2000


def test_few_windows_are_sorted_as_before(spark):
    found = runs.count_sorted(frame(spark, reads(3)), "seq", 33)
    assert [r["kmer"] for r in P.unpacked(found, 33).collect()] == sorted(brute(reads(3), 33))


def test_reads_are_derived_by_many_tasks(spark, sf_dir, monkeypatch):
    """A customer table of one split is dealt out before its reads are derived."""
    monkeypatch.setattr(registry, "KEYS", 20)
    found = registry.long_reads(spark, sf_dir)
    n = found.count()
    assert len(rows_by_task(found)) == -(-n // 20) and found.distinct().count() == n


@pytest.mark.parametrize("query", ["kmer_count_packed_k128", "kmer_count_k128", "kmer_count_k96", "kmer_count_packed_k33"])
def test_tasks_of_a_query_do_not_grow_with_the_table(spark, sf_dir, tmp_path, small_tasks, query):
    """Six times the customers make more final tasks, not larger ones, and the rows are those of the SQL."""
    customers, largest = spark.read.parquet(f"{sf_dir}/customer.parquet"), []
    n = customers.count()
    for copies in (2, 12):
        at = tmp_path / str(copies)
        shifted = customers.crossJoin(spark.range(copies)).withColumn("c_custkey", F.col("c_custkey") + F.col("id") * n).drop("id")
        at.mkdir()
        shifted.toPandas().to_parquet(at / "customer.parquet")
        found = registry.QUERIES[query](spark, str(at))
        largest.append(max(rows_by_task(found).values()))
        assert_same(found, str(at), registry.ORACLE_SQL[query])
    assert max(largest) < 1300


def most_shuffled(spark, run):
    """Rows that one task writes to shuffles at most while something runs, by Spark's own metrics."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    run()
    sc.setJobGroup("", "")
    store, tracker, most = sc._jsc.sc().statusStore(), sc.statusTracker(), 0
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for stage in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}:
        tasks = store.taskList(stage, 0, 100_000) if tracker.getStageInfo(stage).numCompletedTasks else None
        for i in range(tasks.size() if tasks else 0):
            most = max(most, tasks.apply(i).taskMetrics().get().shuffleWriteMetrics().recordsWritten())
    return most


@pytest.mark.parametrize("query", ["kmer_count_packed_k128", "kmer_count_k128", "kmer_count_k96", "kmer_count_packed_k33"])
def test_keys_held_before_the_shuffle_do_not_grow_with_the_table(spark, sf_dir, tmp_path, small_tasks, query):
    """A task that counts windows holds, and sends, about WINDOWS keys; the scan's task had those of its whole split before."""
    customers, most = spark.read.parquet(f"{sf_dir}/customer.parquet"), []
    n = customers.count()
    for copies in (2, 12):
        at = tmp_path / str(copies)
        at.mkdir()
        shifted = customers.crossJoin(spark.range(copies)).withColumn("c_custkey", F.col("c_custkey") + F.col("id") * n).drop("id")
        shifted.toPandas().to_parquet(at / "customer.parquet")
        found = registry.QUERIES[query](spark, str(at))
        most.append(most_shuffled(spark, lambda found=found: found.write.format("noop").mode("overwrite").save()))
    # A read's 33 to 128 windows go to one task, so tasks of 1,000 differ.
    assert 0 < min(most) and max(most) < 4000
