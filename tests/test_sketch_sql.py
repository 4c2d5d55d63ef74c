"""Sketches, progress of a stream, and SQL functions."""

import random

from pyspark.sql import functions as F
from test_kmers import brute, counted, frame

from strandloom.functions import codec
from strandloom.functions import sql as Q
from strandloom.operators import sketch as S
from strandloom.streaming import count_stream


def reads_of(seed, n, letters="ACGT" * 20 + "N"):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=r.randint(0, 120))) for _ in range(n)]


def test_sketches_add_up(spark):
    for k in (9, 40):
        files = [reads_of(i, 300) for i in range(3)]
        df = spark.createDataFrame([(f"f{i}", s) for i, reads in enumerate(files) for s in reads], "file string, seq string")
        per = S.sketch_kmers(df, "seq", k, "file")
        found = {r["file"]: (r["e"], r["n_total"]) for r in per.select("file", "n_total", S.estimate().alias("e")).collect()}
        for i, reads in enumerate(files):
            want = brute(reads, k)
            assert found[f"f{i}"][1] == sum(want.values()) and abs(found[f"f{i}"][0] - len(want)) <= 4 * S.standard_error() * len(want)
        whole = brute([s for reads in files for s in reads], k)
        e = S.merge_sketches(per.where("file < 'f1'"), per.where("file >= 'f1'")).select(S.estimate().alias("e"), "n_total").first()
        assert e["n_total"] == sum(whole.values()) and abs(e["e"] - len(whole)) <= 4 * S.standard_error() * len(whole)
    none = S.merge_sketches(S.sketch_kmers(frame(spark, []), "seq", 3)).select(S.estimate().alias("e"), "n_total").first()
    assert tuple(none) == (0, 0)


def test_progress(spark, tmp_path):
    files = [reads_of(i, 40) for i in range(3)]
    for reads in files:
        spark.createDataFrame([(s,) for s in reads], "seq string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    seen = []
    listener = count_stream.Progress(lambda *x: seen.append(x))
    spark.streams.addListener(listener)
    try:
        stream = spark.readStream.schema("seq string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        count_stream.follow(stream, "seq", 5, f"file://{tmp_path}/t", 4, availableNow=True).awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    whole = brute([s for reads in files for s in reads], 5)
    assert len(seen) == 3 and [b for b, *_ in seen] == [0, 1, 2]
    assert sum(n for _, n, _ in seen) == sum(whole.values()) and seen[-1][2] == len(whole)
    assert seen[0][2] <= seen[1][2] <= seen[2][2]


def test_sql_functions(spark):
    Q.register(spark)
    reads = [*reads_of(5, 60), "", "NNN", "ACGT", None]
    frame(spark, reads).createOrReplaceTempView("r")
    for k in (1, 4, 33):
        got = spark.sql(f"SELECT kmer, count(*) AS cnt FROM r, LATERAL kmer_windows(seq, {k}) GROUP BY kmer")
        assert counted(got) == brute(reads, k)
        back = spark.sql(f"SELECT kmer, kmer_letters(kmer_words(kmer), {k}) AS back, kmer_words(kmer) AS words FROM r, LATERAL kmer_windows(seq, {k})")
        both = back.select("kmer", "back", "words", F.array(*codec.words(F.col("kmer"), k)).alias("w"))
        assert all(x["kmer"] == x["back"] and x["words"] == x["w"] for x in both.collect())
    at = spark.sql("SELECT run_no, pos, kmer FROM kmer_windows('ACGNNTTAC', 3)").collect()
    assert sorted(map(tuple, at)) == [(0, 1, "ACG"), (1, 1, "TTA"), (1, 2, "TAC")]
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan
