import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.functions import codec
from strandloom.jobs import kmers
from strandloom.operators import count as C
from strandloom.operators import extract as X
from strandloom.sources.fastq import read_fastq, read_lengths
from strandloom.sources.kmer_file import read_kmer_file, write_kmer_file


def brute(reads, k):
    out = Counter()
    for s in reads:
        for i in range(len(s or "") - k + 1):
            if set(w := s[i : i + k]) <= set("ACGT"):
                out[w] += 1
    return out


def counted(df):
    return {r["kmer"]: r["cnt"] for r in df.collect()}


def frame(spark, reads):
    return spark.createDataFrame([(i, s) for i, s in enumerate(reads)], "read_id long, seq string")


EDGE = [
    (["ACGTNACG"], 3), (["acgt"], 2), (["AAAAA"], 3), (["AC"], 3), ([""], 1), (["ACG", "TTT"], 3), (["A" * 31 + "C"], 31),
    (["ACGT" * 8], 32), (["ACGT\r"], 4), (["ACNAC"], 1), (["A" * 63 + "N"], 64), (["A" * 63 + "N"], 63), (["ACGT\n"], 5),
    ([None, "ACG"], 2), (["GATTACA", "GATTACA"], 7),
]


@pytest.mark.parametrize("reads,k", EDGE)
def test_edges(spark, reads, k):
    assert counted(C.count_kmers(frame(spark, reads), "seq", k)) == brute(reads, k)


def test_long_runs_are_tiled(spark):
    rng = random.Random(5)
    reads = ["".join(rng.choices("ACGT", k=n)) for n in (1023, 1024, 1025, 5000)]
    for k in (1, 7, 40):
        assert counted(C.count_kmers(frame(spark, reads), "seq", k)) == brute(reads, k)
    at = X.kmer_positions(frame(spark, reads), "seq", 7, "read_id").collect()
    assert all(reads[r["read_id"]][r["pos"] - 1 : r["pos"] + 6] == r["kmer"] for r in at)


def test_k_must_be_positive(spark):
    with pytest.raises(ValueError):
        C.count_kmers(frame(spark, ["A"]), "seq", 0)


def test_merge_sort_nonzero_and_empty(spark):
    a, b = frame(spark, ["ACGACG"]), frame(spark, ["CGA"])
    merged = C.merge_counts(C.count_kmers(a, "seq", 3), C.count_kmers(b, "seq", 3))
    assert counted(merged) == brute(["ACGACG", "CGA"], 3)
    assert [r["kmer"] for r in C.sort_kmers(merged).collect()] == sorted(brute(["ACGACG"], 3))
    zero = spark.createDataFrame([("A", 0), ("C", None), ("G", 2)], "kmer string, cnt long")
    assert counted(C.nonzero(zero)) == {"G": 2}
    empty = C.count_kmers(frame(spark, []), "seq", 3)
    assert empty.dtypes == [("kmer", "string"), ("cnt", "bigint")] and empty.count() == 0
    assert C.distinct_kmers(frame(spark, []), "seq", 3).collect()[0].asDict() == {"n_distinct": 0, "n_total": 0}


def test_packed_words(spark):
    words = [("ACG", 3, "1800000000000000"), ("CGT", 3, "6C00000000000000"), ("GATTACA", 7, "8F10000000000000"), ("T" * 32, 32, "F" * 16)]
    for s, k, hexed in words:
        df = spark.createDataFrame([(s,)], "kmer string").select(F.hex(codec.encode_words(F.col("kmer"), k)).alias("h"))
        assert df.collect()[0]["h"] == hexed
    assert [codec.record_width(k) for k in (1, 32, 33, 128)] == [12, 12, 20, 36]


def test_packed_order_and_round_trip(spark, tmp_path):
    rng = random.Random(1)
    for k in (5, 32, 33, 70):
        keys = sorted({"".join(rng.choices("ACGT", k=k)) for _ in range(200)})
        df = spark.createDataFrame([(s, i + 1) for i, s in enumerate(keys)], "kmer string, cnt long")
        packed = df.select("kmer", codec.encode_words(F.col("kmer"), k).alias("p")).orderBy("p")
        assert [r["kmer"] for r in packed.collect()] == keys
        write_kmer_file(df, str(tmp_path / f"f{k}"), k)
        write_kmer_file(df, str(tmp_path / f"f{k}"), k)
        assert counted(read_kmer_file(spark, str(tmp_path / f"f{k}"), k)) == {s: i + 1 for i, s in enumerate(keys)}


def test_packed_bytes_and_overflow(spark, tmp_path):
    write_kmer_file(spark.createDataFrame([("ACG", 258)], "kmer string, cnt long"), str(tmp_path / "a"), 3)
    data = b"".join(p.read_bytes() for p in (tmp_path / "a").glob("part-*"))
    assert data == bytes.fromhex("0000000000000018") + (258).to_bytes(4, "little")
    with pytest.raises(Exception, match="32 bits"):
        write_kmer_file(spark.createDataFrame([("ACG", 2**32)], "kmer string, cnt long"), str(tmp_path / "b"), 3)


def fastq(reads, end="\n", last=True, head="@r"):
    lines = [x for i, s in enumerate(reads) for x in (f"{head}{i}", s, "+", "+@I"[i % 3] * len(s))]
    return end.join(lines) + (end if last else "")


def test_fastq_forms(spark, tmp_path):
    rng = random.Random(2)
    reads = ["".join(rng.choices("ACGTN", weights=[5, 5, 5, 5, 1], k=n)) for n in (50, 31, 80, 0, 12)]
    for i, text in enumerate((fastq(reads), fastq(reads, last=False), fastq(reads, end="\r\n"), fastq(reads, head="@" + "h" * 200))):
        d = tmp_path / str(i)
        d.mkdir()
        (d / "a.fq").write_bytes(text.encode())
        (d / ".hidden").write_text(fastq(["ACGTACGT"]))
        df = read_fastq(spark, str(d))
        assert Counter(r["seq"] for r in df.collect()) == Counter(reads)
        assert counted(C.count_kmers(df, "seq", 5)) == brute(reads, 5)
    assert read_lengths(df).collect()[0]["n_reads"] == 5


def test_fastq_splits(spark, tmp_path):
    rng = random.Random(3)
    reads = ["".join(rng.choices("ACGT", k=rng.randint(40, 150))) for _ in range(400)]
    (tmp_path / "a.fq").write_text(fastq(reads))
    for size in (1000, 3777, 20000):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            assert Counter(r["seq"] for r in read_fastq(spark, str(tmp_path)).collect()) == Counter(reads)
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fq").write_text(fastq(["ACGTACGT", "TTTTT"]))
    out, text = str(tmp_path / "out"), str(tmp_path / "text")
    kmers.run(spark, kmers.parse(["count", str(tmp_path / "in"), out, "-k", "4", "--form", "packed"]))
    kmers.run(spark, kmers.parse(["print", out, text, "-k", "4"]))
    want = {f"{a} {b}" for a, b in brute(["ACGTACGT", "TTTTT"], 4).items()}
    assert {r["value"] for r in spark.read.text(text).collect()} == want
    kmers.run(spark, kmers.parse(["merge", f"{out},{out}", str(tmp_path / "m"), "-k", "4", "--ordered"]))
    assert counted(spark.read.parquet(str(tmp_path / "m"))) == {a: 2 * b for a, b in brute(["ACGTACGT", "TTTTT"], 4).items()}
