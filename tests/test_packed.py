"""Packed keys, sorted runs, packed folders and their readers."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kmers import brute, counted, fastq, frame

from strandloom.operators import count as C
from strandloom.operators import packed as P
from strandloom.operators import runs
from strandloom.sources import fastq as FQ
from strandloom.sources import kmer_file as K
from strandloom.sources import packed_format as pf


def reads_of(seed, sizes, letters="ACGTN"):
    r = random.Random(seed)
    return ["".join(r.choices(letters, k=n)) for n in sizes]


@pytest.mark.parametrize("k", [1, 2, 31, 32, 33, 63, 64, 65, 97, 128, 130])
def test_packed_windows(spark, k):
    reads = [*reads_of(k, (5, 31, 32, 33, 64, 129, 200)), *reads_of(k, (1500, 3000), "ACGT"), "T" * 700, None, ""]
    counts = P.count_packed(frame(spark, reads), "seq", k)
    want = brute(reads, k)
    assert counted(P.unpacked(counts, k)) == want
    assert [r["kmer"] for r in P.unpacked(runs.sort_packed(counts, k), k).collect()] == sorted(want)
    plan = counts._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_merge_packed_counts(spark):
    a, b = ["ACGTACGTTT"], ["TTTACG", "GGG"]
    both = P.merge_packed_counts(*[P.count_packed(frame(spark, x), "seq", 3) for x in (a, b)])
    assert counted(P.unpacked(both, 3)) == brute(a + b, 3)


@pytest.mark.parametrize("k", [3, 40])
def test_reduce_sorted(spark, k):
    """Runs that end in a partition, at its edge, and one that spans three partitions."""
    r = random.Random(k)
    keys = sorted("".join(r.choices("ACGT", k=k)) for _ in range(30))
    rows = [(x, r.randint(1, 5)) for i, x in enumerate(keys) for _ in range(100 if i == 14 else r.randint(1, 4))]
    want = {}
    for x, n in rows:
        want[x] = want.get(x, 0) + n
    cut = [0, 20, 50, 51, 90, len(rows)]  # the long run covers the parts from 50 and 51 whole
    placed = [(x, n, sum(i >= c for c in cut[1:-1])) for i, (x, n) in enumerate(rows)]
    df = spark.createDataFrame(placed, "kmer string, cnt long, part int").repartitionById(5, F.col("part")).sortWithinPartitions("kmer")
    words = df.select(*[w.alias(f"w{i}") for i, w in enumerate(K.codec.words(F.col("kmer"), k))], "cnt")
    assert sum(x == keys[14] for x, _ in rows[50:51]) == 1 and sum(x == keys[14] for x, _ in rows[90:]) > 0
    out = runs.reduce_sorted(words, k)
    assert counted(P.unpacked(out, k)) == want and out.count() == len(want)
    assert runs.reduce_sorted(words.limit(0), k).count() == 0


def folder(spark, tmp_path, name, reads, k, parts=4):
    counts = P.count_packed(frame(spark, reads), "seq", k)
    at = f"file://{tmp_path}/{name}"
    K.write_words(counts.repartitionByRange(parts, *P.order_of(k)).sortWithinPartitions(*P.order_of(k)), at, k)
    return at


@pytest.mark.parametrize("k", [7, 33])
def test_merge_sorted(spark, tmp_path, k):
    sets = [reads_of(i, (3000, 400), "ACGT") for i in range(3)] + [["A" * 200]]
    at = [folder(spark, tmp_path, f"r{i}", reads, k, parts=1 + i) for i, reads in enumerate(sets)]
    merged = K.merge_sorted(spark, at, k, split_bytes=4000)
    want = brute([x for reads in sets for x in reads], k)
    rows = [tuple(r) for r in merged.collect()]
    assert rows == sorted(want.items())
    assert merged.rdd.getNumPartitions() > 3
    assert "Exchange" not in merged._jdf.queryExecution().toString()


def test_is_sorted(spark, tmp_path):
    at = folder(spark, tmp_path, "s", reads_of(1, (900,), "ACGT"), 5)
    assert K.is_sorted(at) and not K.is_sorted(f"file://{tmp_path}") and not K.is_sorted("viewfs://x/y")
    K.write_kmer_file(spark.createDataFrame([("AAAAA", 1)], "kmer string, cnt long"), at, 5, mode="append")
    assert not K.is_sorted(at)


def test_merge_needs_sorted_folders(spark, tmp_path):
    K.write_kmer_file(spark.createDataFrame([("T", 1), ("A", 1)], "kmer string, cnt long").coalesce(1), f"file://{tmp_path}/x", 1)
    with pytest.raises(Exception, match="sorted parts"):
        K.merge_sorted(spark, [f"file://{tmp_path}/x"], 1).collect()


def planned(path, k, **options):
    return sum(r.n for r in K.RecordReader({"path": path, "k": str(k), **options}).partitions())


def test_lookup_reads_little(spark, tmp_path):
    k, reads = 12, reads_of(3, (60_000,), "ACGT")
    at = folder(spark, tmp_path, "f", reads, k, parts=3)
    want = brute(reads, k)
    for lo, hi in (("ACGTACGTACGT", "ACGTACGTACGV"), ("A", "C"), ("G", None), (None, "AAC"), ("TTTTTTTTTTTT", None), ("CC", "CC")):
        options = {x: y for x, y in (("from", lo), ("to", hi)) if y and set(y) <= set("ACGT")}
        hi = options.get("to")
        got = counted(K.read_kmer_file(spark, at, k, **options))
        assert got == {x: n for x, n in want.items() if (lo is None or x >= lo) and (hi is None or x < hi)}
    one = sorted(want)[len(want) // 2]
    blocks = planned(at, k, **{"from": one, "to": one[:-1] + "T"})
    assert 0 < blocks <= 2 * pf.BLOCK < planned(at, k) == len(want)


def test_sql(spark, tmp_path):
    k, reads = 9, reads_of(4, (30_000,), "ACGT")
    at, want = folder(spark, tmp_path, "f", reads, 9), brute(reads, 9)
    K.register(spark)
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW packed USING kmer_file OPTIONS (path '{at}', k '{k}')")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW slice USING kmer_file OPTIONS (path '{at}', k '{k}', `from` 'GAT', `to` 'GC')")
    assert counted(spark.sql("SELECT * FROM packed WHERE kmer > 'TTT' OR cnt > 3")) == {x: n for x, n in want.items() if x > "TTT" or n > 3}
    assert counted(spark.sql("SELECT * FROM packed WHERE kmer LIKE 'GAT%'")) == {x: n for x, n in want.items() if x.startswith("GAT")}
    assert counted(spark.sql("SELECT * FROM slice")) == {x: n for x, n in want.items() if "GAT" <= x < "GC"}


def test_places(spark, tmp_path):
    at = folder(spark, tmp_path, "f", reads_of(5, (4000,), "ACGT"), 6, parts=3)
    rows = K.read_kmer_file(spark, at, 6, places=True, split_bytes=1000).orderBy("rank").collect()
    assert [r["kmer"] for r in rows] == sorted(brute(reads_of(5, (4000,), "ACGT"), 6))
    assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
    by = {}
    for r in rows:
        by.setdefault(r["file"], []).append(r["record"])
    assert len(by) == 3 and all(v == list(range(len(v))) for v in by.values())


def listed(folder):
    """The one list of a folder."""
    (found,) = folder.glob(pf.PARTS + "*")
    return found


def test_job_that_fails_leaves_the_folder(spark, tmp_path):
    df = spark.createDataFrame([(x, 1) for x in ("AC", "CG", "GT")], "kmer string, cnt long")
    at = f"file://{tmp_path}/f"
    K.write_kmer_file(df, at, 2)
    bad = df.union(spark.createDataFrame([("TT", 2**32)], "kmer string, cnt long")).repartition(4)
    with pytest.raises(Exception, match="32 bits"):
        K.write_kmer_file(bad, at, 2)
    assert counted(K.read_kmer_file(spark, at, 2)) == {"AC": 1, "CG": 1, "GT": 1}
    assert not list((tmp_path / "f").glob("_temporary*"))
    K.write_kmer_file(df.limit(1), at, 2, mode="append")
    assert sorted(r["kmer"] for r in K.read_kmer_file(spark, at, 2).collect()) == ["AC", "AC", "CG", "GT"]
    K.write_kmer_file(df.limit(1), at, 2)
    assert counted(K.read_kmer_file(spark, at, 2)) == {"AC": 1}
    assert len(list((tmp_path / "f").glob("part-*"))) == len(json.loads(listed(tmp_path / "f").read_text()))


def test_commit_that_crashes_shows_the_old_folder(spark, tmp_path):
    """New parts moved but not listed, and old parts not yet deleted: readers go by the list."""
    df = spark.createDataFrame([("AC", 1)], "kmer string, cnt long")
    at = tmp_path / "f"
    K.write_kmer_file(df, f"file://{at}", 2)
    old = listed(at)
    (at / "part-0000000-unlisted.kmers").write_bytes(bytes(12))
    assert counted(K.read_kmer_file(spark, f"file://{at}", 2)) == {"AC": 1}
    K.write_kmer_file(spark.createDataFrame([("GG", 3)], "kmer string, cnt long"), f"file://{at}", 2)
    assert counted(K.read_kmer_file(spark, f"file://{at}", 2)) == {"GG": 3}
    assert listed(at).name > old.name and not old.exists()
    # An old list that is not deleted yet counts no more.
    (at / old.name).write_text("[]")
    assert counted(K.read_kmer_file(spark, f"file://{at}", 2)) == {"GG": 3}


def test_foreign_folder_and_file(spark, tmp_path):
    kind = pf.layout(3)
    rec = np.zeros(5, kind)
    rec["w"][:, 0] = [pf.key_of(x, 3)[0] for x in ("TTT", "ACG", "GGG", "AAA", "CCC")]
    rec["c"] = range(5)
    (tmp_path / "b.bin").write_bytes(rec[:2].tobytes())
    (tmp_path / "c.bin").write_bytes(rec[2:].tobytes())
    (tmp_path / ".hidden").write_bytes(b"x")
    assert [tuple(r) for r in K.read_kmer_file(spark, str(tmp_path), 3).collect()] == [("TTT", 0), ("ACG", 1), ("GGG", 2), ("AAA", 3), ("CCC", 4)]
    assert counted(K.read_kmer_file(spark, str(tmp_path / "c.bin"), 3)) == {"GGG": 2, "AAA": 3, "CCC": 4}
    assert counted(K.read_kmer_file(spark, str(tmp_path), 3, **{"from": "C"})) == {"TTT": 0, "GGG": 2, "CCC": 4}
    slow = K._read_records(spark, str(tmp_path / "c.bin"), 3, True).orderBy("rank").collect()
    assert [(r["kmer"], r["rank"]) for r in slow] == [("GGG", 1), ("AAA", 2), ("CCC", 3)]
    with pytest.raises(Exception, match="whole records"):
        K.read_kmer_file(spark, str(tmp_path / "c.bin"), 40).collect()
    with pytest.raises(ValueError, match="no file system"):
        K.open_at("viewfs://store/x")


@pytest.mark.parametrize(("split", "chunk"), [(1000, 64), (3777, 1000), (20_000, 1 << 20), (97, 50)])
def test_fastq_ranges(spark, tmp_path, split, chunk):
    r = random.Random(split)
    reads = ["".join(r.choices("ACGTN", k=r.randint(0, 150))) for _ in range(300)]
    (tmp_path / "a.fq").write_text(fastq(reads, last=False))
    (tmp_path / "b.fq").write_bytes(fastq(reads[:50], end="\r\n").encode())
    (tmp_path / "empty.fq").write_text("")
    rows = FQ.read_fastq(spark, f"file://{tmp_path}", split_bytes=split, chunk_bytes=chunk).collect()
    assert sorted(x["seq"] for x in rows) == sorted(reads + reads[:50])
    assert {x["file"].rsplit("/", 1)[1] for x in rows} == {"a.fq", "b.fq"}


def test_fastq_compressed_and_sql(spark, tmp_path):
    import gzip

    reads = reads_of(7, (60, 80, 0, 33))
    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(fastq(reads).encode()))
    FQ.read_fastq(spark, str(tmp_path))
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW reads USING fastq OPTIONS (path '{tmp_path}', chunk_bytes '16')")
    assert [r["seq"] for r in spark.sql("SELECT seq FROM reads").collect()] == reads
    assert sorted(r["seq"] for r in FQ.read_fastq_text(spark, str(tmp_path)).collect()) == sorted(reads)


def test_roundtrip_of_folders(spark, tmp_path):
    reads = reads_of(9, (500, 700))
    for k in (5, 70):
        counts = C.count_kmers(frame(spark, reads), "seq", k)
        K.write_kmer_file(counts, str(tmp_path / f"k{k}"), k)
        assert counted(K.read_kmer_file(spark, str(tmp_path / f"k{k}"), k)) == brute(reads, k)
