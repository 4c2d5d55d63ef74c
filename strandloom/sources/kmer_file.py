"""Packed k-mer files: records of ``8 * ceil(k / 32)`` key bytes (little-endian words) and a little-endian uint32 count.

The files have no header; k is an option. ``kmer_file`` reads and writes folders of them, ``kmer_merge`` reads several sorted
folders as one sorted, summed table. Both plan byte ranges and move Arrow batches; on file systems that only Spark opens,
records are read by its fixed-length input.

A written folder has a list of its parts; a job commits by putting the next list in place, in one step. Readers go by the list, so they see the
folder before the job or after it, never between: what failed or repeated tasks have left is in no list. Beside each part lies
an index, the first key of each block of records; sorted parts are searched through it. Folders without a list (from
elsewhere) are read file by file.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..functions import codec
from . import packed_format as pf
from .remote import files, open_at, opens

#: Bytes that one task reads, and records of one Arrow batch.
SPLIT, BATCH = 64 << 20, 1 << 16


@dataclass
class _Wrote(WriterCommitMessage):
    part: pf.Part


class _RecordWriter(DataSourceArrowWriter):
    """One part for each task attempt, under the job's own folder until all tasks have succeeded."""

    def __init__(self, path: str, k: int, overwrite: bool):
        self.path, self.k, self.overwrite, self.job = path, k, overwrite, uuid.uuid4().hex

    def _job(self, at: str) -> str:
        return f"{at}/_temporary-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Wrote:
        fs, at = open_at(self.path)
        # Named by partition, so that parts of a sorted table follow each other in the order of their names.
        part = pf.Part(f"part-{TaskContext.get().partitionId():07d}-{uuid.uuid4().hex}.kmers", 0, sorted=True)
        kind, last, index = pf.layout(self.k), None, []
        for folder in (self._job(at), f"{self._job(at)}/{pf.INDEX}"):
            fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{self._job(at)}/{part.name}") as out:
            for b in batches:
                if not b.num_rows:
                    continue
                count = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
                if b.column(b.num_columns - 1).null_count or count.min() < 0 or count.max() > codec.MAX_COUNT:
                    raise ValueError("a count does not fit in 32 bits")
                rec = np.empty(b.num_rows, kind)
                for i in range(b.num_columns - 1):
                    rec["w"][:, i] = b.column(i).to_numpy(zero_copy_only=False).view(np.uint64)
                rec["c"] = count
                words = np.concatenate([last, rec["w"]]) if last is not None else rec["w"]
                part.sorted = part.sorted and pf.ascending(words)
                part.first = part.first or tuple(map(int, rec["w"][0]))
                last = rec["w"][-1:]
                index.append(rec["w"][-part.records % pf.BLOCK :: pf.BLOCK])
                part.records += len(rec)
                out.write(rec.tobytes())
        if last is not None:
            part.last = tuple(map(int, last[0]))
        with fs.open_output_stream(f"{self._job(at)}/{pf.INDEX}/{part.name}") as out:
            out.write(b"".join(x.astype("<u8").tobytes() for x in index))
        return _Wrote(part)

    def commit(self, messages: list) -> None:
        fs, at = open_at(self.path)
        fs.create_dir(f"{at}/{pf.INDEX}", recursive=True)
        old = pf.parts_of(fs, at)
        if old is None:
            old = [pf.Part(f.base_name, f.size // pf.layout(self.k).itemsize) for f in files(self.path)]
        new = [m.part for m in messages]
        for p in new:
            for name in (p.name, f"{pf.INDEX}/{p.name}"):
                fs.move(f"{self._job(at)}/{name}", f"{at}/{name}")
        # Parts are in place but unlisted; this step makes them the folder's, and only then old ones go.
        before = pf.lists(fs, at)
        name = pf.next_list(before)
        with fs.open_output_stream(f"{self._job(at)}/{name}") as out:
            out.write(pf.to_json(new if self.overwrite else old + new))
        fs.move(f"{self._job(at)}/{name}", f"{at}/{name}")
        for path in before:
            fs.delete_file(path)
        for p in old if self.overwrite else ():
            for name in (p.name, f"{pf.INDEX}/{p.name}"):
                if fs.get_file_info(f"{at}/{name}").type == pafs.FileType.File:
                    fs.delete_file(f"{at}/{name}")
        fs.delete_dir(self._job(at))

    def abort(self, messages: list) -> None:
        fs, at = open_at(self.path)
        if fs.get_file_info(self._job(at)).type == pafs.FileType.Directory:
            fs.delete_dir(self._job(at))


@dataclass
class Range(InputPartition):
    """Records of one file, the place of the first of them among all files, and the keys that are asked for."""

    file: str
    start: int
    n: int
    before: int
    lo: pf.Key | None = None
    hi: pf.Key | None = None

    def __init__(self, file, start, n, before, lo=None, hi=None):
        self.file, self.start, self.n, self.before, self.lo, self.hi = file, start, n, before, lo, hi


class RecordReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.k = options["path"], int(options["k"])
        self.places = options.get("places", "false").lower() == "true"
        self.split = int(options.get("split_bytes", SPLIT))
        self.lo = pf.key_of(options["from"], self.k) if options.get("from") else None
        self.hi = pf.key_of(options["to"], self.k) if options.get("to") else None

    def partitions(self) -> list[Range]:
        fs, at = open_at(self.path)
        width = pf.layout(self.k).itemsize
        parts = pf.parts_of(fs, at)
        if parts is None:
            found = files(self.path)
            for f in found:
                if f.size % width:
                    raise ValueError(f"{f.path} does not hold whole records of k = {self.k}")
            parts, names = [pf.Part(f.base_name, f.size // width) for f in found], [f.path for f in found]
        else:
            names = [f"{at}/{p.name}" for p in parts]
        out, before, most = [], 0, max(1, self.split // width)
        for p, name in zip(parts, names, strict=True):
            if p.meets(self.lo, self.hi):
                a, b = 0, p.records
                if p.sorted and (self.lo, self.hi) != (None, None):
                    a, b = pf.records_between(pf.index_of(fs, at, p, self.k), p, self.lo, self.hi)
                out += [Range(name, i, min(most, b - i), before, self.lo, self.hi) for i in range(a, b, most)]
            before += p.records
        return out or [Range("", 0, 0, 0)]

    def read(self, r: Range) -> Iterator[pa.RecordBatch]:
        if not r.n:
            return
        fs, _ = open_at(self.path)
        kind = pf.layout(self.k)
        with fs.open_input_file(r.file) as f:
            for start in range(r.start, r.start + r.n, BATCH):
                n = min(BATCH, r.start + r.n - start)
                rec = np.frombuffer(f.read_at(n * kind.itemsize, start * kind.itemsize), kind)
                at = np.arange(start, start + n)
                if (r.lo, r.hi) != (None, None):
                    keep = pf.within(rec["w"], r.lo, r.hi)
                    rec, at = rec[keep], at[keep]
                    if not len(rec):
                        continue
                columns = [pf.letters_of(rec["w"], self.k), pa.array(rec["c"].astype(np.int64))]
                names = ["kmer", "cnt"]
                if self.places:
                    columns += [pa.array([r.file.rsplit("/", 1)[1]] * len(rec)), pa.array(at), pa.array(at + r.before + 1)]
                    names += ["file", "record", "rank"]
                yield pa.RecordBatch.from_arrays(columns, names=names)


class KmerFile(DataSource):
    """``spark.read.format("kmer_file").option("k", k)``: ``kmer, cnt`` and, with ``places``, ``file, record, rank``.

    ``record`` counts from 0 in a file, ``rank`` from 1 over all files in order. ``from`` and ``to`` (letters, a k-mer or its
    beginning) limit what is read; sorted parts are searched. Conditions of a query do not: Spark 4.1 keeps the filters pushed
    into a Python source's view for later queries of the view, which would lose rows. Writing takes the words of k-mers, as bigint, and a count.
    """

    @classmethod
    def name(cls) -> str:
        return "kmer_file"

    def schema(self) -> str:
        places = self.options.get("places", "false").lower() == "true"
        return "kmer string, cnt bigint" + (", file string, record bigint, rank bigint" if places else "")

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _RecordWriter(self.options["path"], int(self.options["k"]), overwrite)


@dataclass
class Slice(InputPartition):
    """Keys in [lo, hi) of all runs."""

    lo: pf.Key | None
    hi: pf.Key | None

    def __init__(self, lo, hi):
        self.lo, self.hi = lo, hi


class MergeReader(DataSourceReader):
    """Cut points come from the runs' indexes, a bounded sample of them; each task seeks its slice in every run."""

    SAMPLE = 1 << 17

    def __init__(self, options):
        self.paths, self.k = json.loads(options["paths"]), int(options["k"])
        self.split = int(options.get("split_bytes", SPLIT))

    def _runs(self):
        for path in self.paths:
            fs, at = open_at(path)
            parts = pf.parts_of(fs, at)
            if parts is None or not all(p.sorted for p in parts if p.records):
                raise ValueError(f"{path} is not a folder of sorted parts written here")
            yield fs, at, [p for p in parts if p.records]

    def partitions(self) -> list[Slice]:
        runs = list(self._runs())
        n_parts, total = sum(len(ps) for *_, ps in runs), sum(p.records for *_, ps in runs for p in ps)
        tasks = max(1, -(-total * pf.layout(self.k).itemsize // self.split))
        if tasks == 1:
            return [Slice(None, None)]
        each, sample = max(2, self.SAMPLE // n_parts), []
        for fs, at, parts in runs:
            for p in parts:
                index = pf.index_of(fs, at, p, self.k)
                step = -(-len(index) // each)
                sample += [(tuple(r), step) for r in index[::step].tolist()]
        sample.sort()
        weight, sums = 0, []
        for key, w in sample:
            sums.append((weight, key))
            weight += w
        cuts, at = [], 1
        for before, key in sums:
            while at < tasks and before >= at * weight / tasks:
                cuts.append(key)
                at += 1
        cuts = sorted(set(cuts))
        return [Slice(a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]

    def read(self, s: Slice) -> Iterator[pa.RecordBatch]:
        kind, found = pf.layout(self.k), []
        for fs, at, parts in self._runs():
            for p in (p for p in parts if p.meets(s.lo, s.hi)):
                a, b = pf.records_between(pf.index_of(fs, at, p, self.k), p, s.lo, s.hi)
                with fs.open_input_file(f"{at}/{p.name}") as f:
                    rec = np.frombuffer(f.read_at((b - a) * kind.itemsize, a * kind.itemsize), kind)
                lo = 0 if s.lo is None else pf.first_at(rec["w"], s.lo)
                hi = len(rec) if s.hi is None else pf.first_at(rec["w"], s.hi)
                found.append(rec[lo:hi])
        if not sum(map(len, found)):
            return
        rec = np.concatenate(found)
        rec = rec[pf.order(rec["w"])]
        starts = np.flatnonzero(pf.changes(rec["w"]))
        sums = np.add.reduceat(rec["c"].astype(np.int64), starts)
        words = rec["w"][starts]
        for i in range(0, len(words), BATCH):
            yield pa.RecordBatch.from_arrays([pf.letters_of(words[i : i + BATCH], self.k), pa.array(sums[i : i + BATCH])], names=["kmer", "cnt"])


class KmerMerge(DataSource):
    """``kmer, cnt`` of sorted folders (``paths``, a JSON list), summed and in order: partition i lies before partition i + 1."""

    @classmethod
    def name(cls) -> str:
        return "kmer_merge"

    def schema(self) -> str:
        return "kmer string, cnt bigint"

    def reader(self, schema) -> DataSourceReader:
        return MergeReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``kmer_file`` and ``kmer_merge`` known to a session, for SQL too."""
    for source in (KmerFile, KmerMerge):
        spark.dataSource.register(source)


def write_kmer_file(counts: DataFrame, path: str, k: int, mode: str = "overwrite") -> None:
    """Write ``kmer, cnt`` as packed records; ``overwrite`` replaces what the folder held, ``append`` adds to it."""
    words = [w.alias(f"w{i}") for i, w in enumerate(codec.words(F.col("kmer"), k))]
    write_words(counts.select(*words, "cnt"), path, k, mode)


def write_words(counts: DataFrame, path: str, k: int, mode: str = "overwrite") -> None:
    """``write_kmer_file`` of packed counts (``w0, w1, ..., cnt``)."""
    register(counts.sparkSession)
    counts.write.format("kmer_file").option("k", k).mode(mode).save(path)


def read_kmer_file(spark: SparkSession, path: str, k: int, places: bool = False, **options) -> DataFrame:
    """``kmer, cnt`` of a file or folder of packed records, in the order of parts and records."""
    if not opens(path):
        return _read_records(spark, path, k, places)
    register(spark)
    return spark.read.format("kmer_file").options(k=k, places=places, **options).load(path)


def _read_records(spark: SparkSession, path: str, k: int, places: bool) -> DataFrame:
    """By Spark's fixed-length input, on file systems that only Spark opens; ranks in place of files and record numbers."""
    split = spark.sparkContext.binaryRecords(path, codec.record_width(k))
    record = spark.createDataFrame(split.map(lambda r: (bytearray(r),)), "r binary")
    words = [codec.little_endian(F.substring("r", 8 * i + 1, 8)) for i in range(codec.n_words(k))]
    count_hex = F.hex(F.substring("r", codec.record_width(k) - 3, 4))
    count = F.conv(F.concat(*[F.substring(count_hex, p, 2) for p in (7, 5, 3, 1)]), 16, 10).cast("bigint")
    rows = record.select(codec.decode_words(F.concat(*words), k).alias("kmer"), count.alias("cnt"))
    if not places:
        return rows
    rows = rows.withColumn("_split", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sizes = rows.groupBy("_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = sizes.select("_split", "_first", (F.sum("_n").over(W.orderBy("_split").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_before"))
    rank = (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("rank")
    none = F.lit(None)
    return rows.join(before, "_split").select("kmer", "cnt", none.cast("string").alias("file"), none.cast("bigint").alias("record"), rank)


def numbered_kmer_file(spark: SparkSession, path: str, k: int) -> DataFrame:
    """``kmer, cnt, rank bigint``: 1-based place of each record in the parts' order, known from the parts' sizes."""
    return read_kmer_file(spark, path, k, places=True).select("kmer", "cnt", "rank")


def is_sorted(path: str) -> bool:
    """Whether a folder was written here, each of its parts ascends, and no part begins before the one before it ends."""
    if not opens(path):
        return False
    parts = [p for p in pf.parts_of(*open_at(path)) or [] if p.records]
    return bool(parts) and all(p.sorted for p in parts) and all(a.last <= b.first for a, b in zip(parts, parts[1:]))


def merge_sorted(spark: SparkSession, paths: list[str], k: int, **options) -> DataFrame:
    """The summed counts of sorted folders, in order; no record is shuffled."""
    register(spark)
    return spark.read.format("kmer_merge").options(paths=json.dumps(paths), k=k, **options).load()


def print_lines(counts: DataFrame, k: int, pad: bool = False) -> DataFrame:
    """``line``: ``<letters> <count>``; ``pad`` fills the letters with A to whole words."""
    letters = codec.padded(F.col("kmer"), k) if pad else F.col("kmer")
    return counts.select(F.concat_ws(" ", letters, F.col("cnt").cast("string")).alias("line"))
