"""FASTQ directories as DataFrames.

Records have four lines; a final newline is optional, ``\\r\\n`` is accepted and an empty sequence stays as an empty read.
Names that start with ``.`` or ``_`` are hidden. Files are planned as byte ranges: a task looks for the first record that
starts in its range and reads on to the end of the last one that does, so records are never torn and nothing is shuffled. Lines are
found and cut out of a buffer with numpy and leave as Arrow batches. Compressed files are read by one task each.

On file systems that only Spark opens, Spark's text source makes the splits; records that straddle them are joined afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .remote import files, open_at, opens

_LINES = 4
#: Bytes that one task reads, and those read at once.
SPLIT, CHUNK = 64 << 20, 8 << 20
_PACKED = (".gz", ".bz2", ".zst", ".lz4")


class Span(InputPartition):
    """Bytes of one file."""

    def __init__(self, file: str, start: int, end: int, size: int):
        self.file, self.start, self.end, self.size = file, start, end, size


def _lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the whole lines of a buffer, without their newlines."""
    ends = np.flatnonzero(data == 10)
    return np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends, ends


def _length(data: np.ndarray, start: int, end: int) -> int:
    return end - start - (end > start and data[end - 1] == 13)


def _first_record(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> int | None:
    """The first line that can be a header: ``@``, two lines on ``+``, and as many qualities as bases."""
    for i in range(len(starts) - _LINES + 1):
        at = [data[starts[j]] if ends[j] > starts[j] else 0 for j in (i, i + 2)]
        if at == [64, 43] and _length(data, starts[i + 1], ends[i + 1]) == _length(data, starts[i + 3], ends[i + 3]):
            return i
    return None


def _strings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The pieces of a buffer as one string array."""
    ends = ends - ((ends > starts) & (data[ends - 1] == 13))
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    # Marks where pieces begin and end add up to a mask: a byte for each of the buffer's, where places would take eight for each base.
    marks = np.zeros(len(data) + 1, np.int8)
    full = sizes > 0
    marks[starts[full]] += 1
    marks[ends[full]] -= 1
    pieces = data[np.cumsum(marks[:-1], dtype=np.int8, out=marks[:-1]).view(bool)]
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(pieces))


class FastqReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.split, self.chunk = options["path"], int(options.get("split_bytes", SPLIT)), int(options.get("chunk_bytes", CHUNK))

    def partitions(self) -> list[Span]:
        out = []
        for f in files(self.path):
            step = f.size if f.path.endswith(_PACKED) else self.split
            out += [Span(f.path, a, min(a + step, f.size), f.size) for a in range(0, f.size, max(1, step))]
        return out or [Span("", 0, 0, 0)]

    def read(self, s: Span) -> Iterator[pa.RecordBatch]:
        if s.start == s.end:
            return
        fs, _ = open_at(self.path)
        # A range begins with the byte before it, so that a line which starts with the range is known as one.
        at = max(0, s.start - 1)
        whole = s.file.endswith(_PACKED)
        with fs.open_input_stream(s.file) if whole else fs.open_input_file(s.file) as f:
            if not whole:
                f.seek(at)
            held, synced, ended = b"", s.start == 0, False
            while not ended:
                more = f.read(self.chunk)
                ended = not more
                held += more
                if ended and held and not held.endswith(b"\n"):
                    held += b"\n"
                data = np.frombuffer(held, np.uint8)
                starts, ends = _lines(data)
                if not synced:
                    skip = 1  # the line that the range begins in
                    first = _first_record(data, starts[skip:], ends[skip:])
                    if first is None:
                        continue  # a longer look, or no record starts here
                    starts, ends, synced = starts[skip + first :], ends[skip + first :], True
                n = len(starts) // _LINES
                heads = starts[: n * _LINES : _LINES]
                mine = n if whole else int(np.searchsorted(heads + at, s.end))
                rows = slice(1, mine * _LINES, _LINES)
                if mine:
                    yield pa.RecordBatch.from_arrays([pa.array([s.file] * mine), _strings(data, starts[rows], ends[rows])], names=["file", "seq"])
                if mine < n or not whole and n and at + ends[n * _LINES - 1] + 1 >= s.end:
                    return
                used = int(ends[n * _LINES - 1]) + 1 if n else int(starts[0]) if len(starts) else 0
                held, at = held[used:], at + used


class Fastq(DataSource):
    """``spark.read.format("fastq")``: ``file, seq`` of the records of a file or folder."""

    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self) -> str:
        return "file string, seq string"

    def reader(self, schema) -> DataSourceReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, **options) -> DataFrame:
    """``file string, seq string``, one row per record."""
    if not opens(path):
        return read_fastq_text(spark, path)
    spark.dataSource.register(Fastq)
    return spark.read.format("fastq").options(**options).load(path)


def _starts_record(lines: list[str], i: int) -> bool:
    """A record starts at i if line i is a header, i + 2 a separator, and i + 1 and i + 3 are equally long."""
    if i + 3 >= len(lines):
        return False
    return lines[i].startswith("@") and lines[i + 2].startswith("+") and len(lines[i + 1]) == len(lines[i + 3])


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole records of each split; the lines before the first and after the last one go on as fragments."""
    pending: list[str] = []
    at: tuple[str, int] | None = None
    synced = False

    def row(kind: int, text: str) -> tuple:
        return (*at, kind, text)

    def advance(final: bool) -> list[tuple]:
        nonlocal synced, pending
        out: list[tuple] = []
        i = 0
        if not synced:
            limit = len(pending) - (0 if final else 2 * _LINES)
            while i < limit and not _starts_record(pending, i):
                i += 1
            if i >= limit:
                if final:
                    out.append(row(0, "\n".join(pending)))
                    pending = []
                return out
            out.append(row(0, "\n".join(pending[:i])))
            synced = True
        end = i + (len(pending) - i) // _LINES * _LINES
        out += [row(1, s) for s in pending[i + 1 : end : _LINES]]
        pending = pending[end:]
        if final:
            out.append(row(2, "\n".join(pending)))
            pending = []
        return out

    for batch in batches:
        rows: list[tuple] = []
        for (file, block), lines in batch.groupby(["file", "block"], sort=False)["value"]:
            if (file, block) != at:
                if at is not None:
                    rows += advance(True)
                at, synced = (file, block), block == 0
                if synced:
                    rows.append(row(0, ""))
            pending += lines.str.removesuffix("\r").tolist()
        if at is not None:
            rows += advance(False)
        yield pd.DataFrame(rows, columns=["file", "block", "kind", "text"])
    if at is not None:
        yield pd.DataFrame(advance(True), columns=["file", "block", "kind", "text"])


def read_fastq_text(spark: SparkSession, path: str) -> DataFrame:
    """``read_fastq`` over Spark's text source, for any file system that Spark reads.

    Each split resynchronises on its first whole record. What lies before it and after the last whole record (a few
    lines per split) is joined in split order, one small group per file, so records that straddle splits survive.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    # Whole records dominate, so they leave in the scan's stage; only the fragments are shuffled.
    parts = lines.mapInPandas(_cut, "file string, block bigint, kind int, text string")
    whole = parts.where("kind = 1").select("file", F.col("text").alias("seq"))
    torn = parts.where("kind <> 1 and text <> ''").groupBy("file").agg(
        F.sort_array(F.collect_list(F.struct("block", "kind", "text"))).alias("p")
    )
    # A torn record's lines are consecutive once the fragments are put in order.
    text = F.concat_ws("\n", F.transform("p", lambda x: x["text"]))
    line = torn.select("file", F.posexplode(F.split(text, "\n")).alias("pos", "seq")).where("pos % 4 = 1")
    return whole.unionByName(line.select("file", "seq"))


def read_lengths(reads: DataFrame) -> DataFrame:
    """``file, min_length, max_length, n_reads`` of a FASTQ table."""
    return reads.groupBy("file").agg(
        F.min(F.length("seq")).alias("min_length"),
        F.max(F.length("seq")).alias("max_length"),
        F.count(F.lit(1)).alias("n_reads"),
    )
