"""K-mer counts over a stream of sequences: the batch plan with its state kept by Spark, and a stored table that follows it.

State lies in RocksDB, so it may be larger than memory, and batches run in update mode: each gives only the counts that it has
changed. The stored table is cut into buckets by the hash of the k-mer. A batch writes new versions of the buckets that it touches,
then, in one file, which version of each bucket is current; readers see the table before the batch or after it. A batch
that is repeated after a crash starts from the table before it and gives the same one.

    at/changed/batch=3/bucket=17/...   what batch 3 has changed
    at/data/batch=3/bucket=17/...      bucket 17 as of batch 3
    at/current/batch=3/...             bucket, version: what the table consists of after batch 3
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.extract import extract_kmers
from ..sources.folders import shared_folder
from ..sources.remote import open_at

#: Choose so many that a bucket is a task's work.
BUCKETS = 64
_ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_WINDOWS = "windows"
_ROWS, _CURRENT = "kmer string, cnt bigint", "bucket int, version bigint"


def stream_counts(stream: DataFrame, seq: str, k: int) -> DataFrame:
    """Streaming ``kmer, cnt``; use output mode ``update`` or ``complete``. No watermark: counts never close."""
    windows = extract_kmers(stream, seq, k).observe(_WINDOWS, F.count(F.lit(1)).alias("n"))
    return windows.groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt"))


class Progress(StreamingQueryListener):
    """What the queries of a session have counted so far: after each batch, ``report(batch, windows, distinct)``.

    Windows are those of the batch, as observed on their way to the count; distinct k-mers are the rows of the state, so nothing
    is counted again. Add it with ``spark.streams.addListener``.
    """

    def __init__(self, report):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if _WINDOWS in p.observedMetrics:
            self.report(p.batchId, p.observedMetrics[_WINDOWS]["n"], sum(s.numRowsTotal for s in p.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def _versions(spark: SparkSession, at: str, before: int | None = None) -> dict[int, int]:
    """The current version of each bucket, or that before a batch."""
    listed = spark.read.schema(f"{_CURRENT}, batch bigint").parquet(f"{at}/current")
    if before is not None:
        listed = listed.where(F.col("batch") < before)
    last = listed.agg(F.max("batch")).first()[0]
    return {} if last is None else {r["bucket"]: r["version"] for r in listed.where(F.col("batch") == last).collect()}


def _read(spark: SparkSession, at: str, versions: dict[int, int]) -> DataFrame:
    paths = [f"{at}/data/batch={v}/bucket={b}" for b, v in versions.items()]
    return spark.read.schema(_ROWS).parquet(*paths) if paths else spark.createDataFrame([], _ROWS)


def stored_counts(spark: SparkSession, at: str) -> DataFrame:
    """``kmer, cnt`` of the stored table."""
    return _read(spark, at, _versions(spark, at))


def merge_batch(changed: DataFrame, batch: int, at: str, buckets: int = BUCKETS) -> None:
    """Put the new counts of a batch (``kmer, cnt``) in place of the stored ones; only touched buckets are read and written."""
    spark = changed.sparkSession
    bucket = F.pmod(F.xxhash64("kmer"), F.lit(buckets)).cast("int").alias("bucket")
    # Written, since a second action on a micro-batch would run it again.
    new = f"{at}/changed/batch={batch}"
    changed.select("kmer", "cnt", bucket).write.mode("overwrite").partitionBy("bucket").parquet(new)
    rows = spark.read.schema(f"{_ROWS}, bucket int").parquet(new)
    versions = _versions(spark, at, batch)
    touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
    if not touched:
        return
    old = _read(spark, at, {b: versions[b] for b in touched if b in versions}).select("kmer", "cnt", bucket)
    kept = old.join(rows.select("kmer", "bucket"), ["kmer", "bucket"], "left_anti").select("kmer", "cnt", "bucket")
    kept.unionByName(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{at}/data/batch={batch}")
    listed = versions | dict.fromkeys(touched, batch)
    spark.createDataFrame(sorted(listed.items()), _CURRENT).coalesce(1).write.mode("overwrite").parquet(f"{at}/current/batch={batch}")


def vacuum(spark: SparkSession, at: str, keep: int = 2) -> int:
    """Delete versions of buckets that the last ``keep`` lists do not name, and the lists before them; returns their number."""
    listed = spark.read.schema(f"{_CURRENT}, batch bigint").parquet(f"{at}/current")
    batches = sorted((r["batch"] for r in listed.select("batch").distinct().collect()), reverse=True)
    used = {(r["bucket"], r["version"]) for r in listed.where(F.col("batch").isin(batches[:keep])).select("bucket", "version").distinct().collect()}
    fs, root = open_at(at)

    def numbered(folder: str) -> dict[int, str]:
        if fs.get_file_info(folder).type != pafs.FileType.Directory:
            return {}
        found = (f for f in fs.get_file_info(pafs.FileSelector(folder)) if "=" in f.base_name)
        return {int(f.base_name.split("=")[1]): f.path for f in found}

    gone = [path for b, path in numbered(f"{root}/current").items() if b in batches[keep:]]
    for version, folder in numbered(f"{root}/data").items():
        gone += [path for b, path in numbered(folder).items() if (b, version) not in used]
    gone += [path for b, path in numbered(f"{root}/changed").items() if b < max(batches, default=0)]
    for path in gone:
        fs.delete_dir(path)
    return len(gone)


@contextmanager
def _rocksdb(spark: SparkSession):
    """Queries that start inside keep their state in RocksDB."""
    name, value = _ROCKSDB
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, old)


def follow(stream: DataFrame, seq: str, k: int, at: str, buckets: int = BUCKETS, **trigger):
    """Start a query that keeps the table at ``at`` up to date; ``trigger`` as in ``writeStream.trigger``.

    Its checkpoint lies beside the table, so a query that is started again goes on where the last one stopped.
    """
    spark = stream.sparkSession
    # A stream without data has no batch; its counts are an empty table.
    spark.createDataFrame([], _CURRENT).coalesce(1).write.mode("ignore").parquet(f"{at}/current/batch=-1")
    with _rocksdb(spark):
        writer = stream_counts(stream, seq, k).writeStream.outputMode("update").option("checkpointLocation", f"{at}/state")
        return writer.trigger(**trigger).foreachBatch(lambda batch, i: merge_batch(batch, i, at, buckets)).start()


def run_available(stream: DataFrame, seq: str, k: int, query_name: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Run the stream over what is there now and return the counts.

    The stored table and the stream's checkpoint lie in the shared folder, under the query's name.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/{query_name or f'stream-{uuid.uuid4().hex}'}"
    follow(stream, seq, k, at, buckets, availableNow=True).awaitTermination()
    return stored_counts(spark, at)
