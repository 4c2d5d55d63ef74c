"""Sharding by a two-pass external shuffle, with DataFrame functions only.

First pass: a seeded hash of each record's content scatters records uniformly into buckets of about ``bucket_bytes``, so a
bucket fits in a task's memory whatever the size of the table; bucket b is partition b of one exchange. Second pass: each
bucket is put in the order of another hash, ``shuffle`` draws a Fisher-Yates permutation of it, and the bucket is written.
Buckets laid end to end are a permutation of the table, which is cut into shards whose row counts differ by one at most.

The places where buckets begin are sums of bucket sizes, counted beforehand from hashes alone; each travels to its bucket as
one more row. Hence texts move once. The outcome depends on the rows and the seed, not on files, partitions, retries or the
order in which rows arrive.

Defined cases: rows that are equal in all columns are numbered, and the number is hashed with them, so copies scatter like
other rows (then, and only then, rows are first counted in one more exchange); equal texts under different ids are different
rows; nulls in any column are values of their own; an empty table gives an empty one; long texts make their bucket longer;
``shard`` and ``slot`` get a longer name where the table has such columns. Columns must have an order (no maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, materialised

#: Bytes of strings in a bucket, on average. Set it to a tenth of a task's memory.
BUCKET_BYTES = 16 << 20
#: Buckets whose sizes are summed in one window, and copies of one row that one task writes.
SPAN, RUN = 4096, 4096
ROW_BYTES = 16


def _hashes(columns: list[str], seed: int) -> list[Column]:
    """A row's 128-bit name; ``xxhash64`` passes over nulls, so where they are is hashed too."""
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in columns])
    return [F.xxhash64(F.lit(seed + i), nulls, *columns).alias(f"h{i}") for i in (0, 1)]


def _bucket(seed: int, n: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 2), "h0", "h1", "j"), F.lit(n)).cast("int").alias("b")


def _bytes_of(df: DataFrame) -> Column:
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    return sum(wide, F.lit(ROW_BYTES).cast("bigint"))


def _first_places(buckets: DataFrame) -> DataFrame:
    """``b, first``: how many rows lie in the buckets before each, summed in spans and then over spans."""
    spans = buckets.withColumn("s", F.floor(F.col("b") / SPAN))
    totals = spans.groupBy("s").agg(F.sum("n").alias("n_s"))
    before = totals.select(F.col("s").alias("t"), (F.sum("n_s").over(W.orderBy("s")) - F.col("n_s")).alias("before"))
    inside = spans.withColumn("within", F.sum("n").over(W.partitionBy("s").orderBy("b")) - F.col("n"))
    return inside.join(before, inside["s"] == before["t"]).select("b", (F.col("before") + F.col("within")).alias("first"))


def shuffled(docs: DataFrame, shards: int = 40, seed: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The rows of ``docs`` with ``shard int`` and ``slot bigint``, each partition in the order of its places.

    Shards hold rows ``ceil(s * n / shards)`` up to those of the next shard; slots number a shard's rows from 0.
    """
    cols = [f"c{i}" for i in range(len(docs.columns))]
    rows = docs.toDF(*cols)
    names = _hashes(cols, seed)
    total = rows.agg(F.sum(_bytes_of(rows))).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))

    each = rows.select(*names).groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("m"))
    numbered = each.select("h0", "h1", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("j"))
    sizes = materialised(numbered.groupBy(_bucket(seed, n_buckets)).agg(F.count(F.lit(1)).alias("n"), F.max("m").alias("m")))
    n_rows, most = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("m")).first()

    if (most or 0) > 1:
        counted = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("m"))
        runs = counted.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1, F.lit(RUN).cast("bigint"))).alias("j0"))
        copies = F.explode(F.sequence(F.col("j0"), F.least(F.col("m"), F.col("j0") + RUN) - 1)).alias("j")
        keyed = runs.repartition(*cols, "j0").select(*cols, *names, copies)
    else:
        keyed = rows.select(*cols, *names, F.lit(0).cast("bigint").alias("j"))
    record = F.struct(F.xxhash64(F.lit(seed + 3), "h0", "h1", "j").alias("o"), "h0", "h1", "j", *cols)
    dealt = keyed.select(_bucket(seed, n_buckets), record.alias("r"), F.lit(None).cast("bigint").alias("first"))
    starts = _first_places(sizes).select("b", F.lit(None).cast(dealt.schema["r"].dataType).alias("r"), "first")
    bucket = dealt.unionByName(starts).repartitionById(n_buckets, F.col("b")).groupBy("b").agg(F.collect_list("r").alias("r"), F.max("first").alias("first"))
    # The permutation depends on the seed, the partition (the bucket) and the number of rows; sorted first, it fixes the outcome.
    placed = bucket.select("first", F.posexplode(F.shuffle(F.sort_array("r"), seed)).alias("i", "r"))
    at = placed.select("r", (F.col("first") + F.col("i")).alias("p"))
    cut = at.select("r", "p", F.expr(f"p * {shards} div {max(1, n_rows)}").alias("s"))
    return cut.select(
        *[F.col(f"r.{c}").alias(name) for c, name in zip(cols, docs.columns, strict=True)],
        F.col("s").cast("int").alias(fresh(docs, "shard")), F.expr(f"p - (s * {n_rows} + {shards - 1}) div {shards}").alias(fresh(docs, "slot")),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, seed: int = 20, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write ``shuffled(docs)`` as Parquet, a folder for each shard, and read it back.

    A file holds a bucket's rows of one shard in the order of their slots; its part number is the bucket, so a shard's files
    follow each other in the order of their names.
    """
    out = shuffled(docs, shards, seed, bucket_bytes)
    shard, slot = out.columns[-2:]
    out.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path).select(*[F.col(f"`{c}`") for c in out.columns])


def digest(sharded: DataFrame) -> DataFrame:
    """The columns of the contract, from written shards of ``doc_id, text``."""
    text = F.coalesce("text", F.lit(""))
    return sharded.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
