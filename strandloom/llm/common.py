"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the contracts: the space and \x09 to \x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as an expression, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def type_of(df: DataFrame, name: str) -> str:
    """A column's type as DDL."""
    return df.schema[name].dataType.simpleString()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors see; on a local master one of this machine where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def materialised(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    at = f"{shared_folder(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a ``materialised`` table that is read no more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether a table has ``rows`` rows at most, found by reading no more than that."""
    return df.limit(rows + 1).count() <= rows


def map_chunks(df: DataFrame, columns: list[str], fn, schema: str | StructType, rows: int = 128, flush: int = 8 << 20) -> DataFrame:
    """Apply ``fn(columns as lists) -> iterable of tuples`` to chunks of rows inside Arrow batches; one stage, no shuffle.

    Chunks have ``rows`` rows at most, and output leaves as soon as ``flush`` bytes of strings have gathered, so a worker
    holds little more than the longest texts it meets.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), target)], schema=target)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                held, out = 0, []
                for row in fn(*[c.to_pylist() for c in batch.slice(at, rows).columns]):
                    out.append(row)
                    held += sum(len(v) for v in row if isinstance(v, (str, bytes)))
                    if held >= flush:
                        yield batch_of(out)
                        held, out = 0, []
                if out:
                    yield batch_of(out)

    # ``mapInArrow`` resolves its columns by unquoted names.
    plain = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(columns)])
    return plain.mapInArrow(run, schema)


def map_rows(df: DataFrame, columns: list[str], fn, schema: str | StructType, rows: int = 128, flush: int = 8 << 20) -> DataFrame:
    """``map_chunks`` with ``fn(*values) -> iterable of tuples`` for each row."""

    def each(*lists):
        for values in zip(*lists, strict=True):
            yield from fn(*values)

    return map_chunks(df, columns, each, schema, rows, flush)
