import corpus_pipeline as P
from cases import empty, odd
from pyspark.sql import functions as F

from strandloom.llm import registry
from strandloom.llm.common import materialised


def test_stages_in_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, [docs.count()]
    for _, stage in P.STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        n.append(docs.count())
    assert n == sorted(n, reverse=True) and n[-1] > 0.5 * n[0]
    assert "token = \"[SECRET]" not in "".join(r["text"] for r in docs.collect())
    out = P.STAGES[-1][1](spark, docs, sf_dir)
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert out.count() == n[-1] and {r["doc_id"] for r in out.collect()} == kept


def test_odd_tables(spark, sf_dir):
    for make in (odd, empty):
        docs = make(spark)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, sf_dir)
            docs.collect()


def test_names_with_dots_pass_through(spark, sf_dir):
    """Columns whose names need quotes reach the last stage but one as they were."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).withColumn("a.b", F.col("doc_id")).withColumn("c d", F.lit("x"))
    columns = docs.columns
    for _, stage in P.STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
        assert docs.columns == columns
    assert docs.where("doc_id <> `a.b` or `c d` <> 'x'").isEmpty() and not docs.isEmpty()
    P.STAGES[-1][1](spark, docs, sf_dir).collect()


def test_all_operators_have_a_query():
    assert {int(k[2:].split("_")[0]) for k in registry.QUERIES} == set(range(1, 14))
