"""Documents that exercise the defined cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows, extra=True):
    """rows: (doc_id, text) or (doc_id, text, lang) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], (r[2:3] or (None,))[0], (r[3:4] or (None,))[0], len(r[1]) if r[1] else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if extra:  # names that operators use inside
        for name in ("size", "key", "rank", "bucket", "node", "hash", "spans", "n"):
            df = df.withColumn(name, F.lit(1))
    return df


def odd(spark):
    return docs(
        spark,
        [
            (1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six seven"), (4, "one two three four five six seven"),
            (5, "ünïcödé word \U0001f600 and more words here please"), (6, "x" * 300_000), (7, "many words " * 20_000),
            (None, "a row without an id has some words too"), (8, None, None, "s"),
        ],
    )


def empty(spark):
    return docs(spark, [])
