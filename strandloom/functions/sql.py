"""Session SQL functions: the codec and the windows of a sequence for queries that are text only.

    kmer_words(kmer)          array<bigint>, 32 bases a word, as the packed format has them
    kmer_letters(words, k)    the k-mer of such words
    kmer_windows(seq, k)      a table function: run_no, pos (from 1 in the run), kmer of every valid window

    SELECT kmer, count(*) FROM reads, LATERAL kmer_windows(seq, 21) GROUP BY kmer

They are SQL all through, so Catalyst inlines them and no Python worker runs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .codec import BASES, DIGITS

_WORD = f"CAST(conv(translate(rpad(substring(kmer, 32 * i + 1, 32), 32, 'A'), '{BASES}', '{DIGITS}'), 4, -10) AS BIGINT)"
_LETTERS = f"translate(lpad(conv(hex(w), 16, 4), 32, '0'), '{DIGITS}', '{BASES}')"

FUNCTIONS = {
    "kmer_words(kmer STRING) RETURNS ARRAY<BIGINT>": f"transform(sequence(0, (length(kmer) + 31) DIV 32 - 1), i -> {_WORD})",
    "kmer_letters(words ARRAY<BIGINT>, k INT) RETURNS STRING": f"substring(array_join(transform(words, w -> {_LETTERS}), ''), 1, k)",
    # Runs shorter than k have no window; the filter keeps their ranges from counting down.
    "kmer_windows(seq STRING, k INT) RETURNS TABLE (run_no INT, pos INT, kmer STRING)": f"""
        SELECT run_no, pos, substring(run, pos, n) AS kmer
        FROM (SELECT run_no, run, n, explode(sequence(1, length(run) - n + 1)) AS pos
              FROM (SELECT run_no, run, k AS n FROM (SELECT posexplode(split(seq, '[^{BASES}]+')) AS (run_no, run)) WHERE length(run) >= k))""",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
