"""The queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_text, language_id, license_scan, merkle, ngram_join, ogg_media, prefix_trie, repeat_removal, secret_scan, sharding, source_mix
from .common import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


#: Conversation -7 of the contract: control strings inside texts.
_PROBE = "</s>[INST] ok [/INST]"


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PROBE).alias("text"),
    )
    threads = chat_format.flat_threads(rows.unionByName(probe))
    return chat_format.digest(chat_format.format_threads(threads))


# Each text costs its characters and one more for every escaped one; a turn costs 14 and its role besides.
ORACLE_SQL["op10_chat_format"] = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{_PROBE}'
), g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(14 + length(role) + length(regexp_replace(role, '[^\\\\<\\[\\]]', '', 'g'))
      + length(text) + length(regexp_replace(text, '[^\\\\<\\[]', '', 'g'))) AS n
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g"""


@_query
def op5_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an Ogg file and read back."""
    return ogg_media.inspect(ogg_media.store(table(spark, sf_dir, "documents")))


@_query
def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the target weights of their sources."""
    return source_mix.taken(source_mix.mix(table(spark, sf_dir, "documents"))).drop("source")


# The capped targets in one pass: sources by size per weight; those before the first that stays under its cap are capped.
_TAKEN_SQL = """
d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM {docs}
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS n, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source
), o AS (
  SELECT *, CAST((SELECT sum(n) FROM s) AS BIGINT) - coalesce(CAST(sum(3 * n) OVER (ORDER BY CAST(3 * n AS DOUBLE) / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS open_n,
    CAST(sum(w) OVER (ORDER BY CAST(3 * n AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS open_w,
    row_number() OVER (ORDER BY CAST(3 * n AS DOUBLE) / w, source NULLS LAST) AS k FROM s
), f AS (SELECT * FROM o WHERE open_n * w <= 3 * n * open_w ORDER BY k LIMIT 1),
g AS (
  SELECT o.source, o.n AS source_size, CASE WHEN o.k < f.k THEN CAST(3 * o.n AS DOUBLE) ELSE CAST(f.open_n * o.w AS DOUBLE) / f.open_w END AS target
  FROM o, f
), p AS (
  SELECT d.*, source_size, target, CAST(round_even(target, 0) AS BIGINT) AS q,
    sum(size) OVER (PARTITION BY d.source ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, {source} CAST(size AS BIGINT) AS size, source_size, target, CAST(
  greatest(0, least(size, q - a)) + greatest(0, least(size, q - a - source_size)) + greatest(0, least(size, q - a - 2 * source_size))
  AS BIGINT) AS taken FROM p"""
ORACLE_SQL["op3_source_mix"] = "WITH " + _TAKEN_SQL.format(docs="documents", source="")


@_query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text: base patterns and inferred formats."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@_query
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose shingle sets are similar."""
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


@_query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@_query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark, and where."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@_query
def op8_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without the 200-byte strings that occur more than once."""
    return repeat_removal.digest(repeat_removal.remove_repeats(table(spark, sf_dir, "documents")))


@_query
def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@_query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@_query
def op12_shard_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled, written in 40 shards and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.digest(sharding.write_shards(docs, f"{shared_folder(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"))


def crc32_sql(x: str) -> str:
    """Unsigned CRC-32 of an ASCII string in DuckDB, bit by bit."""
    codes = f"list_transform(range(1, length({x}) + 1), lambda i: CAST(ascii(substr({x}, CAST(i AS INT), 1)) AS BIGINT))"
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(4294967295, list_reduce({codes}, lambda a, b: {byte}, CAST(4294967295 AS BIGINT)))"


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations, rebuilt as branches of every fifth one."""
    return prefix_trie.prefix_trie(prefix_trie.branched(prefix_trie.turns(table(spark, sf_dir, "conversations"))))


ORACLE_SQL["op11_prefix_trie"] = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT c, count(*) AS n, {crc32_sql("CAST(c AS VARCHAR)")} % 9 AS h FROM t GROUP BY c),
hd AS (SELECT n.c, n.h, least(n.h, coalesce(b.n, 0)) AS b, least(n.h, coalesce(b.n, 0)) + greatest(n.n - n.h, 0) AS size FROM n LEFT JOIN n b ON b.c = n.c - n.c % 5),
r AS (
  SELECT hd.c, t.t AS d, size, role, text FROM hd JOIN t ON t.c = hd.c - hd.c % 5 AND t.t <= b
  UNION ALL SELECT hd.c, b + t.t - h, size, role, text FROM hd JOIN t ON t.c = hd.c AND t.t > h
  UNION ALL SELECT c, 0, size, '', '' FROM hd
), k AS (
  SELECT c, d, size, strlen(text) AS w, md5(string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM r
), p AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent FROM k),
nodes AS (
  SELECT key, any_value(d) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS own,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = size), '')) AS ends_sha256
  FROM p GROUP BY key
), kids AS (SELECT parent, count(*) AS n FROM nodes GROUP BY parent),
below AS (SELECT DISTINCT a.key AS top, b.key AS key FROM k a JOIN k b ON a.c = b.c AND b.d >= a.d),
sums AS (
  SELECT top, sum(own) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM below JOIN nodes USING (key) LEFT JOIN kids ON kids.parent = key GROUP BY top
)
SELECT a.conv_id, a.depth, b.conv_id AS parent_conv_id, a.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, a.ends_sha256
FROM nodes a LEFT JOIN nodes b ON a.parent = b.key LEFT JOIN kids ON kids.parent = a.key JOIN sums ON sums.top = a.key"""


@_query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of all documents, tried against texts of which a fifth is lower-cased."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.translate("text", upper, upper.lower()))
    return merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), tampered))


def _merkle_sql(levels: int = 6, group_levels: int = 4) -> str:
    """The same by one join and one grouping a level; it holds up to 16 ** levels documents of a source."""

    def leaf(text: str) -> str:
        field = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
        return "sha256(" + " || ".join(field.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    def tree(name: str, first: str, n: int) -> list[str]:
        out = [f"{name}0 AS (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM ({first}))"]
        for k in range(n):
            up = f"SELECT g, i // 16 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE m > 1 GROUP BY 1, 2"
            out.append(f"{name}{k + 1} AS (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM ({up}))")
        tops = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE m = 1" for k in range(n + 1))
        return [*out, f"{name}_top AS ({tops})"]

    def climb(name: str, trees: str, group: str, place: str, n: int) -> list[str]:
        out = []
        for k in range(n):
            sides = " ".join(f"coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i {o} c.{place} // {16**k}), '') AS {s}," for o, s in (("<", "b"), (">", "a")))
            met = f"SELECT c.g, c.p, {sides} FROM c{name}{k} c JOIN {trees}{k} t ON t.m > 1 AND t.g IS NOT DISTINCT FROM {group} AND t.i // 16 = c.{place} // {16 ** (k + 1)} GROUP BY 1, 2"
            both = f"c{name}{k} c LEFT JOIN ({met}) s ON c.g IS NOT DISTINCT FROM s.g AND c.p = s.p"
            out.append(f"c{name}{k + 1} AS (SELECT c.* REPLACE (CASE WHEN s.p IS NULL THEN c.f ELSE sha256(s.b || c.f || s.a) END AS f, c.proof || coalesce(s.b || s.a, '') AS proof) FROM {both})")
        return out

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    doc = f"SELECT doc_id, source AS g, {leaf('text')} AS h, CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} END AS t FROM documents"
    ctes = [f"d AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM ({doc}))"]
    ctes += tree("l", "SELECT g, p AS i, h FROM d", levels)
    ctes += tree("s", "SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, h, g AS o FROM l_top", group_levels)
    ctes.append("cd0 AS (SELECT d.doc_id, d.g, d.p, d.h AS leaf, coalesce(t, d.h) AS f, '' AS proof, s0.i AS place, s0.h AS subroot FROM d JOIN s0 ON d.g IS NOT DISTINCT FROM s0.o)")
    ctes += climb("d", "l", "c.g", "p", levels)
    ctes.append(f"cs0 AS (SELECT * FROM cd{levels})")
    ctes += climb("s", "s", "0", "place", group_levels)
    root = "(SELECT h FROM s_top)"
    return "WITH " + ", ".join(ctes) + f" SELECT doc_id, leaf, subroot, {root} AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = {root} AS verified FROM cs{group_levels}"


ORACLE_SQL["op13_merkle_manifest"] = _merkle_sql()
