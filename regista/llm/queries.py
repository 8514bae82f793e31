"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regista.llm import chat, fingerprints, langid, line_dedup, mixing, near_dedup, packing, prefix_trie, private_data, quality, sharding, spelling, toxicity
from regista.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_components(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(table(spark, sf_dir, "documents"))


def _spans(column: str) -> Column:
    return F.array_join(F.transform(column, lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",").alias(column)


def op4_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against itself with one answer replaced by its neighbour's; spans as start-end,start-end."""
    pairs = chat.format_preferences(*chat.contrasted(table(spark, sf_dir, "conversations")))
    return pairs.select(F.col("pair_id").alias("conv_id"), "n_common", "prompt", "chosen", "rejected", _spans("chosen_spans"), _spans("rejected_spans"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_data.private_data(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_sharding,
        op3_fingerprints,
        op4_preference_format,
        op5_near_dedup,
        op6_packing,
        op7_language_id,
        op8_quality_rules,
        op9_toxicity,
        op10_mixing,
        op11_prefix_trie,
        op12_spelling_variants,
        op13_private_data,
    )
}



def _crc32(codes: str) -> str:
    """SQL for the unsigned crc32 of a list of bytes, bit by bit."""
    bit = "CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    byte = f"list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: {bit})"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST({codes} AS BIGINT[])), lambda a, b: {byte}), 4294967295)"


#: The others have no SQL: MinHash bands, curve and rank tables, hashed features, pivotal draws, message passing and tokenizers have no counterpart in it, and tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_preference_format": """
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), answers AS (
  SELECT conv_id, pos, text, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n
  FROM t WHERE role = 'assistant'
), own AS (
  SELECT conv_id, pos, text, row_number() OVER (ORDER BY conv_id) - 1 AS r, count(*) OVER () AS m FROM answers WHERE k = conv_id % n
), swap AS (
  SELECT a.conv_id, a.pos, b.text AS other FROM own a JOIN own b ON b.r = (a.r + 1) % a.m WHERE a.text IS DISTINCT FROM b.text
), cut AS (
  SELECT t.conv_id, coalesce(min(swap.pos), count(*)) AS cut, min(swap.other) AS other FROM t LEFT JOIN swap USING (conv_id) GROUP BY t.conv_id
), sides AS (
  SELECT conv_id, cut, pos, role, '<|' || coalesce(role, '') || '|>' || chr(10) AS head,
         coalesce(text, '') || '<|end|>' || chr(10) AS c, coalesce(CASE WHEN pos = cut THEN other ELSE text END, '') || '<|end|>' || chr(10) AS j
  FROM t JOIN cut USING (conv_id)
), placed AS (
  SELECT *, sum(length(head || c)) OVER w AS ec, sum(length(head || j)) OVER w AS ej FROM sides
  WINDOW w AS (PARTITION BY conv_id, pos >= cut ORDER BY pos)
)
SELECT conv_id, CAST(any_value(cut) AS INTEGER) AS n_common,
       coalesce(string_agg(head || c, '' ORDER BY pos) FILTER (pos < cut), '') AS prompt,
       coalesce(string_agg(head || c, '' ORDER BY pos) FILTER (pos >= cut), '') AS chosen,
       coalesce(string_agg(head || j, '' ORDER BY pos) FILTER (pos >= cut), '') AS rejected,
       coalesce(string_agg((ec - length(c)) || '-' || ec, ',' ORDER BY pos) FILTER (pos >= cut AND role = 'assistant'), '') AS chosen_spans,
       coalesce(string_agg((ej - length(j)) || '-' || ej, ',' ORDER BY pos) FILTER (pos >= cut AND role = 'assistant'), '') AS rejected_spans
FROM placed GROUP BY conv_id
""",
    "op11_prefix_trie": f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS b, {_crc32("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda q: ord(q))")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.b AND pos <= h
  UNION ALL SELECT conv_id, pos, role, text FROM c JOIN t USING (conv_id) WHERE pos > h
), s AS (
  SELECT conv_id, row_number() OVER w AS depth, list(md5(role || chr(1) || text)) OVER w AS path, strlen(text) AS bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
  UNION ALL SELECT conv_id, 0, [], 0 FROM c
), ended AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM s
), n AS (
  SELECT path, depth, path[1:depth - 1] AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '') AS ends
  FROM ended GROUP BY path, depth
), kids AS (
  SELECT up, count(*) AS k FROM n WHERE depth > 0 GROUP BY up
), told AS (
  SELECT n.*, coalesce(k, 0) AS n_children FROM n LEFT JOIN kids ON kids.up = n.path
), tree AS (
  SELECT s.path, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.bytes) AS saved FROM told b JOIN s ON s.conv_id = b.conv_id AND s.depth <= b.depth GROUP BY s.path
)
SELECT a.conv_id, a.depth, p.conv_id AS parent_conv_id, a.n_convs, a.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM told a JOIN tree ON tree.path = a.path LEFT JOIN told p ON a.depth > 0 AND p.path = a.up
""",
    "op12_spelling_variants": f"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), told AS (
  SELECT run, n, {_crc32("flatten(list_transform(string_split(id || ':' || run, ''), lambda q: CASE WHEN ord(q) < 128 THEN [ord(q)] ELSE [195, ord(q) - 64] END))")} AS h
  FROM (SELECT id, run, count(*) AS n FROM runs GROUP BY id, run)
), v AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM told)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), gaps AS (
  SELECT word, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM v, unnest(range(length(word))) AS u(k)
), near AS (
  SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.k = b.k AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT g.word, v.word FROM gaps g JOIN v ON v.word = g.rest
  UNION SELECT v.word, g.word FROM gaps g JOIN v ON v.word = g.rest
), best AS (
  SELECT near.word, other, b.n AS m, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY b.n DESC, other) AS place FROM near JOIN v b ON b.word = other
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * v.n THEN other END AS form, CASE WHEN m >= 5 * v.n THEN m END AS form_n FROM v LEFT JOIN best ON best.word = v.word AND place = 1
), onward AS (
  SELECT word, word AS root FROM f UNION ALL SELECT o.word, f.form FROM onward o JOIN f ON f.word = o.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, o.root, f.n, f.n_near, f.form_n FROM f JOIN onward o ON o.word = f.word JOIN f e ON e.word = o.root WHERE e.form IS NULL
""",
}
