"""The registered queries of the package: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.llm import (
    chat, decontaminate, fingerprints, hmm_lm, html_main, jaccard_join, packed_ids, packing, periodic_runs, prefix_trie, suffix_dedup, token_counts, toxicity)
from quillgrid.llm.common import held_out, small_batches, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


#: A conversation whose texts hold the strings of common templates.
_TRICKY = "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRICKY).alias("text"))
    done = chat.format_chat(chat.as_records(rows.unionByName(extra)), "record")
    turns = chat.read_back(F.col("formatted"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = chat.masked_text(F.col("formatted"), F.col("loss"))
    read = done.select("conv_id", "formatted", turns.alias("turns"), told.alias("told"), masked.alias("masked"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2("told", 256).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, 14 + length(role) + length(text)
    + 2 * length(role) - length(replace(replace(role, '\', ''), '#', '')) - length(replace(replace(role, '<', ''), ':', ''))
    + 2 * length(text) - length(replace(replace(text, '\', ''), '#', '')) - length(replace(text, '<', '')) AS chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(COALESCE(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(COALESCE(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def op3_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~toxicity.is_held_out())
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", toxicity.is_held_out().alias("held_out"), "score", "predicted")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.counts(docs.withColumn("edits", token_counts.sample_edits(F.col("text"), F.col("doc_id"))))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = held_out("doc_id", 7, 2)
    scored = hmm_lm.score(table(spark, sf_dir, "documents"), ~held)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt_paths(table(spark, sf_dir, "conversations")))


#: crc32 of a decimal id, bit by bit: a digit is put in, then eight steps (-1) follow.
_CRC32 = """
CREATE_CRC AS (
  SELECT conv_id, xor(list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
        lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) AS crc
  FROM (SELECT DISTINCT conv_id FROM turns))
"""

# A node's leaves and savings are sums over its members: one for each leaf's smallest member, and each turn at which a member is not the
# smallest of its node.
_OP11_SQL = f"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (
      PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(CAST(length(role) AS VARCHAR) || ':' || role || text)) AS i
  FROM (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
{_CRC32.strip().replace("CREATE_CRC", "crcs")},
convs AS (
  SELECT c.conv_id, crc % 6 AS h, (SELECT count(*) FROM turns t WHERE t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= crc % 6) AS k FROM crcs c),
rebuilt AS (
  SELECT c.conv_id, t.i AS d, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, c.k + t.i - c.h AS d, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
named AS (
  SELECT conv_id, d, length(text) AS size,
    list(length(role) || ':' || role || ':' || length(text) || ':' || text) OVER (PARTITION BY conv_id ORDER BY d) AS node
  FROM rebuilt),
members AS (
  SELECT conv_id, 0 AS d, 0 AS size, CAST([] AS VARCHAR[]) AS node FROM convs UNION ALL SELECT conv_id, d, size, node FROM named),
ends AS (SELECT conv_id, max(d) AS last FROM members GROUP BY conv_id),
nodes AS (SELECT node, d, min(conv_id) AS least, count(*) AS n, max(size) AS size FROM members GROUP BY node, d),
kids AS (
  SELECT p.node, count(*) AS children FROM nodes c JOIN nodes p ON p.d = c.d - 1 AND p.node = c.node[1:len(c.node) - 1] GROUP BY p.node),
placed AS (
  SELECT m.conv_id, m.d, m.node, n.least, n.size, e.last,
    CASE WHEN m.d = e.last AND n.least = m.conv_id AND k.children IS NULL THEN 1 ELSE 0 END AS leaf,
    CASE WHEN n.least = m.conv_id THEN 0 ELSE n.size END AS saved
  FROM members m JOIN nodes n ON n.node = m.node AND n.d = m.d JOIN ends e ON e.conv_id = m.conv_id LEFT JOIN kids k ON k.node = m.node),
summed AS (
  SELECT *, sum(leaf) OVER w AS leaves_on, sum(saved) OVER w AS saved_on FROM placed
  WINDOW w AS (PARTITION BY conv_id ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT s.least AS conv_id, s.d AS depth, p.least AS parent_conv_id, count(*) AS n_convs, COALESCE(any_value(k.children), 0) AS n_children,
  CAST(sum(leaves_on) AS BIGINT) AS n_leaves, CAST(sum(saved_on) AS BIGINT) AS saved_tokens,
  sha256(COALESCE(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) FILTER (WHERE s.d = s.last), '')) AS ends_sha256
FROM summed s LEFT JOIN kids k ON k.node = s.node LEFT JOIN nodes p ON p.d = s.d - 1 AND p.node = s.node[1:len(s.node) - 1]
GROUP BY s.node, s.least, s.d, p.least
"""


def op12_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.round_trip(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.collapse(table(spark, sf_dir, "documents"), sample_edit=True)


def _prepared(query: Query) -> Query:
    return lambda spark, sf_dir: query(small_batches(spark), sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: _prepared(f) for f in (
        op1_fingerprints, op2_chat_format, op3_html_main_text, op4_jaccard_join, op5_best_fit_packing, op6_toxicity, op7_decontaminate,
        op8_token_counts, op9_suffix_dedup, op10_hmm_lm, op11_prefix_trie, op12_packed_ids, op13_periodic_runs)}


def oracles() -> dict[str, str]:
    return {"op2_chat_format": _OP2_SQL, "op11_prefix_trie": _OP11_SQL}
