"""Queries of the manifest, the secret scan and the conversation trie, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.llm import merkle, prefix_trie, secrets
from oreline.llm.crc_sql import crc32_sql


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return merkle.manifest(docs, tampered=merkle.lower_cased_thirds())


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: Every level of both trees as rows; proofs are the other nodes of a run, and folding walks up through them.
OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, *, coalesce('1' || lang, '0') AS grp,
    CASE WHEN {crc32_sql("doc_id")} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
  FROM documents
), leaves AS (
  SELECT r, doc_id, grp, {_leaf("text")} AS leaf, {_leaf("changed")} AS changed_leaf FROM d
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), up AS (
  SELECT grp, 0 AS lvl, pos, leaf AS h, n FROM placed
  UNION ALL
  SELECT grp, lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM up WHERE n > 1 GROUP BY grp, lvl, pos // 8, n
), subroots AS (
  SELECT grp, h AS subroot, row_number() OVER (ORDER BY encode(grp)) - 1 AS place, count(*) OVER () AS of FROM up WHERE n = 1
), top AS (
  SELECT 0 AS lvl, place AS pos, subroot AS h, of AS n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, pos // 8, n
), sides AS (
  SELECT grp, lvl, pos, coalesce(string_agg(h, '' ORDER BY pos) OVER before, '') AS l, coalesce(string_agg(h, '' ORDER BY pos) OVER after, '') AS r
  FROM (SELECT * FROM up UNION ALL SELECT '' AS grp, * FROM top) WHERE n > 1
  WINDOW before AS (PARTITION BY grp, lvl, pos // 8 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (PARTITION BY grp, lvl, pos // 8 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
), fold AS (
  SELECT r, grp, 0 AS lvl, pos, changed_leaf AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.r, f.grp, f.lvl + 1, f.pos // 8, sha256(s.l || f.h || s.r), f.proof || s.l || s.r FROM fold f JOIN sides s USING (grp, lvl, pos)
), at_subroot AS (
  SELECT f.*, place FROM (SELECT r, max_by(h, lvl) AS h, max_by(proof, lvl) AS proof, any_value(grp) AS grp FROM fold GROUP BY r) f JOIN subroots USING (grp)
), fold_top AS (
  SELECT r, 0 AS lvl, place AS pos, h, proof FROM at_subroot
  UNION ALL
  SELECT f.r, f.lvl + 1, f.pos // 8, sha256(s.l || f.h || s.r), f.proof || s.l || s.r FROM fold_top f JOIN sides s ON s.grp = '' AND s.lvl = f.lvl AND s.pos = f.pos
), ends AS (
  SELECT r, max_by(h, lvl) AS folded_root, sha256(max_by(proof, lvl)) AS proof_sha256 FROM fold_top GROUP BY r
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots USING (grp) JOIN ends USING (r) CROSS JOIN (SELECT h AS root FROM top WHERE n = 1)
"""


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.with_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(secrets.written_spans(base).cast("binary"), 256)
    return found.select("doc_id", *map(count, secrets.KINDS), digest.alias("base_sha256"), secrets.written_spans(F.col("spans")).alias("spans"), "n_unread")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


#: Every prefix of every conversation as a row, and every node met with all its ancestors.
OP13_SQL = f"""
WITH t AS (
  SELECT conv_id, sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS token, strlen(coalesce(text, '')) AS bytes, turn
  FROM conversations WHERE conv_id IS NOT NULL
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, token) - 1 AS i FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {crc32_sql("conv_id")} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 0 AS part, i, token, bytes FROM c JOIN o ON o.conv_id = c.base AND i < h
  UNION ALL SELECT c.conv_id, 1, i, token, bytes FROM c JOIN o ON o.conv_id = c.conv_id AND i >= h
), s AS (
  SELECT conv_id, coalesce(list(token ORDER BY part, i) FILTER (token IS NOT NULL), []) AS tokens, list(bytes ORDER BY part, i) AS sizes FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id
), p AS (
  SELECT conv_id, len(tokens) AS n, d AS depth, tokens[1:d] AS path, coalesce(sizes[d], 0) AS bytes FROM (SELECT *, unnest(range(0, len(tokens) + 1)) AS d FROM s)
), nodes AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM p GROUP BY path, depth
), children AS (
  SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), full_nodes AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.path = c.path
), subtrees AS (
  SELECT path[1:d] AS path, sum((n_children = 0)::INTEGER)::BIGINT AS n_leaves, sum((n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE bytes END)::BIGINT AS saved_tokens
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM full_nodes) GROUP BY 1
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM full_nodes n JOIN subtrees s ON n.path = s.path LEFT JOIN nodes u ON n.depth > 0 AND u.path = n.path[1:n.depth - 1]
"""


def queries() -> dict:
    return {"op11_merkle": op11_merkle, "op12_secrets": op12_secrets, "op13_trie": op13_trie}


def oracle_sql() -> dict[str, str]:
    return {"op11_merkle": OP11_SQL, "op13_trie": OP13_SQL}
