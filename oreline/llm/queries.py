"""Queries of the corpus operators over the driver's tables.

Each reads its whole table with ``spark.read`` and derives the digest columns
of its contract from the operator's real output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oreline.llm import fertility, langid, mixing, pii, quality, sentencepiece_bpe, simhash, structure_queries, suffix_dedup, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_spans(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    digest = F.sha2(pii.written_spans(base).cast("binary"), 256)
    return found.select("doc_id", *map(count, pii.KINDS), digest.alias("base_sha256"), pii.written_spans(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantised(_table(spark, sf_dir, "embeddings"))
    return topk.exact_top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


#: Exact search over whole numbers is plain SQL on a small table.
OP2_SQL = """
WITH vectors AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.encode_decode(_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_repeats(_table(spark, sf_dir, "documents"))


#: All 400-byte windows at once, on hexadecimal text: for small tables.
OP5_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT r, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT r, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1
), islands AS (
  SELECT r, min(i) AS s, max(i) + 400 AS e FROM (
    SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM (
      SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM repeated))
  GROUP BY r, g
), gaps AS (
  SELECT r, s, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY s), 0) AS before FROM islands
), cut AS (
  SELECT r, sum(e - s) AS removed, count(*) AS spans, max(e) AS last, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS front
  FROM gaps JOIN d USING (r) GROUP BY r
)
SELECT doc_id, n AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN cut USING (r)
"""


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fertility.judged(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(_table(spark, sf_dir, "documents"), keep=("doc_id",))
    return mix.select("row.doc_id", "size", "source_size", "target", "taken")


#: The mix as set operations: levels, quotients and blocks are all enumerated.
OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5(concat('8:', coalesce(doc_id::VARCHAR, ''), ':', coalesce(text, ''))) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS z FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][1 + place % 3] AS weight FROM (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place FROM s)
), levels AS (
  SELECT *, min(weight * (total - spent) > 3 * z * (weights - used)) OVER (ORDER BY 3 * z / weight, place) AS capped FROM (
    SELECT *, sum(z) OVER () AS total, sum(weight) OVER () AS weights,
      coalesce(sum(3 * z) OVER before, 0) AS spent, coalesce(sum(weight) OVER before, 0) AS used
    FROM w WINDOW before AS (ORDER BY 3 * z / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
), goals AS (
  SELECT source, place, z, weight, capped, total - coalesce(sum(3 * z) FILTER (capped) OVER (), 0) AS rest, sum(weight) FILTER (NOT capped) OVER () AS of_rest FROM levels
), seats AS (
  SELECT place, count(*) FILTER (line <= rest // 64) AS won, bool_or(line = rest // 64 + 1) AS next FROM (
    SELECT place, rest, row_number() OVER (ORDER BY weight / (2 * k + 1) DESC, place, k) AS line
    FROM (SELECT place, weight, rest, unnest(range(0, (rest // 64 + 1)::BIGINT)) AS k FROM goals WHERE NOT capped))
  GROUP BY place
), quota AS (
  SELECT source, z, CASE WHEN capped THEN (3 * z)::DOUBLE ELSE (weight * rest)::DOUBLE / of_rest::DOUBLE END AS target,
    least(3 * z, CASE WHEN capped THEN 3 * z ELSE coalesce(won, 0) * 64 + CASE WHEN next THEN rest % 64 ELSE 0 END END)::BIGINT AS q
  FROM goals LEFT JOIN seats USING (place)
), pass AS (
  SELECT *, q // greatest(z, 1) AS passes, q % greatest(z, 1) AS left_over FROM quota
), blocks AS (
  SELECT source, left_over, z, j, j // 4096 AS shard, least(64, z - 64 * j) AS n, least(262144, z - 262144 * (j // 4096)) AS shard_words
  FROM (SELECT *, unnest(range(0, (z + 63) // 64)) AS j FROM pass)
), shard_line AS (
  SELECT source, shard, line, left_over FROM (
    SELECT source, shard, left_over, row_number() OVER (PARTITION BY source ORDER BY n < 64, shard_words / (2 * k + 1) DESC, shard) AS line
    FROM (SELECT *, row_number() OVER (PARTITION BY source, shard ORDER BY j) - 1 AS k FROM blocks))
), shard_seats AS (
  SELECT source, shard, count(*) FILTER (line <= left_over // 64) AS won, bool_or(line = left_over // 64 + 1) AS next FROM shard_line GROUP BY source, shard
), chosen AS (
  SELECT source, j, CASE WHEN rank < won THEN 64 WHEN rank = won AND next THEN left_over % 64 ELSE 0 END AS cut FROM (
    SELECT b.*, won, next, CASE WHEN n = 64 THEN (j % 4096 + b.shard * 7919 + 8) % (shard_words // 64) ELSE shard_words // 64 END AS rank
    FROM blocks b JOIN shard_seats t ON b.source IS NOT DISTINCT FROM t.source AND b.shard = t.shard)
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
), of_rest AS (
  SELECT r, sum(greatest(0, least(start + size, 64 * c.j + c.cut) - greatest(start, 64 * c.j))) AS words
  FROM (SELECT r, source, start, size, unnest(range(start // 64, (start + size + 63) // 64)) AS j FROM placed WHERE size > 0) p
  JOIN chosen c ON p.source IS NOT DISTINCT FROM c.source AND p.j = c.j GROUP BY r
)
SELECT doc_id, size, z AS source_size, target, (passes * size + coalesce(words, 0))::BIGINT AS taken
FROM d LEFT JOIN of_rest USING (r) JOIN pass ON d.source IS NOT DISTINCT FROM pass.source
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": op1_pii,
        "op2_topk": op2_topk,
        "op3_toxicity": op3_toxicity,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_fertility": op6_fertility,
        "op7_langid": op7_langid,
        "op8_mixing": op8_mixing,
        "op9_simhash": op9_simhash,
        "op10_quality": op10_quality,
        **structure_queries.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_topk": OP2_SQL, "op5_suffix_dedup": OP5_SQL, "op8_mixing": OP8_SQL, **structure_queries.oracle_sql()}
