"""The registered queries of this subpackage: ``QUERIES[name] = (function, oracle SQL or None)``.

Each applies one operator, with its production parameters, to its whole table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm import (chat_views, cover_search, decontaminate, hard_negatives, importance, language_id, mixing,
                            ngram_join, ppm, sharding, site_style, turn_repair, warc)
from threadlens.llm.common import table


def op1_site_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_text(table(spark, sf_dir, "pages"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


def op4_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_views.rotate(table(spark, sf_dir, "conversations"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.ppm_scores(table(spark, sf_dir, "documents"))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.hilbert_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_cover_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_search.top_k(table(spark, sf_dir, "embeddings"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, CASE WHEN coalesce(trim(role), '') = '' THEN 'unknown' ELSE lower(trim(role)) END AS speaker,
        coalesce(text, '') AS text, coalesce(CAST(conv_id AS VARCHAR), '') AS conv FROM conversations),
w AS (SELECT DISTINCT conv, speaker AS perspective FROM t WHERE speaker NOT IN ('system', 'tool', 'unknown')),
r AS (SELECT t.*, perspective, CASE WHEN speaker = perspective THEN 'assistant'
        WHEN speaker IN ('system', 'tool') THEN speaker ELSE 'user' END AS role FROM t JOIN w ON t.conv = w.conv),
n AS (SELECT *, CASE WHEN role = 'user' THEN speaker END AS name FROM r),
h AS (SELECT *, '<|im_start|>' || role || coalesce(' name=' || regexp_replace(name, '\s+', '_', 'g'), '') || chr(10) AS head FROM n),
g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
s AS (SELECT *, row_number() OVER o - 1 AS position,
        coalesce(sum(length(segment)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM g WINDOW o AS (PARTITION BY conv, perspective ORDER BY turn NULLS FIRST, speaker, text))
SELECT conv_id, perspective, position::BIGINT AS position, turn, speaker, role, name, segment, start,
    CASE WHEN role = 'assistant' THEN start + length(head) END AS mask_start,
    CASE WHEN role = 'assistant' THEN start + length(head) + length(text) END AS mask_end
FROM s
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, source,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
        ('0x' || substr(md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13))::BIGINT AS hash
    FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1) AS w
    FROM d GROUP BY source),
r AS (SELECT *, 3.0::DOUBLE * source_size AS cap,
        row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source) AS k FROM s),
p AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM r),
level AS (SELECT arg_min(((SELECT sum(size) FROM d) - before) / rest, k) AS level FROM p
    WHERE ((SELECT sum(size) FROM d) - before) / rest * w <= cap),
t AS (SELECT source, source_size, least(w * level, cap) AS target FROM r, level),
n AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS share FROM t),
slots AS (SELECT source, hash >> 40 AS slot, sum(size) AS words,
        sum(sum(size)) OVER (PARTITION BY source ORDER BY hash >> 40) AS upto FROM d GROUP BY source, hash >> 40),
edge AS (SELECT n.source, min(slot) AS slot, min(upto - words) AS before, any_value((share - floor(share)) * source_size) AS want
    FROM n JOIN slots ON n.source IS NOT DISTINCT FROM slots.source
    WHERE upto > (share - floor(share)) * source_size AND upto - words <= (share - floor(share)) * source_size
      AND (share - floor(share)) * source_size > 0 GROUP BY n.source),
inside AS (SELECT d.source, d.hash, d.size, edge.want, edge.slot, edge.before + coalesce(sum(d.size) OVER (
        PARTITION BY d.source ORDER BY d.hash RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
    FROM d JOIN edge ON d.source IS NOT DISTINCT FROM edge.source AND d.hash >> 40 = edge.slot),
ends AS (SELECT source, coalesce(max(hash + 1) FILTER (WHERE ahead + size / 2.0 <= want), any_value(slot) << 40) AS below
    FROM inside GROUP BY source)
SELECT d.doc_id, d.size, n.source_size, n.target,
    (d.size * (floor(n.share)::BIGINT + CASE WHEN d.hash < coalesce(ends.below, 0) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
LEFT JOIN ends ON d.source IS NOT DISTINCT FROM ends.source
"""

OP11_SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id, o.label = a.label AS same, list_dot_product(a.x, o.x)::BIGINT AS score
    FROM v a JOIN v o ON a.vec_id % 100 = 0 AND o.vec_id <> a.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
    (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""

OP13_SQL = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
    FROM pages),
w AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p),
r AS (SELECT *, payload_bytes >= 100 AND page_id IS DISTINCT FROM first AS again FROM w)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN again THEN first END AS refers_to
FROM r
"""

QUERIES = {
    "op1_site_style": (op1_site_style, None),
    "op2_ngram_jaccard_join": (op2_ngram_jaccard_join, None),
    "op3_mix_sources": (op3_mix_sources, OP3_SQL),
    "op4_quality_resample": (op4_quality_resample, None),
    "op5_perspectives": (op5_perspectives, OP5_SQL),
    "op6_decontaminate": (op6_decontaminate, None),
    "op7_language_id": (op7_language_id, None),
    "op8_ppm": (op8_ppm, None),
    "op9_hilbert_shards": (op9_hilbert_shards, None),
    "op10_cover_search": (op10_cover_search, None),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_turn_repair": (op12_turn_repair, None),
    "op13_warc": (op13_warc, OP13_SQL),
}
