"""Registered queries for trees, ranking, filtering and sampling (2.4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import forest as FO
from threadlens.operators import ranking as R
from threadlens.operators import tree as T
from threadlens.plans.oracle import WS, sql
from threadlens.plans.registry import register, _v


def _tree_sql(src: str, key: str = "seq", max_roots: int | None = None,
              max_depth: int | None = 5) -> tuple[str, str]:
    """Recursive CTE ``t``: reachable comments of ``src`` with depth and path of sibling keys."""
    keyed = f"(SELECT *, {key} AS _key FROM {src})"
    roots = f"SELECT * FROM {keyed} WHERE parent_id IS NULL"
    if max_roots is not None:
        roots = (f"SELECT * EXCLUDE (_r) FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY _key) AS _r "
                 f"FROM ({roots})) WHERE _r <= {max_roots}")
    body = f"""
SELECT r.* EXCLUDE (_key), 0 AS depth, r.comment_id AS root_id, [r._key] AS path FROM ({roots}) r
UNION ALL
SELECT c.* EXCLUDE (_key), t.depth + 1, t.root_id, list_append(t.path, c._key)
FROM {keyed} c JOIN t ON c.post_id = t.post_id AND c.parent_id = t.comment_id
{"" if max_depth is None else f"WHERE t.depth < {max_depth}"}"""
    return ("t", body)


_WORDS = f"len(list_filter(regexp_split_to_array(coalesce(body, ''), '{WS}+'), lambda w: w <> ''))"
_HEUR = (f"((CASE WHEN {_WORDS} >= 20 THEN 1.0::DOUBLE ELSE {_WORDS}::DOUBLE / 20.0::DOUBLE END) * 0.5::DOUBLE "
         f"+ (1.0::DOUBLE - least(depth::DOUBLE * 0.05::DOUBLE, 0.5::DOUBLE)) * 0.3::DOUBLE) "
         f"+ score::DOUBLE / 1000.0::DOUBLE")


@register("tree_depth", sql("SELECT post_id, comment_id, CAST(depth AS BIGINT) AS depth FROM t",
                            "v_chain", extra=[_tree_sql("v_chain")], recursive=True))
def q_tree_depth(spark, d):
    t = T.build_tree(_v(spark, d).chain())
    return t.select("post_id", "comment_id", F.col("depth").cast("bigint").alias("depth"))


@register("tree_preorder", sql("""
SELECT post_id, comment_id, CAST(depth AS BIGINT) AS depth, root_id,
       row_number() OVER (PARTITION BY post_id ORDER BY path) AS preorder FROM t""",
                               "v_threads", extra=[_tree_sql("v_threads")], recursive=True))
def q_tree_preorder(spark, d):
    t = T.preorder(T.build_tree(_v(spark, d).threads()))
    return t.select("post_id", "comment_id", F.col("depth").cast("bigint").alias("depth"), "root_id", "preorder")


_LOST = ("o", """
SELECT c.post_id, c.comment_id FROM v_deep c WHERE c.parent_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM v_deep p WHERE p.post_id = c.post_id AND p.comment_id = c.parent_id)
UNION ALL
SELECT c.post_id, c.comment_id FROM v_deep c JOIN o ON c.post_id = o.post_id AND c.parent_id = o.comment_id""")


@register("tree_depth_deep", sql("""
SELECT v.post_id, v.comment_id, t.root_id, CAST(t.depth AS BIGINT) AS depth,
       CASE WHEN t.comment_id IS NOT NULL THEN 'ok' WHEN o.comment_id IS NOT NULL THEN 'orphan' ELSE 'cycle' END AS status
FROM v_deep v LEFT JOIN t USING (post_id, comment_id) LEFT JOIN o USING (post_id, comment_id)""",
                                 "v_deep", extra=[_tree_sql("v_deep", max_depth=None), _LOST], recursive=True))
def q_tree_depth_deep(spark, d):
    return FO.climb(_v(spark, d).deep()).select("post_id", "comment_id", "root_id", "depth", "status")


@register("tree_preorder_deep", sql("""
SELECT post_id, comment_id, CAST(depth AS BIGINT) AS depth,
       row_number() OVER (PARTITION BY post_id ORDER BY path) AS preorder FROM t""",
                                    "v_deep", extra=[_tree_sql("v_deep", max_depth=None)], recursive=True))
def q_tree_preorder_deep(spark, d):
    t = FO.preorder_any(FO.forest(_v(spark, d).deep()))
    return t.select("post_id", "comment_id", F.col("depth").cast("bigint").alias("depth"), "preorder")


@register("nested_replies", sql("""
SELECT post_id, comment_id, parent_id, CAST(depth AS BIGINT) AS depth,
       row_number() OVER (PARTITION BY post_id ORDER BY path) - 1 AS seq, score, body FROM t""",
                                "v_nested", extra=[_tree_sql("v_nested", max_depth=None)], recursive=True))
def q_nested_replies(spark, d):
    t = FO.from_nested_any(_v(spark, d).nested(), {"score": "bigint", "body": "string"})
    return t.select("post_id", "comment_id", "parent_id", F.col("depth").cast("bigint").alias("depth"), "seq", "score", "body")


@register("tree_order_top", sql("""
SELECT post_id, comment_id, row_number() OVER (PARTITION BY post_id ORDER BY path) AS preorder FROM t""",
                                "v_comments", extra=[_tree_sql("v_comments", key="{'k': -score, 's': seq}")],
                                recursive=True))
def q_tree_order_top(spark, d):
    t = T.preorder(T.build_tree(_v(spark, d).comments(), order="top"))
    return t.select("post_id", "comment_id", "preorder")


@register("root_limit", sql("SELECT post_id, comment_id, CAST(depth AS BIGINT) AS depth FROM t",
                            "v_comments", extra=[_tree_sql("v_comments", max_roots=1)], recursive=True))
def q_root_limit(spark, d):
    t = T.root_limit(_v(spark, d).comments(), n=1)
    return t.select("post_id", "comment_id", F.col("depth").cast("bigint").alias("depth"))


@register("root_limit_threads", sql("SELECT post_id, comment_id, CAST(depth AS BIGINT) AS depth FROM t",
                                    "v_threads", extra=[_tree_sql("v_threads", max_roots=100)], recursive=True))
def q_root_limit_threads(spark, d):
    t = T.root_limit(_v(spark, d).threads(), n=100)
    return t.select("post_id", "comment_id", F.col("depth").cast("bigint").alias("depth"))


@register("heuristic_score", sql(f"SELECT post_id, comment_id, {_HEUR} AS heuristic FROM t",
                                 "v_threads", extra=[_tree_sql("v_threads")], recursive=True))
def q_heuristic_score(spark, d):
    t = T.build_tree(_v(spark, d).threads())
    return t.select("post_id", "comment_id", R.heuristic_score().alias("heuristic"))


@register("pre_filter", sql(f"""
SELECT post_id, comment_id, rank, heuristic FROM (
  SELECT post_id, comment_id, {_HEUR} AS heuristic,
         CAST(row_number() OVER (PARTITION BY post_id ORDER BY {_HEUR} DESC, path) AS BIGINT) AS rank FROM t)
WHERE rank <= 10""", "v_threads", extra=[_tree_sql("v_threads")], recursive=True))
def q_pre_filter(spark, d):
    t = T.build_tree(_v(spark, d).threads())
    return R.pre_filter(t, 10).select("post_id", "comment_id", "rank", "heuristic")


@register("filter_quality", sql("""
SELECT post_id, comment_id, quality_score FROM v_enriched WHERE coalesce(quality_score, 0) >= 2.0""", "v_enriched"))
def q_filter_quality(spark, d):
    return R.filter_quality(_v(spark, d).enriched(), 2.0).select("post_id", "comment_id", "quality_score")


@register("top_comments", sql("""
SELECT post_id, rank, comment_id, weight FROM (
  SELECT post_id, comment_id, coalesce(relevance_score, 0) * CAST(coalesce(score, 0) AS DOUBLE) AS weight,
         CAST(row_number() OVER (PARTITION BY post_id
              ORDER BY coalesce(relevance_score, 0) * CAST(coalesce(score, 0) AS DOUBLE) DESC, seq) AS BIGINT) AS rank
  FROM v_enriched WHERE coalesce(quality_score, 0) >= 2.0)
WHERE rank <= 10""", "v_enriched"))
def q_top_comments(spark, d):
    q = R.filter_quality(_v(spark, d).enriched(), 2.0)
    return R.top_comments(q, 10).select("post_id", "rank", "comment_id", "weight")


@register("best_comment", sql("""
SELECT post_id, comment_id AS best_comment_id, score AS best_score FROM (
  SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY coalesce(score, 0) DESC, path) AS rn FROM t)
WHERE rn = 1""", "v_threads", extra=[_tree_sql("v_threads")], recursive=True))
def q_best_comment(spark, d):
    t = T.build_tree(_v(spark, d).threads())
    return R.best_comment(t).select("post_id", "best_comment_id", F.col("best_score"))


@register("hot_posts", sql("""
SELECT subreddit, rank, post_id, title, url, score, num_comments FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY subreddit ORDER BY score DESC, post_id) AS BIGINT) AS rank
  FROM v_posts) WHERE rank <= 5""", "v_posts"))
def q_hot_posts(spark, d):
    return R.hot_posts(_v(spark, d).posts(), 5).select("subreddit", "rank", "post_id", "title", "url",
                                                      "score", "num_comments")


@register("sampling_strategy", sql("""
SELECT post_id, CASE WHEN num_comments < 50 THEN 'all' WHEN num_comments < 500 THEN 'top_plus_sampling'
                     ELSE 'top_clustering' END AS strategy,
       CAST(CASE WHEN num_comments < 50 THEN NULL WHEN num_comments < 500 THEN 100 ELSE 200 END AS BIGINT) AS max_comments,
       CAST(0 AS BIGINT) AS more_limit
FROM v_posts""", "v_posts"))
def q_sampling_strategy(spark, d):
    p = _v(spark, d).posts()
    return p.select("post_id", R.sampling_strategy("num_comments").alias("s")).select("post_id", "s.*")


@register("apply_sampling", sql("""
SELECT post_id, comment_id, CAST(CASE WHEN n <= 20 THEN src WHEN rn <= 14 THEN rn ELSE (rn - 15) // step + 15 END AS BIGINT)
       AS sample_pos
FROM (SELECT *, greatest((n - 14) // 6, 1) AS step FROM (
        SELECT post_id, comment_id, count(*) OVER (PARTITION BY post_id) AS n,
               row_number() OVER (PARTITION BY post_id ORDER BY coalesce(score, 0) DESC, seq) AS rn,
               row_number() OVER (PARTITION BY post_id ORDER BY seq) AS src
        FROM v_enriched))
WHERE n <= 20 OR rn <= 14 OR ((rn - 15) % step = 0 AND (rn - 15) // step < 6)""", "v_enriched"))
def q_apply_sampling(spark, d):
    return R.apply_sampling(_v(spark, d).enriched(), 20).select("post_id", "comment_id", "sample_pos")


@register("filter_quality_labels", sql("""
SELECT d.doc_id AS comment_id, CAST(d.doc_id % 20 AS BIGINT) AS post_id, CAST(l.quality AS DOUBLE) * 10.0 AS quality_score
FROM documents d JOIN labels l USING (doc_id) WHERE coalesce(CAST(l.quality AS DOUBLE) * 10.0, 0) >= 5.0"""))
def q_filter_quality_labels(spark, d):
    """RK3 with the labels table as the quality source (quality 0/1 scaled to 0/10)."""
    v = _v(spark, d)
    c = v.threads().join(v.t("labels").select(F.col("doc_id").alias("comment_id"),
                                              (F.col("quality").cast("double") * 10.0).alias("quality_score")),
                         "comment_id")
    return R.filter_quality(c, 5.0).select("comment_id", "post_id", "quality_score")
