"""Registered queries: synthesis (EN4, EN9), insights (REP4), batch analysis (PL2, AG9),
fetch diagnosis (PL4), report sinks (SNK1-SNK3, SRC5) and the streaming dedupe (ST1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadlens.operators import enrich as EN
from threadlens.operators import report as REP
from threadlens.plans import pipeline as PL
from threadlens.plans.oracle import sql
from threadlens.plans.q_report import AS_OF, _EXEC, _md_sql, _posts, _reports, _rsql
from threadlens.plans.q_scalars import _ID, _KW
from threadlens.plans.q_threads import _tree_sql
from threadlens.plans.registry import register, _v
from threadlens.session import scratch_path
from threadlens.sources import reports as SR
from threadlens.streaming import dedupe as ST


def _synth_responses(spark, d):
    p = _v(spark, d).posts()
    i = F.col("post_id").cast("string")
    obj = F.concat(
        F.lit('{"executive_summary": "summary '), i, F.lit('", "key_issue": "issue '), i,
        F.lit('", "community_consensus": {"validation_status": "validated", "agreement_level": "high"}, '
              '"key_insights": ["plain '), i,
        F.lit('", {"insight": "object '), i, F.lit('", "evidence": "ev", "importance": "high"}, {"evidence": "untitled"}]}'))
    return p.select("post_id", F.when(F.col("post_id") % 2 == 0, obj).otherwise(F.lit("no synthesis")).alias("response"))


_SYNTH = ("synth", """
SELECT post_id, CASE WHEN post_id % 2 = 0 THEN
  '{"executive_summary": "summary ' || CAST(post_id AS VARCHAR) || '", "key_issue": "issue ' || CAST(post_id AS VARCHAR)
  || '", "community_consensus": {"validation_status": "validated", "agreement_level": "high"}, "key_insights": ["plain '
  || CAST(post_id AS VARCHAR) || '", {"insight": "object ' || CAST(post_id AS VARCHAR)
  || '", "evidence": "ev", "importance": "high"}, {"evidence": "untitled"}]}' END AS j FROM v_posts""")


@register("default_synthesis", sql("""
SELECT post_id, coalesce(j->>'$.executive_summary', 'Synthesis unavailable') AS executive_summary,
       coalesce(j->>'$.key_issue', 'Unable to synthesize') AS key_issue,
       coalesce(j->>'$.community_consensus.validation_status', 'unknown') AS validation_status,
       coalesce(j->>'$.community_consensus.validation_status', 'unknown') AS validation,
       CASE WHEN j IS NULL THEN 'Unavailable' END AS context,
       CAST(coalesce(json_array_length(j, '$.key_insights'), 0) AS BIGINT) AS n_key_insights
FROM synth""", "v_posts", extra=[_SYNTH]))
def q_default_synthesis(spark, d):
    s = REP.normalize_synthesis(EN.synthesis_from(F.col("response")))
    x = _synth_responses(spark, d).select("post_id", s.alias("s"))
    return x.select("post_id", F.col("s.executive_summary").alias("executive_summary"),
                    F.col("s.key_issue").alias("key_issue"),
                    F.col("s.community_consensus.validation_status").alias("validation_status"),
                    F.col("s.community_consensus.validation").alias("validation"),
                    F.col("s.context").alias("context"),
                    F.size("s.key_insights").cast("bigint").alias("n_key_insights"))


@register("normalize_insight", sql("""
SELECT post_id, CAST(i - 1 AS BIGINT) AS idx,
       CASE WHEN json_type(e) = 'OBJECT' THEN coalesce(e->>'$.insight', 'Insight') ELSE e->>'$' END AS insight,
       CASE WHEN json_type(e) = 'OBJECT' THEN e->>'$.evidence' END AS evidence,
       CASE WHEN json_type(e) = 'OBJECT' THEN e->>'$.importance' END AS importance,
       json_type(e) = 'OBJECT' AS is_object
FROM (SELECT post_id, unnest(range(1, 4)) AS i, json_extract(j, '$.key_insights[' || CAST(unnest(range(0, 3)) AS VARCHAR) || ']') AS e
      FROM synth WHERE j IS NOT NULL)""", "v_posts", extra=[_SYNTH]))
def q_normalize_insight(spark, d):
    s = EN.synthesis_from(F.col("response"))
    x = _synth_responses(spark, d).select("post_id", F.posexplode(s["key_insights"]).alias("idx", "v"))
    n = REP.normalize_insight("v")
    return x.select("post_id", F.col("idx").cast("bigint").alias("idx"), n["insight"].alias("insight"),
                    n["evidence"].alias("evidence"), n["importance"].alias("importance"),
                    n["is_object"].alias("is_object"))


@register("synthesis_prompt", None)
def q_synthesis_prompt(spark, d):
    """EN4 over the pipeline's annotated comments (rows check: JSON spacing is Spark's)."""
    posts = _posts(spark, d).withColumn("post_annotation", EN.default_post_annotation())
    flat = PL.annotate_comments(_v(spark, d).threads())
    return EN.synthesis_prompt(posts.select("post_id", "title", "post_annotation"), flat)


def _batch_urls(spark, d):
    v = _v(spark, d)
    rp = v.raw_posts().select(F.concat(F.lit("https://reddit.com"), F.col("permalink")).alias("url"))
    return rp.unionByName(v.posts().select("url")).unionByName(v.t("pages").select("url"))


_BURLS = ("urls", """
SELECT 'https://reddit.com' || permalink AS url FROM v_raw_posts UNION ALL SELECT url FROM v_posts
UNION ALL SELECT url FROM pages""")
_BATCH_SQL = f"""
SELECT url AS post_url, pid IS NOT NULL AND pid IN (SELECT CAST(post_id AS VARCHAR) FROM v_posts) AS success,
       CASE WHEN pid IS NULL THEN 'no post id in URL'
            WHEN pid NOT IN (SELECT CAST(post_id AS VARCHAR) FROM v_posts) THEN 'post not found' END AS error
FROM (SELECT url, {_ID} AS pid FROM urls)"""


@register("analyze_batch", sql(_BATCH_SQL, "v_raw_posts", extra=[_BURLS]))
def q_analyze_batch(spark, d):
    return PL.analyze_batch(_batch_urls(spark, d), _reports(spark, d)).select("post_url", "success", "error")


@register("batch_summary", sql(f"""
SELECT count(*) FILTER (WHERE success) AS succeeded, count(*) AS total, bool_and(success) AS all_ok
FROM ({_BATCH_SQL})""", "v_raw_posts", extra=[_BURLS]))
def q_batch_summary(spark, d):
    from threadlens.operators.stats import batch_summary
    return batch_summary(PL.analyze_batch(_batch_urls(spark, d), _reports(spark, d)))


@register("diagnose_fetch", sql(f"""
SELECT p.post_id, array_to_string({_KW.replace('url', 'p.url')}, '|') AS slug_keywords,
       len({_KW.replace('url', 'p.url')}) > 0 AND NOT list_bool_or(list_transform({_KW.replace('url', 'p.url')},
           lambda k: contains(lower(coalesce(p.title, '')), k))) AS slug_title_mismatch,
       coalesce(c.n, 0) AS flattened_count, coalesce(c.n, 0) > 0 AS comments_ok,
       b.comment_id AS best_comment_id, b.score AS best_score
FROM v_posts p
LEFT JOIN (SELECT post_id, count(*) AS n FROM t GROUP BY post_id) c USING (post_id)
LEFT JOIN (SELECT post_id, comment_id, score FROM (
             SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY coalesce(score, 0) DESC, path) AS rn FROM t)
           WHERE rn = 1) b USING (post_id)""", "v_posts", "v_threads", extra=[_tree_sql("v_threads")], recursive=True))
def q_diagnose_fetch(spark, d):
    v = _v(spark, d)
    x = PL.diagnose_fetch(v.posts(), v.threads())
    return x.select("post_id", F.array_join("slug_keywords", "|").alias("slug_keywords"), "slug_title_mismatch",
                    "flattened_count", "comments_ok", F.col("best_comment_id"), F.col("best_score"))


@register("write_reports", _rsql(f"""
SELECT post_id, CAST(post_id AS VARCHAR) AS report_post_id, {_EXEC} AS executive_summary, TRUE AS success,
       CAST(post_id AS VARCHAR) || '.md' AS file_name, {_md_sql()} AS markdown FROM rep"""))
def q_write_reports(spark, d):
    """SNK1-SNK3 + SRC5: write JSON and Markdown reports to the shared folder, read both back."""
    path = scratch_path(spark, f"reports-{uuid.uuid4().hex}")
    SR.save_reports(_reports(spark, d).select("post_id", "report", "markdown"), path, "both")
    back = SR.load_reports(spark, f"{path}/json")
    text = spark.read.schema("post_id string, file_name string, markdown string").json(f"{path}/markdown")
    return back.join(text, "post_id").select(
        F.col("post_id").cast("bigint").alias("post_id"), "file_name", "markdown",
        F.col("report.metadata.post_id").alias("report_post_id"),
        F.col("report.synthesis.executive_summary").alias("executive_summary"),
        F.col("report.success").alias("success"))


@register("stream_dedupe", """
WITH RECURSIVE r AS (SELECT 'https://reddit.com/r/x/comments/' || CAST(user_id AS VARCHAR) || '/' || event_type || '/' AS post_url,
    ts AS requested_at FROM events),
k AS (SELECT post_url, min(requested_at) AS requested_at FROM r GROUP BY post_url
    UNION ALL
    SELECT r.post_url, min(r.requested_at) FROM k JOIN r ON r.post_url = k.post_url
      AND r.requested_at > k.requested_at + INTERVAL 24 HOUR GROUP BY r.post_url, k.requested_at)
SELECT post_url, CAST(requested_at AS TIMESTAMP) AS requested_at FROM k""")
def q_stream_dedupe(spark, d):
    """ST1: requests derived from events (one per event; URL per user and event type) stream
    through the TTL rule; the requests that are due are read back."""
    root = scratch_path(spark, f"stream-{uuid.uuid4().hex}")
    e = _v(spark, d).t("events")
    req = e.select(F.concat(F.lit("https://reddit.com/r/x/comments/"), F.col("user_id").cast("string"),
                            F.lit("/"), F.col("event_type"), F.lit("/")).alias("post_url"),
                   F.col("ts").cast("timestamp").alias("requested_at"))
    req.write.parquet(f"{root}/in")

    def process(batch, epoch):
        batch.write.mode("append").parquet(f"{root}/out")

    q = ST.start(spark, f"{root}/in", f"{root}/ckpt", process, ttl_hours=24)
    if not q.awaitTermination(3600):
        q.stop()
        raise TimeoutError("the dedupe stream did not end within an hour")
    return spark.read.schema(ST.REQUEST_SCHEMA).parquet(f"{root}/out").select(
        "post_url", F.col("requested_at").cast("timestamp_ntz").alias("requested_at"))
