"""Registered queries for the memo tables (2.7). as_of = 2024-01-31 00:00, TTL 24 h."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import memo as M
from threadlens.plans.oracle import sql
from threadlens.plans.registry import register, _v

AS_OF = "2024-01-31 00:00:00"
_LIMIT = f"(TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR)"
_CUR = ("cur", "SELECT url, arg_max(payload, (cached_at, version)) AS payload, max(cached_at) AS cached_at, "
               "max(version) AS version FROM v_memo GROUP BY url")
_LIVE = ("live", f"SELECT * FROM cur WHERE cached_at >= {_LIMIT}")
_KEYS = ("keys", "SELECT DISTINCT CAST(user_id AS VARCHAR) || ':' || "
                 "CASE WHEN event_id % 3 = 0 THEN 'share' ELSE event_type END AS url FROM events")


def _msql(body, extra=()):
    return sql(body, "v_memo", extra=[_CUR, _LIVE, _KEYS, *extra])


def _cur(spark, d):
    return M.current(_v(spark, d).memo(), "url", ("cached_at", "version"))


def _keys(spark, d):
    e = _v(spark, d).t("events")
    k = F.concat(F.col("user_id").cast("string"), F.lit(":"),
                 F.when(F.col("event_id") % 3 == 0, F.lit("share")).otherwise(F.col("event_type")))
    return e.select(k.alias("url")).distinct()


@register("memo_expired", _msql(f"SELECT url, coalesce(cached_at < {_LIMIT}, true) AS expired FROM cur"))
def q_memo_expired(spark, d):
    return _cur(spark, d).select("url", M.is_expired("cached_at", AS_OF, 24).alias("expired"))


@register("memo_lookup", _msql("""
SELECT k.url, l.payload, l.cached_at, l.version, l.url IS NOT NULL AS hit
FROM keys k LEFT JOIN live l USING (url)"""))
def q_memo_lookup(spark, d):
    return M.memo_lookup(_keys(spark, d), _cur(spark, d), "url", AS_OF, 24).select(
        "url", "payload", "cached_at", "version", "hit")


@register("memo_misses", _msql("SELECT url FROM keys WHERE url NOT IN (SELECT url FROM live)"))
def q_memo_misses(spark, d):
    return M.memo_misses(_keys(spark, d), _cur(spark, d), "url", AS_OF, 24)


@register("memo_upsert", sql("""
SELECT url, arg_max(payload, (src, cached_at, version)) AS payload, arg_max(cached_at, (src, cached_at, version)) AS cached_at,
       arg_max(version, (src, cached_at, version)) AS version
FROM (SELECT *, CASE WHEN cached_at < TIMESTAMP '2024-01-16 00:00:00' THEN 0 ELSE 1 END AS src FROM v_memo)
GROUP BY url""", "v_memo"))
def q_memo_upsert(spark, d):
    m = _v(spark, d).memo()
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp_ntz")
    return M.memo_upsert(m.filter(F.col("cached_at") < cut), m.filter(F.col("cached_at") >= cut), "url",
                         ("cached_at", "version"))


def _tables(spark, d):
    v = _v(spark, d)
    cur = _cur(spark, d)
    ocr = cur.select(F.concat(F.lit("ocr:"), "url").alias("image_url"), F.col("payload").alias("extracted_text"),
                     F.timestamp_add("HOUR", F.lit(18), F.col("cached_at")).alias("cached_at"))
    links = v.links().select("url", "title", "content", "source_domain",
                             F.lit("2024-01-30 12:00:00").cast("timestamp_ntz").alias("cached_at"))
    comments = cur.filter(F.lit(False)).select(F.col("url").alias("comment_id"), F.col("url").alias("post_url"),
                                               "cached_at")
    return {"posts": cur, "comments": comments, "ocr_results": ocr, "link_content": links}


_OCR = ("ocr_t", "SELECT 'ocr:' || url AS image_url, cached_at + INTERVAL 18 HOUR AS cached_at FROM cur")


@register("memo_purge", _msql(f"""
SELECT 'posts' AS table_name, count(*) FILTER (WHERE coalesce(cached_at < {_LIMIT}, true)) AS purged,
       count(*) FILTER (WHERE NOT coalesce(cached_at < {_LIMIT}, true)) AS kept FROM cur
UNION ALL SELECT 'comments', 0, 0
UNION ALL SELECT 'ocr_results', count(*) FILTER (WHERE coalesce(cached_at < {_LIMIT}, true)),
       count(*) FILTER (WHERE NOT coalesce(cached_at < {_LIMIT}, true)) FROM ocr_t
UNION ALL SELECT 'link_content', 0, count(*) FROM pages""", [_OCR]))
def q_memo_purge(spark, d):
    _, counts = M.memo_purge(_tables(spark, d), AS_OF, 24)
    return counts


@register("memo_stats", _msql("""
SELECT 'posts' AS table_name, count(*) AS entries FROM cur
UNION ALL SELECT 'comments', 0 UNION ALL SELECT 'ocr_results', count(*) FROM cur
UNION ALL SELECT 'link_content', count(*) FROM pages"""))
def q_memo_stats(spark, d):
    return M.memo_stats(_tables(spark, d))


@register("memo_delete_cascade", _msql("""
SELECT 'posts' AS table_name, url AS entry_key FROM cur WHERE url NOT IN (SELECT DISTINCT CAST(user_id AS VARCHAR) || ':error' FROM events)
UNION ALL
SELECT 'comments', CAST(comment_id AS VARCHAR) FROM (
  SELECT event_id AS comment_id, CAST(user_id AS VARCHAR) || ':' || event_type AS post_url FROM events)
WHERE post_url NOT IN (SELECT DISTINCT CAST(user_id AS VARCHAR) || ':error' FROM events)"""))
def q_memo_delete_cascade(spark, d):
    e = _v(spark, d).t("events")
    comments = e.select(F.col("event_id").alias("comment_id"),
                        F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("post_url"))
    keys = e.select(F.concat(F.col("user_id").cast("string"), F.lit(":error")).alias("url"))
    p, c = M.memo_delete_cascade(_cur(spark, d), comments, keys)
    return (p.select(F.lit("posts").alias("table_name"), F.col("url").alias("entry_key"))
             .unionByName(c.select(F.lit("comments").alias("table_name"),
                                   F.col("comment_id").cast("string").alias("entry_key"))))


@register("memo_clear_all", _msql("SELECT url, payload, cached_at, version FROM cur WHERE false"))
def q_memo_clear_all(spark, d):
    return M.memo_clear_all(_cur(spark, d))


@register("memo_reuse", _msql(f"""
SELECT k.url, coalesce(u.payload, 'computed:' || k.url) AS payload, u.url IS NOT NULL AS from_cache
FROM keys k LEFT JOIN (SELECT * FROM cur WHERE payload NOT LIKE '%"k": 1%' AND cached_at >= {_LIMIT}) u USING (url)"""))
def q_memo_reuse(spark, d):
    cur = _cur(spark, d)
    memo = cur.withColumn("payload", F.when(~F.col("payload").like('%"k": 1%'), F.col("payload")))
    return M.memo_reuse(_keys(spark, d), memo, "url", "payload",
                        lambda miss: miss.select("url", F.concat(F.lit("computed:"), F.col("url")).alias("payload")),
                        AS_OF, 24)
