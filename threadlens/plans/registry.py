"""Named queries: each is a Spark DataFrame over the test tables plus its DuckDB oracle.

``QUERIES[name] = (fn(spark, sf_dir) -> DataFrame, oracle_sql | None)``. Every query reads
the given tables (or views Spark derives from them) whole; integer outputs are BIGINT and
every computed column carries the same alias in both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.operators import stats
from threadlens.plans.oracle import sql
from threadlens.sources.tables import Views

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, oracle: str | None):
    def deco(fn):
        QUERIES[name] = (fn, oracle)
        return fn
    return deco


_VIEWS: dict = {}
_PLANS: dict = {}


def _session_key(spark, sf_dir):
    return (spark.sparkContext.applicationId, id(spark), sf_dir)


def _v(spark, sf_dir) -> Views:
    """The views of one folder, shared by all queries of a session (table reads happen once)."""
    k = _session_key(spark, sf_dir)
    if k not in _VIEWS:
        _VIEWS[k] = Views(spark, sf_dir)
    return _VIEWS[k]


def shared_plan(fn):
    """Build a (lazy) DataFrame once per session and folder; queries that start from the same
    plan reuse the object instead of re-constructing it. No data is cached."""
    def wrapper(spark, sf_dir):
        k = (fn.__module__, fn.__name__, *_session_key(spark, sf_dir))
        if k not in _PLANS:
            _PLANS[k] = fn(spark, sf_dir)
        return _PLANS[k]
    wrapper.__name__, wrapper.__doc__ = fn.__name__, fn.__doc__
    return wrapper


# ---------------------------------------------------------------- aggregations (2.6)

@register("sentiment_distribution", sql("""
SELECT post_id, coalesce(toward_op, 'neutral') AS toward_op, count(*) AS n
FROM v_enriched GROUP BY ALL""", "v_enriched"))
def q_sentiment_distribution(spark, d):
    return stats.sentiment_distribution(_v(spark, d).enriched())


@register("tone_distribution", sql("""
SELECT post_id, coalesce(overall_tone, 'neutral') AS overall_tone, count(*) AS n
FROM v_enriched GROUP BY ALL""", "v_enriched"))
def q_tone_distribution(spark, d):
    return stats.tone_distribution(_v(spark, d).enriched())


@register("intent_distribution", sql("""
SELECT post_id, coalesce(intent_primary, 'UNKNOWN') AS intent_primary, count(*) AS n
FROM v_enriched GROUP BY ALL""", "v_enriched"))
def q_intent_distribution(spark, d):
    return stats.intent_distribution(_v(spark, d).enriched())


@register("label_distributions", sql("""
SELECT post_id, kind, label, count(*) AS n FROM (
  SELECT post_id, 'sentiment' AS kind, coalesce(toward_op, 'neutral') AS label FROM v_enriched
  UNION ALL SELECT post_id, 'tone', coalesce(overall_tone, 'neutral') FROM v_enriched
  UNION ALL SELECT post_id, 'intent', coalesce(intent_primary, 'UNKNOWN') FROM v_enriched)
GROUP BY ALL""", "v_enriched"))
def q_label_distributions(spark, d):
    return stats.distributions(_v(spark, d).enriched())


def _half_even_pct_sql(c: str, n: str) -> str:
    q, r = f"(({c}) * 1000 // ({n}))", f"(({c}) * 1000 % ({n}))"
    return (f"(CASE WHEN ({n}) > 0 THEN {q} + CASE WHEN 2 * {r} > ({n}) OR (2 * {r} = ({n}) AND {q} % 2 = 1) "
            f"THEN 1 ELSE 0 END ELSE 0 END) / 10.0")


@register("theme_percentages", sql(f"""
SELECT post_id, CAST(rank AS BIGINT) AS rank, intent_primary AS theme, n,
       {_half_even_pct_sql('n', 'total')} AS pct
FROM (SELECT *, sum(n) OVER (PARTITION BY post_id) AS total,
             row_number() OVER (PARTITION BY post_id ORDER BY n DESC, intent_primary) AS rank
      FROM (SELECT post_id, coalesce(intent_primary, 'UNKNOWN') AS intent_primary, count(*) AS n
            FROM v_enriched GROUP BY ALL))
WHERE rank <= 5""", "v_enriched"))
def q_theme_percentages(spark, d):
    return stats.theme_percentages(_v(spark, d).enriched())


@register("quality_counts", sql(f"""
SELECT post_id, count(*) AS total_processed, count(*) AS total_fetched,
       count(*) FILTER (WHERE coalesce(quality_score, 0) >= 2.0) AS high_quality_count,
       {_half_even_pct_sql('count(*) FILTER (WHERE coalesce(quality_score, 0) >= 2.0)', 'count(*)')}
         AS high_quality_percentage
FROM v_enriched GROUP BY post_id""", "v_enriched"))
def q_quality_counts(spark, d):
    return stats.quality_counts(_v(spark, d).enriched(), threshold=2.0)


@register("all_insights", sql("""
SELECT DISTINCT post_id, insight FROM v_enriched
WHERE coalesce(quality_score, 0) >= 5.0 AND insight IS NOT NULL""", "v_enriched"))
def q_all_insights(spark, d):
    e = _v(spark, d).enriched().withColumn("key_insights", F.array("insight"))
    from threadlens.operators.ranking import filter_quality
    return stats.distinct_union(filter_quality(e, 5.0), "key_insights", "insight")


@register("merge_insights", sql("""
SELECT post_id, arg_min(insight, src * 2 + pos) AS insight, min(src * 2 + pos) // 2 AS first_src,
       CAST(min(src * 2 + pos) % 2 AS BIGINT) AS first_pos
FROM (SELECT post_id, seq AS src, unnest([0, 1]) AS pos,
             unnest([insight, upper(substring(insight, 1, 1)) || substring(insight, 2)]) AS insight
      FROM v_enriched)
GROUP BY post_id, lower(regexp_replace(insight, '^\\s+|\\s+$', '', 'g'))""", "v_enriched"))
def q_merge_insights(spark, d):
    e = _v(spark, d).enriched()
    e = e.withColumn("lists", F.array("insight", F.concat(F.upper(F.substring("insight", 1, 1)),
                                                          F.substring("insight", 2, 1 << 30))))
    return stats.merge_insights(e, "lists", "seq")


@register("sentiment_percentage", sql("""
SELECT post_id, toward_op, n,
       CASE WHEN sum(n) OVER (PARTITION BY post_id) = 0 THEN 0.0
            ELSE n / sum(n) OVER (PARTITION BY post_id) * 100.0 END AS pct
FROM (SELECT post_id, coalesce(toward_op, 'neutral') AS toward_op, count(*) AS n
      FROM v_enriched GROUP BY ALL)""", "v_enriched"))
def q_sentiment_percentage(spark, d):
    return stats.sentiment_percentage(stats.sentiment_distribution(_v(spark, d).enriched()))


@register("estimate_time", sql("""
SELECT subreddit, count(*) AS posts, sum(10.0 + CAST(num_comments AS DOUBLE) * 0.5) AS est_seconds
FROM v_posts GROUP BY subreddit""", "v_posts"))
def q_estimate_time(spark, d):
    p = _v(spark, d).posts()
    return p.groupBy("subreddit").agg(F.count(F.lit(1)).alias("posts"),
                                      F.sum(stats.estimate_time("num_comments")).alias("est_seconds"))


@register("consensus_rollup", sql(f"""
SELECT post_id, count(*) AS total,
       count(*) FILTER (WHERE coalesce(toward_op, 'neutral') = 'supportive') AS n_supportive,
       count(*) FILTER (WHERE coalesce(toward_op, 'neutral') = 'critical') AS n_critical,
       count(*) FILTER (WHERE coalesce(toward_op, 'neutral') = 'neutral') AS n_neutral,
       count(DISTINCT coalesce(intent_primary, 'UNKNOWN')) AS n_themes,
       {_half_even_pct_sql("count(*) FILTER (WHERE coalesce(toward_op, 'neutral') = 'supportive')", 'count(*)')} AS pct_supportive,
       {_half_even_pct_sql("count(*) FILTER (WHERE coalesce(toward_op, 'neutral') = 'critical')", 'count(*)')} AS pct_critical,
       {_half_even_pct_sql("count(*) FILTER (WHERE coalesce(toward_op, 'neutral') = 'neutral')", 'count(*)')} AS pct_neutral
FROM v_enriched GROUP BY post_id""", "v_enriched"))
def q_consensus_rollup(spark, d):
    return stats.consensus_rollup(_v(spark, d).enriched())

