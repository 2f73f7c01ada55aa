"""Registered queries for report assembly and the pipelines (2.6 AG9, 2.8, 2.9).

Pipeline input: posts = v_raw_posts normalised (SRC1) with their assembled text (TX1);
comments = v_threads; rule annotator; as_of = 2024-01-31T00:00:00.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions.rounding import tenths_str
from threadlens.operators import enrich as EN
from threadlens.operators import report as REP
from threadlens.plans import pipeline as PL
from threadlens.plans.oracle import WS, sql
from threadlens.plans.q_scalars import _SRC1_SQL
from threadlens.plans.q_threads import _HEUR, _tree_sql
from threadlens.plans.registry import register, shared_plan, _v
from threadlens.session import ensure_checkpoint_dir, stored
from threadlens.sources import posts as P

AS_OF = "2024-01-31T00:00:00"
_THR = 2.0


@shared_plan
def _posts(spark, d):
    v = _v(spark, d)
    p = P.normalize_posts(v.raw_posts(), id_col="post_id").withColumn("post_id", F.col("id").cast("bigint"))
    return PL.post_content(p, v.ocr(), v.links())


def _reports(spark, d):
    return PL.analyze(_posts(spark, d), _v(spark, d).threads(), AS_OF)


# ---- SQL mirror

_CUE, _EXP, _SUP, _CRI = EN.ADVICE_CUE_RE, EN.EXPERIENCE_RE, EN.SUPPORT_RE, EN.CRITIC_RE
_RANKED = f"""
SELECT t.*, CAST(row_number() OVER (PARTITION BY post_id ORDER BY {_HEUR} DESC, seq) AS BIGINT) AS rank FROM t"""
_FLAT = f"""
SELECT *, CASE WHEN q >= 5.0 THEN [first] ELSE [] END AS key_insights,
       CASE WHEN cue THEN [first] ELSE [] END AS actionable_advice,
       q >= {_THR} AS hq
FROM (SELECT post_id, comment_id, rank, score, body, b, w, cue,
        4.0::DOUBLE * least(w::DOUBLE / 20.0::DOUBLE, 1.0::DOUBLE)
        + 3.0::DOUBLE * least(greatest(coalesce(score, 0)::DOUBLE, 0.0::DOUBLE) / 100.0::DOUBLE, 1.0::DOUBLE)
        + CASE WHEN cue THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END
        + CASE WHEN regexp_matches(b, 'https?://') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS q,
        CASE WHEN contains(b, '?') THEN 'QUESTION' WHEN cue THEN 'ADVICE'
             WHEN regexp_matches(lower(b), '{_EXP}') THEN 'EXPERIENCE' ELSE 'DISCUSSION' END AS intent_primary,
        CASE WHEN regexp_matches(lower(b), '{_SUP}') THEN 'supportive'
             WHEN regexp_matches(lower(b), '{_CRI}') THEN 'critical' ELSE 'neutral' END AS toward_op,
        CASE WHEN cue THEN 'constructive' ELSE 'neutral' END AS overall_tone,
        least(w::DOUBLE / 10.0::DOUBLE, 10.0::DOUBLE) AS relevance_score,
        regexp_extract(trim(regexp_replace(b, '{WS}+', ' ', 'g')), '^[^.!?]*[.!?]?', 0) AS first
      FROM (SELECT *, coalesce(body, '') AS b,
                   len(list_filter(regexp_split_to_array(coalesce(body, ''), '{WS}+'), lambda x: x <> '')) AS w,
                   regexp_matches(lower(coalesce(body, '')), '{_CUE}') AS cue FROM ranked))"""
_QC = "SELECT post_id, count(*) AS n, count(*) FILTER (WHERE hq) AS hqn FROM flat GROUP BY post_id"


def _tenths(c, n):
    q, r = f"(({c}) * 1000 // ({n}))", f"(({c}) * 1000 % ({n}))"
    return (f"(CASE WHEN ({n}) > 0 THEN {q} + CASE WHEN 2 * {r} > ({n}) OR (2 * {r} = ({n}) AND {q} % 2 = 1) "
            f"THEN 1 ELSE 0 END ELSE 0 END)")


def _tstr(t):
    return f"(CAST(({t}) // 10 AS VARCHAR) || '.' || CAST(({t}) % 10 AS VARCHAR))"


_THEMES = f"""
SELECT post_id, list(theme ORDER BY rk) AS themes, list({_tenths('cnt', 'total')} ORDER BY rk) AS tenths
FROM (SELECT *, row_number() OVER (PARTITION BY post_id ORDER BY cnt DESC, theme) AS rk,
             sum(cnt) OVER (PARTITION BY post_id) AS total
      FROM (SELECT post_id, intent_primary AS theme, count(*) AS cnt FROM flat GROUP BY ALL))
WHERE rk <= 5 GROUP BY post_id"""
_CONS = """
SELECT post_id, CASE WHEN s > c THEN 'validated' WHEN c > s THEN 'disputed' ELSE 'mixed' END AS validation_status,
       CASE WHEN greatest(s, c, u) * 10 >= total * 6 THEN 'high' WHEN greatest(s, c, u) * 10 >= total * 4 THEN 'medium'
            ELSE 'low' END AS agreement_level, count_labels
FROM (SELECT post_id, count(*) AS total, count(*) FILTER (WHERE toward_op = 'supportive') AS s,
             count(*) FILTER (WHERE toward_op = 'critical') AS c, count(*) FILTER (WHERE toward_op = 'neutral') AS u,
             count(DISTINCT toward_op) AS count_labels
      FROM flat GROUP BY post_id)"""
_TOP = """
SELECT post_id, list(comment_id ORDER BY trk) AS ids, list(score ORDER BY trk) AS scores,
       list(intent_primary ORDER BY trk) AS intents, list(toward_op ORDER BY trk) AS towards,
       list(body ORDER BY trk) AS bodies, count(*) AS n_top
FROM (SELECT *, row_number() OVER (PARTITION BY post_id
                 ORDER BY coalesce(relevance_score, 0) * CAST(coalesce(score, 0) AS DOUBLE) DESC, rank) AS trk
      FROM flat WHERE hq) WHERE trk <= 10 GROUP BY post_id"""
_INS = """
SELECT post_id, list_sort(list(DISTINCT x)) AS all_insights FROM (SELECT post_id, unnest(key_insights) AS x FROM flat WHERE hq)
WHERE x IS NOT NULL GROUP BY post_id"""
_ADV = """
SELECT post_id, list_sort(list(DISTINCT x)) AS all_advice FROM (SELECT post_id, unnest(actionable_advice) AS x FROM flat WHERE hq)
WHERE x IS NOT NULL GROUP BY post_id"""
_REP = f"""
SELECT p.post_id, p.subreddit, p.author, p.score, p.num_comments AS comment_count, p.content_type, p.title,
       p.upvote_ratio, p.created_utc,
       coalesce(qc.n, 0) AS total_processed, coalesce(qc.hqn, 0) AS high_quality_count,
       {_tenths('coalesce(qc.hqn, 0)', 'coalesce(qc.n, 0)')} AS hq_tenths,
       coalesce(th.themes, []) AS themes, coalesce(th.tenths, []) AS theme_tenths,
       coalesce(cs.validation_status, 'unknown') AS validation_status,
       coalesce(cs.agreement_level, 'unknown') AS agreement_level, coalesce(cs.count_labels, 0) AS n_sentiment_labels,
       tp.ids, tp.scores, tp.intents, tp.towards, tp.bodies, coalesce(tp.n_top, 0) AS n_top,
       coalesce(i.all_insights, []) AS all_insights, coalesce(a.all_advice, []) AS all_advice
FROM (SELECT CAST(id AS BIGINT) AS post_id, * EXCLUDE (id) FROM ({_SRC1_SQL})) p
LEFT JOIN qc USING (post_id) LEFT JOIN themes th USING (post_id) LEFT JOIN cons cs USING (post_id)
LEFT JOIN top tp USING (post_id) LEFT JOIN ins i USING (post_id) LEFT JOIN adv a USING (post_id)"""
_EXEC = ("'r/' || subreddit || ': ' || CAST(total_processed AS VARCHAR) || ' comments analysed, ' || "
         f"CAST(high_quality_count AS VARCHAR) || ' high quality (' || {_tstr('hq_tenths')} || '%).'")

_CTES = [_tree_sql("v_threads", max_depth=None), ("ranked", _RANKED), ("flat", _FLAT), ("qc", _QC),
         ("themes", _THEMES), ("cons", _CONS), ("top", _TOP), ("ins", _INS), ("adv", _ADV), ("rep", _REP)]


def _rsql(body):
    return sql(body, "v_raw_posts", "v_threads", extra=_CTES, recursive=True)


@register("thread_report", _rsql(f"""
SELECT post_id, subreddit, author, score, comment_count, content_type, total_processed, high_quality_count,
       hq_tenths / 10.0 AS high_quality_percentage, CAST(n_sentiment_labels AS BIGINT) AS n_sentiment_labels,
       themes[1] AS top_theme, theme_tenths[1] / 10.0 AS top_theme_pct, n_top AS n_top_comments,
       CAST(ids[1] AS VARCHAR) AS top1_comment_id, CAST(len(all_insights) AS BIGINT) AS n_insights,
       CAST(len(all_advice) AS BIGINT) AS n_advice, validation_status, agreement_level, {_EXEC} AS executive_summary
FROM rep"""))
def q_thread_report(spark, d):
    r = F.col("report")
    md, ca, sy = r["metadata"], r["comments_analysis"], r["synthesis"]
    return _reports(spark, d).select(
        "post_id", md["subreddit"].alias("subreddit"), md["author"].alias("author"), md["score"].alias("score"),
        md["comment_count"].alias("comment_count"), r["post_analysis"]["content_type"].alias("content_type"),
        ca["total_processed"].alias("total_processed"), ca["high_quality_count"].alias("high_quality_count"),
        ca["high_quality_percentage"].alias("high_quality_percentage"),
        F.size(ca["sentiment_distribution"]).cast("bigint").alias("n_sentiment_labels"),
        F.get(F.map_keys(ca["theme_percentages"]), 0).alias("top_theme"),
        F.get(F.map_values(ca["theme_percentages"]), 0).alias("top_theme_pct"),
        F.size(ca["top_comments"]).cast("bigint").alias("n_top_comments"),
        F.get(ca["top_comments"], 0)["comment_id"].alias("top1_comment_id"),
        F.size(ca["all_insights"]).cast("bigint").alias("n_insights"),
        F.size(ca["all_advice"]).cast("bigint").alias("n_advice"),
        sy["community_consensus"]["validation_status"].alias("validation_status"),
        sy["community_consensus"]["agreement_level"].alias("agreement_level"),
        sy["executive_summary"].alias("executive_summary"))


@register("build_report", _rsql("""
SELECT post_id, 'sentiment' AS kind, toward_op AS label, count(*) AS n FROM flat GROUP BY ALL
UNION ALL SELECT post_id, 'tone', overall_tone, count(*) FROM flat GROUP BY ALL
UNION ALL SELECT post_id, 'intent', intent_primary, count(*) FROM flat GROUP BY ALL"""))
def q_build_report(spark, d):
    ca = F.col("report")["comments_analysis"]
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), ca[c].alias("m")) for k, c in (
        ("sentiment", "sentiment_distribution"), ("tone", "tone_distribution"), ("intent", "intent_distribution"))])
    x = _reports(spark, d).select("post_id", F.explode(kinds).alias("k"))
    return x.select("post_id", F.col("k.kind").alias("kind"), F.explode("k.m").alias("label", "n"))


def _md_sql():
    nl = "chr(10)"
    themes = (f"CASE WHEN len(themes) > 0 THEN '### Comment Themes' || {nl} || {nl} || array_to_string("
              f"list_transform(themes, lambda t, i: '- **' || t || '**: ' || {_tstr('theme_tenths[i]')} || '%'), {nl})"
              f" || {nl} END")
    ins = (f"CASE WHEN len(all_insights) > 0 THEN '### Key Insights' || {nl} || {nl} || array_to_string("
           f"list_transform(all_insights[1:5], lambda x: '- ' || x), {nl}) || {nl} END")
    acts = (f"CASE WHEN len(all_advice) > 0 THEN '### Recommended Actions' || {nl} || {nl} || array_to_string("
            f"list_transform(all_advice[1:5], lambda x: '- ' || x), {nl}) || {nl} END")
    tops = (f"CASE WHEN n_top > 0 THEN array_to_string(list_transform(ids[1:5], lambda c, i: "
            f"'### Comment ' || CAST(i AS VARCHAR) || ' (Score: ' || CAST(coalesce(scores[i], 0) AS VARCHAR) || ')' || {nl} || "
            f"'**Intent:** ' || coalesce(intents[i], 'N/A') || {nl} || '**Sentiment toward OP:** ' || "
            f"coalesce(towards[i], 'N/A') || {nl} || {nl} || coalesce(bodies[i], '') || {nl}), {nl}) END")
    return f"""concat_ws({nl},
  '# Reddit Post Analysis Report' || {nl},
  '**Subreddit:** r/' || subreddit, '**Author:** u/' || author,
  '**Score:** ' || CAST(score AS VARCHAR) || ' (' || CAST(CAST(round_even(coalesce(upvote_ratio, 0.0) * 100.0, 0) AS BIGINT) AS VARCHAR) || '% upvoted)',
  '**Comments:** ' || CAST(comment_count AS VARCHAR), '**Posted:** ' || strftime(created_utc, '%Y-%m-%dT%H:%M:%S'),
  '**Analyzed:** {AS_OF}' || {nl},
  '## Executive Summary' || {nl}, {_EXEC}, '',
  '## Post Analysis' || {nl}, '**Type:** ' || content_type, '**Core Issue:** Unable to analyze' || {nl},
  '### Summary', 'Analysis unavailable', '',
  '### Sentiment', '- **Primary:** neutral', '- **Intensity:** medium', '- **Tone:** neutral' || {nl},
  '## Community Response' || {nl}, '**Validation Status:** ' || validation_status,
  '**Agreement Level:** ' || agreement_level || {nl},
  {themes}, {ins}, {acts},
  '## Top Comments' || {nl}, {tops})"""


@register("markdown_report", _rsql(f"SELECT post_id, {_md_sql()} AS markdown FROM rep"))
def q_markdown_report(spark, d):
    return _reports(spark, d).select("post_id", "markdown")


@register("analysis_summary", _rsql(f"""
SELECT post_id, concat_ws(chr(10), 'Post: r/' || subreddit,
  'Score: ' || CASE WHEN score >= 1000000 THEN {_tstr('(score // 100000) + CASE WHEN 2 * (score % 100000) > 100000 OR (2 * (score % 100000) = 100000 AND (score // 100000) % 2 = 1) THEN 1 ELSE 0 END')} || 'M'
                    WHEN score >= 1000 THEN {_tstr('(score // 100) + CASE WHEN 2 * (score % 100) > 100 OR (2 * (score % 100) = 100 AND (score // 100) % 2 = 1) THEN 1 ELSE 0 END')} || 'k'
                    ELSE CAST(score AS VARCHAR) END,
  'Comments: ' || CAST(comment_count AS VARCHAR), '', 'Summary:', {_EXEC}, '',
  CASE WHEN len(all_insights) > 0 THEN 'Key Insights:' || chr(10) ||
       array_to_string(list_transform(all_insights[1:3], lambda x: '  • ' || x), chr(10)) END) AS summary
FROM rep"""))
def q_analysis_summary(spark, d):
    return _reports(spark, d).select("post_id", REP.analysis_summary("report").alias("summary"))


@register("analyze_reuse", _rsql(f"""
SELECT post_id, post_id % 3 = 0 AS from_cache, {_EXEC} AS executive_summary,
       (SELECT count(*) FROM v_threads x WHERE x.post_id = rep.post_id) AS comments_available FROM rep"""))
def q_analyze_reuse(spark, d):
    """PL1 behind its memo: a third of the posts has a live entry, a third an expired one."""
    posts = stored(_posts(spark, d), "posts")      # read by the memo's analysis, the look-up and the new analysis
    threads, key = _v(spark, d).threads(), F.col("post_id")
    hours = F.when(key % 3 == 0, F.lit(-1)).otherwise(F.lit(-72))
    memo = PL.analyze(posts.where(key % 3 < 2), threads, AS_OF).withColumn(
        "cached_at", F.timestamp_add("HOUR", hours, F.lit(AS_OF).cast("timestamp_ntz")))
    ensure_checkpoint_dir(spark)
    memo = memo.checkpoint(eager=True)  # a memo is a stored table, not a plan to be run again
    reports, _ = PL.analyze_reuse(posts, threads, memo, AS_OF)
    r = F.col("report")
    return reports.select("post_id", r["metadata"]["from_cache"].alias("from_cache"),
                          r["synthesis"]["executive_summary"].alias("executive_summary"),
                          r["comments_analysis"]["comments_available"].alias("comments_available"))


@register("terminal_view", _rsql(f"""
SELECT rep.post_id, array_to_string(all_insights[1:5], chr(10)) AS insights,
       array_to_string(all_advice[1:5], chr(10)) AS actions,
       array_to_string(coalesce(list_transform(list_sort(list_transform(themes, lambda t, i: {{'k': -theme_tenths[i], 't': t}})),
           lambda x: x.t || ' ' || {_tstr('(-x.k)')}), []), chr(10)) AS themes,
       array_to_string(coalesce(tones, []), chr(10)) AS tones
FROM rep LEFT JOIN (SELECT post_id, list(overall_tone || ' ' || CAST(n AS VARCHAR) ORDER BY n DESC, overall_tone)[1:6] AS tones
    FROM (SELECT post_id, overall_tone, count(*) AS n FROM flat GROUP BY ALL) GROUP BY post_id) tn USING (post_id)"""))
def q_terminal_view(spark, d):
    x = _reports(spark, d).select("post_id", *REP.terminal_view("report"))

    def lines(name, arr):
        return F.array_join(arr, REP.NL).alias(name)

    return x.select(
        "post_id", lines("insights", F.transform("insights", lambda v: v["insight"])), lines("actions", F.col("actions")),
        lines("themes", F.transform("theme_distribution", lambda e: F.concat(
            e["key"], F.lit(" "), tenths_str(F.bround(e["value"] * 10, 0).cast("bigint"))))),
        lines("tones", F.transform("tone_top6", lambda e: F.concat(e["key"], F.lit(" "), e["value"].cast("string")))))
