"""Registered queries for the annotator boundary (2.5).

The model in these queries is a scripted annotator: its response text is derived from
the batch rows (four response styles by thread: bare JSON, fenced JSON, JSON inside
prose, broken text; some threads lose an element or get a non-object element), so the
parsing, positional matching and default rules are exercised on every batch.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.operators import enrich as EN
from threadlens.operators.annotators import scripted_python_annotator
from threadlens.operators import ranking as R
from threadlens.operators import tree as T
from threadlens.plans.oracle import WS, sql
from threadlens.plans.q_scalars import _TX1_SQL, _assembled
from threadlens.plans.q_threads import _HEUR, _tree_sql
from threadlens.plans.registry import register, shared_plan, _v

_BATCH = 20
_MAX = 100


@shared_plan
def _batched(spark, d):
    t = T.build_tree(_v(spark, d).threads())
    return EN.assign_batches(R.pre_filter(t, _MAX), _BATCH)


def scripted_element(pos="pos", score="score", seq="seq", cid="comment_id"):
    """One response element as JSON text (fixed formatting, identical in both engines)."""
    s = F.abs(F.col(score))
    intent = F.element_at(F.array(F.lit("QUESTION"), F.lit("ADVICE"), F.lit("STORY")),
                          (F.col(seq) % 3 + 1).cast("int"))
    tone = F.element_at(F.array(F.lit("supportive"), F.lit("critical"), F.lit("neutral"), F.lit("mixed")),
                        (F.col(seq) % 4 + 1).cast("int"))
    return F.concat(
        F.lit('{"comment_id": "'), (F.col(pos) + 1).cast("string"),
        F.lit('", "quality_score": '), (s % 11).cast("string"),
        F.lit(', "intent_primary": "'), intent,
        F.lit('", "sentiment": {"toward_op": "'), tone,
        F.lit('", "toward_subject": "neutral", "overall_tone": "calm"}, "key_insights": ["insight '),
        F.col(cid).cast("string"),
        F.lit('"], "actionable_advice": [], "shared_experiences": [], "relevance_score": '),
        (s % 7 + 3).cast("string"), F.lit("}"))


def scripted_responses(batched):
    """(post_id, batch_id, response) from the scripted annotator."""
    el = F.when((F.col("post_id") % 7 == 3) & (F.col("pos") == 1), F.lit("42")).otherwise(scripted_element())
    g = (batched.groupBy("post_id", "batch_id")
                .agg(F.array_sort(F.collect_list(F.struct("pos", el.alias("e")))).alias("a")))
    n = F.size("a")
    keep = F.when(F.col("post_id") % 5 == 0, F.slice("a", 1, n - 1)).otherwise(F.col("a"))
    body = F.concat(F.lit("["), F.array_join(F.transform(keep, lambda x: x["e"]), ", "), F.lit("]"))
    style = (F.col("post_id") % 4).cast("int")
    resp = (F.when(style == 0, body)
             .when(style == 1, F.concat(F.lit("Sure!\n```json\n"), body, F.lit("\n```\nDone.")))
             .when(style == 2, F.concat(F.lit("Here you go: "), body, F.lit(" - end")))
             .otherwise(F.lit("Sorry, I cannot help with that.")))
    return g.select("post_id", "batch_id", resp.alias("response"))


# ---- SQL mirror of the same pipeline

_RANKED = f"""
SELECT * FROM (SELECT t.*, CAST(row_number() OVER (PARTITION BY post_id ORDER BY {_HEUR} DESC, path) AS BIGINT) AS rank
               FROM t) WHERE rank <= {_MAX}"""
_BATCHED = f"""
SELECT *, CAST((rank - 1) // {_BATCH} AS BIGINT) AS batch_id, CAST((rank - 1) % {_BATCH} AS BIGINT) AS pos FROM ranked"""
_ELEM = """('{"comment_id": "' || CAST(pos + 1 AS VARCHAR) || '", "quality_score": ' || CAST(abs(score) % 11 AS VARCHAR)
  || ', "intent_primary": "' || ['QUESTION', 'ADVICE', 'STORY'][seq % 3 + 1]
  || '", "sentiment": {"toward_op": "' || ['supportive', 'critical', 'neutral', 'mixed'][seq % 4 + 1]
  || '", "toward_subject": "neutral", "overall_tone": "calm"}, "key_insights": ["insight ' || CAST(comment_id AS VARCHAR)
  || '"], "actionable_advice": [], "shared_experiences": [], "relevance_score": ' || CAST(abs(score) % 7 + 3 AS VARCHAR) || '}')"""
_RESP = f"""
SELECT post_id, batch_id, CASE post_id % 4
    WHEN 0 THEN body WHEN 1 THEN 'Sure!' || chr(10) || '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'Done.'
    WHEN 2 THEN 'Here you go: ' || body || ' - end' ELSE 'Sorry, I cannot help with that.' END AS response
FROM (SELECT post_id, batch_id, '[' || string_agg(e, ', ' ORDER BY pos) || ']' AS body FROM (
        SELECT post_id, batch_id, pos, CASE WHEN post_id % 7 = 3 AND pos = 1 THEN '42' ELSE {_ELEM} END AS e,
               max(pos) OVER (PARTITION BY post_id, batch_id) AS last FROM batched)
      WHERE NOT (post_id % 5 = 0 AND pos = last)
      GROUP BY post_id, batch_id)"""
# The response-extraction patterns, as the other engine writes them.
_FENCED = r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```"
_OBJ = r"\{(?:[^{}]|(?:\{[^{}]*\}))*\}"
_ARR = r"\[(?:[^\[\]]|(?:\[[^\[\]]*\]))*\]"


def _extract_sql(t):
    fenced = f"nullif(regexp_extract({t}, '{_FENCED}', 1), '')"
    emb = lambda p: f"list_filter(regexp_extract_all({t}, '{p}'), lambda x: json_valid(x) AND length(x) > 50)[1]"
    return (f"CASE WHEN json_valid({t}) THEN {t} WHEN coalesce(json_valid({fenced}), false) THEN {fenced} "
            f"ELSE coalesce({emb(_OBJ)}, {emb(_ARR)}) END")


def _rule_sql(t):
    fenced = f"nullif(regexp_extract({t}, '{_FENCED}', 1), '')"
    return (f"CASE WHEN json_valid({t}) THEN 'whole' WHEN coalesce(json_valid({fenced}), false) THEN 'fenced' "
            f"WHEN ({_extract_sql(t)}) IS NOT NULL THEN 'embedded' END")


_PARSED = f"""
SELECT post_id, batch_id, response, j, {_rule_sql('response')} AS parse_rule,
       coalesce(json_type(j) = 'ARRAY' AND json_array_length(j) > 0, false) AS usable
FROM (SELECT *, {_extract_sql('response')} AS j FROM responses)"""

_CTES = [_tree_sql("v_threads"), ("ranked", _RANKED), ("batched", _BATCHED), ("responses", _RESP),
         ("parsed", _PARSED)]

_MATCHED = """
SELECT b.post_id, b.comment_id, b.batch_id, b.pos, p.usable,
       json_extract(p.j, '$[' || CAST(b.pos AS VARCHAR) || ']') AS e,
       coalesce(json_array_length(p.j), 0) AS n_el
FROM batched b LEFT JOIN parsed p ON p.post_id = b.post_id AND p.batch_id = b.batch_id"""

_ANNOTATED = f"""
SELECT post_id, comment_id, batch_id, pos,
  CASE WHEN NOT coalesce(usable, false) THEN 'default_batch' WHEN pos >= n_el THEN 'default_missing' WHEN json_type(e) = 'OBJECT' THEN 'parsed'
       ELSE 'default_element' END AS annotation_status,
  CASE WHEN coalesce(usable, false) AND json_type(e) = 'OBJECT' THEN e->>'$.comment_id' ELSE CAST(comment_id AS VARCHAR) END AS ann_comment_id,
  CASE WHEN coalesce(usable, false) AND json_type(e) = 'OBJECT' THEN CAST(e->>'$.quality_score' AS DOUBLE) ELSE 5.0 END AS quality_score,
  CASE WHEN coalesce(usable, false) AND json_type(e) = 'OBJECT' THEN e->>'$.intent_primary' ELSE 'UNKNOWN' END AS intent_primary,
  CASE WHEN coalesce(usable, false) AND json_type(e) = 'OBJECT' THEN e->>'$.sentiment.toward_op' ELSE 'neutral' END AS toward_op,
  CASE WHEN coalesce(usable, false) AND json_type(e) = 'OBJECT' THEN CAST(e->>'$.relevance_score' AS DOUBLE) ELSE 5.0 END AS relevance_score
FROM matched"""


def _esql(body, extra=()):
    return sql(body, "v_threads", extra=_CTES + list(extra), recursive=True)


@register("assign_batches", _esql("SELECT post_id, comment_id, rank, batch_id, pos FROM batched"))
def q_assign_batches(spark, d):
    return _batched(spark, d).select("post_id", "comment_id", "rank", "batch_id", "pos")


@register("comments_prompt", _esql(f"""
SELECT post_id, batch_id, count(*) AS n_comments,
       string_agg(CAST(pos + 1 AS VARCHAR) || '. [Score: ' || CAST(coalesce(score, 0) AS VARCHAR) || '] "'
                  || coalesce(body, '') || '"', chr(10) || chr(10) ORDER BY pos) AS comments_text
FROM batched GROUP BY post_id, batch_id"""))
def q_comments_prompt(spark, d):
    return EN.comments_prompt(_batched(spark, d)).select("post_id", "batch_id", "n_comments", "comments_text")


@register("post_prompt", sql(f"""
SELECT post_id, 'Subreddit: r/' || subreddit || chr(10) || 'Title: ' || title || chr(10) || chr(10)
       || extracted_text AS prompt
FROM ({_TX1_SQL.replace('SELECT p.post_id, p.content_type,', 'SELECT p.post_id, p.content_type, p.subreddit, p.title,')})""",
                             "v_posts", "v_gallery", "v_ocr", "v_links"))
def q_post_prompt(spark, d):
    a = _assembled(spark, d).join(_v(spark, d).posts().select("post_id", "subreddit", "title"), "post_id")
    return a.select("post_id", EN.post_prompt(a).alias("prompt"))


@register("parse_response", _esql("""
SELECT post_id, batch_id, parse_rule, usable, CAST(CASE WHEN usable THEN json_array_length(j) END AS BIGINT) AS n_elements
FROM parsed"""))
def q_parse_response(spark, d):
    r = scripted_responses(_batched(spark, d))
    lst = EN.annotation_list(EN.parse_response("response"))
    return r.select("post_id", "batch_id", EN.parse_rule("response").alias("parse_rule"),
                    lst.isNotNull().alias("usable"), F.size(lst).cast("bigint").alias("n_elements"))


def _annotated(spark, d):
    b = _batched(spark, d)
    m = EN.match_annotations(b, scripted_responses(b))
    a = F.col("annotation")
    return m.select("post_id", "comment_id", "batch_id", "pos", "annotation_status",
                    a["comment_id"].alias("ann_comment_id"), a["quality_score"].alias("quality_score"),
                    a["intent_primary"].alias("intent_primary"), a["sentiment"]["toward_op"].alias("toward_op"),
                    a["relevance_score"].alias("relevance_score"))


@register("match_annotations", _esql("SELECT * FROM annotated WHERE annotation_status <> 'default_batch'",
                                     [("matched", _MATCHED), ("annotated", _ANNOTATED)]))
def q_match_annotations(spark, d):
    return _annotated(spark, d).filter(F.col("annotation_status") != "default_batch")


@register("default_annotation", _esql("SELECT * FROM annotated", [("matched", _MATCHED), ("annotated", _ANNOTATED)]))
def q_default_annotation(spark, d):
    return _annotated(spark, d)


def _post_responses(spark, d):
    p = _v(spark, d).posts()
    obj = F.concat(F.lit('{"core_issue": "issue '), F.col("post_id").cast("string"),
                   F.lit('", "summaries": {"one_sentence": "about '), F.col("subreddit"),
                   F.lit('"}, "classification": {"type": "question", "topics": ["t1", "t2"]}}'))
    m = (F.col("post_id") % 3).cast("int")
    resp = (F.when(m == 0, obj).when(m == 1, F.concat(F.lit("```json\n"), obj, F.lit("\n```")))
             .otherwise(F.lit("n/a")))
    return p.select("post_id", resp.alias("response"))


@register("default_post_annotation", sql("""
SELECT post_id, coalesce(j->>'$.core_issue', CASE WHEN j IS NULL THEN 'Unable to analyze' END) AS core_issue,
       CASE WHEN j IS NULL THEN 'neutral' ELSE j->>'$.sentiment.primary' END AS sentiment_primary,
       CASE WHEN j IS NULL THEN 'Analysis unavailable' ELSE j->>'$.summaries.one_sentence' END AS one_sentence,
       CASE WHEN j IS NULL THEN 'other' ELSE j->>'$.classification.type' END AS classification_type,
       CAST(CASE WHEN j IS NULL THEN 0 ELSE json_array_length(j, '$.classification.topics') END AS BIGINT) AS n_topics
FROM (SELECT post_id, CASE post_id % 3 WHEN 2 THEN NULL ELSE
        '{"core_issue": "issue ' || CAST(post_id AS VARCHAR) || '", "summaries": {"one_sentence": "about ' || subreddit
        || '"}, "classification": {"type": "question", "topics": ["t1", "t2"]}}' END AS j FROM v_posts)""", "v_posts"))
def q_default_post_annotation(spark, d):
    a = F.col("post_annotation")
    r = _post_responses(spark, d).withColumn("post_annotation", EN.post_annotation_from(F.col("response")))
    return r.select("post_id", a["core_issue"].alias("core_issue"), a["sentiment"]["primary"].alias("sentiment_primary"),
                    a["summaries"]["one_sentence"].alias("one_sentence"),
                    a["classification"]["type"].alias("classification_type"),
                    F.size(a["classification"]["topics"]).cast("bigint").alias("n_topics"))


_CUE = EN.ADVICE_CUE_RE


@register("rule_quality", sql(f"""
SELECT post_id, comment_id,
  4.0::DOUBLE * least(w::DOUBLE / 20.0::DOUBLE, 1.0::DOUBLE)
  + 3.0::DOUBLE * least(greatest(coalesce(score, 0)::DOUBLE, 0.0::DOUBLE) / 100.0::DOUBLE, 1.0::DOUBLE)
  + CASE WHEN regexp_matches(lower(b), '{_CUE}') THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN regexp_matches(b, 'https?://') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS quality_score,
  CASE WHEN contains(b, '?') THEN 'QUESTION' WHEN regexp_matches(lower(b), '{_CUE}') THEN 'ADVICE'
       WHEN regexp_matches(lower(b), '{EN.EXPERIENCE_RE}') THEN 'EXPERIENCE' ELSE 'DISCUSSION' END AS intent_primary,
  CASE WHEN regexp_matches(lower(b), '{EN.SUPPORT_RE}') THEN 'supportive'
       WHEN regexp_matches(lower(b), '{EN.CRITIC_RE}') THEN 'critical' ELSE 'neutral' END AS toward_op,
  least(w::DOUBLE / 10.0::DOUBLE, 10.0::DOUBLE) AS relevance_score
FROM (SELECT *, coalesce(body, '') AS b,
             len(list_filter(regexp_split_to_array(coalesce(body, ''), '{WS}+'), lambda x: x <> '')) AS w
      FROM v_threads)""", "v_threads"))
def q_rule_quality(spark, d):
    t = _v(spark, d).threads()
    a = EN.rule_annotation()
    return t.select("post_id", "comment_id", a["quality_score"].alias("quality_score"),
                    a["intent_primary"].alias("intent_primary"), a["sentiment"]["toward_op"].alias("toward_op"),
                    a["relevance_score"].alias("relevance_score"))


@register("enrich_comments_udf", _esql("""
SELECT post_id, CASE WHEN pos < n THEN CAST(pos + 1 AS VARCHAR) ELSE CAST(comment_id AS VARCHAR) END AS comment_id, batch_id, pos,
       CASE WHEN pos < n THEN CAST((chars + pos) % 11 AS DOUBLE) ELSE 5.0 END AS quality_score,
       CASE WHEN pos < n THEN 'ASK' ELSE 'UNKNOWN' END AS intent_primary,
       CASE WHEN pos < n THEN 'parsed' WHEN n = 0 THEN 'default_batch' ELSE 'default_missing' END AS annotation_status
FROM batched JOIN (
  SELECT post_id, batch_id, length(prompt) AS chars, len(list_filter(string_split(prompt, chr(10) || chr(10)),
             lambda x: regexp_matches(x, '^[0-9]') AND contains(x, '. [Score: '))) AS n
  FROM (SELECT post_id, batch_id, 'Post context: ' || chr(10) || chr(10) || 'Comments:' || chr(10)
          || string_agg(CAST(pos + 1 AS VARCHAR) || '. [Score: ' || CAST(coalesce(score, 0) AS VARCHAR) || '] "'
                        || coalesce(body, '') || '"', chr(10) || chr(10) ORDER BY pos) AS prompt
        FROM batched GROUP BY post_id, batch_id)) USING (post_id, batch_id)"""))
def q_enrich_comments_udf(spark, d):
    """EN10 with a Python annotator over Arrow batches; it counts and measures what it is sent."""
    t = T.build_tree(_v(spark, d).threads())
    m = EN.enrich_comments(R.pre_filter(t, _MAX), scripted_python_annotator, _BATCH, partitions=4)
    return EN.merge_annotation(m).select("post_id", "comment_id", "batch_id", "pos", "quality_score",
                                         "intent_primary", "annotation_status")


@register("parse_long_responses", """
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^A-Za-z]', ' ', 'g') AS body FROM documents)
SELECT doc_id, doc_id AS answer_id, CAST(length(body) AS BIGINT) AS answer_chars, 'embedded' AS parse_rule FROM t""")
def q_parse_long_responses(spark, d):
    """EN5 on long answers: prose, an unclosed brace and one object that carries a whole document."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", " ")
    t = F.concat(F.lit("The answer is { as follows: "), body, F.lit(' {"doc": '), F.col("doc_id").cast("string"),
                 F.lit(', "note": "a field that makes the object long enough", "body": "'), body, F.lit('"} '), body)
    x = _v(spark, d).t("documents").select("doc_id", t.alias("response"))
    v = x.select("doc_id", EN.parse_response("response").alias("v"), EN.parse_rule("response").alias("parse_rule"))
    return v.select("doc_id", F.try_variant_get("v", "$.doc", "bigint").alias("answer_id"),
                    F.length(F.try_variant_get("v", "$.body", "string")).cast("bigint").alias("answer_chars"), "parse_rule")
