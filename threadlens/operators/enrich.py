"""The annotator boundary (EN1-EN13): batching, prompts, response parsing, positional
matching and default filling around any annotator.

An annotator is either a Column function (prompt -> response text, or comment columns ->
annotation struct, evaluated natively) or a Python callable ``list[str] -> list[str]`` run
through ``mapInPandas`` on Arrow batches of prompts. Responses are parsed into VARIANT and
cast to fixed structs; anything unusable becomes the documented default, never a failed job.
Batches are keyed by ``(post_id, batch_id)`` so that one thread's batches spread over tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.text import clean_text, word_count
from threadlens.schemas import COMMENT_ANNOTATION, POST_ANNOTATION, SYNTHESIS

BY = ["post_id"]

# Response-extraction patterns (fenced block, then one-level-nested object / array).
FENCED_RE = r"(?s)```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```"
# Runs are possessive: the same language, but long answers need no recursion per character.
OBJECT_RE = r"\{(?:[^{}]++|\{[^{}]*+\})*+\}"
ARRAY_RE = r"\[(?:[^\[\]]++|\[[^\[\]]*+\])*+\]"
MIN_EMBEDDED_LEN = 50

# Default annotations used when a response is missing or unusable.
DEFAULT_QUALITY = 5.0
DEFAULT_RELEVANCE = 5.0
DEFAULT_INTENT = "UNKNOWN"
DEFAULT_LABEL = "neutral"
UNAVAILABLE = "Analysis unavailable"
POST_DEFAULTS = {"primary": "neutral", "intensity": "medium", "emotional_tone": "neutral",
                 "core_issue": "Unable to analyze", "classification_type": "other"}
SYNTHESIS_DEFAULTS = {"executive_summary": "Synthesis unavailable", "key_issue": "Unable to synthesize",
                      "validation_status": "unknown", "agreement_level": "unknown",
                      "context_and_background": "Unavailable", "factual_accuracy": "unknown",
                      "expert_input": "unknown", "source_citations": "unknown"}

# Prompt wording is caller configuration; these templates only place the computed parts.
COMMENTS_TEMPLATE = "Post context: {post_summary}\n\nComments:\n{comments_text}"
POST_TEMPLATE = "Subreddit: r/{subreddit}\nTitle: {title}\n\n{post_text}"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def fill_template(template: str, **parts) -> Column:
    """``str.format``-style template over columns: literal pieces and ``{name}`` slots."""
    pieces = re.split(r"\{(\w+)\}", template)
    cols = []
    for i, p in enumerate(pieces):
        if i % 2 == 0:
            if p:
                cols.append(F.lit(p))
        else:
            cols.append(F.coalesce(_c(parts[p]).cast("string"), F.lit("")))
    return F.concat(*cols) if cols else F.lit("")


# ---------------------------------------------------------------- EN1-EN3, EN12

def _cut(c, limit: int | None) -> Column:
    """The first ``limit`` characters, or all of them without a limit."""
    return _c(c) if limit is None else F.substring(_c(c), 1, limit)


def assign_batches(ranked: DataFrame, size: int = 20, rank: str = "rank") -> DataFrame:
    """EN1: consecutive chunks of ``size`` in ranked order: batch_id and pos (both 0-based)."""
    r = F.col(rank).cast("bigint") - 1
    return (ranked.withColumn("batch_id", F.floor(r / size).cast("bigint"))
                  .withColumn("pos", (r % size).cast("bigint")))


def comment_line(pos="pos", score="score", body="body", body_cut: int | None = None) -> Column:
    """``{i}. [Score: s] "{body}"`` with i restarting at 1 per batch; ``body_cut`` shortens the body."""
    return F.concat((_c(pos) + 1).cast("string"), F.lit(". [Score: "),
                    F.coalesce(_c(score), F.lit(0)).cast("string"), F.lit('] "'),
                    _cut(F.coalesce(_c(body), F.lit("")), body_cut), F.lit('"'))


def comments_prompt(batched: DataFrame, by=BY, context: str | None = None,
                    template: str = COMMENTS_TEMPLATE, body_cut: int | None = None,
                    summary_cut: int | None = None) -> DataFrame:
    """EN2: one prompt per (thread, batch); lines joined by a blank line in batch order."""
    x = batched.withColumn("_line", comment_line(body_cut=body_cut))
    keys = [*by, "batch_id"]
    aggs = [F.expr("listagg(_line, '\\n\\n') WITHIN GROUP (ORDER BY pos)").alias("comments_text"),
            F.count(F.lit(1)).alias("n_comments")]
    if context:
        aggs.append(F.first(context).alias("_ctx"))
    out = x.groupBy(*keys).agg(*aggs)
    ctx = _cut("_ctx", summary_cut) if context else F.lit("")
    out = out.withColumn("prompt", fill_template(template, post_summary=ctx, comments_text="comments_text"))
    return out.drop("_ctx") if context else out


def post_prompt(posts: DataFrame, text: str = "extracted_text", template: str = POST_TEMPLATE,
                text_cut: int | None = None) -> Column:
    """EN3: the post prompt from the text (its first ``text_cut`` characters), subreddit and title."""
    return fill_template(template, post_text=_cut(text, text_cut),
                         subreddit="subreddit", title="title")


def post_context(annotation="post_annotation", title="title") -> Column:
    """EN12: the one-sentence summary, else the title."""
    return F.coalesce(_c(annotation)["summaries"]["one_sentence"], _c(title))


# ---------------------------------------------------------------- EN5 parsing

def extract_json_text(t) -> Column:
    """EN5: the JSON text a response carries, by rule: whole text, first fenced block,
    first embedded object then array that parses and is longer than 50 characters."""
    t = _c(t)
    fenced = F.regexp_extract(t, FENCED_RE, 1)

    def embedded(pat):
        ok = F.filter(F.regexp_extract_all(t, F.lit(pat), 0),
                      lambda x: F.try_parse_json(x).isNotNull() & (F.length(x) > MIN_EMBEDDED_LEN))
        return F.get(ok, 0)

    return (F.when(F.try_parse_json(t).isNotNull(), t)
             .when(F.try_parse_json(F.nullif(fenced, F.lit(""))).isNotNull(), fenced)
             .otherwise(F.coalesce(embedded(OBJECT_RE), embedded(ARRAY_RE))))


def parse_rule(t) -> Column:
    t = _c(t)
    fenced = F.nullif(F.regexp_extract(t, FENCED_RE, 1), F.lit(""))
    return (F.when(F.try_parse_json(t).isNotNull(), F.lit("whole"))
             .when(F.try_parse_json(fenced).isNotNull(), F.lit("fenced"))
             .when(extract_json_text(t).isNotNull(), F.lit("embedded")))


def parse_response(t) -> Column:
    """EN5 as VARIANT (null when nothing parses)."""
    return F.try_parse_json(extract_json_text(t))


def _is_array(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("ARRAY"), F.lit(False))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def annotation_list(v) -> Column:
    """The elements of a parsed response when it is a non-empty list, else null."""
    arr = F.try_variant_get(_c(v), "$", "array<variant>")
    return F.when(_is_array(_c(v)) & (F.size(arr) > 0), arr)


# ---------------------------------------------------------------- EN7-EN9 defaults

def default_comment_annotation(comment_id) -> Column:
    """EN7: the annotation every comment of an unusable batch receives."""
    empty = F.array().cast("array<string>")
    return F.struct(
        _c(comment_id).cast("string").alias("comment_id"),
        F.lit(DEFAULT_QUALITY).alias("quality_score"), F.lit(DEFAULT_INTENT).alias("intent_primary"),
        F.lit(None).cast("string").alias("intent_secondary"),
        F.struct(F.lit(DEFAULT_LABEL).alias("toward_op"), F.lit(DEFAULT_LABEL).alias("toward_subject"),
                 F.lit(DEFAULT_LABEL).alias("overall_tone")).alias("sentiment"),
        empty.alias("key_insights"), empty.alias("actionable_advice"), empty.alias("shared_experiences"),
        F.lit(DEFAULT_RELEVANCE).alias("relevance_score")).cast(COMMENT_ANNOTATION)


def default_post_annotation() -> Column:
    """EN8: the post annotation used when the response does not parse."""
    empty = F.array().cast("array<string>")
    return F.struct(
        F.struct(empty.alias("organizations"), empty.alias("people"), empty.alias("products"),
                 empty.alias("locations")).alias("entities"),
        F.struct(*[F.lit(POST_DEFAULTS[k]).alias(k) for k in ("primary", "intensity", "emotional_tone")],
                 F.create_map().cast("map<string,string>").alias("targets")).alias("sentiment"),
        F.lit(POST_DEFAULTS["core_issue"]).alias("core_issue"),
        F.lit(None).cast("string").alias("irony_or_contradiction"),
        F.struct(F.lit(UNAVAILABLE).alias("one_sentence"), F.lit(UNAVAILABLE).alias("actionable"),
                 F.lit(UNAVAILABLE).alias("analytical")).alias("summaries"),
        F.struct(F.lit(POST_DEFAULTS["classification_type"]).alias("type"), empty.alias("topics")).alias("classification"),
    ).cast(POST_ANNOTATION)


def default_synthesis() -> Column:
    """EN9: the synthesis used when the response does not parse."""
    empty = F.array().cast("array<string>")
    return F.struct(
        F.lit(SYNTHESIS_DEFAULTS["executive_summary"]).alias("executive_summary"),
        F.lit(SYNTHESIS_DEFAULTS["key_issue"]).alias("key_issue"),
        F.struct(F.lit(SYNTHESIS_DEFAULTS["validation_status"]).alias("validation_status"),
                 F.lit(SYNTHESIS_DEFAULTS["agreement_level"]).alias("agreement_level"),
                 empty.alias("top_solutions"),
                 F.create_map().cast("map<string,double>").alias("sentiment_breakdown"),
                 F.lit(None).cast("string").alias("validation")).alias("community_consensus"),
        F.lit(SYNTHESIS_DEFAULTS["context_and_background"]).alias("context_and_background"),
        F.lit(None).cast("string").alias("context"),
        empty.alias("recommended_actions"), F.array().cast("array<variant>").alias("key_insights"),
        empty.alias("systemic_patterns"), empty.alias("notable_perspectives"),
        F.struct(*[F.lit(SYNTHESIS_DEFAULTS[k]).alias(k) for k in ("factual_accuracy", "expert_input",
                                                                   "source_citations")]).alias("information_quality"),
        F.lit(None).cast("map<string,double>").alias("comment_themes"),
        F.lit(None).cast("map<string,double>").alias("engagement_metrics"),
    ).cast(SYNTHESIS)


def post_annotation_from(response) -> Column:
    """EN8: parsed post annotation (an object response), else the default."""
    v = parse_response(response)
    parsed = F.when(_is_object(v), F.try_variant_get(v, "$", POST_ANNOTATION))
    return F.coalesce(parsed, default_post_annotation())


def synthesis_from(response) -> Column:
    """EN9: parsed synthesis (an object response), else the default."""
    v = parse_response(response)
    parsed = F.when(_is_object(v), F.try_variant_get(v, "$", SYNTHESIS))
    return F.coalesce(parsed, default_synthesis())


# ---------------------------------------------------------------- EN6 / EN7 matching

def match_annotations(batched: DataFrame, responses: DataFrame, by=BY,
                      response: str = "response", id_col: str = "comment_id") -> DataFrame:
    """EN6 + EN7: zip each usable batch response with its comments by position.

    A usable response is a non-empty JSON list: element i annotates the comment at pos i.
    Surplus elements are dropped; an element that is not an object, or one that is missing,
    gives its comment the default (``default_element``, ``default_missing``). Any other response, or none, gives every comment of the batch the
    default annotation. Adds ``annotation`` (struct) and ``annotation_status``.
    """
    keys = [*by, "batch_id"]
    r = (responses.select(*keys, parse_response(F.col(response)).alias("_v"))
                  .select(*keys, annotation_list(F.col("_v")).alias("_elems")))
    x = (batched.join(r, keys, "left")
                .withColumn("_elem", F.get(F.col("_elems"), F.col("pos").cast("int"))))
    usable = F.col("_elems").isNotNull()
    x = x.withColumn("_parsed", F.when(_is_object(F.col("_elem")),
                                       F.try_variant_get(F.col("_elem"), "$", COMMENT_ANNOTATION)))
    parsed = F.col("_parsed")
    ann = F.when(usable & parsed.isNotNull(), parsed).otherwise(default_comment_annotation(F.col(id_col)))
    status = (F.when(~usable, F.lit("default_batch"))
               .when(F.col("_elem").isNull(), F.lit("default_missing"))
               .when(parsed.isNull(), F.lit("default_element")).otherwise(F.lit("parsed")))
    return (x.withColumns({"annotation": ann, "annotation_status": status})
             .drop("_elems", "_elem", "_parsed"))


def merge_annotation(df: DataFrame, ann: str = "annotation") -> DataFrame:
    """EN13: right-biased merge of the annotation's fields over the row's own columns."""
    fields = [f.name for f in df.schema[ann].dataType.fields]
    keep = [c for c in df.columns if c not in fields and c != ann]
    return df.select(*keep, *[F.col(ann)[f].alias(f) for f in fields])


# ---------------------------------------------------------------- EN10 annotators

def _safe_batch(fn: Callable[[list[str]], list[str]], prompts: list[str]) -> list:
    try:
        out = list(fn(prompts))
        if len(out) == len(prompts):
            return out
    except Exception:  # noqa: BLE001 - one bad call must not fail the stage
        pass
    res = []
    for p in prompts:  # isolate the failing prompt(s)
        try:
            res.append(fn([p])[0])
        except Exception:  # noqa: BLE001
            res.append(None)
    return res


def call_annotator(prompts: DataFrame, fn: Callable[[list[str]], list[str]], keys: list[str],
                   prompt: str = "prompt", partitions: int | None = None) -> DataFrame:
    """EN10: run a Python annotator over Arrow batches of prompts -> (keys..., response).

    ``partitions`` bounds the number of concurrent annotator calls (rate limits); the rows
    are hash-partitioned by the batch keys so retries of a lost task recompute the same rows.
    """
    src = prompts.select(*keys, prompt)
    if partitions:
        src = src.repartition(partitions, *keys)
    schema = src.drop(prompt).schema.add("response", "string")

    def run(batches):
        for pdf in batches:
            out = pdf[keys].copy()
            out["response"] = _safe_batch(fn, pdf[prompt].fillna("").tolist()) if len(pdf) else []
            yield out

    return src.mapInPandas(run, schema)


def enrich_comments(ranked: DataFrame, annotator, batch_size: int = 20, by=BY,
                    context: str | None = None, partitions: int | None = None) -> DataFrame:
    """EN10 for comments: batches -> prompts -> annotator -> EN6/EN7 matching.

    ``annotator`` is a Python callable on prompt lists, or a function Column -> Column that
    maps the prompt column to the response column natively.
    """
    batched = assign_batches(ranked, batch_size)
    prompts = comments_prompt(batched, by, context=context)
    keys = [*by, "batch_id"]
    if callable(annotator) and getattr(annotator, "native", False):
        responses = prompts.select(*keys, annotator(F.col("prompt")).alias("response"))
    else:
        responses = call_annotator(prompts, annotator, keys, partitions=partitions)
    return match_annotations(batched, responses, by)


def enrich_posts(posts: DataFrame, annotator, text: str = "extracted_text",
                 partitions: int | None = None) -> DataFrame:
    """EN10 for posts: one prompt per post -> annotator -> EN8 (parsed or default)."""
    p = posts.withColumn("prompt", post_prompt(posts, text))
    if getattr(annotator, "native", False):
        r = p.withColumn("response", annotator(F.col("prompt")))
    else:
        # written once: the answers feed both the comment prompts and the report
        resp = call_annotator(p, annotator, ["post_id"], partitions=partitions).checkpoint(eager=True)
        r = p.join(resp, "post_id", "left")
    return r.withColumn("post_annotation", post_annotation_from(F.col("response"))).drop("prompt", "response")


def native(fn):
    """Mark a Column -> Column function as a native annotator."""
    fn.native = True
    return fn


# ---------------------------------------------------------------- EN11 rule annotator

# Fixed values of the rule annotator (our weights for the stated quality rubric): cue words,
# matched as whole tokens of the lower-cased body (tokens are runs of [a-z0-9_]).
ADVICE_WORDS = ["try", "should", "recommend", "use"]
EXPERIENCE_WORDS = ["i", "my", "me"]
SUPPORT_WORDS = ["thanks", "agree", "great", "love"]
CRITIC_WORDS = ["wrong", "disagree", "bad", "hate"]
TOKEN_CHAR_RE = "[a-z0-9_]"


def _word_re(words: list[str]) -> str:
    """The same test as a regex (used by the SQL oracle)."""
    return r"(^|[^a-z0-9_])(" + "|".join(words) + r")([^a-z0-9_]|$)"


ADVICE_CUE_RE = _word_re(ADVICE_WORDS)
EXPERIENCE_RE = _word_re(EXPERIENCE_WORDS)
SUPPORT_RE = _word_re(SUPPORT_WORDS)
CRITIC_RE = _word_re(CRITIC_WORDS)


def _has_word(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


# Any rule word as a whole token (a maximal run of token characters).
RULE_WORD_RE = (f"(?<!{TOKEN_CHAR_RE})(?:" + "|".join(sorted({*ADVICE_WORDS, *EXPERIENCE_WORDS, *SUPPORT_WORDS, *CRITIC_WORDS}))
                + f")(?!{TOKEN_CHAR_RE})")


def tokens_of(lower_body) -> Column:
    """The rule words among a text's tokens. One pass over the text; the other tokens, nearly all of
    them, are never built."""
    return F.regexp_extract_all(_c(lower_body), F.lit(RULE_WORD_RE), F.lit(0))


URL_RE = r"https?://"
FIRST_SENTENCE_RE = r"^[^.!?]*[.!?]?"


def _quality(b: Column, w: Column, cue: Column, score) -> Column:
    s = F.coalesce(_c(score), F.lit(0)).cast("double")
    return (F.lit(4.0) * F.least(w / F.lit(20.0), F.lit(1.0))
            + F.lit(3.0) * F.least(F.greatest(s, F.lit(0.0)) / F.lit(100.0), F.lit(1.0))
            + F.when(cue, F.lit(2.0)).otherwise(F.lit(0.0))
            + F.when(F.regexp_like(b, F.lit(URL_RE)), F.lit(1.0)).otherwise(F.lit(0.0)))


def rule_quality(body="body", score="score") -> Column:
    """EN11: 4*min(words/20,1) + 3*min(max(score,0)/100,1) + 2*[advice cue] + 1*[URL]."""
    b = F.coalesce(_c(body), F.lit(""))
    return _quality(b, word_count(b).cast("double"), _has_word(tokens_of(F.lower(b)), ADVICE_WORDS), score)


def rule_annotation(body="body", score="score", comment_id="comment_id", *, tokens=None, words=None) -> Column:
    """EN11: a complete comment annotation from native rules (no model call).

    ``tokens`` / ``words`` may name precomputed columns (see ``rule_annotate``).
    """
    b = F.coalesce(_c(body), F.lit(""))
    tk = _c(tokens) if tokens is not None else tokens_of(F.lower(b))
    w = (_c(words) if words is not None else word_count(b)).cast("double")
    cue = _has_word(tk, ADVICE_WORDS)
    q = _quality(b, w, cue, score)
    intent = (F.when(F.contains(b, F.lit("?")), F.lit("QUESTION")).when(cue, F.lit("ADVICE"))
               .when(_has_word(tk, EXPERIENCE_WORDS), F.lit("EXPERIENCE"))
               .otherwise(F.lit("DISCUSSION")))
    toward = (F.when(_has_word(tk, SUPPORT_WORDS), F.lit("supportive"))
               .when(_has_word(tk, CRITIC_WORDS), F.lit("critical")).otherwise(F.lit("neutral")))
    # first sentence of the cleaned text = the cleaned first sentence of the raw text
    first = clean_text(F.regexp_extract(F.regexp_replace(b, r"^(?U)\s+", ""), FIRST_SENTENCE_RE, 0))
    empty = F.array().cast("array<string>")
    return F.struct(
        _c(comment_id).cast("string").alias("comment_id"), q.alias("quality_score"),
        intent.alias("intent_primary"), F.lit(None).cast("string").alias("intent_secondary"),
        F.struct(toward.alias("toward_op"), toward.alias("toward_subject"),
                 F.when(cue, F.lit("constructive")).otherwise(F.lit("neutral")).alias("overall_tone")).alias("sentiment"),
        F.when(q >= 5.0, F.array(first)).otherwise(empty).alias("key_insights"),
        F.when(cue, F.array(first)).otherwise(empty).alias("actionable_advice"),
        empty.alias("shared_experiences"),
        F.least(w / F.lit(10.0), F.lit(10.0)).alias("relevance_score"),
    ).cast(COMMENT_ANNOTATION)


def rule_annotate(ranked: DataFrame, batch_size: int = 20) -> DataFrame:
    """EN11 in the enrichment flow: batches assigned as for a model, annotation from rules."""
    return rule_facts(assign_batches(ranked, batch_size)).drop("_w")


def rule_facts(comments: DataFrame) -> DataFrame:
    """The rule annotation of each comment, and ``_w``, its number of words; no shuffle."""
    pre = comments.withColumns({"_tk": tokens_of(F.lower(F.coalesce(F.col("body"), F.lit("")))),
                         "_w": word_count("body")})
    return (pre.withColumns({"annotation": rule_annotation(tokens="_tk", words="_w"),
                             "annotation_status": F.lit("rule")})
               .drop("_tk"))


# ---------------------------------------------------------------- EN4 synthesis prompt

SYNTHESIS_TEMPLATE = "The post, as JSON:\n{post_data}\n\nIts best comments, as JSON:\n{comments_data}"


def synthesis_prompt(posts: DataFrame, flat: DataFrame, k: int = 20, by=BY,
                     template: str = SYNTHESIS_TEMPLATE, body_cut: int | None = None) -> DataFrame:
    """EN4: post JSON (title, core_issue, sentiment, summaries) and the top-k comments by
    relevance x score as JSON, placed whole in the template (``body_cut`` shortens the bodies,
    never the JSON).

    posts: (post_id, title, post_annotation); flat: annotated comment rows.
    """
    from threadlens.operators.ranking import top_comments
    pretty = {"pretty": "true"}
    pa = F.col("post_annotation")
    post_json = F.to_json(F.struct(F.col("title"), pa["core_issue"].alias("core_issue"),
                                   pa["sentiment"].alias("sentiment"), pa["summaries"].alias("summaries")), pretty)
    tie = "rank" if "rank" in flat.columns else "seq"
    t = top_comments(flat.withColumnRenamed("rank", "_pre") if tie == "rank" else flat, k, by,
                     tie="_pre" if tie == "rank" else tie)
    packed = (t.groupBy(*by)
               .agg(F.array_sort(F.collect_list(F.struct(
                   F.col("rank").alias("_k"), F.coalesce(F.col("score"), F.lit(0)).alias("score"),
                   _cut(F.coalesce(F.col("body"), F.lit("")), body_cut).alias("body"),
                   F.coalesce(F.col("intent_primary"), F.lit("")).alias("intent"),
                   F.col("sentiment"), F.col("key_insights")))).alias("_c"))
               .select(*by, F.to_json(F.transform("_c", lambda x: x.dropFields("_k")), pretty).alias("_cj")))
    x = posts.select(*by, post_json.alias("_pj")).join(packed, by, "left")
    return x.select(*by, fill_template(template, post_data="_pj", comments_data=F.coalesce("_cj", F.lit("[]")))
                    .alias("prompt"))
