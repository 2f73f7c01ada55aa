"""Report assembly and renderings (REP0-REP4).

The per-thread pieces (counts, distributions, top comments, insights) are grouped aggregates
over whole threads, combined in each task before the shuffle (``thread_parts``), joined onto
the posts and packed into one nested row per post.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.rounding import pct_tenths, tenths_str
from threadlens.functions.text import format_score

BY = ["post_id"]
ISO = "yyyy-MM-dd'T'HH:mm:ss"
NL = "\n"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _empty_map(t: str) -> Column:
    return F.create_map().cast(t)


def _empty_arr() -> Column:
    return F.array().cast("array<string>")


def rule_synthesis(subreddit="subreddit", title="title") -> Column:
    """EN9 re-aimed: a synthesis made from the exact aggregates (no model call)."""
    z = F.lit(0).cast("bigint")
    n, hq = F.coalesce(F.col("total_processed"), z), F.coalesce(F.col("high_quality_count"), z)
    hq_pct = tenths_str(pct_tenths(hq, n))
    insights = F.coalesce(F.col("all_insights"), _empty_arr())
    advice = F.coalesce(F.col("all_advice"), _empty_arr())
    vs = F.coalesce(F.col("validation_status"), F.lit("unknown"))
    return F.struct(
        F.concat(F.lit("r/"), F.coalesce(_c(subreddit), F.lit("")), F.lit(": "),
                 n.cast("string"), F.lit(" comments analysed, "),
                 hq.cast("string"), F.lit(" high quality ("), hq_pct,
                 F.lit("%).")).alias("executive_summary"),
        F.coalesce(_c(title), F.lit("")).alias("key_issue"),
        F.struct(vs.alias("validation_status"),
                 F.coalesce(F.col("agreement_level"), F.lit("unknown")).alias("agreement_level"),
                 F.slice(advice, 1, 3).alias("top_solutions"),
                 F.coalesce(F.col("sentiment_breakdown"), _empty_map("map<string,double>")).alias("sentiment_breakdown"),
                 vs.alias("validation")).alias("community_consensus"),
        F.lit("Unavailable").alias("context_and_background"), F.lit("Unavailable").alias("context"),
        F.slice(advice, 1, 5).alias("recommended_actions"),
        F.transform(F.slice(insights, 1, 5), lambda x: x.cast("variant")).alias("key_insights"),
        _empty_arr().alias("systemic_patterns"), _empty_arr().alias("notable_perspectives"),
        F.struct(F.lit("unknown").alias("factual_accuracy"), F.lit("unknown").alias("expert_input"),
                 F.lit("unknown").alias("source_citations")).alias("information_quality"),
        F.coalesce(F.col("theme_percentages"), _empty_map("map<string,double>")).alias("comment_themes"),
        F.lit(None).cast("map<string,double>").alias("engagement_metrics"))


def normalize_synthesis(s) -> Column:
    """REP0 key aliases: validation := validation_status and context := context_and_background
    when they are absent."""
    s = _c(s)
    cc = s["community_consensus"]
    return (s.withField("community_consensus",
                        cc.withField("validation", F.coalesce(cc["validation"], cc["validation_status"])))
             .withField("context", F.coalesce(s["context"], s["context_and_background"])))


def normalize_insight(v) -> Column:
    """REP4: a string insight, or an {insight, evidence, importance} object, as one struct."""
    v = _c(v)
    is_obj = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    return F.struct(
        F.when(is_obj, F.coalesce(F.try_variant_get(v, "$.insight", "string"), F.lit("Insight")))
         .otherwise(F.try_variant_get(v, "$", "string")).alias("insight"),
        F.when(is_obj, F.try_variant_get(v, "$.evidence", "string")).alias("evidence"),
        F.when(is_obj, F.try_variant_get(v, "$.importance", "string")).alias("importance"),
        is_obj.alias("is_object"))


def build_report(posts: DataFrame, parts: DataFrame | None, as_of: str, by=BY) -> DataFrame:
    """REP0: one nested report row per post from the per-thread parts (joined by post_id)."""
    x = posts if parts is None else posts.join(parts, by, "left")
    z = F.lit(0).cast("bigint")
    n = F.coalesce(F.col("total_processed"), z)
    hq = F.coalesce(F.col("high_quality_count"), z)
    available = F.coalesce(F.col("comments_available"), z) if "comments_available" in x.columns else n
    lm = "map<string,bigint>"
    return x.select(
        *by,
        F.struct(F.col("permalink").alias("post_url"), F.col("post_id").cast("string").alias("post_id"),
                 "subreddit", "author", F.date_format("created_utc", ISO).alias("timestamp"), "score",
                 "upvote_ratio", F.col("num_comments").alias("comment_count"),
                 F.lit(as_of).alias("analysis_timestamp"),
                 F.lit(None).cast("double").alias("analysis_duration_seconds"),
                 F.lit(False).alias("from_cache")).alias("metadata"),
        F.struct("content_type", F.coalesce("extracted_text", F.lit("")).alias("extracted_text"),
                 F.col("post_annotation.entities").alias("entities"),
                 F.col("post_annotation.sentiment").alias("sentiment"),
                 F.col("post_annotation.core_issue").alias("core_issue"),
                 F.col("post_annotation.irony_or_contradiction").alias("irony_or_contradiction"),
                 F.col("post_annotation.summaries").alias("summaries"),
                 F.col("post_annotation.classification").alias("classification")).alias("post_analysis"),
        F.struct(available.alias("comments_available"), n.alias("total_fetched"), n.alias("total_processed"), hq.alias("high_quality_count"),
                 (pct_tenths(hq, n) / F.lit(10.0)).alias("high_quality_percentage"),
                 F.coalesce("sentiment_distribution", _empty_map(lm)).alias("sentiment_distribution"),
                 F.coalesce("intent_distribution", _empty_map(lm)).alias("intent_distribution"),
                 F.coalesce("theme_percentages", _empty_map("map<string,double>")).alias("theme_percentages"),
                 F.coalesce("tone_distribution", _empty_map(lm)).alias("tone_distribution"),
                 F.coalesce("top_comments", F.array()).alias("top_comments"),
                 F.coalesce("all_insights", _empty_arr()).alias("all_insights"),
                 F.coalesce("all_advice", _empty_arr()).alias("all_advice")).alias("comments_analysis"),
        normalize_synthesis("synthesis").alias("synthesis"),
        F.lit(True).alias("success"))


def _lines(*parts: Column) -> Column:
    return F.concat_ws(NL, *parts)


def _bullets(arr: Column, fmt) -> Column:
    return F.array_join(F.transform(arr, fmt), NL)


def _insight_text(v: Column) -> Column:
    n = normalize_insight(v)
    return F.when(n["is_object"], n["insight"]).otherwise(n["insight"])


def markdown_report(report="report", top_k: int = 5, body_cut: int | None = None) -> Column:
    """REP1: the Markdown rendering of a report (fixed section order).

    Comment bodies are whole; with ``body_cut``, longer ones are cut and end in an ellipsis.

    Fixed values: the headings and labels below are the reference's Markdown layout, in the
    order they appear in the document.
    """
    r = _c(report)
    md, pa, ca, sy = r["metadata"], r["post_analysis"], r["comments_analysis"], r["synthesis"]
    cc = sy["community_consensus"]
    na = lambda c: F.coalesce(c, F.lit("N/A"))

    def body(b):
        if body_cut is None:
            return b
        return F.when(F.length(b) > body_cut, F.concat(F.substring(b, 1, body_cut), F.lit("..."))).otherwise(b)

    upv = F.bround(F.coalesce(md["upvote_ratio"], F.lit(0.0)) * F.lit(100.0), 0).cast("bigint").cast("string")
    themes = ca["theme_percentages"]
    ins = F.coalesce(sy["key_insights"], F.array().cast("array<variant>"))
    acts = F.coalesce(sy["recommended_actions"], _empty_arr())
    tops = F.slice(ca["top_comments"], 1, top_k)
    theme_block = F.when(F.size(themes) > 0, _lines(
        F.lit("### Comment Themes\n"),
        _bullets(F.map_entries(themes), lambda e: F.concat(
            F.lit("- **"), e["key"], F.lit("**: "), tenths_str(F.bround(e["value"] * 10, 0).cast("bigint")), F.lit("%"))),
        F.lit("")))
    ins_block = F.when(F.size(ins) > 0, _lines(F.lit("### Key Insights\n"),
                                                _bullets(ins, lambda v: F.concat(F.lit("- "), _insight_text(v))),
                                                F.lit("")))
    act_block = F.when(F.size(acts) > 0, _lines(F.lit("### Recommended Actions\n"),
                                                 _bullets(acts, lambda a: F.concat(F.lit("- "), a)), F.lit("")))
    top_block = F.array_join(F.transform(tops, lambda c, i: _lines(
        F.concat(F.lit("### Comment "), (i + 1).cast("string"), F.lit(" (Score: "),
                 F.coalesce(c["score"], F.lit(0)).cast("string"), F.lit(")")),
        F.concat(F.lit("**Intent:** "), na(c["intent_primary"])),
        F.concat(F.lit("**Sentiment toward OP:** "), na(c["sentiment"]["toward_op"])),
        F.concat(F.lit("\n"), body(F.coalesce(c["body"], F.lit(""))), F.lit(NL)))), NL)
    return _lines(
        F.lit("# Reddit Post Analysis Report\n"),
        F.concat(F.lit("**Subreddit:** r/"), md["subreddit"]),
        F.concat(F.lit("**Author:** u/"), md["author"]),
        F.concat(F.lit("**Score:** "), md["score"].cast("string"), F.lit(" ("), upv, F.lit("% upvoted)")),
        F.concat(F.lit("**Comments:** "), md["comment_count"].cast("string")),
        F.concat(F.lit("**Posted:** "), md["timestamp"]),
        F.concat(F.lit("**Analyzed:** "), md["analysis_timestamp"], F.lit("\n")),
        F.lit("## Executive Summary\n"), sy["executive_summary"], F.lit(""),
        F.lit("## Post Analysis\n"),
        F.concat(F.lit("**Type:** "), pa["content_type"]),
        F.concat(F.lit("**Core Issue:** "), pa["core_issue"], F.lit("\n")),
        F.lit("### Summary"), F.coalesce(pa["summaries"]["analytical"], F.lit("")), F.lit(""),
        F.lit("### Sentiment"),
        F.concat(F.lit("- **Primary:** "), na(pa["sentiment"]["primary"])),
        F.concat(F.lit("- **Intensity:** "), na(pa["sentiment"]["intensity"])),
        F.concat(F.lit("- **Tone:** "), na(pa["sentiment"]["emotional_tone"]), F.lit("\n")),
        F.lit("## Community Response\n"),
        F.concat(F.lit("**Validation Status:** "), na(cc["validation_status"])),
        F.concat(F.lit("**Agreement Level:** "), na(cc["agreement_level"]), F.lit("\n")),
        theme_block, ins_block, act_block,
        F.lit("## Top Comments\n"),
        F.when(F.size(tops) > 0, top_block))


def analysis_summary(report="report") -> Column:
    """REP2: header, executive summary and the first three insights.

    Fixed values: the line labels below are the reference's summary layout, in order.
    """
    r = _c(report)
    md, sy = r["metadata"], r["synthesis"]
    ins = F.coalesce(sy["key_insights"], F.array().cast("array<variant>"))
    return _lines(
        F.concat(F.lit("Post: r/"), md["subreddit"]),
        F.concat(F.lit("Score: "), format_score(md["score"])),
        F.concat(F.lit("Comments: "), md["comment_count"].cast("string")),
        F.lit(""), F.lit("Summary:"), sy["executive_summary"], F.lit(""),
        F.when(F.size(ins) > 0, _lines(F.lit("Key Insights:"), _bullets(
            F.slice(ins, 1, 3), lambda v: F.concat(F.lit("  • "), _insight_text(v))))))


def _by_share(a: Column, b: Column) -> Column:
    """Order of map entries: larger value first, ties by name."""
    return (F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1)
             .when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))


def terminal_view(report="report") -> list[Column]:
    """REP3: the terminal summary as columns (5 insights, 5 actions, themes by share, top-6 tones)."""
    r = _c(report)
    sy, ca = r["synthesis"], r["comments_analysis"]
    ins = F.slice(F.coalesce(sy["key_insights"], F.array().cast("array<variant>")), 1, 5)
    themes = F.array_sort(F.map_entries(ca["theme_percentages"]),
                          lambda a, b: _by_share(a, b))
    tones = F.slice(F.array_sort(F.map_entries(ca["tone_distribution"]),
                                 lambda a, b: _by_share(a, b)), 1, 6)
    return [F.transform(ins, lambda v: normalize_insight(v)).alias("insights"),
            F.slice(F.coalesce(sy["recommended_actions"], _empty_arr()), 1, 5).alias("actions"),
            themes.alias("theme_distribution"), tones.alias("tone_top6")]


# ---------------------------------------------------------------- per-thread parts

TOP_FIELDS = ["comment_id", "score", "body", "author", "depth", "quality_score", "intent_primary", "intent_secondary",
              "sentiment", "key_insights", "actionable_advice", "shared_experiences", "relevance_score"]


def _desc_then(a_key: Column, b_key: Column, a_tie: Column, b_tie: Column) -> Column:
    return (F.when(a_key > b_key, -1).when(a_key < b_key, 1)
             .when(a_tie < b_tie, -1).when(a_tie > b_tie, 1).otherwise(0))


def label_parts(flat: DataFrame, threshold: float = 2.0, themes_k: int = 5, by=BY) -> DataFrame:
    """Counts, distributions, themes and consensus (AG1-AG5, AG11), one row per thread.

    One aggregate counts every (thread, kind, label); tasks ship their counts, not comments. What a
    thread's row then gathers is one entry a label.
    """
    def label(col, missing):
        return F.coalesce(F.col(col), F.lit(missing))

    high = F.coalesce(F.col("quality_score"), F.lit(0.0)) >= threshold
    kinds = {"sentiment": label("sentiment.toward_op", "neutral"), "tone": label("sentiment.overall_tone", "neutral"),
             "intent": label("intent_primary", "UNKNOWN"), "quality": F.when(high, F.lit("high")).otherwise(F.lit("low"))}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("label")) for k, c in kinds.items()])
    counts = flat.select(*by, F.explode(pairs).alias("k")).groupBy(*by, "k.kind", "k.label").agg(F.count(F.lit(1)).alias("n"))
    rows = counts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("kind", "label", "n"))).alias("_l"))

    def entries(kind):
        return F.transform(F.filter("_l", lambda x: x["kind"] == kind), lambda x: F.struct(x["label"], x["n"]))

    x = rows.select(*by, *[F.map_from_entries(entries(k)).alias(k) for k in kinds], entries("intent").alias("_i"))

    def of(kind, name):
        return F.coalesce(F.try_element_at(kind, F.lit(name)), F.lit(0).cast("bigint"))

    hq, n = of("quality", "high"), of("quality", "high") + of("quality", "low")
    themes = F.slice(F.array_sort("_i", lambda a, b: _desc_then(a["n"], b["n"], a["label"], b["label"])), 1, themes_k)
    ns, nc, nn = (of("sentiment", k) for k in ("supportive", "critical", "neutral"))
    mx = F.greatest(ns, nc, nn)
    return x.select(
        *by, n.alias("total_processed"), hq.alias("high_quality_count"),
        F.col("sentiment").alias("sentiment_distribution"), F.col("tone").alias("tone_distribution"),
        F.col("intent").alias("intent_distribution"),
        F.map_from_entries(F.transform(themes, lambda t: F.struct(t["label"], pct_tenths(t["n"], n) / F.lit(10.0))))
        .alias("theme_percentages"),
        (F.when(ns > nc, F.lit("validated")).when(nc > ns, F.lit("disputed")).otherwise(F.lit("mixed")))
        .alias("validation_status"),
        (F.when(mx * 10 >= n * 6, F.lit("high")).when(mx * 10 >= n * 4, F.lit("medium")).otherwise(F.lit("low")))
        .alias("agreement_level"),
        F.create_map(*[x for k, c in (("supportive", ns), ("critical", nc), ("neutral", nn))
                       for x in (F.lit(k), pct_tenths(c, n) / F.lit(10.0))]).alias("sentiment_breakdown"))


def top_parts(flat: DataFrame, top_k: int = 10, by=BY, bodies: DataFrame | None = None) -> DataFrame:
    """RK4 as an ordered array a thread: ties by ``rank`` if there is one, else by heuristic and seq.

    The top-k cuts each task's rows before the shuffle. ``bodies`` (thread, comment, body) is joined
    to the k rows only, when ``flat`` has none.
    """
    from threadlens.operators.ranking import relevance_weight, top_k as first
    ties = [F.col("rank")] if "rank" in flat.columns else [F.col("heuristic").desc(), F.col("seq")]
    rows = first(flat.withColumn("_weight", relevance_weight()), top_k, [F.col("_weight").desc(), *ties], by, rank="_k")
    if bodies is not None:
        b = bodies.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("comment_id").cast("string").alias("_id"), "body")
        on = F.col("comment_id") == F.col("_id")
        for c in by:
            on = on & (F.col(c) == F.col(f"_{c}"))
        rows = rows.join(b, on, "left")
    fields = [f for f in TOP_FIELDS if f in rows.columns]
    rows = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_k", *fields))).alias("_t"))      # at most k
    return rows.select(*by, F.transform("_t", lambda x: x.dropFields("_k").withField("text", x["body"])).alias("top_comments"))


def union_parts(quality: DataFrame, by=BY) -> DataFrame:
    """AG6: the distinct insights and advice of a thread, each once a task before the shuffle."""
    def tagged(kind, col):
        none = F.array().cast("array<string>")
        return F.transform(F.coalesce(F.col(col), none), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))

    values = quality.select(*by, F.explode(F.concat(tagged("i", "key_insights"), tagged("a", "actionable_advice"))).alias("x"))
    values = values.select(*by, "x.kind", "x.v").where("v is not null").distinct()

    def of(kind):
        return F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("v"))))

    return values.groupBy(*by).agg(of("i").alias("all_insights"), of("a").alias("all_advice"))


def thread_parts(flat: DataFrame, threshold: float = 2.0, top_k: int = 10, themes_k: int = 5, by=BY,
                 bodies: DataFrame | None = None) -> DataFrame:
    """All per-thread parts of the report over every row of ``flat`` (annotated comments)."""
    quality = flat.where(F.coalesce(F.col("quality_score"), F.lit(0.0)) >= threshold)
    return (label_parts(flat, threshold, themes_k, by).join(top_parts(quality, top_k, by, bodies), by, "left")
            .join(union_parts(quality, by), by, "left"))
