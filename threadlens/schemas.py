"""Fixed schemas of the annotation, synthesis and report structures."""

from __future__ import annotations

SENTIMENT = "struct<toward_op: string, toward_subject: string, overall_tone: string>"

COMMENT_ANNOTATION = (
    "struct<comment_id: string, quality_score: double, intent_primary: string, intent_secondary: string, "
    f"sentiment: {SENTIMENT}, key_insights: array<string>, actionable_advice: array<string>, "
    "shared_experiences: array<string>, relevance_score: double>")

POST_ANNOTATION = (
    "struct<entities: struct<organizations: array<string>, people: array<string>, products: array<string>, "
    "locations: array<string>>, sentiment: struct<primary: string, intensity: string, emotional_tone: string, "
    "targets: map<string, string>>, core_issue: string, irony_or_contradiction: string, "
    "summaries: struct<one_sentence: string, actionable: string, analytical: string>, "
    "classification: struct<type: string, topics: array<string>>>")

INSIGHT = "struct<insight: string, evidence: string, importance: string>"

SYNTHESIS = (
    "struct<executive_summary: string, key_issue: string, "
    "community_consensus: struct<validation_status: string, agreement_level: string, top_solutions: array<string>, "
    "sentiment_breakdown: map<string, double>, validation: string>, context_and_background: string, "
    "context: string, recommended_actions: array<string>, key_insights: array<variant>, "
    "systemic_patterns: array<string>, notable_perspectives: array<string>, "
    "information_quality: struct<factual_accuracy: string, expert_input: string, source_citations: string>, "
    "comment_themes: map<string, double>, engagement_metrics: map<string, double>>")

TOP_COMMENT = (
    "struct<comment_id: string, score: bigint, body: string, author: string, depth: int, quality_score: double, "
    f"intent_primary: string, intent_secondary: string, sentiment: {SENTIMENT}, key_insights: array<string>, "
    "actionable_advice: array<string>, shared_experiences: array<string>, relevance_score: double, text: string>")

_POST_PARTS = POST_ANNOTATION.removeprefix("struct<")

REPORT = (
    "struct<metadata: struct<post_url: string, post_id: string, subreddit: string, author: string, timestamp: string, "
    "score: bigint, upvote_ratio: double, comment_count: bigint, analysis_timestamp: string, "
    "analysis_duration_seconds: double, from_cache: boolean>, "
    f"post_analysis: struct<content_type: string, extracted_text: string, {_POST_PARTS}, "
    "comments_analysis: struct<comments_available: bigint, total_fetched: bigint, total_processed: bigint, "
    "high_quality_count: bigint, high_quality_percentage: double, sentiment_distribution: map<string, bigint>, "
    "intent_distribution: map<string, bigint>, theme_percentages: map<string, double>, "
    f"tone_distribution: map<string, bigint>, top_comments: array<{TOP_COMMENT}>, all_insights: array<string>, "
    f"all_advice: array<string>>, synthesis: {SYNTHESIS}, success: boolean>")

SAVED_REPORT = f"post_id string, report {REPORT}"
MEMO_REPORT = f"post_id string, report {REPORT}, markdown string, cached_at timestamp_ntz"
