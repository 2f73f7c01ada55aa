"""Per-thread aggregations (AG1-AG11).

All are grouped aggregates keyed by ``by`` (the thread key), so Spark runs them as a
partial (map-side) aggregate followed by one shuffle of already-combined rows: a hot
thread never ships its raw comments to a single task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.rounding import pct1, pct_tenths

BY = ["post_id"]

# Labels used when a comment carries none.
MISSING = {"toward_op": "neutral", "overall_tone": "neutral", "intent_primary": "UNKNOWN"}
KINDS = {"sentiment": "toward_op", "tone": "overall_tone", "intent": "intent_primary"}


def _label(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(MISSING[col]))


def label_distribution(df: DataFrame, col: str, by=BY, out: str | None = None) -> DataFrame:
    """AG1/AG2/AG3 for one label column: (by..., label, n)."""
    out = out or col
    return (df.groupBy(*by, _label(col).alias(out))
              .agg(F.count(F.lit(1)).alias("n")))


def sentiment_distribution(df, by=BY):
    """AG1: comments per toward_op label (missing -> neutral)."""
    return label_distribution(df, "toward_op", by)


def tone_distribution(df, by=BY):
    """AG2: comments per overall_tone label (missing -> neutral)."""
    return label_distribution(df, "overall_tone", by)


def intent_distribution(df, by=BY):
    """AG3: comments per intent_primary label (missing -> UNKNOWN)."""
    return label_distribution(df, "intent_primary", by)


def distributions(df: DataFrame, by=BY) -> DataFrame:
    """AG1-AG3 in one scan and one shuffle: (by..., kind, label, n)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), _label(c).alias("label"))
                      for k, c in KINDS.items()])
    return (df.select(*by, F.explode(pairs).alias("kl"))
              .groupBy(*by, F.col("kl.kind").alias("kind"), F.col("kl.label").alias("label"))
              .agg(F.count(F.lit(1)).alias("n")))


def theme_percentages(df: DataFrame, by=BY, k: int = 5) -> DataFrame:
    """AG4: top-k intents per thread with their exact one-decimal share of all comments.

    Ties in count are broken by label name.
    """
    counts = intent_distribution(df, by)
    w_total = Window.partitionBy(*by)
    w_rank = Window.partitionBy(*by).orderBy(F.col("n").desc(), F.col("intent_primary"))
    return (counts.withColumn("total", F.sum("n").over(w_total))
                  .withColumn("rank", F.row_number().over(w_rank))
                  .filter(F.col("rank") <= k)
                  .select(*by, F.col("rank").cast("bigint").alias("rank"),
                          F.col("intent_primary").alias("theme"), "n",
                          pct1("n", "total").alias("pct")))


def quality_counts(df: DataFrame, threshold: float = 2.0, by=BY) -> DataFrame:
    """AG5: total_fetched = total_processed, high_quality_count and its percentage."""
    hq = F.coalesce(F.col("quality_score"), F.lit(0.0)) >= threshold
    return (df.groupBy(*by)
              .agg(F.count(F.lit(1)).alias("total_processed"),
                   F.count_if(hq).alias("high_quality_count"))
              .withColumn("total_fetched", F.col("total_processed"))
              .withColumn("high_quality_percentage",
                          pct1("high_quality_count", "total_processed")))


def distinct_union(df: DataFrame, array_col: str, out: str, by=BY) -> DataFrame:
    """AG6: distinct values of an array column over a thread's rows, long form (by..., out)."""
    return (df.select(*by, F.explode(F.col(array_col)).alias(out))
              .filter(F.col(out).isNotNull())
              .distinct())


def merge_insights(df: DataFrame, list_col: str, order_col: str, by=BY) -> DataFrame:
    """AG7: concatenate lists in source order, keep the first spelling of each
    case/space-insensitive value. Result: (by..., insight, first_src, first_pos) where
    (first_src, first_pos) orders the merged list.
    """
    x = df.select(*by, F.col(order_col).alias("src"),
                  F.posexplode(F.col(list_col)).alias("pos", "insight"))
    key = F.lower(F.regexp_replace(F.col("insight"), r"(?U)^\s+|\s+$", ""))
    first = F.min(F.struct("src", "pos", "insight"))
    return (x.groupBy(*by, key.alias("k")).agg(first.alias("f"))
             .select(*by, F.col("f.insight").alias("insight"),
                     F.col("f.src").alias("first_src"), F.col("f.pos").cast("bigint").alias("first_pos")))


def sentiment_percentage(dist: DataFrame, label: str = "toward_op", by=BY) -> DataFrame:
    """AG8: unrounded share of each label; 0.0 everywhere when the total is 0."""
    total = F.sum("n").over(Window.partitionBy(*by))
    return dist.withColumn("pct", F.when(total == 0, F.lit(0.0))
                                   .otherwise(F.col("n") / total * F.lit(100.0)))


def batch_summary(results: DataFrame) -> DataFrame:
    """AG9: succeeded / total / all succeeded, over per-input result rows."""
    return results.agg(F.count_if(F.col("success")).alias("succeeded"),
                       F.count(F.lit(1)).alias("total"),
                       F.coalesce(F.bool_and(F.col("success")), F.lit(True)).alias("all_ok"))


def estimate_time(n_comments) -> Column:
    """AG10: 10 s per post plus 0.5 s per comment."""
    n = F.col(n_comments) if isinstance(n_comments, str) else n_comments
    return F.lit(10.0) + n.cast("double") * F.lit(0.5)


def consensus_rollup(df: DataFrame, by=BY) -> DataFrame:
    """AG11: supportive / critical / neutral counts and exact shares, distinct themes."""
    s = _label("toward_op")
    agg = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(s == "supportive").alias("n_supportive"),
        F.count_if(s == "critical").alias("n_critical"),
        F.count_if(s == "neutral").alias("n_neutral"),
        F.count_distinct(_label("intent_primary")).alias("n_themes"))
    return agg.select("*", *[pct1(f"n_{x}", "total").alias(f"pct_{x}")
                             for x in ("supportive", "critical", "neutral")])
