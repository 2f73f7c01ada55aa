"""Ranking, filtering and sampling of comments (RK1-RK6, SA1, SA2).

Bounded top-k per thread is ``row_number() <= k``, which Catalyst plans as a
``WindowGroupLimit`` before and after the shuffle: each map task forwards at most k rows
per thread, so a hot thread costs k rows of shuffle per task, not its size. Every
ranking ends with a unique tie-break (the pre-order ``path`` or ``seq``), so results are
deterministic under any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.text import word_count

BY = ["post_id"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def heuristic_score(body="body", depth="depth", score="score") -> Column:
    """RK1: length bonus * 0.5 + depth penalty * 0.3 + score / 1000 (all DOUBLE)."""
    return heuristic_of(word_count(body), depth, score)


def heuristic_of(words, depth="depth", score="score") -> Column:
    """RK1 from a word count."""
    w = _c(words).cast("double")
    lb = F.when(w >= 20, F.lit(1.0)).otherwise(w / F.lit(20.0))
    dp = F.lit(1.0) - F.least(F.coalesce(_c(depth), F.lit(0)).cast("double") * F.lit(0.05), F.lit(0.5))
    s = F.coalesce(_c(score), F.lit(0)).cast("double")
    return (lb * F.lit(0.5) + dp * F.lit(0.3)) + s / F.lit(1000.0)


def top_k(df: DataFrame, k: int, order: list, by=BY, rank: str = "rank") -> DataFrame:
    """Generic per-group top-k with a 1-based BIGINT rank column."""
    w = Window.partitionBy(*by).orderBy(*order)
    return (df.withColumn(rank, F.row_number().over(w))
              .filter(F.col(rank) <= k)
              .withColumn(rank, F.col(rank).cast("bigint")))


def pre_filter(df: DataFrame, max_count: int = 100, by=BY, tie="path") -> DataFrame:
    """RK2: the max_count comments with the best heuristic score, ties in pre-order."""
    x = df.withColumn("heuristic", heuristic_score())
    return top_k(x, max_count, [F.col("heuristic").desc(), F.col(tie)], by)


def filter_quality(df: DataFrame, threshold: float = 2.0) -> DataFrame:
    """RK3: quality_score (missing = 0) at least threshold."""
    return df.filter(F.coalesce(F.col("quality_score").cast("double"), F.lit(0.0)) >= threshold)


def relevance_weight() -> Column:
    return (F.coalesce(F.col("relevance_score").cast("double"), F.lit(0.0))
            * F.coalesce(F.col("score"), F.lit(0)).cast("double"))


def top_comments(df: DataFrame, k: int = 10, by=BY, tie="seq") -> DataFrame:
    """RK4: k comments by relevance x score, descending; adds text = body when present."""
    x = df.withColumn("weight", relevance_weight())
    if "body" in df.columns:
        x = x.withColumn("text", F.col("body"))
    return top_k(x, k, [F.col("weight").desc(), F.col(tie)], by)


def best_comment(df: DataFrame, by=BY, tie="path", cols=("comment_id", "score")) -> DataFrame:
    """RK5: the highest-scoring comment per thread (missing score = 0), first in order on ties.

    A grouped ``min_by`` aggregates partially on the map side: one row per thread per task.
    """
    key = F.struct((-F.coalesce(F.col("score"), F.lit(0))).alias("neg"), F.col(tie).alias("t"))
    return df.groupBy(*by).agg(*[F.min_by(F.col(c), key).alias(f"best_{c}") for c in cols])


def hot_posts(posts: DataFrame, k: int = 5, community: str = "subreddit",
              rank_col: str = "score") -> DataFrame:
    """RK6: top-k posts per community by a ranking column (ties by post_id)."""
    return top_k(posts, k, [F.col(rank_col).desc(), F.col("post_id")], [community])


# Comment-count bands of the sampling strategy.
SAMPLING_BANDS = [(50, "all", None), (500, "top_plus_sampling", 100), (None, "top_clustering", 200)]


def sampling_strategy(n) -> Column:
    """SA1: (strategy, max_comments, more_limit) from a thread's comment count."""
    n = _c(n)
    strategy = (F.when(n < 50, F.lit("all")).when(n < 500, F.lit("top_plus_sampling"))
                 .otherwise(F.lit("top_clustering")))
    max_c = (F.when(n < 50, F.lit(None).cast("bigint")).when(n < 500, F.lit(100).cast("bigint"))
              .otherwise(F.lit(200).cast("bigint")))
    return F.struct(strategy.alias("strategy"), max_c.alias("max_comments"),
                    F.lit(0).cast("bigint").alias("more_limit"))


def apply_sampling(df: DataFrame, max_comments: int, by=BY, tie="seq") -> DataFrame:
    """SA2: threads with at most max comments keep all in source order; larger ones keep the
    top 70 % by score and then every step-th of the rest, step = len(rest) // (max - top).

    Adds ``sample_pos`` (1-based position in the sampled list). The score rank and thread size
    come from range-partitioned segments (a hot thread is split over many tasks); the source
    order is only needed for threads of at most ``max_comments`` rows, a bounded window.
    """
    from threadlens.operators.positions import group_positions
    top = int(max_comments * 0.7)
    room = max_comments - top
    x = group_positions(df, by, [(F.coalesce(F.col("score"), F.lit(0)), True), (tie, False)], key=[tie],
                        out="_rn", size="_n")
    small = x.filter(F.col("_n") <= max_comments).withColumn(
        "sample_pos", F.row_number().over(Window.partitionBy(*by).orderBy(tie)).cast("bigint"))
    step = F.greatest(F.floor((F.col("_n") - top) / F.lit(max(1, room))).cast("bigint"), F.lit(1))
    idx = F.col("_rn") - top - 1
    keep = (F.col("_rn") <= top) | ((idx % step == 0) & (F.floor(idx / step) < room))
    pos = F.when(F.col("_rn") <= top, F.col("_rn")).otherwise(F.floor(idx / step) + top + 1)
    big = (x.filter(F.col("_n") > max_comments).filter(keep)
            .withColumn("sample_pos", pos.cast("bigint")))
    return small.unionByName(big).drop("_n", "_rn")
