"""Normalising raw post and comment dumps (SRC1-SRC3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.functions.content import ingest_content_type

# Site root for permalinks and the placeholder for a missing author.
SITE_ROOT = "https://reddit.com"
DELETED_AUTHOR = "[deleted]"

POST_FIELDS = ["id", "title", "selftext", "author", "subreddit", "score", "upvote_ratio",
               "num_comments", "created_utc", "url", "permalink", "is_self", "link_flair_text",
               "over_18", "spoiler", "stickied", "locked"]
METADATA_FIELDS = ["id", "title", "subreddit", "author", "score", "num_comments", "created_utc"]


def epoch_to_utc(epoch) -> Column:
    """Epoch seconds to a zone-free UTC timestamp (TIMESTAMP_NTZ)."""
    e = F.col(epoch) if isinstance(epoch, str) else epoch
    return F.timestamp_add("SECOND", e.cast("bigint"),
                           F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def normalize_posts(raw: DataFrame, id_col: str = "id", epoch_col: str = "created_epoch") -> DataFrame:
    """SRC1: the 17 post fields plus content_type, video_url and gallery_data when present."""
    cols = set(raw.columns)

    def opt(name, dtype="boolean"):
        return F.col(name) if name in cols else F.lit(None).cast(dtype)

    out = raw.select(
        F.col(id_col).cast("string").alias("id"), "title", "selftext",
        F.coalesce(F.col("author"), F.lit(DELETED_AUTHOR)).alias("author"),
        "subreddit", F.col("score").cast("bigint").alias("score"),
        F.col("upvote_ratio").cast("double").alias("upvote_ratio"),
        F.col("num_comments").cast("bigint").alias("num_comments"),
        epoch_to_utc(epoch_col).alias("created_utc"), "url",
        F.concat(F.lit(SITE_ROOT), F.col("permalink")).alias("permalink"),
        "is_self", opt("link_flair_text", "string").alias("link_flair_text"),
        opt("over_18").alias("over_18"), opt("spoiler").alias("spoiler"),
        opt("stickied").alias("stickied"), opt("locked").alias("locked"),
        ingest_content_type(opt("is_video"), opt("is_gallery"), "is_self", "url").alias("content_type"),
        F.when(F.coalesce(opt("is_video"), F.lit(False)), F.col("url")).alias("video_url"),
        *([F.col("gallery_data")] if "gallery_data" in cols else []))
    return out


def normalize_comments(raw: DataFrame, epoch_col: str = "created_epoch") -> DataFrame:
    """SRC2: author placeholder, edited (false or an epoch) to BOOLEAN, epoch to timestamp."""
    edited_bool = F.coalesce(F.col("edited").try_cast("double"), F.lit(0.0)) != 0
    keep = [c for c in raw.columns if c not in ("author", "edited", epoch_col)]
    return raw.select(*keep, F.coalesce(F.col("author"), F.lit(DELETED_AUTHOR)).alias("author"),
                      epoch_to_utc(epoch_col).alias("created_utc"), edited_bool.alias("edited"))


def post_metadata(posts: DataFrame) -> DataFrame:
    """SRC3: the lightweight 7-column projection (column pruning reaches the file scan)."""
    return posts.select(*METADATA_FIELDS)
