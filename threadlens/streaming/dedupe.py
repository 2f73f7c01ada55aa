"""ST1: skip posts that were processed within the TTL, as a streaming query.

Incoming requests (post_url, requested_at) pass if their URL was never processed, or if it was
processed more than ``ttl_hours`` before. The state of a URL is the time it was last processed,
kept by ``applyInPandasWithState`` until the watermark has passed that time plus the TTL: from then
on every request of the URL is due, so nothing needs to be known. The state thus holds the URLs
processed within the TTL and the allowed lateness, not all there ever were. Requests that come more
than ``late_hours`` after later ones are dropped. Within a micro-batch a URL's requests are judged in
event-time order; a request older than the last processed time is not due. Each micro-batch goes to ``process(batch_df, epoch_id)`` (e.g. the PL1 pipeline plus a memo upsert).
The checkpoint folder makes the query restartable after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

REQUEST_SCHEMA = "post_url STRING, requested_at TIMESTAMP"


def _due(ttl_us: int):
    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"key": pd.Series([], dtype="str"), "at": pd.Series([], dtype="int64")})
            return
        last = state.get[0] if state.exists else None
        kept = []
        for t in sorted(t for p in pdfs for t in p["at"].tolist()):
            if last is None or t > last + ttl_us:
                last = t
                kept.append(t)
        state.update((last,))
        # the first millisecond after which every later request is due
        state.setTimeoutTimestamp(max((last + ttl_us) // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"key": [key[0]] * len(kept), "at": pd.Series(kept, dtype="int64")})
    return run


def fresh_requests(stream: DataFrame, ttl_hours: int = 24, key: str = "post_url",
                   ts: str = "requested_at", late_hours: int = 24) -> DataFrame:
    """The requests ``(key, ts)`` that are due. Null keys or times are not requests and are dropped."""
    due = (stream.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
                 .select(F.col(key).alias("key"), F.col(ts).cast("timestamp").alias("ts"))
                 .withWatermark("ts", f"{late_hours} hours").withColumn("at", F.unix_micros("ts"))
                 .groupBy("key").applyInPandasWithState(_due(ttl_hours * 3_600_000_000), "key string, at bigint", "last bigint",
                                                        "append", GroupStateTimeout.EventTimeTimeout))
    return due.select(F.col("key").alias(key), F.timestamp_micros("at").alias(ts))


def start(spark: SparkSession, source: str, checkpoint: str, process: Callable[[DataFrame, int], None],
          ttl_hours: int = 24, available_now: bool = True, schema: str = REQUEST_SCHEMA,
          max_files_per_trigger: int | None = None, state_partitions: int | None = None,
          late_hours: int = 24) -> StreamingQuery:
    """Start the dedupe stream. ``state_partitions`` sizes the state store (fixed for the life
    of the checkpoint); the stream runs in a child session so the caller's SQL settings are
    not changed. Default: the cluster's default parallelism."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions",
                     str(state_partitions or spark.sparkContext.defaultParallelism))
    r = session.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    w = (fresh_requests(r.parquet(source), ttl_hours, late_hours=late_hours)
         .writeStream.option("checkpointLocation", checkpoint).foreachBatch(process))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def analyze_batches(posts: DataFrame, comments: DataFrame, store, as_of: str, params=None,
                    annotator="rule", url_col: str = "post_url") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: analyse the posts a micro-batch asks for (PL2 -> PL1) and
    upsert their reports into the memo store (M3), keyed by the requested URL.

    ``posts`` / ``comments`` are the tables the reports are computed from; ``store`` is a
    ``threadlens.operators.memo.MemoStore``.
    """
    from threadlens.functions.urls import post_id
    from threadlens.params import DEFAULT
    from threadlens.plans import pipeline as PL

    p = params or DEFAULT

    def process(batch: DataFrame, epoch: int) -> None:
        wanted = (batch.select(F.col(url_col).alias("post_url"), post_id(F.col(url_col)).alias("_pid"))
                       .filter(F.col("_pid").isNotNull()))
        ids = wanted.select(F.col("_pid").alias("_k")).distinct()
        sel_posts = posts.join(ids, posts["post_id"].cast("string") == ids["_k"], "left_semi")
        sel_comments = comments.join(ids, comments["post_id"].cast("string") == ids["_k"], "left_semi")
        reports = PL.analyze(sel_posts, sel_comments, as_of, p, annotator=annotator)
        rows = (wanted.join(reports.select(F.col("post_id").cast("string").alias("_pid"), "report", "markdown"),
                            "_pid")
                      .select(F.col("post_url").alias("url"), F.to_json("report").alias("enriched_data"),
                              "markdown", F.lit(as_of).cast("timestamp_ntz").alias("cached_at"),
                              F.lit(epoch).cast("bigint").alias("version")))
        store.upsert(rows, "url", ("cached_at", "version"))

    return process
