"""Loading the input tables and the thread-shaped views over them.

The views give the test tables the shapes of the reference's data (posts, comment
forests, annotated comments, memo logs); the same definitions exist as SQL in
``threadlens.plans.oracle`` so that both engines see identical inputs.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# Schemas of the thread-relevant input tables (given, so reading needs no inference job).
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
    "benchmark": "item_id BIGINT, text STRING",
}


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan that yields fewer splits than the cluster has cores.

    A large input already scans in at least as many splits as there are cores and is
    returned unchanged (no shuffle); a small file with a single row group would otherwise
    run every per-row expression in one task.
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        splits = df.rdd.getNumPartitions()
    except Exception:  # noqa: BLE001 - no RDD view (e.g. a remote session): leave the scan as is
        return df
    return df if splits >= cores else df.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str, spread_small: bool = True) -> DataFrame:
    r = spark.read
    if name in SCHEMAS:
        r = r.schema(SCHEMAS[name])
    df = r.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if spread_small else df


def _memo(method):
    """Build a view's (lazy) DataFrame once per Views instance."""
    def wrapper(self):
        key = method.__name__
        if key not in self._built:
            self._built[key] = method(self)
        return self._built[key]
    wrapper.__name__, wrapper.__doc__ = method.__name__, method.__doc__
    return wrapper


class Views:
    """Thread-shaped views over one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._built: dict[str, DataFrame] = {}

    VIEW_NAMES = ["comments", "chain", "threads", "enriched", "posts", "memo", "raw_posts", "gallery", "ocr", "links"]

    def register(self, prefix: str = "v_") -> list[str]:
        """Register the views (and the raw tables) as temporary views for Spark SQL."""
        names = []
        for n in self.VIEW_NAMES:
            getattr(self, n)().createOrReplaceTempView(prefix + n)
            names.append(prefix + n)
        for t in ("events", "documents", "pages", "conversations", "labels"):
            self.t(t).createOrReplaceTempView(t)
            names.append(t)
        return names

    def t(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = table(self.spark, self.sf_dir, name)
        return self._tables[name]

    @_memo
    def comments(self) -> DataFrame:
        """v_comments: a forest with two roots per thread."""
        c = self.t("conversations")
        turn, conv = F.col("turn"), F.col("conv_id")
        return c.select(
            conv.alias("post_id"),
            (conv * 100 + turn).alias("comment_id"),
            F.when(turn < 2, F.lit(None).cast("bigint"))
             .otherwise(conv * 100 + F.floor(turn / 2).cast("bigint")).alias("parent_id"),
            turn.alias("seq"),
            F.col("role").alias("author"),
            F.col("text").alias("body"),
            (F.col("role") == "user").alias("is_submitter"),
            ((conv * 37 + turn * 11) % 400 - 40).alias("score"))

    @_memo
    def chain(self) -> DataFrame:
        """v_chain: each turn replies to the previous one (depth reaches 7)."""
        return self.comments().withColumn(
            "parent_id", F.when(F.col("seq") == 0, F.lit(None).cast("bigint"))
                          .otherwise(F.col("comment_id") - 1))

    @_memo
    def threads(self) -> DataFrame:
        """v_threads: 20 large threads over documents; reply chains 8 deep (depth cut at 5)."""
        d = self.t("documents")
        i = F.col("doc_id")
        step = F.floor(i / 20).cast("bigint")
        return d.select(
            (i % 20).alias("post_id"), i.alias("comment_id"),
            F.when(step % 8 == 0, F.lit(None).cast("bigint")).otherwise(i - 20).alias("parent_id"),
            step.alias("seq"), F.concat(F.lit("u"), (i % 97).cast("string")).alias("author"),
            F.col("text").alias("body"), ((i * 37) % 400 - 40).alias("score"))

    @_memo
    def deep(self) -> DataFrame:
        """v_deep: five threads over events: chains of 1,200, one parent for all, a binary tree, a
        bushy tree, and one with orphans and cycles."""
        e = self.t("events").select(F.col("event_id").alias("comment_id"), (F.col("event_id") % 5).alias("post_id"),
                                    F.expr("event_id div 5").alias("i"))
        up = F.expr("""CASE post_id
            WHEN 0 THEN CASE WHEN i % 1200 > 0 THEN i - 1 END
            WHEN 1 THEN CASE WHEN i > 0 THEN 0 END
            WHEN 2 THEN CASE WHEN i > 0 THEN (i - 1) div 2 END
            WHEN 3 THEN CASE WHEN i % 500 = 0 THEN NULL WHEN i % 7 = 3 THEN i div 2 ELSE i - 1 END
            ELSE CASE WHEN i % 20 = 0 THEN NULL WHEN i % 10 = 9 THEN -i WHEN i % 10 = 7 THEN i + 1 ELSE i - 1 END END""")
        return e.select("post_id", "comment_id", (up * 5 + F.col("post_id")).alias("parent_id"), F.col("comment_id").alias("seq"))

    @_memo
    def nested(self) -> DataFrame:
        """A dump of nested replies over documents: 12 levels deep, each level with a leaf beside
        the next one; ``replies`` is VARIANT."""
        d = self.t("documents").where("doc_id is not null").select(
            F.expr("doc_id div 12").alias("post_id"), (F.col("doc_id") % 12).alias("k"), F.col("doc_id").cast("string").alias("id"),
            F.coalesce("text", F.lit("")).alias("body"))
        last = F.col("k") == F.max("k").over(Window.partitionBy("post_id"))      # 12 rows at most
        leaf = F.concat(F.lit('{"id":"L'), "id", F.lit('","score":0,"replies":[]}'))
        comma = F.when(last, F.lit("")).otherwise(F.lit(","))
        text = F.to_json(F.struct("body"))
        head = F.concat(F.lit('{"id":"D'), "id", F.lit('","score":'), F.col("k").cast("string"), F.lit(","),
                        F.expr("substring(j, 2, length(j) - 2)"), F.lit(',"replies":['))
        d = d.withColumn("j", text).select(
            "post_id", "k", F.when(F.col("k") % 2 == 0, F.concat(head, leaf, comma)).otherwise(head).alias("head"),
            F.when(F.col("k") % 2 == 0, F.lit("]}")).otherwise(F.concat(comma, leaf, F.lit("]}"))).alias("tail"))
        g = d.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("k", "head", "tail"))).alias("r"))
        heads, tails = F.transform("r", lambda x: x["head"]), F.reverse(F.transform("r", lambda x: x["tail"]))
        dump = F.concat(F.lit("["), F.array_join(heads, ""), F.array_join(tails, ""), F.lit("]"))
        return g.select("post_id", F.try_parse_json(dump).alias("replies"))

    @_memo
    def enriched(self) -> DataFrame:
        """v_enriched: annotated comments; the 'error' event plays a missing label."""
        e = self.t("events")
        k = F.get_json_object("props", "$.k").try_cast("bigint")
        et = F.col("event_type")
        return e.select(
            F.col("user_id").alias("post_id"), F.col("event_id").alias("comment_id"),
            F.col("event_id").alias("seq"), F.col("ts").alias("created_utc"),
            k.alias("score"),
            F.least(F.col("value") / 10, F.lit(10.0)).alias("quality_score"),
            F.least(F.col("value") / 25, F.lit(10.0)).alias("relevance_score"),
            F.when(et == "error", F.lit(None).cast("string")).otherwise(F.upper(et)).alias("intent_primary"),
            F.when(et.isin("purchase", "signup"), F.lit("supportive"))
             .when(et == "click", F.lit("critical"))
             .when(et == "view", F.lit("neutral")).alias("toward_op"),
            F.when(et == "purchase", F.lit("helpful"))
             .when(et == "click", F.lit("cynical")).alias("overall_tone"),
            F.concat(et, F.lit("-"), (k % 7).cast("string")).alias("insight"))

    @_memo
    def posts(self) -> DataFrame:
        """v_posts: one post per document; its title is the text's first sentence."""
        d = self.t("documents")
        i = F.col("doc_id")
        m6 = (i % 6).cast("int")
        url = (F.when(m6 == 0, F.concat(F.lit("https://i.redd.it/"), i.cast("string")))
                .when(m6 == 1, F.concat(F.lit("https://example.com/a"), i.cast("string"), F.lit(".PNG?x=1")))
                .when(m6 == 2, F.concat(F.lit("https://youtu.be/"), i.cast("string")))
                .when(m6 == 3, F.concat(F.lit("https://www.reddit.com/r/"), F.col("source"),
                                        F.lit("/comments/a"), i.cast("string"), F.lit("/some_long-slug_of_it/")))
                .when(m6 == 4, F.concat(F.lit("https://redd.it/abc"), (i + 100).cast("string")))
                .otherwise(F.concat(F.lit("http://user@news.example.org:8080/story/"), i.cast("string"))))
        return d.select(
            i.alias("post_id"), F.substring_index("text", ". ", 1).alias("title"),
            F.col("text").alias("selftext"), F.col("source").alias("subreddit"), "lang",
            ((i * 13) % 5000 - 50).alias("score"), ((i * 7) % 900).alias("num_comments"),
            ((i % 51 + 50).cast("double") / 100).alias("upvote_ratio"),
            F.when(i % 11 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("u"), (i % 97).cast("string"))).alias("author"),
            (i % 3 == 0).alias("is_self"), (i % 29 == 0).alias("is_video"),
            (i % 23 == 0).alias("is_gallery"), url.alias("url"))

    @_memo
    def memo(self) -> DataFrame:
        """v_memo: a memo log with several versions per key."""
        e = self.t("events")
        return e.select(
            F.concat(F.col("user_id").cast("string"), F.lit(":"), F.col("event_type")).alias("url"),
            F.col("props").alias("payload"), F.col("ts").alias("cached_at"),
            F.col("event_id").alias("version"))

    @_memo
    def raw_posts(self) -> DataFrame:
        """v_raw_posts: v_posts as an API dump (epoch seconds, relative permalink)."""
        p = self.posts()
        return p.select(
            "*",
            F.concat(F.lit("/r/"), F.col("subreddit"), F.lit("/comments/"),
                     F.col("post_id").cast("string"), F.lit("/")).alias("permalink"),
            (F.lit(1704067200) + F.col("post_id") * 3607).alias("created_epoch"),
            F.when(F.col("post_id") % 13 == 0, F.lit("Discussion")).alias("link_flair_text"),
            (F.col("post_id") % 17 == 0).alias("over_18"),
            (F.col("post_id") % 19 == 0).alias("spoiler"),
            (F.col("post_id") % 31 == 0).alias("stickied"),
            (F.col("post_id") % 37 == 0).alias("locked"))

    @_memo
    def gallery(self) -> DataFrame:
        """v_gallery: gallery image URLs for gallery posts (1 to 7 images, in order)."""
        p = self.posts().filter("is_gallery")
        n = (F.col("post_id") % 7 + 1).cast("int")
        return p.select("post_id", F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda k: F.concat(F.lit("https://i.redd.it/g"), F.col("post_id").cast("string"),
                               F.lit("_"), k.cast("string"), F.lit(".jpg"))).alias("gallery_data"))

    @_memo
    def ocr(self) -> DataFrame:
        """v_ocr: OCR memo for post images and gallery images (every third gallery image has none).

        Each image reads as its post's whole text, a gallery image with its place in front.
        """
        p = self.posts()
        post_img = p.select(F.col("url").alias("image_url"),
                            F.col("selftext").alias("extracted_text"))
        g = (self.gallery().select("post_id", F.posexplode("gallery_data").alias("k", "image_url"))
             .filter(F.col("k") % 3 != 2)
             .join(p.select("post_id", "selftext"), "post_id")
             .select("image_url", F.concat(F.lit("Image "), F.col("k").cast("string"), F.lit(": "),
                                           F.col("selftext")).alias("extracted_text")))
        return post_img.unionByName(g)

    @_memo
    def links(self) -> DataFrame:
        """v_links: link memo rows, one page per story URL."""
        from threadlens.functions.html import extract_page
        pg = self.t("pages").select(
            "page_id", F.concat(F.lit("http://user@news.example.org:8080/story/"),
                                F.col("page_id").cast("string")).alias("url"), "html")
        return extract_page(pg).select("url", "title", F.col("text").alias("content"),
                                       "source_domain", "found")
