"""Pipelines (PL1, PL2, PL4): the whole analysis for all posts as one Spark plan.

PL1 ``analyze``: comments -> tree -> (root limit, depth cut, heuristic pre-filter where they
are set) -> batches -> annotator -> quality filter -> per-thread aggregates -> report row per post.

Shuffle plan: by default whole threads are analysed. The rules read a comment's body where it
is scanned; only keys, labels and numbers join the climb of the tree on (post_id, comment_id),
and the per-thread parts are aggregates combined in each task, so no task holds a thread. Bodies
are joined to the few top comments only. With ``max_comments`` the pre-filter is a per-thread
top-k (``WindowGroupLimit`` runs before the shuffle). A model annotator's output is checkpointed
to the shared checkpoint folder so that a lost executor never re-calls the model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.functions import content as ct
from threadlens.functions import urls as U
from threadlens.params import DEFAULT, Params
from threadlens.operators import enrich as EN
from threadlens.operators import forest as FO
from threadlens.operators import memo as M
from threadlens.operators import ranking as R
from threadlens.operators import report as REP
from threadlens.operators import tree as T
from threadlens.operators.positions import group_positions
from threadlens.session import stored

BY = ["post_id"]


def _latest(memo: DataFrame, key: str, order=("cached_at", "version")) -> DataFrame:
    """One row per key of a memo log: its latest entry; without any order column, its greatest."""
    own = [c for c in order if c in memo.columns]
    others = [c for c in memo.columns if c != key]
    return memo.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(
        F.struct(*others), F.struct(*own, *[c for c in others if c not in own])).alias("_r")).select(key, "_r.*")


def post_content(posts: DataFrame, ocr: DataFrame | None = None, links: DataFrame | None = None,
                 params: Params = DEFAULT) -> DataFrame:
    """Content typing (CT3) and text assembly (TX1) with OCR and link text from memo tables.

    ocr: (image_url, extracted_text); links: (url, title, content, found). Of several versions of
    a key the latest is used, so a post stays one row.
    """
    p = posts
    if "content_type" not in p.columns:
        gal = F.col("gallery_data") if "gallery_data" in p.columns else F.lit(None).cast("array<string>")
        p = p.withColumn("content_type", ct.detect_content_type(F.lit(None).cast("string"), "is_self", "url", gal))
    spark = p.sparkSession
    if ocr is None:
        ocr = spark.createDataFrame([], "image_url string, extracted_text string")
    if links is None:
        links = spark.createDataFrame([], "url string, title string, content string, found boolean")
    ocr, links = _latest(ocr, "image_url"), _latest(links, "url")
    img = ocr.select(F.col("image_url").alias("url"), F.col("extracted_text").alias("_image_text"))
    x = p.join(img, "url", "left")
    if "gallery_data" in p.columns:
        g = (p.select("post_id", F.posexplode(ct.first_n(F.col("gallery_data"), params.gallery_images)).alias("_k", "image_url"))
             .join(ocr, "image_url", "left")
             .groupBy("post_id")
             .agg(F.array_sort(F.collect_list(F.struct("_k", "extracted_text"))).alias("_g"))
             .select("post_id", F.transform("_g", lambda e: e["extracted_text"]).alias("_gallery_texts")))
        x = x.join(g, "post_id", "left")
    else:
        x = x.withColumn("_gallery_texts", F.lit(None).cast("array<string>"))
    lk = links.select("url", F.col("found").alias("_lf"), F.col("title").alias("_lt"), F.col("content").alias("_lc"))
    x = x.join(lk, "url", "left")
    text = ct.assemble_text("content_type", "title", "selftext", "_image_text", "_gallery_texts", "_lf", "_lt", "_lc",
                            params.gallery_images, params.article_cut)
    return x.withColumn("extracted_text", text).drop("_image_text", "_gallery_texts", "_lf", "_lt", "_lc")


def annotate_comments(comments: DataFrame, params: Params = DEFAULT, annotator="rule",
                      context: DataFrame | None = None, by=BY, with_body: bool = True) -> DataFrame:
    """TR1/FL1 -> RK2 -> EN1 -> annotator (rule, native Column function, or Python callable)
    -> EN6/EN7 -> EN13 flat columns (quality_score, intent_primary, toward_op, ...).

    Whole threads under the rules have no ``rank``, and no ``body`` unless it is asked for: the
    report joins it to its top comments only.
    """
    if annotator == "rule" and params.max_comments is None:
        flat = _whole_threads(comments, params, by)
        if with_body:
            flat = flat.join(comments.select(*by, F.col("comment_id").cast("string").alias("comment_id"), "body"),
                             [*by, "comment_id"])
    else:
        if params.max_depth is None:
            tree = FO.forest(comments, max_roots=params.max_comments, order=params.comment_order)
            tie = "seq"
        else:
            tree = T.build_tree(comments, params.max_depth, max_roots=params.max_comments, order=params.comment_order)
            tie = "path"
        if params.max_comments is not None:
            ranked = R.pre_filter(tree, params.max_comments, by, tie=tie)
        else:
            ranked = group_positions(tree.withColumn("heuristic", R.heuristic_score()), by,
                                     [("heuristic", True), ("seq", False)], key=["comment_id"], out="rank")
        if annotator == "rule":
            ann = EN.rule_annotate(ranked, params.batch_size)
        else:
            if context is not None:
                ranked = ranked.join(context.select(*by, F.col("post_context").alias("_ctx")), by, "left")
            ann = EN.enrich_comments(ranked, annotator, params.batch_size, by,
                                     context="_ctx" if context is not None else None,
                                     partitions=params.max_concurrent_calls)
            if not getattr(annotator, "native", False):
                ann = ann.checkpoint(eager=True)  # never call the model twice for one batch
        flat = EN.merge_annotation(ann)
    return (flat.withColumn("toward_op", F.col("sentiment")["toward_op"])
                .withColumn("overall_tone", F.col("sentiment")["overall_tone"]))


def _whole_threads(comments: DataFrame, params: Params, by=BY) -> DataFrame:
    """Every comment that hangs on a root, annotated by the rules where it is scanned; stored, as
    several aggregates read it. The body stays behind."""
    keep = [c for c in ("author", "score", "seq") if c in comments.columns]
    facts = EN.rule_facts(comments).select(*by, "comment_id", *keep, "_w", "annotation", "annotation_status")
    places = FO.climb(comments).where("status = 'ok'").select(*by, "comment_id", F.col("depth").cast("int").alias("depth"))
    if params.max_depth is not None:
        places = places.where(F.col("depth") <= params.max_depth)
    flat = facts.join(places, [*by, "comment_id"]).withColumn("heuristic", R.heuristic_of("_w")).drop("_w")
    return stored(EN.merge_annotation(flat), "annotated")


def thread_parts(flat: DataFrame, params: Params = DEFAULT, by=BY, comments: DataFrame | None = None) -> DataFrame:
    """Per-thread aggregates of the annotated comments, one row per thread."""
    return REP.thread_parts(flat, params.quality_threshold, params.report_top_k, params.themes_top_k, by,
                            bodies=None if "body" in flat.columns else comments)


def analyze(posts: DataFrame, comments: DataFrame, as_of: str, params: Params = DEFAULT,
            annotator="rule", post_annotator=None, synthesizer=None, by=BY) -> DataFrame:
    """PL1: one report row per post: (post_id, report, markdown).

    posts need post_id, title, selftext, subreddit, author, score, upvote_ratio, num_comments,
    created_utc, url, permalink, content_type, extracted_text (see ``post_content``).
    """
    if post_annotator is None:
        p = posts.withColumn("post_annotation", EN.default_post_annotation())
    else:
        p = EN.enrich_posts(posts, post_annotator, partitions=params.max_concurrent_calls)
    ctx = p.select(*by, EN.post_context("post_annotation", "title").alias("post_context"))
    flat = annotate_comments(comments, params, annotator, context=None if annotator == "rule" else ctx, by=by,
                             with_body=False)
    parts = thread_parts(flat, params, by, comments)
    available = comments.groupBy(*by).agg(F.count(F.lit(1)).alias("comments_available"))
    x = p.join(parts, by, "left").join(available, by, "left")
    if synthesizer is None:
        x = x.withColumn("synthesis", REP.rule_synthesis())
    else:
        x = x.withColumn("synthesis", EN.synthesis_from(synthesizer(x)))
    rep = _report(x, as_of, by)
    return rep.withColumn("markdown", REP.markdown_report("report", params.markdown_top_k, params.markdown_body_cut))


def analyze_reuse(posts: DataFrame, comments: DataFrame, memo: DataFrame, as_of: str, params: Params = DEFAULT,
                  use_cache: bool = True, **models) -> tuple[DataFrame, DataFrame]:
    """PL1 behind its memo: ``(reports, new memo rows)``.

    ``memo`` is a log of ``(post_id, report, markdown, cached_at)``. A post whose latest entry is
    live (``params.memo_ttl_hours``) gets that report with ``from_cache`` true; only the other
    posts and their comments are analysed, once (the result is checkpointed, as the caller both
    writes it and upserts it). With ``use_cache`` false everything is analysed.
    """
    from threadlens.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(posts.sparkSession)
    hits = M.live(M.current(memo, "post_id"), as_of, params.memo_ttl_hours).where(
        F.col("report").isNotNull() & F.lit(use_cache)).join(posts.select("post_id"), "post_id", "left_semi")
    todo = posts.join(stored(hits.select("post_id"), "hits"), "post_id", "left_anti")
    # several plans read the comments to analyse: their threads are settled once, by keys alone
    threads = stored(comments.select("post_id").distinct().join(todo.select("post_id"), "post_id", "left_semi"), "todo")
    fresh = analyze(todo, comments.join(threads, "post_id", "left_semi"), as_of, params, **models).checkpoint(eager=True)
    cached = F.col("report").withField("metadata.from_cache", F.lit(True)).alias("report")
    new = fresh.withColumn("cached_at", F.lit(as_of).cast("timestamp_ntz"))
    return hits.select("post_id", cached, "markdown").unionByName(fresh), new


def requested(urls: DataFrame, posts: DataFrame, comments: DataFrame, url_col: str = "url"):
    """PL2: the posts and comments that a URL list asks for, before any work is done on them.

    The URLs' ids are cast to the tables' key type, not the other way round; a URL without a
    usable id asks for nothing.
    """
    kind = posts.schema["post_id"].dataType
    ids = urls.select(U.post_id(F.col(url_col)).try_cast(kind).alias("post_id")).where("post_id is not null").distinct()
    return posts.join(ids, "post_id", "left_semi"), comments.join(ids, "post_id", "left_semi")


def _report(x: DataFrame, as_of: str, by=BY) -> DataFrame:
    r = REP.build_report(x, None, as_of, by)
    return r.select(*by, F.struct("metadata", "post_analysis", "comments_analysis", "synthesis", "success")
                    .alias("report"))


def analyze_batch(urls: DataFrame, reports: DataFrame, url_col: str = "url") -> DataFrame:
    """PL2: one row per input URL: success, error and the report when the post is known."""
    u = urls.select(F.col(url_col).alias("post_url"), U.post_id(F.col(url_col)).alias("_pid"))
    r = reports.select(F.col("report.metadata.post_id").alias("_pid"), "report")
    x = u.join(r, "_pid", "left")
    ok = F.col("report").isNotNull()
    return x.select("post_url", ok.alias("success"),
                    F.when(F.col("_pid").isNull(), F.lit("no post id in URL"))
                     .when(~ok, F.lit("post not found")).alias("error"), "report")


def diagnose_fetch(posts: DataFrame, comments: DataFrame, by=BY) -> DataFrame:
    """PL4: slug/title check, flattened comment count and best comment per post."""
    tree = T.build_tree(comments)
    counts = tree.groupBy(*by).agg(F.count(F.lit(1)).alias("flattened_count"))
    best = R.best_comment(tree, by, cols=("comment_id", "score", "body"))
    kw = U.slug_keywords("url")
    p = posts.select(*by, "url", "title", kw.alias("slug_keywords"),
                     U.slug_title_mismatch(kw, "title").alias("slug_title_mismatch"))
    return (p.join(counts, by, "left").join(best, by, "left")
             .withColumn("flattened_count", F.coalesce("flattened_count", F.lit(0).cast("bigint")))
             .withColumn("comments_ok", F.col("flattened_count") > 0))
