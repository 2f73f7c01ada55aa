"""Registered queries for sources, URL, content and text scalars (2.1-2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadlens.functions import content as ct
from threadlens.functions import text as tx
from threadlens.functions import urls as U
from threadlens.functions.html import extract_page
from threadlens.plans.oracle import (WS, authority, decode_entities, page_text, page_title, sql, ws_collapse,
                                     strip_unicode, url_path)
from threadlens.plans.registry import register, shared_plan, _v
from threadlens.session import scratch_path
from threadlens.sources import posts as P
from threadlens.sources.urllist import load_url_list

V_URLS = ("v_urls", """
SELECT post_id AS id, url, title FROM v_posts
UNION ALL SELECT page_id + 1000000000 AS id, url, NULL AS title FROM pages""")


@shared_plan
def _urls(spark, d):
    v = _v(spark, d)
    pages = v.t("pages").select((F.col("page_id") + 1000000000).alias("id"), "url",
                                F.lit(None).cast("string").alias("title"))
    return v.posts().select(F.col("post_id").alias("id"), "url", "title").unionByName(pages)


def _usql(body):
    return sql(body, "v_posts", extra=[V_URLS])


# ---------------------------------------------------------------- URL scalars (2.2)

_P = url_path("url")
_A = authority("url")
_ID = (f"coalesce(nullif(regexp_extract({_P}, '(?i)/comments/([a-z0-9]+)/?([^/]*)', 1), ''), "
       f"CASE WHEN {_A} IN ('redd.it', 'www.redd.it') THEN "
       f"nullif(regexp_extract({_P}, '(?i)^/([a-z0-9]{{5,8}})/?', 1), '') END)")
_KW = (f"CASE WHEN regexp_matches({_P}, '(?i)/comments/([a-z0-9]+)/?([^/]*)') THEN "
       f"list_filter(regexp_split_to_array(lower(regexp_extract({_P}, '(?i)/comments/([a-z0-9]+)/?([^/]*)', 2)), '[-_]+'), "
       f"lambda w: length(w) >= 4) ELSE [] END")


@register("url_post_id", _usql(f"SELECT id, {_ID} AS post_id FROM v_urls"))
def q_url_post_id(spark, d):
    return _urls(spark, d).select("id", U.post_id("url").alias("post_id"))


@register("url_slug_keywords", _usql(f"""
SELECT id, array_to_string({_KW}, '|') AS slug_keywords, CAST(len({_KW}) AS BIGINT) AS n_keywords FROM v_urls"""))
def q_url_slug_keywords(spark, d):
    kw = U.slug_keywords("url")
    return _urls(spark, d).select("id", F.array_join(kw, "|").alias("slug_keywords"),
                                  F.size(kw).cast("bigint").alias("n_keywords"))


@register("slug_mismatch", _usql(f"""
SELECT id, len({_KW}) > 0 AND NOT list_bool_or(list_transform({_KW}, lambda k: contains(lower(coalesce(title, '')), k)))
       AS slug_title_mismatch FROM v_urls"""))
def q_slug_mismatch(spark, d):
    return _urls(spark, d).select(
        "id", U.slug_title_mismatch(U.slug_keywords("url"), "title").alias("slug_title_mismatch"))


@register("url_post_id_simple", _usql(
    "SELECT id, regexp_extract(url, '/comments/([a-z0-9]+)', 1) AS post_id FROM v_urls"))
def q_url_post_id_simple(spark, d):
    return _urls(spark, d).select("id", U.post_id_simple("url").alias("post_id"))


@register("url_post_id_split", _usql("""
SELECT id, CASE WHEN contains(url, '/comments/') THEN split_part(split_part(url, '/comments/', 2), '/', 1)
                WHEN contains(url, 'redd.it') THEN regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$', 0)
                ELSE '' END AS post_id FROM v_urls"""))
def q_url_post_id_split(spark, d):
    return _urls(spark, d).select("id", U.post_id_split("url").alias("post_id"))


@register("url_valid", _usql(
    r"SELECT id, regexp_matches(url, '^https?://(www\.)?reddit\.com/r/\w+/comments/[a-z0-9]+/') AS valid FROM v_urls"))
def q_url_valid(spark, d):
    return _urls(spark, d).select("id", U.url_valid("url").alias("valid"))


@register("source_domain", _usql(f"SELECT id, {_A} AS source_domain FROM v_urls"))
def q_source_domain(spark, d):
    return _urls(spark, d).select("id", U.source_domain("url").alias("source_domain"))


# ---------------------------------------------------------------- content typing (2.3)

def _url_type_sql(u):
    lu = f"lower(coalesce({u}, ''))"
    img = " OR ".join(f"contains({lu}, '{x}')" for x in ct.IMAGE_EXTENSIONS + ct.IMAGE_HOSTS)
    vid = " OR ".join(f"contains({lu}, '{x}')" for x in ct.VIDEO_HOSTS)
    return f"(CASE WHEN {img} THEN 'image' WHEN {vid} THEN 'video' ELSE 'link' END)"


@register("url_type", _usql(f"SELECT id, {_url_type_sql('url')} AS url_type FROM v_urls"))
def q_url_type(spark, d):
    return _urls(spark, d).select("id", ct.url_type("url").alias("url_type"))


_CT2 = (f"CASE WHEN is_video THEN 'video' WHEN is_gallery THEN 'gallery' WHEN is_self THEN 'text' "
        f"ELSE {_url_type_sql('url')} END")


@register("content_type", sql(f"SELECT post_id, {_CT2} AS content_type FROM v_posts", "v_posts"))
def q_content_type(spark, d):
    return _v(spark, d).posts().select(
        "post_id", ct.ingest_content_type("is_video", "is_gallery", "is_self", "url").alias("content_type"))


@register("detect_content_type", sql(f"""
SELECT p.post_id, coalesce(CASE WHEN p.post_id % 7 = 0 THEN 'gallery' END,
         CASE WHEN p.is_self THEN 'text' WHEN {_url_type_sql('p.url')} <> 'link' THEN {_url_type_sql('p.url')}
              WHEN g.gallery_data IS NOT NULL THEN 'gallery' ELSE 'link' END) AS detected_type
FROM v_posts p LEFT JOIN v_gallery g USING (post_id)""", "v_posts", "v_gallery"))
def q_detect_content_type(spark, d):
    v = _v(spark, d)
    p = v.posts().join(v.gallery(), "post_id", "left")
    existing = F.when(F.col("post_id") % 7 == 0, F.lit("gallery"))
    return p.select("post_id", ct.detect_content_type(existing, "is_self", "url", "gallery_data")
                    .alias("detected_type"))


def _gallery_items(spark, d):
    """Gallery items and media metadata shaped like the site's API, from v_gallery:
    item i has metadata unless i % 3 = 1, and that metadata has no source when i % 4 = 3."""
    g = _v(spark, d).gallery()
    idx = F.sequence(F.lit(0), F.size("gallery_data") - 1)
    items = F.transform(idx, lambda i: F.struct(F.concat(F.lit("m"), i.cast("string")).alias("media_id")))
    entries = F.transform(
        F.filter(idx, lambda i: i % 3 != 1),
        lambda i: F.struct(F.concat(F.lit("m"), i.cast("string")).alias("key"),
                           F.struct(F.when(i % 4 != 3, F.struct(F.element_at("gallery_data", i + 1).alias("u")))
                                    .alias("s")).alias("value")))
    return g.select("post_id", items.alias("items"), F.map_from_entries(entries).alias("media_metadata"))


@register("gallery_urls", sql("""
SELECT post_id, array_to_string(list_filter(gallery_data, lambda u, i: (i - 1) % 3 <> 1 AND (i - 1) % 4 <> 3), ' ')
       AS gallery_urls FROM v_gallery""", "v_gallery"))
def q_gallery_urls(spark, d):
    g = _gallery_items(spark, d)
    return g.select("post_id", F.array_join(ct.gallery_urls("items", "media_metadata"), " ").alias("gallery_urls"))


# ---------------------------------------------------------------- text assembly (2.3)

@shared_plan
def _assembled(spark, d):
    v = _v(spark, d)
    p = v.posts().withColumn("content_type",
                             ct.ingest_content_type("is_video", "is_gallery", "is_self", "url"))
    ocr = v.ocr()
    img = ocr.select(F.col("image_url").alias("url"), F.col("extracted_text").alias("image_text"))
    gal = (v.gallery().select("post_id", F.posexplode("gallery_data").alias("k", "image_url"))
           .join(ocr, "image_url", "left")
           .groupBy("post_id")
           .agg(F.array_sort(F.collect_list(F.struct("k", "extracted_text"))).alias("g"))
           .select("post_id", F.transform("g", lambda x: x["extracted_text"]).alias("gallery_texts")))
    links = v.links().select("url", F.col("found").alias("link_found"),
                             F.col("title").alias("link_title"), F.col("content").alias("link_text"))
    x = p.join(img, "url", "left").join(gal, "post_id", "left").join(links, "url", "left")
    return x.select("post_id", "content_type", ct.assemble_text(
        "content_type", "title", "selftext", "image_text", "gallery_texts",
        "link_found", "link_title", "link_text").alias("extracted_text"))


_NL2 = "chr(10) || chr(10)"
_TX1_SQL = f"""
SELECT p.post_id, p.content_type, concat_ws({_NL2},
  CASE WHEN p.title <> '' THEN 'Title: ' || p.title END,
  CASE WHEN p.content_type = 'text' AND p.selftext <> '' THEN 'Body: ' || p.selftext END,
  CASE WHEN p.content_type = 'image' AND o.extracted_text <> '' THEN 'Image Text: ' || o.extracted_text END,
  CASE WHEN p.content_type = 'gallery' THEN nullif(array_to_string(list_filter(list_transform(g.texts,
       lambda x, i: CASE WHEN x <> '' THEN 'Image ' || CAST(i AS VARCHAR) || ' Text: ' || x END), lambda y: y IS NOT NULL), {_NL2}), '') END,
  CASE WHEN p.content_type = 'link' AND l.found THEN 'Linked Article Title: ' || coalesce(l.title, '') END,
  CASE WHEN p.content_type = 'link' AND l.found AND l.content <> ''
       THEN 'Article Content: ' || l.content END,
  CASE WHEN p.content_type = 'video' THEN '{ct.VIDEO_PLACEHOLDER}' END) AS extracted_text
FROM (SELECT *, {_CT2} AS content_type FROM v_posts) p
LEFT JOIN v_ocr o ON o.image_url = p.url
LEFT JOIN (SELECT post_id, list(extracted_text ORDER BY k) AS texts FROM (
             SELECT gg.post_id, gg.k, oo.extracted_text FROM (
               SELECT post_id, unnest(gallery_data) AS image_url,
                      unnest(range(0, len(gallery_data))) AS k FROM v_gallery) gg
             LEFT JOIN v_ocr oo ON oo.image_url = gg.image_url) GROUP BY post_id) g ON g.post_id = p.post_id
LEFT JOIN v_links l ON l.url = p.url"""


@register("assemble_text", sql(_TX1_SQL, "v_posts", "v_gallery", "v_ocr", "v_links"))
def q_assemble_text(spark, d):
    return _assembled(spark, d)


@register("ocr_only", sql(f"""
SELECT post_id, CASE WHEN len(string_split(extracted_text, 'Image Text:')) > 1
                     THEN {strip_unicode("string_split(extracted_text, 'Image Text:')[2]")} END AS ocr_text
FROM ({_TX1_SQL}) WHERE content_type = 'image'""", "v_posts", "v_gallery", "v_ocr", "v_links"))
def q_ocr_only(spark, d):
    a = _assembled(spark, d).filter(F.col("content_type") == "image")
    return a.select("post_id", tx.ocr_only("extracted_text").alias("ocr_text"))


@register("clean_text", sql(f"SELECT doc_id, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS cleaned FROM documents"))
def q_clean_text(spark, d):
    return _v(spark, d).t("documents").select("doc_id", tx.clean_text("text").alias("cleaned"))


@register("extract_page", sql(f"""
SELECT page_id, {page_title('html')} AS title, {page_text('html')} AS text, {authority('url')} AS source_domain
FROM pages"""))
def q_extract_page(spark, d):
    return extract_page(_v(spark, d).t("pages")).select("page_id", "title", "text", "source_domain")


_VISIBLE = page_text("""'<body>' || regexp_replace(html, '(?i)</?(article|main|body)\\b[^>]*>', ' ', 'g')""")


@register("extract_page_nested", sql(f"""
SELECT page_id, {ws_collapse(f"'A ' || CAST(page_id AS VARCHAR) || ' B é&x; ' || {_VISIBLE} || ' tail'")} AS text
FROM pages"""))
def q_extract_page_nested(spark, d):
    """Every page inside the article of another, among nested menus and a nested article."""
    pages = _v(spark, d).t("pages")
    nested = F.concat(F.lit("<nav>menu<nav>in</nav>rest</nav><article>A "), F.col("page_id").cast("string"),
                      F.lit(" <article>B &eacute;&ampx;</article><nav>n<nav>m</nav>k</nav> "), F.col("html"),
                      F.lit(" tail</article> out"))
    return extract_page(pages.select("page_id", "url", nested.alias("html"))).select("page_id", "text")


@register("text_preview", sql("""
SELECT doc_id, CASE WHEN length(text) <= 500 THEN text
  WHEN (CASE WHEN instr(reverse(substring(text, 1, 500)), '.') > 0
             THEN length(substring(text, 1, 500)) - instr(reverse(substring(text, 1, 500)), '.') ELSE -1 END) > 350.0
  THEN substring(text, 1, length(substring(text, 1, 500)) - instr(reverse(substring(text, 1, 500)), '.') + 1)
  ELSE substring(text, 1, 500) || '...' END AS preview
FROM documents"""))
def q_text_preview(spark, d):
    return _v(spark, d).t("documents").select("doc_id", tx.text_preview("text", 500).alias("preview"))


@register("truncate_text", sql("""
SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE substring(text, 1, 97) || '...' END AS truncated
FROM documents"""))
def q_truncate_text(spark, d):
    return _v(spark, d).t("documents").select("doc_id", tx.truncate_text("text", 100).alias("truncated"))


@register("word_count", sql(f"""
SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda w: w <> '')) AS BIGINT) AS words
FROM documents"""))
def q_word_count(spark, d):
    return _v(spark, d).t("documents").select("doc_id", tx.word_count("text").alias("words"))


@register("format_timestamp", sql("""
SELECT event_id, coalesce(strftime(try_cast(s AS TIMESTAMP), '%Y-%m-%d %H:%M'), s) AS formatted
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 'not a date ' || CAST(event_id AS VARCHAR)
                            ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS s FROM events)"""))
def q_format_timestamp(spark, d):
    e = _v(spark, d).t("events")
    s = (F.when(F.col("event_type") == "error", F.concat(F.lit("not a date "), F.col("event_id").cast("string")))
          .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")))
    return e.select("event_id", tx.format_timestamp(s, "%Y-%m-%d %H:%M").alias("formatted"))


def _fmt_score_sql(n):
    def tenths(div):
        q, r = f"(({n}) // {div})", f"(({n}) % {div})"
        t = f"({q} + CASE WHEN 2 * {r} > {div} OR (2 * {r} = {div} AND {q} % 2 = 1) THEN 1 ELSE 0 END)"
        return f"CAST({t} // 10 AS VARCHAR) || '.' || CAST({t} % 10 AS VARCHAR)"
    return (f"CASE WHEN {n} >= 1000000 THEN {tenths(100000)} || 'M' WHEN {n} >= 1000 THEN {tenths(100)} || 'k' "
            f"ELSE CAST({n} AS VARCHAR) END")


@register("format_score", sql(f"""
SELECT post_id, {_fmt_score_sql('score')} AS score_text, {_fmt_score_sql('score * 1013')} AS big_score_text
FROM v_posts""", "v_posts"))
def q_format_score(spark, d):
    p = _v(spark, d).posts()
    return p.select("post_id", tx.format_score("score").alias("score_text"),
                    tx.format_score(F.col("score") * 1013).alias("big_score_text"))


# ---------------------------------------------------------------- sources and sinks (2.1)

_SRC1_SQL = f"""
SELECT CAST(post_id AS VARCHAR) AS id, title, selftext, coalesce(author, '[deleted]') AS author, subreddit,
       score, upvote_ratio, num_comments, make_timestamp(created_epoch * 1000000) AS created_utc, url,
       'https://reddit.com' || permalink AS permalink, is_self, link_flair_text, over_18, spoiler, stickied,
       locked, {_CT2} AS content_type, CASE WHEN is_video THEN url END AS video_url
FROM v_raw_posts"""


@register("normalize_posts", sql(_SRC1_SQL, "v_raw_posts"))
def q_normalize_posts(spark, d):
    return P.normalize_posts(_v(spark, d).raw_posts(), id_col="post_id")


def _raw_comments(spark, d):
    c = _v(spark, d).comments()
    return c.select("post_id", F.col("comment_id").alias("id"), "parent_id", "seq", "body",
                    F.when(F.col("seq") % 5 == 4, F.lit(None).cast("string")).otherwise(F.col("author")).alias("author"),
                    "score", (F.lit(1704067200) + F.col("comment_id") * 61).alias("created_epoch"),
                    "is_submitter", (F.col("seq") == 0).alias("stickied"),
                    F.when(F.col("seq") % 3 == 0, F.lit(0.0))
                     .otherwise((F.lit(1704067200) + F.col("comment_id") * 67).cast("double")).alias("edited"),
                    (F.col("score") < 0).cast("int").alias("controversiality"))


@register("normalize_comments", sql("""
SELECT post_id, comment_id AS id, parent_id, seq, body, score, is_submitter, seq = 0 AS stickied,
       CAST(score < 0 AS INTEGER) AS controversiality,
       coalesce(CASE WHEN seq % 5 = 4 THEN NULL ELSE author END, '[deleted]') AS author,
       make_timestamp((1704067200 + comment_id * 61) * 1000000) AS created_utc,
       seq % 3 <> 0 AS edited
FROM v_comments""", "v_comments"))
def q_normalize_comments(spark, d):
    return P.normalize_comments(_raw_comments(spark, d))


@register("post_metadata", sql(f"""
SELECT id, title, subreddit, author, score, num_comments, created_utc FROM ({_SRC1_SQL})""", "v_raw_posts"))
def q_post_metadata(spark, d):
    return P.post_metadata(P.normalize_posts(_v(spark, d).raw_posts(), id_col="post_id"))


@register("url_list", sql("""
SELECT trim(url) AS url FROM v_posts WHERE NOT is_self"""
                          , "v_posts"))
def q_url_list(spark, d):
    """Writes a URL list file derived from v_posts (self posts as '#' comments, some lines
    indented, blank lines in between), then reads it back through SRC4."""
    p = _v(spark, d).posts()
    m = F.col("post_id") % 4
    line = (F.when(F.col("is_self"), F.concat(F.lit("# "), F.col("url")))
             .when(m == 1, F.concat(F.lit("   "), F.col("url"), F.lit("\t ")))
             .otherwise(F.col("url")))
    lines = p.select(F.explode(F.array(line, F.lit(""))).alias("value"))
    path = scratch_path(spark, f"url_list_{abs(hash(d)) % 10**8}")
    lines.write.mode("overwrite").text(path)
    return load_url_list(spark, path)


@register("output_name", sql(f"""
SELECT id, id || '_' || strftime(created_utc, '%Y%m%d_%H%M%S') || '.json' AS json_name,
       id || '.md' AS md_name FROM ({_SRC1_SQL})""", "v_raw_posts"))
def q_output_name(spark, d):
    from threadlens.sources.reports import output_name
    p = P.normalize_posts(_v(spark, d).raw_posts(), id_col="post_id")
    return p.select("id", output_name("id", "json", "created_utc").alias("json_name"),
                    output_name("id", "md").alias("md_name"))
