"""DuckDB SQL for the fixture views and the scalar rules, used as independent oracles.

Every view here mirrors ``threadlens.sources.tables.Views``; every scalar helper mirrors a
Spark column function. ``sql(body, *views)`` prepends the WITH clause a query needs.
"""

from __future__ import annotations

# Unicode White_Space, the class Java's (?U)\s matches (RE2's \s is ASCII only).
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "v_comments": ("""
SELECT conv_id AS post_id, conv_id * 100 + turn AS comment_id,
       CASE WHEN turn < 2 THEN NULL ELSE conv_id * 100 + CAST(floor(turn / 2) AS BIGINT) END AS parent_id,
       turn AS seq, role AS author, text AS body, role = 'user' AS is_submitter,
       (conv_id * 37 + turn * 11) % 400 - 40 AS score
FROM conversations""", []),
    "v_chain": ("""
SELECT post_id, comment_id, CASE WHEN seq = 0 THEN NULL ELSE comment_id - 1 END AS parent_id,
       seq, author, body, is_submitter, score
FROM v_comments""", ["v_comments"]),
    "v_threads": ("""
SELECT doc_id % 20 AS post_id, doc_id AS comment_id,
       CASE WHEN (doc_id // 20) % 8 = 0 THEN NULL ELSE doc_id - 20 END AS parent_id,
       doc_id // 20 AS seq, 'u' || CAST(doc_id % 97 AS VARCHAR) AS author, text AS body,
       (doc_id * 37) % 400 - 40 AS score
FROM documents""", []),
    "v_deep": ("""
SELECT post_id, comment_id, up * 5 + post_id AS parent_id, comment_id AS seq FROM (
  SELECT *, CASE post_id
      WHEN 0 THEN CASE WHEN i % 1200 > 0 THEN i - 1 END
      WHEN 1 THEN CASE WHEN i > 0 THEN 0 END
      WHEN 2 THEN CASE WHEN i > 0 THEN (i - 1) // 2 END
      WHEN 3 THEN CASE WHEN i % 500 = 0 THEN NULL WHEN i % 7 = 3 THEN i // 2 ELSE i - 1 END
      ELSE CASE WHEN i % 20 = 0 THEN NULL WHEN i % 10 = 9 THEN -i WHEN i % 10 = 7 THEN i + 1 ELSE i - 1 END END AS up
  FROM (SELECT event_id AS comment_id, event_id % 5 AS post_id, event_id // 5 AS i FROM events))""", []),
    "v_nested": ("""
WITH d AS (SELECT doc_id // 12 AS post_id, doc_id % 12 AS k, doc_id, coalesce(text, '') AS body FROM documents WHERE doc_id IS NOT NULL)
SELECT post_id, 'D' || CAST(doc_id AS VARCHAR) AS comment_id,
       CASE WHEN k > 0 THEN 'D' || CAST(doc_id - 1 AS VARCHAR) END AS parent_id,
       CASE WHEN k > 0 AND (k - 1) % 2 = 0 THEN 1 ELSE 0 END AS seq, k AS score, body FROM d
UNION ALL
SELECT post_id, 'L' || CAST(doc_id AS VARCHAR), 'D' || CAST(doc_id AS VARCHAR), CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END, 0, NULL
FROM d""", []),
    "v_enriched": ("""
SELECT user_id AS post_id, event_id AS comment_id, event_id AS seq, ts AS created_utc,
       TRY_CAST(props->>'$.k' AS BIGINT) AS score,
       least(value / 10, 10.0) AS quality_score, least(value / 25, 10.0) AS relevance_score,
       CASE WHEN event_type = 'error' THEN NULL ELSE upper(event_type) END AS intent_primary,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'supportive' WHEN event_type = 'click' THEN 'critical'
            WHEN event_type = 'view' THEN 'neutral' END AS toward_op,
       CASE WHEN event_type = 'purchase' THEN 'helpful' WHEN event_type = 'click' THEN 'cynical' END AS overall_tone,
       event_type || '-' || CAST(TRY_CAST(props->>'$.k' AS BIGINT) % 7 AS VARCHAR) AS insight
FROM events""", []),
    "v_posts": ("""
SELECT doc_id AS post_id, split_part(text, '. ', 1) AS title, text AS selftext, source AS subreddit, lang,
       (doc_id * 13) % 5000 - 50 AS score, (doc_id * 7) % 900 AS num_comments,
       CAST((doc_id % 51) + 50 AS DOUBLE) / 100 AS upvote_ratio,
       CASE WHEN doc_id % 11 = 0 THEN NULL ELSE 'u' || CAST(doc_id % 97 AS VARCHAR) END AS author,
       doc_id % 3 = 0 AS is_self, doc_id % 29 = 0 AS is_video, doc_id % 23 = 0 AS is_gallery,
       CASE CAST(doc_id % 6 AS INT)
         WHEN 0 THEN 'https://i.redd.it/' || CAST(doc_id AS VARCHAR)
         WHEN 1 THEN 'https://example.com/a' || CAST(doc_id AS VARCHAR) || '.PNG?x=1'
         WHEN 2 THEN 'https://youtu.be/' || CAST(doc_id AS VARCHAR)
         WHEN 3 THEN 'https://www.reddit.com/r/' || source || '/comments/a' || CAST(doc_id AS VARCHAR) || '/some_long-slug_of_it/'
         WHEN 4 THEN 'https://redd.it/abc' || CAST(doc_id + 100 AS VARCHAR)
         ELSE 'http://user@news.example.org:8080/story/' || CAST(doc_id AS VARCHAR) END AS url
FROM documents""", []),
    "v_memo": ("""
SELECT CAST(user_id AS VARCHAR) || ':' || event_type AS url, props AS payload, ts AS cached_at,
       event_id AS version
FROM events""", []),
    "v_raw_posts": ("""
SELECT *, '/r/' || subreddit || '/comments/' || CAST(post_id AS VARCHAR) || '/' AS permalink,
       1704067200 + post_id * 3607 AS created_epoch,
       CASE WHEN post_id % 13 = 0 THEN 'Discussion' END AS link_flair_text,
       post_id % 17 = 0 AS over_18, post_id % 19 = 0 AS spoiler, post_id % 31 = 0 AS stickied,
       post_id % 37 = 0 AS locked
FROM v_posts""", ["v_posts"]),
    "v_gallery": ("""
SELECT post_id, list_transform(range(0, CAST(post_id % 7 + 1 AS BIGINT)),
         lambda k: 'https://i.redd.it/g' || CAST(post_id AS VARCHAR) || '_' || CAST(k AS VARCHAR) || '.jpg') AS gallery_data
FROM v_posts WHERE is_gallery""", ["v_posts"]),
    "v_ocr": ("""
SELECT url AS image_url, selftext AS extracted_text FROM v_posts
UNION ALL
SELECT g.image_url, 'Image ' || CAST(g.k AS VARCHAR) || ': ' || p.selftext AS extracted_text
FROM (SELECT post_id, unnest(gallery_data) AS image_url,
             unnest(range(0, len(gallery_data))) AS k FROM v_gallery) g
JOIN v_posts p USING (post_id)
WHERE g.k % 3 <> 2""", ["v_posts", "v_gallery"]),
}


def ws_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip_unicode(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


TAG_END = """(?:[^>"'']|"[^"]*"|''[^'']*'')*>"""
ENTITY_SQL = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
              ("&apos;", "''"), ("&nbsp;", " "), ("&copy;", "©"), ("&reg;", "®"),
              ("&middot;", "·"), ("&hellip;", "…"), ("&mdash;", "—"),
              ("&ndash;", "–"), ("&laquo;", "«"), ("&raquo;", "»")]


def decode_numeric(x: str) -> str:
    c1 = {chr(b): c for b in range(128, 160) if (c := bytes([b]).decode("cp1252", "ignore"))}
    code = ("TRY_CAST(CASE WHEN p[3:3] IN ('x', 'X') THEN '0x' || rtrim(p[4:], ';') ELSE rtrim(p[3:], ';') END AS BIGINT)")
    char = f"chr(CASE WHEN {code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111 THEN {code} ELSE 65533 END::INT)"
    return (f"array_to_string(list_transform(regexp_extract_all({x}, "
            "'&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|[^&]+|&'), lambda p: CASE WHEN NOT regexp_matches(p, "
            f"'^&#[xX]?[0-9a-fA-F]') THEN p WHEN {char} = '&' THEN '&amp;' "
            f"ELSE translate({char}, '{''.join(c1)}', '{''.join(c1.values())}') END), '')")


def decode_entities(x: str) -> str:
    x = decode_numeric(x)
    for ent, ch in ENTITY_SQL:
        x = f"replace({x}, '{ent}', '{ch}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def page_title(h: str) -> str:
    raw = f"regexp_extract({h}, '(?is)<title\\b{TAG_END}(.*?)</title\\s*>', 1)"
    return strip_unicode(decode_entities(raw))


def page_text(h: str) -> str:
    x = f"regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ["script", "style", "nav", "footer", "header"]:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b{TAG_END}.*?</{tag}\\s*>', ' ', 'g')"
    main = "NULL"
    for tag in ["body", "main", "article"]:
        main = (f"CASE WHEN regexp_matches({x}, '(?is)<{tag}\\b') THEN "
                f"regexp_extract({x}, '(?is)<{tag}\\b{TAG_END}(.*?)(?:</{tag}\\s*>|\\z)', 1) ELSE {main} END")
    return ws_collapse(decode_entities(f"regexp_replace({main}, '<[a-zA-Z/!?]{TAG_END}', ' ', 'g')"))


def authority(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


def url_path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


VIEWS["v_links"] = (f"""
SELECT url, {page_title('html')} AS title, {page_text('html')} AS content,
       {authority('url')} AS source_domain, {page_text('html')} IS NOT NULL AS found
FROM (SELECT page_id, 'http://user@news.example.org:8080/story/' || CAST(page_id AS VARCHAR) AS url, html
      FROM pages)""", [])


def _deps(names, out):
    for n in names:
        if n in out:
            continue
        _deps(VIEWS[n][1], out)
        out.append(n)
    return out


def sql(body: str, *views: str, extra: list[tuple[str, str]] | None = None,
        recursive: bool = False) -> str:
    """Prefix ``body`` with the fixture views it reads (dependencies first) and extra CTEs."""
    names = _deps(list(views), [])
    ctes = [f"{n} AS ({VIEWS[n][0].strip()})" for n in names]
    ctes += [f"{n} AS ({q.strip()})" for n, q in (extra or [])]
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + ",\n".join(ctes) + "\n" if ctes else "") + body.strip()
