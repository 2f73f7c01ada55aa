"""URL and identity scalars (URL1-URL7)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Fixed values that must equal the reference's for the same results.
COMMENTS_PATH_RE = r"(?i)/comments/([a-z0-9]+)/?([^/]*)"
SHORTLINK_PATH_RE = r"(?i)^/([a-z0-9]{5,8})/?"
SHORTLINK_HOSTS = ["redd.it", "www.redd.it"]
SLUG_SPLIT_RE = r"[-_]+"
SLUG_MIN_LEN = 4
SIMPLE_ID_RE = r"/comments/([a-z0-9]+)"
VALID_URL_RE = r"^https?://(www\.)?reddit\.com/r/\w+/comments/[a-z0-9]+/"


# Lenient split of scheme://authority/path for URLs the URI parser rejects (spaces, etc.).
AUTHORITY_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
PATH_RE = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def url_path(url) -> Column:
    u = _c(url)
    return F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.regexp_extract(u, PATH_RE, 1))


def source_domain(url) -> Column:
    """URL7: the network location, keeping user info and port ('' when there is none)."""
    u = _c(url)
    return F.coalesce(F.try_parse_url(u, F.lit("AUTHORITY")), F.regexp_extract(u, AUTHORITY_RE, 1))


def post_id(url) -> Column:
    """URL1: id from ``/comments/<id>`` on the path, else a shortlink id, else null."""
    path = url_path(url)
    from_comments = F.nullif(F.regexp_extract(path, COMMENTS_PATH_RE, 1), F.lit(""))
    short = F.nullif(F.regexp_extract(path, SHORTLINK_PATH_RE, 1), F.lit(""))
    return F.coalesce(from_comments,
                      F.when(source_domain(url).isin(*SHORTLINK_HOSTS), short))


def slug_keywords(url) -> Column:
    """URL2: lower-cased slug split on '-'/'_' runs, words of 4+ chars; [] for shortlinks."""
    path = url_path(url)
    has = F.coalesce(F.regexp_like(path, F.lit(COMMENTS_PATH_RE)), F.lit(False))
    slug = F.lower(F.regexp_extract(path, COMMENTS_PATH_RE, 2))
    words = F.filter(F.split(slug, SLUG_SPLIT_RE), lambda w: F.length(w) >= SLUG_MIN_LEN)
    return F.when(has, words).otherwise(F.array().cast("array<string>"))


def slug_title_mismatch(keywords, title) -> Column:
    """URL3: keywords exist and none occurs in the lower-cased title."""
    t = F.lower(F.coalesce(_c(title), F.lit("")))
    return (F.size(_c(keywords)) > 0) & ~F.exists(_c(keywords), lambda k: F.contains(t, k))


def post_id_simple(url) -> Column:
    """URL4: case-sensitive ``/comments/<id>`` anywhere in the URL, '' when absent."""
    return F.regexp_extract(_c(url), SIMPLE_ID_RE, 1)


def post_id_split(url) -> Column:
    """URL5: segment after '/comments/' up to '/', else last segment of a redd.it URL, else ''."""
    u = _c(url)
    after = F.split_part(u, F.lit("/comments/"), F.lit(2))
    seg = F.split_part(after, F.lit("/"), F.lit(1))
    last = F.substring_index(F.regexp_replace(u, "/+$", ""), "/", -1)
    return (F.when(F.contains(u, F.lit("/comments/")), seg)
             .when(F.contains(u, F.lit("redd.it")), last)
             .otherwise(F.lit("")))


def url_valid(url) -> Column:
    """URL6: anchored-at-start reddit post URL pattern."""
    return F.coalesce(F.regexp_like(_c(url), F.lit(VALID_URL_RE)), F.lit(False))
