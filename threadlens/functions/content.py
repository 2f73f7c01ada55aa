"""Content typing (CT1-CT4) and post text assembly (TX1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# Fixed values that must equal the reference's: URL markers, checked in this order,
# as substrings anywhere in the lower-cased URL.
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp"]
IMAGE_HOSTS = ["i.redd.it", "i.imgur.com"]
VIDEO_HOSTS = ["v.redd.it", "youtube.com", "youtu.be"]
VIDEO_PLACEHOLDER = "[Video content - unsupported for text extraction]"


def _any_in(u: Column, needles) -> Column:
    cond = F.lit(False)
    for n in needles:
        cond = cond | F.contains(u, F.lit(n))
    return cond


def url_type(url) -> Column:
    """CT1: image / video / link from URL substrings."""
    u = F.lower(F.coalesce(_c(url), F.lit("")))
    return (F.when(_any_in(u, IMAGE_EXTENSIONS), F.lit("image"))
             .when(_any_in(u, IMAGE_HOSTS), F.lit("image"))
             .when(_any_in(u, VIDEO_HOSTS), F.lit("video"))
             .otherwise(F.lit("link")))


def ingest_content_type(is_video, is_gallery, is_self, url) -> Column:
    """CT2: type decided when a post is loaded."""
    return (F.when(F.coalesce(_c(is_video), F.lit(False)), F.lit("video"))
             .when(F.coalesce(_c(is_gallery), F.lit(False)), F.lit("gallery"))
             .when(F.coalesce(_c(is_self), F.lit(False)), F.lit("text"))
             .otherwise(url_type(url)))


def detect_content_type(content_type, is_self, url, gallery_data) -> Column:
    """CT3: an existing type wins; else text, image, video, then gallery, else link."""
    u = url_type(url)
    return F.coalesce(
        _c(content_type),
        F.when(F.coalesce(_c(is_self), F.lit(False)), F.lit("text"))
         .when(u != "link", u)
         .when(_c(gallery_data).isNotNull(), F.lit("gallery"))
         .otherwise(F.lit("link")))


def gallery_urls(items, media_metadata) -> Column:
    """CT4: image URL per gallery item in item order; items without a source are skipped.

    items: ARRAY<STRUCT<media_id STRING>>; media_metadata: MAP<STRING, STRUCT<s: STRUCT<u STRING>>>.
    """
    mm = _c(media_metadata)
    urls = F.transform(_c(items), lambda i: F.try_element_at(mm, i["media_id"])["s"]["u"])
    return F.filter(urls, lambda u: u.isNotNull())


def _nz(c: Column) -> Column:
    """Null for null or empty strings (Python truthiness of a str)."""
    return F.when(c != "", c)


def first_n(arr: Column, n: int | None) -> Column:
    """The first ``n`` elements; all of them without a limit."""
    return arr if n is None else F.slice(arr, 1, n)


def assemble_text(content_type, title, selftext, image_text, gallery_texts,
                  link_found, link_title, link_text, gallery_images: int | None = None,
                  article_cut: int | None = None) -> Column:
    """TX1: the post's text, parts joined by a blank line.

    Fixed values: the part labels ("Title: ", "Body: ", "Image Text: ", "Image {n} Text: ",
    "Linked Article Title: ", "Article Content: ") and the video placeholder are the
    reference's, in the order the parts appear.

    image_text: OCR text of the post image; gallery_texts: ARRAY<STRING> of OCR texts aligned
    with gallery_data (null or '' when an image has none); link_found/link_title/link_text:
    the linked page as extracted by TX5. ``gallery_images`` and ``article_cut`` limit the images
    and the article's characters; by default all are used.
    """
    ct = _c(content_type)
    title_part = F.concat(F.lit("Title: "), _nz(_c(title)))
    body = F.when(ct == "text", F.concat(F.lit("Body: "), _nz(_c(selftext))))
    image = F.when(ct == "image", F.concat(F.lit("Image Text: "), _nz(_c(image_text))))
    gallery = F.when(ct == "gallery", F.transform(
        first_n(F.coalesce(_c(gallery_texts), F.array().cast("array<string>")), gallery_images),
        lambda x, i: F.concat(F.lit("Image "), (i + 1).cast("string"), F.lit(" Text: "), _nz(x))))
    is_link = (ct == "link") & F.coalesce(_c(link_found), F.lit(False))
    link_head = F.when(is_link, F.concat(F.lit("Linked Article Title: "),
                                         F.coalesce(_c(link_title), F.lit(""))))
    link_body = F.when(is_link, F.concat(F.lit("Article Content: "),
                                         _nz(_c(link_text) if article_cut is None
                                             else F.substring(_c(link_text), 1, article_cut))))
    video = F.when(ct == "video", F.lit(VIDEO_PLACEHOLDER))
    return F.concat_ws("\n\n", title_part, body, image, gallery, link_head, link_body, video)
