"""Micro goldens for URL, content and text scalars (hand-written inputs)."""

import pytest
from pyspark.sql import functions as F

from threadlens.functions import content as ct
from threadlens.functions import rounding as rd
from threadlens.functions import text as tx
from threadlens.functions import urls as U


def one(spark, col, rows, schema="x string"):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(col).collect()]


@pytest.mark.parametrize("ending", [".jpg", ".jpeg", ".png", ".gif", ".webp"])
def test_url_type_by_ending(spark, ending):
    """An image ending counts anywhere and in any case, before every host."""
    urls = [f"http://cdn.test/pic{ending}", f"http://cdn.test/PIC{ending.upper()}?w=9#f", f"https://youtu.be/clip{ending}",
            f"https://blog.test/how{ending}-files-work", f"https://v.redd.it/{ending}"]
    assert one(spark, ct.url_type("x"), [(u,) for u in urls]) == ["image"] * 5


def test_url_type_by_host(spark):
    kinds = {"https://I.redd.it/no_ending": "image", "http://i.imgur.com/": "image", "https://m.test/?to=i.imgur.com": "image",
             "http://V.REDD.IT/9/DASH": "video", "https://m.youtube.com/shorts/k": "video", "https://youtu.be/": "video",
             "https://i.redd.it/x?u=youtu.be": "image", "https://imgur.com/a/1": "link", "https://vimeo.test/1": "link", "": "link"}
    assert one(spark, ct.url_type("x"), [(u,) for u in kinds]) == list(kinds.values())


def test_content_type_rules(spark):
    rows = [(None, True, "https://i.redd.it/a.jpg", None), ("gallery", False, "https://x.org", None),
            (None, False, "https://x.org", ["a"]), (None, False, "https://i.redd.it/a.jpg", ["a"]),
            (None, False, "https://x.org", None)]
    df = spark.createDataFrame(rows, "ct string, is_self boolean, url string, g array<string>")
    got = [r[0] for r in df.select(ct.detect_content_type("ct", "is_self", "url", "g")).collect()]
    assert got == ["text", "gallery", "gallery", "image", "link"]
    df2 = spark.createDataFrame([(True, True, True, "u"), (False, True, True, "u"), (False, False, True, "u"),
                                 (False, False, False, "https://v.redd.it/q")],
                                "v boolean, g boolean, s boolean, url string")
    assert [r[0] for r in df2.select(ct.ingest_content_type("v", "g", "s", "url")).collect()] == \
        ["video", "gallery", "text", "video"]


def test_assemble_text(spark):
    df = spark.createDataFrame(
        [("video", "T", None, None, None, None, None, None),
         ("gallery", "T", None, None, ["one", "", None, "four", "five", "six"], None, None, None),
         ("link", "", None, None, None, True, "", "x" * 6000),
         ("text", "T", "", None, None, None, None, None)],
        "ct string, t string, s string, o string, g array<string>, lf boolean, lt string, lc string")
    got = [r[0] for r in df.select(ct.assemble_text("ct", "t", "s", "o", "g", "lf", "lt", "lc")).collect()]
    assert got[0] == "Title: T\n\n[Video content - unsupported for text extraction]"
    assert got[1] == "Title: T\n\nImage 1 Text: one\n\nImage 4 Text: four\n\nImage 5 Text: five\n\nImage 6 Text: six"
    assert got[2] == "Linked Article Title: \n\nArticle Content: " + "x" * 6000
    cut = [r[0] for r in df.select(ct.assemble_text("ct", "t", "s", "o", "g", "lf", "lt", "lc", 5, 5000)).collect()]
    assert cut[1].endswith("Image 5 Text: five") and cut[2].endswith(": " + "x" * 5000)
    assert got[3] == "Title: T"


def test_clean_preview_truncate(spark):
    txt = "   Line 1   \n\n   Line 2 with   spaces\n   Line 3\n"
    assert one(spark, tx.clean_text("x"), [(txt,)]) == ["Line 1 Line 2 with spaces Line 3"]
    assert one(spark, tx.text_preview("x", 100), [("A" * 1000,)]) == ["A" * 100 + "..."]
    s = "a" * 80 + "." + "b" * 50
    assert one(spark, tx.text_preview("x", 100), [(s,)]) == ["a" * 80 + "."]
    assert one(spark, tx.text_preview("x", 100), [("short",)]) == ["short"]
    assert one(spark, tx.truncate_text("x", 10), [("abcdefghijkl",), ("abc",)]) == ["abcdefg...", "abc"]
    assert one(spark, tx.word_count("x"), [(" a  b\tc\n",), ("",), (None,)]) == [3, 0, 0]
    assert one(spark, tx.ocr_only("x"), [("Title: t\n\nImage Text:  hello \n",), ("none",)]) == ["hello", None]


def test_format_score_and_timestamp(spark):
    got = one(spark, tx.format_score("x"), [(999,), (1000,), (1050,), (1150,), (12345,), (2_500_000,), (-5000,)],
              "x bigint")
    assert got == ["999", "1.0k", "1.0k", "1.2k", "12.3k", "2.5M", "-5000"]
    got = one(spark, tx.format_timestamp("x", "%Y/%m/%d %H:%M"), [("2024-01-02T03:04:05",), ("garbage",)])
    assert got == ["2024/01/02 03:04", "garbage"]


def test_half_even_contract(spark):
    df = spark.createDataFrame([(1, 16), (3, 16), (23, 80), (0, 0), (80, 100)], "c bigint, n bigint")
    assert [r[0] for r in df.select(rd.pct1("c", "n")).collect()] == [6.2, 18.8, 28.8, 0.0, 80.0]


def test_url_ids(spark):
    urls = ["https://www.reddit.com/r/Python/comments/1h4l0zd/what_do_you_automate_with_python/",
            "https://redd.it/abc1234", "https://www.reddit.com/comments/XyZ12/", "https://example.com/x",
            "https://notredd.it/abcdef"]
    df = spark.createDataFrame([(u,) for u in urls], "x string")
    r = df.select(U.post_id("x"), F.array_join(U.slug_keywords("x"), ","), U.post_id_simple("x"),
                  U.post_id_split("x"), U.url_valid("x")).collect()
    assert [x[0] for x in r] == ["1h4l0zd", "abc1234", "XyZ12", None, None]
    assert r[0][1] == "what,automate,with,python"
    assert [x[2] for x in r] == ["1h4l0zd", "", "", "", ""]
    assert [x[3] for x in r] == ["1h4l0zd", "abc1234", "XyZ12", "", "abcdef"]
    assert [x[4] for x in r] == [True, False, False, False, False]
    df2 = spark.createDataFrame([(["python", "automate"], "What do you automate?"), (["zzzz"], "title"),
                                 ([], "t")], "k array<string>, t string")
    assert [x[0] for x in df2.select(U.slug_title_mismatch("k", "t")).collect()] == [False, True, False]
    assert one(spark, U.source_domain("x"), [("http://user@news.example.org:8080/a",)]) == \
        ["user@news.example.org:8080"]


def test_urls_the_uri_parser_rejects(spark):
    df = spark.createDataFrame([("https://www.reddit.com/r/a b/comments/xyz12/some slug/",), ("not a url",)], "x string")
    r = df.select(U.post_id("x"), U.source_domain("x")).collect()
    assert (r[0][0], r[0][1]) == ("xyz12", "www.reddit.com")
    assert (r[1][0], r[1][1]) == (None, "")


def test_normalize_post_and_comment(spark):
    import datetime as dt
    from threadlens.sources import posts as P
    raw = spark.createDataFrame(
        [("abc123", "Test Post", "Test content", "test_user", "test", 100, 0.95, 50, 1234567890,
          "https://reddit.com/r/test/comments/abc123", "/r/test/comments/abc123", True, None, False, False,
          False, False), ("x", "T", "", None, "s", 1, 1.0, 0, 0, "https://v.redd.it/q", "/r/s/comments/x", False,
                          None, False, False, False, False)],
        "id string, title string, selftext string, author string, subreddit string, score bigint, "
        "upvote_ratio double, num_comments bigint, created_epoch bigint, url string, permalink string, "
        "is_self boolean, link_flair_text string, over_18 boolean, spoiler boolean, stickied boolean, locked boolean")
    r = P.normalize_posts(raw).orderBy("id").collect()
    a = r[0]
    assert (a.id, a.title, a.selftext, a.author, a.subreddit, a.score) == \
        ("abc123", "Test Post", "Test content", "test_user", "test", 100)
    assert a.permalink == "https://reddit.com/r/test/comments/abc123" and a.content_type == "text"
    assert a.created_utc == dt.datetime(2009, 2, 13, 23, 31, 30)
    assert (r[1].author, r[1].content_type) == ("[deleted]", "video")
    c = spark.createDataFrame([("c1", "Test comment", None, 50, 1234567890, False, False, 0.0, 0),
                               ("c2", "b", "u", 1, 0, True, False, 1700000000.0, 1)],
                              "id string, body string, author string, score bigint, created_epoch bigint, "
                              "is_submitter boolean, stickied boolean, edited double, controversiality int")
    got = {x.id: (x.author, x.edited) for x in P.normalize_comments(c).collect()}
    assert got == {"c1": ("[deleted]", False), "c2": ("u", True)}
