"""Plan shape checks, TX5 against the stdlib HTML parser, streaming, pipeline and entry."""

import html
import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import functions as F

from threadlens.functions.html import extract_page
from threadlens.operators import ranking as R
from threadlens.operators import tree as T
from threadlens.sources.tables import Views

from conftest import SF_MID, SF_SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefilter_uses_group_limit(spark):
    t = T.build_tree(Views(spark, SF_SMALL).threads())
    p = plan(R.pre_filter(t, 100))
    assert "WindowGroupLimit" in p            # top-k per thread is limited before the shuffle


def test_aggregates_are_partial(spark):
    from threadlens.operators import stats as S
    p = plan(S.distributions(Views(spark, SF_SMALL).enriched()))
    assert p.count("HashAggregate") >= 2 and "partial_count" in p


def test_scan_prunes_columns(spark):
    from threadlens.sources import posts as P
    v = Views(spark, SF_SMALL)
    p = plan(P.post_metadata(P.normalize_posts(v.raw_posts(), id_col="post_id")))
    scan = [line for line in p.split("\n") if "FileScan parquet" in line][0]
    assert "text" in scan and "lang" not in scan


class _Text(HTMLParser):
    """Reference-style extraction with the stdlib parser (brute force for TX5)."""
    SKIP = {"script", "style", "nav", "footer", "header"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.title, self.in_title, self.parts, self.main_depth = [], "", False, [], None

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "meta"):
            return
        self.stack.append(tag)
        if tag == "title" and not self.title:
            self.in_title = True
        if tag == "article" and self.main_depth is None:
            self.main_depth = len(self.stack)

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if self.main_depth is not None and len(self.stack) >= self.main_depth \
                and not (set(self.stack) & self.SKIP):
            s = data.strip()
            if s:
                self.parts.append(s)


def test_extract_page_matches_stdlib_parser(spark):
    pages = Views(spark, SF_MID).t("pages")
    got = {r.page_id: (r.title, r.text) for r in extract_page(pages).select("page_id", "title", "text").collect()}
    for r in pages.collect():
        p = _Text()
        p.feed(r.html)
        p.close()
        text = " ".join(" ".join(p.parts).split())
        assert got[r.page_id] == (p.title.strip(), text), r.page_id


def test_stream_dedupe(spark, tmp_path):
    from threadlens.streaming import dedupe as ST
    src = str(tmp_path / "in")
    rows = [("u1", "2024-01-01 00:00:00"), ("u1", "2024-01-01 01:00:00"), ("u2", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "post_url string, s string") \
        .select("post_url", F.to_timestamp("s").alias("requested_at")).write.parquet(src)
    out = []
    q = ST.start(spark, src, str(tmp_path / "ckpt"), lambda b, e: out.extend(b.collect()), ttl_hours=24)
    q.awaitTermination(120)
    assert sorted(r.post_url for r in out) == ["u1", "u2"]


def test_stream_dedupe_reprocesses_after_ttl(spark, tmp_path):
    """Micro-batches in event-time order: a repeat within the TTL is dropped; once the
    watermark has passed first_seen + TTL the URL is processed again."""
    from threadlens.streaming import dedupe as ST
    src = tmp_path / "in"
    days = [[("u1", "2024-01-01 00:00:00")], [("u1", "2024-01-01 12:00:00")], [("u9", "2024-01-03 12:00:00")],
            [("u8", "2024-01-03 13:00:00")], [("u1", "2024-01-03 18:00:00")]]
    for i, rows in enumerate(days):   # one folder per batch, written in order
        spark.createDataFrame(rows, "post_url string, s string") \
            .select("post_url", F.to_timestamp("s").alias("requested_at")).coalesce(1) \
            .write.parquet(str(src / f"part={i}"))
    out = []
    q = ST.start(spark, str(src), str(tmp_path / "ckpt"), lambda b, e: out.extend(b.collect()), ttl_hours=24,
                 schema=ST.REQUEST_SCHEMA + ", part INT", max_files_per_trigger=1)
    q.awaitTermination(180)
    got = sorted((r.post_url, str(r.requested_at)) for r in out)
    assert got == [("u1", "2024-01-01 00:00:00"), ("u1", "2024-01-03 18:00:00"), ("u8", "2024-01-03 13:00:00"),
                   ("u9", "2024-01-03 12:00:00")]


def test_stream_dedupe_rule_is_exact(spark, tmp_path):
    """A URL is due again just after 24 hours since it was last processed, not since it was last seen."""
    from threadlens.streaming import dedupe as ST
    src = tmp_path / "in"
    times = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:01", "2024-01-02 23:00:00", "2024-01-03 01:00:00"]
    for i, t in enumerate(times):
        spark.createDataFrame([("u", t)], "post_url string, s string").select(
            "post_url", F.to_timestamp("s").alias("requested_at")).coalesce(1).write.parquet(str(src / f"part={i}"))
    out = []
    q = ST.start(spark, str(src), str(tmp_path / "ckpt"), lambda b, e: out.extend(b.collect()), ttl_hours=24,
                 schema=ST.REQUEST_SCHEMA + ", part INT", max_files_per_trigger=1)
    assert q.awaitTermination(180)
    assert sorted(str(r.requested_at) for r in out) == [times[0], times[2], times[4]]


def test_stream_dedupe_forgets_what_no_longer_matters(spark, tmp_path):
    """A URL's state goes when the watermark has passed its last time plus the TTL; the rule stays exact."""
    from threadlens.streaming import dedupe as ST
    src = tmp_path / "in"
    days = [[(f"u{i}", "2024-01-01 00:00:00") for i in range(20)], [("v", "2024-01-02 12:00:00"), ("u0", "2024-01-01 20:00:00")],
            [("w", "2024-01-03 12:00:00")], [("u0", "2024-01-03 13:00:00"), ("late", "2024-01-01 01:00:00")],
            [("w", "2024-01-09 00:00:00")]]
    for i, rows in enumerate(days):
        spark.createDataFrame(rows, "post_url string, s string").select(
            "post_url", F.to_timestamp("s").alias("requested_at")).coalesce(1).write.parquet(str(src / f"part={i}"))
    out = []
    q = ST.start(spark, str(src), str(tmp_path / "ckpt"), lambda b, e: out.extend(b.collect()), ttl_hours=24,
                 schema=ST.REQUEST_SCHEMA + ", part INT", max_files_per_trigger=1, late_hours=12)
    assert q.awaitTermination(180)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert held[0] == 20 and held[-1] == 1                         # only w, the last one processed
    got = Counter(r.post_url for r in out)
    assert got["u0"] == 2 and got["v"] == 1 and got["w"] == 2 and got["late"] == 0 and got["u5"] == 1


def test_memo_versions_do_not_repeat_posts(spark):
    from threadlens.plans import pipeline as PL
    p = spark.createDataFrame([(1, "t", "", "http://i.redd.it/a.png", False)],
                              "post_id bigint, title string, selftext string, url string, is_self boolean")
    ocr = spark.createDataFrame([("http://i.redd.it/a.png", "old", "2024-01-01"), ("http://i.redd.it/a.png", "new", "2024-01-02")],
                                "image_url string, extracted_text string, cached_at string")
    rows = PL.post_content(p, ocr).collect()
    assert len(rows) == 1 and "new" in rows[0].extracted_text and "old" not in rows[0].extracted_text


def test_pipeline_report_shape(spark):
    import __spark_entry__ as E
    from threadlens.plans.q_report import _reports
    assert E.entry(spark).count() > 0
    df = _reports(spark, SF_SMALL)
    rows = df.collect()
    assert len(rows) > 0
    assert {"post_id", "report", "markdown"} <= set(df.columns)
    r = [x for x in rows if x.report.comments_analysis.total_processed > 0][0]
    ca = r.report.comments_analysis
    assert ca.total_fetched == ca.total_processed >= ca.high_quality_count
    assert r.markdown.startswith("# Reddit Post Analysis Report\n\n**Subreddit:** r/")
    assert r.report.synthesis.community_consensus.validation == r.report.synthesis.community_consensus.validation_status
    assert len(ca.top_comments) <= 10


def test_from_nested_roundtrip(spark):
    nested = spark.createDataFrame(
        [(1, [{"id": "a", "body": "x", "replies": [{"id": "b", "body": "y", "replies": []}]},
              {"id": "c", "body": "z", "replies": []}])],
        "post_id bigint, replies array<struct<id string, body string, replies array<struct<id string, body string, "
        "replies array<struct<id string>>>>>>")
    flat = T.from_nested(nested, levels=3).orderBy("seq").collect()
    assert [(r.id, r.parent_id, r.depth, r.seq) for r in flat] == [("a", None, 0, 0), ("b", "a", 1, 1), ("c", None, 0, 2)]


def test_pipeline_with_python_annotator(spark):
    """PL1 with a model-style Python annotator: prompts carry the post context, responses are
    parsed and matched, and the annotated rows are checkpointed (never re-annotated)."""
    from threadlens.operators.annotators import scripted_python_annotator
    from threadlens.plans import pipeline as PL
    from threadlens.plans.q_report import _posts
    from threadlens.params import Params
    v = Views(spark, SF_SMALL)
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        return scripted_python_annotator(prompts)

    rep = PL.analyze(_posts(spark, SF_SMALL), v.threads(), "2024-01-31T00:00:00", Params(batch_size=5), annotator=model)
    n_calls = calls.value
    rows = rep.collect()
    rep.count()
    assert calls.value == n_calls > 0           # the model ran once, before the actions
    with_comments = [r for r in rows if r.report.comments_analysis.total_processed > 0]
    assert with_comments and all(r.report.comments_analysis.intent_distribution for r in with_comments)
    assert set().union(*[set(r.report.comments_analysis.intent_distribution) for r in with_comments]) <= {"ASK", "UNKNOWN"}  # unanswered comments keep the default


def test_stream_into_pipeline_and_memo(spark, tmp_path):
    """ST1 + PL2/PL1 + M3: each micro-batch's requested posts are analysed and upserted."""
    from threadlens.operators.memo import MemoStore
    from threadlens.plans.q_report import _posts
    from threadlens.streaming import dedupe as ST
    v = Views(spark, SF_SMALL)
    posts = _posts(spark, SF_SMALL)
    src = tmp_path / "in"
    urls = [("https://reddit.com/r/src3/comments/3/", "2024-01-01 00:00:00"),
            ("https://reddit.com/r/src4/comments/4/", "2024-01-01 01:00:00"),
            ("https://reddit.com/r/src3/comments/3/", "2024-01-01 02:00:00"),
            ("https://example.com/no-post", "2024-01-01 03:00:00")]
    for i, row in enumerate(urls):
        spark.createDataFrame([row], "post_url string, s string") \
            .select("post_url", F.to_timestamp("s").alias("requested_at")).coalesce(1) \
            .write.parquet(str(src / f"part={i}"))
    store = MemoStore(spark, str(tmp_path / "memo"))
    proc = ST.analyze_batches(posts, v.threads(), store, "2024-01-31T00:00:00")
    q = ST.start(spark, str(src), str(tmp_path / "ckpt"), proc, schema=ST.REQUEST_SCHEMA + ", part INT",
                 max_files_per_trigger=2)
    q.awaitTermination(300)
    got = {r.url: r.version for r in store.read().collect()}
    assert set(got) == {"https://reddit.com/r/src3/comments/3/", "https://reddit.com/r/src4/comments/4/"}
    assert '"post_id":"3"' in store.read().filter("url LIKE '%/3/'").first().enriched_data


def test_sql_over_registered_views(spark):
    names = Views(spark, SF_SMALL).register()
    assert "v_enriched" in names and "v_threads" in names
    r = spark.sql("SELECT post_id, count(*) AS n FROM v_enriched GROUP BY post_id ORDER BY n DESC LIMIT 1").first()
    assert r.n > 0


def test_cli_analyze_and_batch(spark, tmp_path):
    from threadlens.__main__ import main
    from threadlens.plans.q_report import _posts
    v = Views(spark, SF_SMALL)
    _posts(spark, SF_SMALL).write.parquet(str(tmp_path / "posts"))
    v.threads().write.parquet(str(tmp_path / "comments"))
    (tmp_path / "urls.txt").write_text("# header\nhttps://reddit.com/r/src3/comments/3/\n\n  https://example.com/x  \n")
    common = ["--posts", str(tmp_path / "posts"), "--comments", str(tmp_path / "comments"),
              "--as-of", "2024-01-31T00:00:00"]
    assert main(["analyze", *common, "--out", str(tmp_path / "out"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "out" / "json")).count() == v.posts().count()
    assert main(["batch", *common, "--out", str(tmp_path / "b"), "--urls", str(tmp_path / "urls.txt")]) == 1
    rows = {r.post_url: r.success for r in spark.read.json(str(tmp_path / "b" / "batch")).collect()}
    assert rows == {"https://reddit.com/r/src3/comments/3/": True, "https://example.com/x": False}


def test_post_annotator_and_synthesizer_hooks(spark):
    from threadlens.plans import pipeline as PL
    from threadlens.plans.q_report import _posts

    def post_model(prompts):
        return ['{"core_issue": "issue", "summaries": {"one_sentence": "one", "analytical": "deep"}}'
                if "Subreddit: r/src1" in p else "no idea" for p in prompts]

    def synth(x):   # native synthesizer: response text from the thread's columns
        return F.concat(F.lit('{"executive_summary": "n='), F.coalesce(F.col("total_processed"), F.lit(0)).cast("string"),
                        F.lit('", "community_consensus": {"validation_status": "validated"}}'))

    rep = PL.analyze(_posts(spark, SF_SMALL), Views(spark, SF_SMALL).threads(), "2024-01-31T00:00:00",
                     post_annotator=post_model, synthesizer=synth)
    rows = {r.post_id: r for r in rep.collect()}
    r1, r2 = rows[1], rows[2]
    assert r1.report.post_analysis.core_issue == "issue" and r1.report.post_analysis.summaries.analytical == "deep"
    assert r2.report.post_analysis.core_issue == "Unable to analyze"
    s = r1.report.synthesis
    assert s.executive_summary.startswith("n=") and s.community_consensus.validation == "validated"
    assert s.context == "Unavailable" or s.context is None


def test_pipeline_comment_order(spark):
    """Params.comment_order decides which roots survive the root limit."""
    from threadlens.params import Params
    from threadlens.plans import pipeline as PL
    rows = [(1, i, None, i, "w " * 30, i * 10) for i in range(5)]
    c = spark.createDataFrame(rows, "post_id bigint, comment_id bigint, parent_id bigint, seq bigint, body string, "
                                    "score bigint")
    src = {r.comment_id for r in PL.annotate_comments(c, Params(max_comments=2)).collect()}
    top = {r.comment_id for r in PL.annotate_comments(c, Params(max_comments=2, comment_order="top")).collect()}
    assert src == {"0", "1"} and top == {"4", "3"}


def test_page_attributes_and_references(spark):
    """Quoted '>' ends no tag, a bare '<' starts none, references give their characters."""
    from threadlens.functions.html import extract_page
    long = "<body><p title='" + "x>" * 200_000 + "'>whole</p></body>"
    rows = [(0, "<title a='>'>T&#8217;s</title><article class=\"a>b\"><p title='c>d'>one</p> 1 < 2 it's</article>"),
            (1, "<main>&#x2019;&#233;&#146;&#38;lt;&#0;&#xD800;&#65 &#; &amp;#65;</main>"),
            (2, "<nav data-x='>'>menu</nav><body>a &amp; b</body>"), (3, "<p>none</p>"), (4, None), (5, ""), (6, long)]
    pages = spark.createDataFrame([(i, "http://h.org/x", h) for i, h in rows], "page_id bigint, url string, html string")
    got = {r.page_id: (r.title, r.text, r.found) for r in extract_page(pages).collect()}
    assert got[0] == ("T\u2019s", "one 1 < 2 it's", True)
    assert got[1][1] == "\u2019\u00e9\u2019&lt;\ufffd\ufffdA &#; &#65;"
    assert got[2][1] == "a & b"
    assert [got[i][1:] for i in (3, 4, 5)] == [(None, False)] * 3
    assert got[6][1] == "whole"
    import duckdb
    import pandas as pd
    from threadlens.plans.oracle import page_text, page_title
    pdf = pd.DataFrame(rows, columns=["page_id", "html"])  # noqa: F841 - read by name
    sql = duckdb.sql(f"SELECT page_id, {page_title('html')}, {page_text('html')} FROM pdf").fetchall()
    assert {i: (t, x) for i, t, x in sql} == {i: v[:2] for i, v in got.items()}
