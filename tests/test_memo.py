"""Memo tables: TTL rule, lookup, upsert, purge, stats, cascade delete, snapshot store."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from threadlens.operators import memo as M

AS_OF = "2024-01-31 00:00:00"


def memo(spark, rows):
    return spark.createDataFrame(rows, "url string, payload string, cached_at timestamp_ntz")


def test_expiry_rule(spark):
    t = dt.datetime(2024, 1, 31)
    df = memo(spark, [("a", "1", t - dt.timedelta(hours=25)), ("b", "2", t - dt.timedelta(hours=23)),
                      ("c", "3", None), ("d", "4", t - dt.timedelta(hours=24))])
    got = dict(df.select("url", M.is_expired("cached_at", AS_OF, 24)).collect())
    assert got == {"a": True, "b": False, "c": True, "d": False}
    # TTL 0 h: an entry written before as_of is expired; TTL 1 h: a fresh one is live
    df0 = memo(spark, [("x", "1", t - dt.timedelta(seconds=1))])
    assert df0.select(M.is_expired("cached_at", AS_OF, 0)).first()[0] is True
    assert df0.select(M.is_expired("cached_at", AS_OF, 1)).first()[0] is False


def test_lookup_upsert_delete(spark):
    t = dt.datetime(2024, 1, 30, 12)
    cur = memo(spark, [("a", "old", t), ("b", "b1", t - dt.timedelta(days=3))])
    new = memo(spark, [("a", "new", t - dt.timedelta(hours=1)), ("c", "c1", t)])
    up = {r.url: r.payload for r in M.memo_upsert(cur, new, "url").collect()}
    assert up == {"a": "new", "b": "b1", "c": "c1"}
    keys = spark.createDataFrame([("a",), ("b",), ("z",)], "url string")
    look = {r.url: (r.hit, r.payload) for r in M.memo_lookup(keys, cur, "url", AS_OF).collect()}
    assert look == {"a": (True, "old"), "b": (False, None), "z": (False, None)}
    assert sorted(r.url for r in M.memo_misses(keys, cur, "url", AS_OF).collect()) == ["b", "z"]
    comments = spark.createDataFrame([("c1", "a"), ("c2", "b")], "comment_id string, post_url string")
    p, c = M.memo_delete_cascade(cur, comments, spark.createDataFrame([("a",)], "url string"))
    assert [r.url for r in p.collect()] == ["b"] and [r.comment_id for r in c.collect()] == ["c2"]


def test_stats_purge_clear(spark):
    t = dt.datetime(2024, 1, 30, 12)
    posts = memo(spark, [("p1", "x", t), ("p2", "y", t)])
    ocr = spark.createDataFrame([("i1", "txt", t)], "image_url string, extracted_text string, cached_at timestamp_ntz")
    link = spark.createDataFrame([("l1", "T", "C", "d", t - dt.timedelta(days=2))],
                                 "url string, title string, content string, source_domain string, cached_at timestamp_ntz")
    comments = spark.createDataFrame([], "comment_id string, post_url string, cached_at timestamp_ntz")
    tables = {"posts": posts, "comments": comments, "ocr_results": ocr, "link_content": link}
    stats = {r.table_name: r.entries for r in M.memo_stats(tables).collect()}
    assert stats == {"posts": 2, "comments": 0, "ocr_results": 1, "link_content": 1}
    kept, counts = M.memo_purge(tables, AS_OF)
    assert {r.table_name: (r.purged, r.kept) for r in counts.collect()}["link_content"] == (1, 0)
    assert M.memo_clear_all(posts).count() == 0 and M.memo_clear_all(posts).schema == posts.schema


def test_reuse_marks_cache(spark):
    t = dt.datetime(2024, 1, 30, 12)
    m = memo(spark, [("a", "A", t), ("b", None, t)])
    keys = spark.createDataFrame([("a",), ("b",)], "url string")
    r = M.memo_reuse(keys, m, "url", "payload",
                     lambda miss: miss.select("url", F.lit("fresh").alias("payload")), AS_OF)
    assert {x.url: (x.payload, x.from_cache) for x in r.collect()} == {"a": ("A", True), "b": ("fresh", False)}


def test_snapshot_store(spark):
    root = tempfile.mkdtemp(prefix="memo-store-")
    store = M.MemoStore(spark, root)
    assert store.read() is None
    t = dt.datetime(2024, 1, 30, 12)
    store.write(memo(spark, [("a", "1", t)]))
    store.upsert(memo(spark, [("a", "2", t), ("b", "3", t)]), "url")
    assert {r.url: r.payload for r in store.read().collect()} == {"a": "2", "b": "3"}


def test_report_sinks_switch(spark, tmp_path):
    import pytest
    from threadlens.sources import reports as SR
    df = spark.createDataFrame([(1, "x", "# md")], "post_id bigint, summary string, markdown string")
    assert SR.save_reports(df, str(tmp_path / "a"), "json") == [str(tmp_path / "a") + "/json"]
    assert SR.save_reports(df, str(tmp_path / "b"), "both", save_to_file=False) == []
    out = SR.save_reports(df, str(tmp_path / "c"), "markdown")
    md = spark.read.json(out[0]).first()
    assert (md.post_id, md.file_name, md.markdown) == ("1", "1.md", "# md")
    back = spark.read.json(str(tmp_path / "a") + "/json").first()
    assert back.summary == "x" and "markdown" not in back.asDict()
    with pytest.raises(ValueError):
        SR.save_reports(df, str(tmp_path / "d"), "pdf")


def test_cli_memo_commands(spark, tmp_path, capsys):
    from threadlens.__main__ import main
    t = dt.datetime(2024, 1, 30, 12)
    store = M.MemoStore(spark, str(tmp_path / "posts"))
    store.write(memo(spark, [("a", "1", t), ("b", "2", t - dt.timedelta(days=3))]))
    assert main(["memo-stats", "--store", f"posts={tmp_path / 'posts'}"]) == 0
    assert "posts\t2" in capsys.readouterr().out
    assert main(["memo-purge", "--store", f"posts={tmp_path / 'posts'}", "--as-of", AS_OF]) == 0
    assert "posts\t1 purged\t1 kept" in capsys.readouterr().out
    assert [r.url for r in store.read().collect()] == ["a"]
    assert main(["memo-delete", "--store", f"posts={tmp_path / 'posts'}", "--key-column", "url", "--key", "zz"]) == 0
    assert store.read().count() == 1
    assert main(["memo-clear", "--store", f"posts={tmp_path / 'posts'}"]) == 0
    assert store.read().count() == 0 and store.read().columns


def test_unreadable_store_is_an_error(spark, tmp_path):
    import pytest
    (tmp_path / "broken" / "_commits").mkdir(parents=True)
    (tmp_path / "broken" / "_commits" / "000000000001").write_bytes(b"no commit at all")
    with pytest.raises(Exception):
        M.MemoStore(spark, str(tmp_path / "broken")).read()


def test_reports_through_memo_and_schema(spark, tmp_path):
    """PL1 behind its memo: the second run reuses all reports; saved reports keep their types."""
    from threadlens.plans import pipeline as PL
    from threadlens.plans.q_report import _posts
    from threadlens.schemas import MEMO_REPORT
    from threadlens.sources import reports as SR
    from threadlens.sources.tables import Views
    d = "/root/testdata/sf0.001"
    urls = spark.createDataFrame([("https://reddit.com/r/a/comments/3/x/",), ("https://example.com/none",)], "url string")
    posts, comments = PL.requested(urls, _posts(spark, d), Views(spark, d).threads())
    assert [r.post_id for r in posts.collect()] == [3]
    store = M.MemoStore(spark, str(tmp_path / "memo"))
    empty = store.read(MEMO_REPORT).withColumn("post_id", F.col("post_id").cast("bigint"))
    first, new = PL.analyze_reuse(posts, comments, empty, AS_OF)
    assert [r.report.metadata.from_cache for r in first.collect()] == [False]
    store.upsert(new, "post_id")
    again, none = PL.analyze_reuse(posts, comments, store.read(), AS_OF)
    row = again.first()
    assert row.report.metadata.from_cache and none.count() == 0
    assert row.report.comments_analysis.comments_available == comments.count() > 0
    _, all_new = PL.analyze_reuse(posts, comments, store.read(), AS_OF, use_cache=False)
    assert all_new.count() == 1
    SR.save_reports(first, str(tmp_path / "out"), "json")
    back = SR.load_reports(spark, str(tmp_path / "out") + "/json")
    assert back.schema["report"].dataType.simpleString() == first.schema["report"].dataType.simpleString()
    assert back.first().report.comments_analysis.intent_distribution == \
        first.first().report.comments_analysis.intent_distribution


def _rows(store):
    return {r.url: r.payload for r in store.read().collect()}


def test_store_writes_only_the_rows_it_is_given(spark, tmp_path):
    t = dt.datetime(2024, 1, 30, 12)
    store = M.MemoStore(spark, str(tmp_path / "m"), buckets=8)
    store.write(memo(spark, [(f"k{i}", "old", t) for i in range(200)]), "url")
    before = {p for p in (tmp_path / "m" / "runs").iterdir()}
    store.upsert(memo(spark, [("k1", "new", t), ("k1", "older", t - dt.timedelta(hours=1)), ("n", "new", t)]), "url")
    added = [p for p in (tmp_path / "m" / "runs").iterdir() if p not in before]
    assert len(added) == 1 and spark.read.parquet(str(added[0])).count() == 2
    assert len(list(added[0].glob("_bucket=*/*.parquet"))) <= 2
    rows = _rows(store)
    assert len(rows) == 201 and rows["k1"] == rows["n"] == "new" and rows["k2"] == "old"
    store.delete(spark.createDataFrame([("k2",), ("absent",)], "url string"), "url")
    assert "k2" not in _rows(store) and len(_rows(store)) == 200
    store.upsert(memo(spark, [("k2", "back", t)]), "url")
    assert _rows(store)["k2"] == "back"


def test_store_merges_runs_and_equals_a_dict(spark, tmp_path):
    import random
    rng, t, want = random.Random(3), dt.datetime(2024, 1, 30, 12), {}
    store = M.MemoStore(spark, str(tmp_path / "m"), buckets=4)
    for step in range(10):
        keys = rng.sample(range(40), rng.randrange(1, 12))
        if step % 4 == 3:
            store.delete(spark.createDataFrame([(f"k{k}",) for k in keys], "url string"), "url")
            for k in keys:
                want.pop(f"k{k}", None)
        else:
            store.upsert(memo(spark, [(f"k{k}", f"{step}", t) for k in keys]), "url")
            want.update({f"k{k}": f"{step}" for k in keys})
        assert len(store._head()[1]["runs"]) <= 6
    assert _rows(store) == want
    listed = {r["run"] for r in store._head()[1]["runs"]}
    assert store.vacuum(keep=1) and {p.name for p in (tmp_path / "m" / "runs").iterdir()} == listed
    assert _rows(store) == want


def test_second_writer_of_a_version_fails(spark, tmp_path):
    import pytest
    t = dt.datetime(2024, 1, 30, 12)
    store = M.MemoStore(spark, str(tmp_path / "m"), buckets=4, retries=0)
    store.write(memo(spark, [("a", "0", t), ("b", "0", t), ("c", "0", t)]), "url")
    head, commit = store._head()
    mine, theirs = (store._write_run(memo(spark, [(k, "1", t)]), "url") for k in "ab")
    store._append_to(head, commit, "url", theirs)
    with pytest.raises(M.MemoConflict):
        store._append_to(head, commit, "url", mine)
    assert _rows(store) == {"a": "0", "b": "1", "c": "0"}
    store._append("url", mine)                     # looking again, nothing of either is lost
    assert _rows(store) == {"a": "1", "b": "1", "c": "0"}
    assert not [p for p in (tmp_path / "m" / "_commits").iterdir() if "-" in p.name and not p.name.endswith(".crc")]


def test_lookup_reads_the_buckets_of_its_keys(spark, tmp_path):
    t = dt.datetime(2024, 1, 30, 12)
    store = M.MemoStore(spark, str(tmp_path / "m"), buckets=16)
    store.write(memo(spark, [(f"k{i}", str(i), t) for i in range(100)]), "url")
    store.upsert(memo(spark, [("k7", "new", t), ("k8", "late", t - dt.timedelta(days=9))]), "url")
    got = store.lookup(spark.createDataFrame([("k7",), ("k8",), ("none",)], "url string"), AS_OF)
    assert {r.url: (r.payload, r.hit) for r in got.collect()} == \
        {"k7": ("new", True), "k8": (None, False), "none": (None, False)}
    one = store.lookup(spark.createDataFrame([("k7",)], "url string"), AS_OF)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(_bucket") + plan.count("PartitionFilters: [(_bucket") >= 2, plan
    assert store.purge(AS_OF) == (1, 99) and "k8" not in _rows(store)


def test_lookup_over_runs_of_other_buckets(spark, tmp_path):
    """A first table written without a key, and writers with other numbers of buckets."""
    t, root = dt.datetime(2024, 1, 30, 12), str(tmp_path / "m")
    M.MemoStore(spark, root).write(memo(spark, [(f"k{i}", "a", t) for i in range(30)]))
    M.MemoStore(spark, root, buckets=8).upsert(memo(spark, [(f"k{i}", "b", t) for i in range(5)]), "url")
    store = M.MemoStore(spark, root, buckets=3)
    store.upsert(memo(spark, [("k0", "c", t)]), "url")
    keys = spark.createDataFrame([("k0",), ("k4",), ("k29",), ("k30",)], "url string")
    got = {r.url: r.payload for r in store.lookup(keys, AS_OF).collect()}
    assert got == {"k0": "c", "k4": "b", "k29": "a", "k30": None}
