"""Tree, ranking, sampling and aggregation goldens on hand-written threads."""

from pyspark.sql import functions as F

from threadlens.operators import ranking as R
from threadlens.operators import stats as S
from threadlens.operators import tree as T

SCHEMA = "post_id bigint, comment_id bigint, parent_id bigint, seq bigint, body string, score bigint"


def test_depth_cut_and_preorder(spark):
    # chain of 8: depth 0..7; only depth <= 5 survive; plus an orphan
    rows = [(1, i, None if i == 0 else i - 1, i, "b", 1) for i in range(8)] + [(1, 99, 77, 8, "o", 1)]
    t = T.build_tree(spark.createDataFrame(rows, SCHEMA))
    got = sorted((r.comment_id, r.depth) for r in t.collect())
    assert got == [(i, i) for i in range(6)]


def test_preorder_and_root_limit(spark):
    # roots 10, 20; 10 -> 11 -> 12, 10 -> 13; 20 -> 21
    rows = [(1, 10, None, 0, "", 0), (1, 20, None, 1, "", 0), (1, 11, 10, 2, "", 0), (1, 21, 20, 3, "", 0),
            (1, 12, 11, 4, "", 0), (1, 13, 10, 5, "", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    p = T.preorder(T.build_tree(df)).orderBy("preorder").collect()
    assert [r.comment_id for r in p] == [10, 11, 12, 13, 20, 21]
    lim = T.root_limit(df, n=1).collect()
    assert sorted(r.comment_id for r in lim) == [10, 11, 12, 13]
    top = T.preorder(T.build_tree(df.withColumn("score", F.col("comment_id")), order="top")).orderBy("preorder")
    assert [r.comment_id for r in top.collect()] == [20, 21, 10, 13, 11, 12]


def test_heuristic_and_prefilter(spark):
    df = spark.createDataFrame([(1, 1, None, 0, " ".join(["w"] * 10), 100)], SCHEMA).withColumn("depth", F.lit(2))
    h = df.select(R.heuristic_score()).first()[0]
    assert abs(h - 0.62) < 1e-12
    rows = [(1, i, None, i, "same words here", 5) for i in range(5)]
    pf = R.pre_filter(T.build_tree(spark.createDataFrame(rows, SCHEMA)), 3).orderBy("rank").collect()
    assert [r.comment_id for r in pf] == [0, 1, 2]      # ties keep source order


def test_top_comments_order(spark):
    # (relevance, score) pairs of a saved report; expected order of products 96, 80, 72, 64, 56, 54, 42
    pairs = [(8, 12), (7, 6), (8, 10), (9, 8), (8, 7), (9, 6), (8, 8)]
    rows = [(1, i, i, float(r), s, 9.0) for i, (r, s) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "post_id bigint, comment_id bigint, seq bigint, relevance_score double, "
                                     "score bigint, quality_score double")
    got = [r.weight for r in R.top_comments(df, 10).orderBy("rank").collect()]
    assert got == [96.0, 80.0, 72.0, 64.0, 56.0, 54.0, 42.0]


def test_sampling(spark):
    df = spark.createDataFrame([(n,) for n in (30, 200, 1000)], "n bigint")
    got = [tuple(r[0]) for r in df.select(R.sampling_strategy("n")).collect()]
    assert got == [("all", None, 0), ("top_plus_sampling", 100, 0), ("top_clustering", 200, 0)]
    rows = [(1, i, i, 100 - i) for i in range(50)]
    c = spark.createDataFrame(rows, "post_id bigint, comment_id bigint, seq bigint, score bigint")
    s = R.apply_sampling(c, 20).orderBy("sample_pos").collect()
    assert [r.score for r in s] == list(range(100, 86, -1)) + [86, 80, 74, 68, 62, 56]
    small = R.apply_sampling(c, 60).orderBy("sample_pos").collect()
    assert [r.comment_id for r in small] == list(range(50))


def test_best_comment_ties(spark):
    rows = [(1, 1, None, 0, "", 5), (1, 2, None, 1, "", 7), (1, 3, 1, 2, "", 7)]
    t = T.build_tree(spark.createDataFrame(rows, SCHEMA))
    assert R.best_comment(t).first().best_comment_id == 3     # pre-order: 1, 3, 2


def test_theme_percentages_golden(spark):
    labels = ["A"] * 80 + ["B"] * 17 + ["C", "D", "E"]
    df = spark.createDataFrame([(1, x) for x in labels], "post_id bigint, intent_primary string")
    got = [(r.theme, r.pct) for r in S.theme_percentages(df).orderBy("rank").collect()]
    assert got == [("A", 80.0), ("B", 17.0), ("C", 1.0), ("D", 1.0), ("E", 1.0)]


def test_merge_insights(spark):
    df = spark.createDataFrame([(1, 0, ["Alpha", " beta "]), (1, 1, ["alpha", "Gamma", "BETA"])],
                               "post_id bigint, seq bigint, l array<string>")
    got = [r.insight for r in S.merge_insights(df, "l", "seq").orderBy("first_src", "first_pos").collect()]
    assert got == ["Alpha", " beta ", "Gamma"]


def test_partition_invariance(spark):
    from threadlens.sources.tables import Views
    v = Views(spark, "/root/testdata/sf0.001")
    t = v.threads()
    a = sorted(R.pre_filter(T.build_tree(t), 5).select("post_id", "comment_id", "rank").collect())
    b = sorted(R.pre_filter(T.build_tree(t.repartition(7).orderBy(F.rand(3))), 5)
               .select("post_id", "comment_id", "rank").collect())
    assert a == b


def test_group_positions_hot_group(spark):
    """One thread with most of the rows: positions equal a plain row_number, and the hot
    thread is spread over several range partitions."""
    from pyspark.sql import Window
    from threadlens.operators.positions import group_positions
    df = spark.range(0, 5000).select((F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(100)))
                                     .alias("post_id"), F.col("id").alias("seq"),
                                     ((F.col("id") * 7919) % 1000).alias("score"))
    got = group_positions(df, ["post_id"], [("score", True), ("seq", False)], key=["seq"], out="pos", size="n",
                          partitions=8)
    want = df.withColumn("pos", F.row_number().over(
        Window.partitionBy("post_id").orderBy(F.col("score").desc(), "seq")))
    assert sorted(got.select("post_id", "seq", "pos").collect()) == sorted(want.collect() and
                                                                          want.select("post_id", "seq", "pos").collect())
    hot = df.filter("post_id = 100").repartitionByRange(8, "post_id", F.col("score").desc(), "seq")
    assert hot.select(F.spark_partition_id()).distinct().count() > 1
    assert got.filter("post_id = 100").select("n").distinct().first()[0] == df.filter("post_id = 100").count()


def test_new_order(spark):
    import datetime as dt
    rows = [(1, 10, None, 0, dt.datetime(2024, 1, 1)), (1, 20, None, 1, dt.datetime(2024, 1, 3)),
            (1, 11, 10, 2, dt.datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "post_id bigint, comment_id bigint, parent_id bigint, seq bigint, "
                                     "created_utc timestamp")
    p = T.preorder(T.build_tree(df, order="new")).orderBy("preorder").collect()
    assert [r.comment_id for r in p] == [20, 10, 11]
