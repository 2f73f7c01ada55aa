"""Brute force on a skewed fixture: one thread holds over a third of all comments.

The tree unroll (depth cut), pre-order and the heuristic pre-filter are compared with a
plain-Python implementation of the same rules (recursive flatten, stable sorts).
"""

import random

from pyspark.sql import functions as F

from threadlens.operators import ranking as R
from threadlens.operators import tree as T

SCHEMA = "post_id bigint, comment_id bigint, parent_id bigint, seq bigint, body string, score bigint"


def make_forest(seed=7):
    rnd = random.Random(seed)
    rows, cid = [], 0
    for post, n in [(1, 1500)] + [(p, rnd.randint(1, 60)) for p in range(2, 60)]:
        ids = []
        for s in range(n):
            r = rnd.random()
            parent = None if not ids or r < 0.15 else (ids[-1] if r < 0.55 else rnd.choice(ids))
            if r > 0.995:
                parent = 10 ** 9 + cid                      # orphan: parent does not exist
            words = " ".join(["w"] * rnd.randint(0, 30))
            rows.append((post, cid, parent, s, words, rnd.randint(-50, 500)))
            ids.append(cid)
            cid += 1
    return rows


def brute(rows, max_depth=5, k=100):
    by_post = {}
    for r in rows:
        by_post.setdefault(r[0], []).append(r)
    depth, order, top = {}, {}, {}
    for post, rs in by_post.items():
        kids = {}
        for r in sorted(rs, key=lambda r: r[3]):
            kids.setdefault(r[2], []).append(r)
        flat = []

        def walk(node, d):
            flat.append((node, d))
            depth[node[1]] = d
            if d < max_depth:
                for c in kids.get(node[1], []):
                    walk(c, d + 1)

        for root in kids.get(None, []):
            walk(root, 0)
        for i, (node, _) in enumerate(flat):
            order[node[1]] = i + 1

        def h(item):
            node, d = item
            w = len(node[4].split())
            lb = 1.0 if w >= 20 else w / 20.0
            return (lb * 0.5 + (1.0 - min(d * 0.05, 0.5)) * 0.3) + node[5] / 1000.0

        ranked = sorted(flat, key=h, reverse=True)[:k]
        for i, (node, _) in enumerate(ranked):
            top[node[1]] = i + 1
    return depth, order, top


def test_skewed_thread_matches_brute_force(spark):
    rows = make_forest()
    assert sum(r[0] == 1 for r in rows) * 3 > len(rows)     # the hot thread
    depth, order, top = brute(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    tree = T.build_tree(df)
    got_depth = {r.comment_id: r.depth for r in tree.select("comment_id", "depth").collect()}
    assert got_depth == depth
    got_order = {r.comment_id: r.preorder for r in T.preorder(tree).select("comment_id", "preorder").collect()}
    assert got_order == order
    got_top = {r.comment_id: r.rank for r in R.pre_filter(tree, 100).select("comment_id", "rank").collect()}
    assert got_top == top


def test_hot_thread_spreads_in_tree_joins(spark):
    """Finished rows are keyed by their own id, so the hot thread's rows are not hashed to a
    single (post_id, null) partition."""
    rows = [(1, i, None if i % 10 == 0 else i - 1, i, "", 0) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = F.coalesce(F.col("parent_id"), F.col("comment_id"))
    parts = df.repartition(8, "post_id", key).select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts == 8


def test_invariant_to_shuffle_partitions(spark):
    """Same results with 1 and 64 shuffle partitions (positions, top-k, sampling, aggregates)."""
    import __spark_entry__ as E
    from conftest import SF_SMALL
    names = ["tree_preorder", "pre_filter", "apply_sampling", "theme_percentages", "best_comment", "memo_upsert"]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    results = {}
    try:
        for n in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results[n] = {q: sorted(map(tuple, E.queries()[q](spark, SF_SMALL).collect())) for q in names}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for q in names:
        assert results["1"][q] == results["64"][q], q
