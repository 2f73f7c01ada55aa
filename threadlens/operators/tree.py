"""Comment trees: depth, pre-order and the root limit (TR1-TR3, FL1).

Spark has no recursive type, so a forest is an adjacency table
``(post_id, comment_id, parent_id, seq, ...)``. The tree is unrolled level by level with
equi-joins on ``(post_id, parent_id) = (post_id, comment_id)``: the join key contains the
comment id, so a thread with millions of comments spreads over all tasks instead of one.
The depth bound (replies are followed while depth < 5) makes the unroll a fixed number
of joins, all visible in one plan; the shuffle of the child side is the same at every
level and is reused by Spark.

Pre-order is carried as ``path``: the array of sibling sort keys from the root to the
node. Arrays compare lexicographically, so ``ORDER BY path`` is pre-order without
materialising a position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDERS = ("source", "new", "top")


def sibling_key(order: str = "source") -> Column:
    """TR3: the sort key of a comment among its siblings (ascending = first)."""
    if order == "source":
        k = F.col("seq").cast("double")
    elif order == "top":
        k = -F.col("score").cast("double")
    elif order == "new":
        k = -F.unix_micros(F.col("created_utc").cast("timestamp")).cast("double")
    else:
        raise ValueError(f"order must be one of {ORDERS}")
    return F.struct(k.alias("k"), F.col("seq").alias("s"))


def build_tree(comments: DataFrame, max_depth: int = 5, max_roots: int | None = None,
               order: str = "source", post: str = "post_id", cid: str = "comment_id",
               parent: str = "parent_id") -> DataFrame:
    """TR1 (+ FL1 when ``max_roots``): reachable comments with depth <= max_depth.

    Adds ``depth INT``, ``root_id`` and ``path ARRAY<STRUCT<k DOUBLE, s BIGINT>>``.
    ``max_roots`` keeps the first N roots in sibling order with all their replies.

    Each comment climbs its ancestor chain, one level per equi-join of a narrow
    (post, id, parent, key) projection against the same ancestor table (Spark reuses that
    shuffle at every level). After ``max_depth`` climbs, comments that have not reached a
    root are deeper than the cut; comments whose chain breaks (missing parent) are
    unreachable. The wide comment rows are joined back once at the end.
    """
    keyed = comments.select(post, cid, parent, sibling_key(order).alias("_key"))
    anc = keyed.select(F.col(post).alias("_ap"), F.col(cid).alias("_aid"),
                       F.col(parent).alias("_apar"), F.col("_key").alias("_akey"))
    # Rows that reached their root have no ancestor to look up. Their join key (_jk) is their
    # own id, so a thread's finished rows spread over all tasks instead of hashing to
    # (post_id, null); the non-equi guard on _cur keeps them from matching.
    x = keyed.select(post, cid, F.array("_key").alias("path"), F.col(parent).alias("_cur"),
                     F.col(cid).alias("root_id"), F.lit(0).alias("depth"), F.lit(True).alias("_ok"),
                     F.coalesce(F.col(parent), F.col(cid)).alias("_jk"))
    for _ in range(max_depth):
        j = x.join(anc, (x[post] == anc["_ap"]) & (x["_jk"] == anc["_aid"]) & x["_cur"].isNotNull(), "left")
        up = F.col("_cur").isNotNull()
        hit = up & F.col("_aid").isNotNull()
        nxt = F.when(up, F.col("_apar"))
        x = j.select(post, cid,
                     F.when(hit, F.concat(F.array("_akey"), F.col("path"))).otherwise(F.col("path")).alias("path"),
                     nxt.alias("_cur"),
                     F.when(hit, F.col("_aid")).otherwise(F.col("root_id")).alias("root_id"),
                     (F.col("depth") + F.when(hit, 1).otherwise(0)).alias("depth"),
                     (F.col("_ok") & ~(up & ~hit)).alias("_ok"),
                     F.coalesce(nxt, F.col(cid)).alias("_jk"))
    reach = x.filter(F.col("_cur").isNull() & F.col("_ok")).drop("_cur", "_ok", "_jk")
    if max_roots is not None:
        roots = limited_roots(keyed, max_roots, post, cid, parent)
        reach = reach.join(roots, [post, "root_id"], "left_semi")
    return comments.join(reach, [post, cid], "inner")


def limited_roots(keyed: DataFrame, n: int, post: str, cid: str, parent: str) -> DataFrame:
    """The first n roots of each thread by ``_key``. Roots are the rows without a parent: no climb."""
    return (keyed.filter(F.col(parent).isNull())
                 .withColumn("_r", F.row_number().over(Window.partitionBy(post).orderBy("_key")))
                 .filter(F.col("_r") <= n)
                 .select(post, F.col(cid).alias("root_id")))


def preorder(tree: DataFrame, post: str = "post_id") -> DataFrame:
    """TR2: 1-based pre-order position within the thread (``preorder``).

    ``path`` is a total order within a thread (sibling keys end with the unique seq), and
    the position is computed with range-partitioned segments, so a hot thread is split
    over many tasks (see ``positions.group_positions``).
    """
    from threadlens.operators.positions import group_positions
    return group_positions(tree, [post], [("path", False)], key=["comment_id"], out="preorder")


def root_limit(comments: DataFrame, n: int = 100, **kw) -> DataFrame:
    """FL1: the first n root comments of each thread with all their replies."""
    return build_tree(comments, max_roots=n, **kw)


def from_nested(posts_with_replies: DataFrame, levels: int = 6, post: str = "post_id",
                replies: str = "replies") -> DataFrame:
    """Nested comment trees (an array of comments whose ``replies`` nest ``levels`` deep)
    to the adjacency table with ``parent_id`` and a sibling ``seq``.
    """
    cur = posts_with_replies.select(
        post, F.lit(None).cast("string").alias("parent_id"),
        F.lit(0).alias("depth"), F.array().cast("array<int>").alias("_ord"),
        F.posexplode_outer(replies).alias("_i", "c")).filter(F.col("c").isNotNull())
    out = []
    for lvl in range(levels):
        cur = cur.withColumn("_ord", F.concat("_ord", F.array("_i")))
        fields = [f for f in cur.schema["c"].dataType.fieldNames() if f != replies]
        out.append(cur.select(post, "parent_id", F.lit(lvl).alias("depth"), "_ord",
                              *[F.col("c")[f].alias(f) for f in fields]))
        if replies not in cur.schema["c"].dataType.fieldNames() or lvl == levels - 1:
            break
        cur = cur.select(post, F.col("c.id").alias("parent_id"), "_ord",
                         F.posexplode_outer(F.col("c")[replies]).alias("_i", "c")).filter(F.col("c").isNotNull())
    res = out[0]
    for o in out[1:]:
        res = res.unionByName(o, allowMissingColumns=True)
    from threadlens.operators.positions import group_positions
    res = group_positions(res, [post], [("_ord", False)], key=["_ord"], out="seq")
    return res.withColumn("seq", F.col("seq") - 1).drop("_ord")
