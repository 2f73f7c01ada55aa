"""Comment forests of any depth: climb, pre-order and nested input (TR1, TR2, SRC2).

``climb`` finds every comment's root and depth by pointer doubling: each round joins a comment
with the ancestor it points at and takes that one's ancestor, so the rounds grow with the
logarithm of the depth. A round in which nobody arrives has only cycles left. Of the comments that
have arrived, later rounds carry those that are still asked for.

``preorder_any`` numbers a forest in pre-order without paths: each comment has an entry and an
exit, the successor of each is known from the siblings, and the list of a thread is ranked over
drawn elements. Every element has one successor and one predecessor, so no join key is hot.

``from_nested_any`` unfolds nested replies (VARIANT) one level a round until none is left.

Each round is written to the shared checkpoint folder (``session.stored``), so plans stay short and
a lost executor costs one round. Tables in the rounds hold keys and numbers only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlens.operators.positions import group_positions
from threadlens.operators.tree import limited_roots, sibling_key
from threadlens.session import stored


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def climb(comments: DataFrame, post: str = "post_id", cid: str = "comment_id", parent: str = "parent_id") -> DataFrame:
    """``post, cid, root_id, depth, status`` of every comment.

    ``status``: ``ok``; ``orphan`` when the chain of parents ends in a comment that is not there;
    ``cycle`` when it never ends. Only ``ok`` rows have a root and a depth.
    """
    base = stored(comments.select(post, cid, F.col(parent).alias("_to")), "parents")
    kind = dict(base.dtypes)[cid]
    none, away = F.lit(None).cast(kind), F.lit(None).cast("bigint")
    done = [base.where("_to is null").select(post, cid, F.col(cid).alias("root_id"), F.lit(0).cast("bigint").alias("depth"),
                                             F.lit("ok").alias("status"))]
    above = list(done)      # the done rows that a round may still ask for
    active = base.where("_to is not null").select(post, cid, "_to", F.lit(1).cast("bigint").alias("_far"))
    left = asked = active.count()
    while left:
        look = _union(above).select(F.col(post).alias("_p"), F.col(cid).alias("_id"), "root_id", "depth", "status",
                                    none.alias("_next"), away.alias("_more")).unionAll(
            active.select(post, cid, none, away, F.lit(None).cast("string"), "_to", "_far"))
        j = active.join(look, (F.col(post) == F.col("_p")) & (F.col("_to") == F.col("_id")), "left")
        lost = F.col("_id").isNull()
        r = j.select(
            post, cid, "root_id", (F.col("depth") + F.col("_far")).alias("depth"),
            F.when(lost, F.lit("orphan")).otherwise(F.col("status")).alias("status"),
            F.col("_next").alias("_to"), (F.col("_far") + F.col("_more")).alias("_far"))
        r = stored(r.withColumn("_done", F.col("status").isNotNull()), "climb", by="_done")
        here, active = r.where("_done"), r.where("not _done")
        remain = active.count()
        if remain == left:      # depths have no holes: who does not arrive now never will
            done.append(active.select(post, cid, none.alias("root_id"), away.alias("depth"), F.lit("cycle").alias("status")))
            break
        here, active, left = here.select(post, cid, "root_id", "depth", "status"), active.select(post, cid, "_to", "_far"), remain
        done.append(here)
        above.append(here)
        if left and left * 2 <= asked:      # who is not asked for now never will be: the next round asks for their ancestors
            asked = left
            ask = active.select(F.col(post).alias("_p"), F.col("_to").alias("_id")).distinct()
            above = [stored(_union(above).join(ask, (F.col(post) == F.col("_p")) & (F.col(cid) == F.col("_id")), "left_semi"), "above")]
    return _union(done)


def forest(comments: DataFrame, max_depth: int | None = None, max_roots: int | None = None, order: str = "source",
           post: str = "post_id", cid: str = "comment_id", parent: str = "parent_id") -> DataFrame:
    """TR1 (+ FL1): the comments that hang on a root, with ``depth INT`` and ``root_id``.

    Without ``max_depth`` at any depth; ``max_roots`` keeps the first roots in sibling order.
    """
    if max_roots is not None:
        roots = limited_roots(comments.select(post, cid, parent, sibling_key(order).alias("_key")), max_roots, post, cid, parent)
    places = climb(comments, post, cid, parent).where("status = 'ok'").select(
        post, cid, "root_id", F.col("depth").cast("int").alias("depth"))
    if max_depth is not None:
        places = places.where(F.col("depth") <= max_depth)
    if max_roots is not None:
        places = places.join(roots, [post, "root_id"], "left_semi")
    return comments.join(places, [post, cid])


FEW = 100_000      # a round's rows up to this number are broadcast
_DRAW = 4          # one element in so many is drawn to stand for the others


def _drawn(e: str, level: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(level), F.col(e)), F.lit(_DRAW)) == 0


def _walked(links: DataFrame, stop: Column, look_at: Column, small: bool) -> DataFrame:
    """Each list element's way, ``e, next, w``, made longer by pointer doubling until ``stop`` holds; an
    element that does not stop the others is one of ``look_at``. ``small``: all lists fit a few tasks."""
    own = ["e", "next", "w"]
    done, active = [links.where(stop).select(*own)], links.where(~stop).select(*own)
    left = active.count()
    while left:
        look = _union([*done, active]).where(look_at).select(F.col("e").alias("_e"), F.col("next").alias("_n"), F.col("w").alias("_w"))
        r = (F.broadcast(active) if left <= FEW else active).join(look, F.col("next") == F.col("_e")).select(
            "e", F.col("_n").alias("next"), (F.col("w") + F.col("_w")).alias("w"))
        r = stored((r.coalesce(4) if small else r).withColumn("_done", stop), "ways", by="_done")
        done.append(r.where("_done").select(*own))
        active = r.where("not _done").select(*own)
        left = active.count()
    return _union(done)


def _ranked(links: DataFrame, level: int = 0) -> DataFrame:
    """``e, rank`` from lists ``e, next, w``: the sum of ``w`` from each element to its list's end.

    A fourth of the elements is drawn by a hash. Every element walks to the next drawn one, whatever the
    list's length some four steps and never many, so the rounds are few; the drawn ones make a list a
    fourth as long, ranked in the same way, and one join gives its ranks to all. The work is in proportion
    to the elements; only the last list, of at most ``FEW`` elements, is walked to its end.
    """
    end = F.col("next").isNull()
    if links.count() <= FEW:
        return _walked(links, end, F.lit(True), True).select("e", F.col("w").alias("rank"))
    ways = _walked(links, end | _drawn("next", level), ~_drawn("e", level), False)
    far = _ranked(stored(ways.where(_drawn("e", level)), "drawn"), level + 1).select(F.col("e").alias("_e"), "rank")
    near = ways.where(end).select("e", F.col("w").alias("rank"))
    return near.unionAll(ways.where(~end).join(far, F.col("next") == F.col("_e")).select("e", (F.col("w") + F.col("rank")).alias("rank")))


def preorder_any(tree: DataFrame, key: Column | None = None, post: str = "post_id", cid: str = "comment_id",
                 parent: str = "parent_id", out: str = "preorder") -> DataFrame:
    """TR2: adds the 1-based pre-order position of each comment of a forest, of any depth.

    ``tree`` holds comments whose ancestors are all there (as ``forest`` gives them); siblings
    come in the order of ``key`` (by default ``seq``), ties by comment id.
    """
    group = F.when(F.col(parent).isNull(), F.lit("")).otherwise(F.concat(F.lit("p"), F.col(parent).cast("string")))
    n = tree.select(post, cid, parent, group.alias("_g"), (sibling_key() if key is None else key).alias("_key"))
    n = stored(n.withColumn("_node", F.monotonically_increasing_id() * 2), "nodes")
    total = n.groupBy(post).agg(F.count(F.lit(1)).alias("_total")).select(F.col(post).alias("_p"), "_total")
    n = stored(group_positions(n, [post, "_g"], [("_key", False), (cid, False)], key=[cid], out="_pos", size="_n"), "siblings")
    own = n.select(F.col(post).alias("_p"), F.col(cid).alias("_id"), F.col("_node").alias("_up"))
    nxt = n.select(F.col(post).alias("_p"), F.col("_g").alias("_h"), (F.col("_pos") - 1).alias("_q"), F.col("_node").alias("_right"))
    # one row a parent: its first and its last child
    first = n.where(f"_pos = 1 and `{parent}` is not null").join(
        own, (F.col(post) == F.col("_p")) & (F.col(parent) == F.col("_id"))).select("_up", F.col("_node").alias("_down"))
    last = n.where(f"_pos = _n and `{parent}` is not null").join(
        own, (F.col(post) == F.col("_p")) & (F.col(parent) == F.col("_id"))).select((F.col("_node") + 1).alias("e"), (F.col("_up") + 1).alias("next"))
    beside = n.where("_pos < _n").join(nxt, (F.col(post) == F.col("_p")) & (F.col("_g") == F.col("_h")) & (F.col("_pos") == F.col("_q"))).select(
        (F.col("_node") + 1).alias("e"), F.col("_right").alias("next"))
    ends = n.where(f"_pos = _n and `{parent}` is null").select((F.col("_node") + 1).alias("e"), F.lit(None).cast("bigint").alias("next"))
    enter = n.select("_node").join(first, F.col("_node") == F.col("_up"), "left").select(
        F.col("_node").alias("e"), F.coalesce("_down", F.col("_node") + 1).alias("next"))
    links = enter.withColumn("w", F.lit(1).cast("bigint")).unionAll(
        beside.unionAll(last).unionAll(ends).withColumn("w", F.lit(0).cast("bigint")))
    rank = _ranked(stored(links, "tour"))
    place = n.join(rank, F.col("_node") == F.col("e")).join(total, F.col(post) == F.col("_p")).select(
        post, cid, (F.col("_total") - F.col("rank") + 1).alias(out))
    return tree.join(place, [post, cid])


def from_nested_any(posts: DataFrame, fields: dict[str, str], post: str = "post_id", replies: str = "replies",
                    cid: str = "id") -> DataFrame:
    """SRC2: nested comment trees of any depth to the adjacency table.

    ``posts`` has ``post`` and the VARIANT column ``replies``: an array of objects that nest further
    ones under the same name. ``fields`` gives the other fields to read, with their types. Returns
    ``post, comment_id, parent_id, depth, seq`` (0-based pre-order) and the fields. Elements that
    are not objects with an id are dropped with what they hold.
    """
    array = "array<variant>"
    front = posts.select(post, F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"),
                         F.posexplode(F.try_variant_get(replies, "$", array)).alias("_i", "c"))
    levels = []
    while True:
        front = stored(front.withColumn("comment_id", F.try_variant_get("c", f"$.{cid}", "string")).where(
            "comment_id is not null"), "front")
        if levels and front.isEmpty():
            break
        levels.append(front.select(post, "comment_id", "parent_id", "depth", "_i",
                                   *[F.try_variant_get("c", f"$.{f}", t).alias(f) for f, t in fields.items()]))
        front = front.select(post, F.col("comment_id").alias("parent_id"), (F.col("depth") + 1).alias("depth"),
                             F.posexplode(F.try_variant_get("c", f"$.{replies}", array)).alias("_i", "c"))
    out = preorder_any(_union(levels), F.col("_i"), post, out="seq")
    return out.withColumn("seq", F.col("seq") - 1).drop("_i")
