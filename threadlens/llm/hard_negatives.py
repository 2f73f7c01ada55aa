"""Hard-negative mining by inner product with coordinate pruning over length buckets.

Vectors are scaled to integers, and scores are exact integer products. Rows are put into length buckets
(norms within a factor), and each bucket is cut into blocks of a bounded number of rows. A block holds its
vectors at unit length with one list per coordinate, sorted by value. For an anchor that wants scores of at
least t, a row of the block can only qualify at a cosine of at least t / (|anchor| * block's longest): a
block that would need more than 1 is skipped, and each of the anchor's focus coordinates (its largest ones)
leaves a feasible range of values, a run of that coordinate's sorted list. The runs of all focus coordinates
are intersected, and only what is left is scored.

Scale: the anchors are a stated share of the rows, and blocks of anchors meet blocks of data in joins by
block group, never rows. Every anchor first searches a sixteenth of the block groups, then the others with
the scores reached there as its least wanted ones; so few rows leave a task. A hot label or a
repeated vector is cut into blocks like any other run of rows. Nothing is sent to the driver but counts.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import positions, shuffle_partitions, store

SCALE = 256
ANCHOR_EVERY = 100
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90           # percent of the positive's score
LENGTH_STEP = 1.05           # norms in a length bucket are within this factor
BLOCK = 2048                 # rows of a data block
ANCHORS = 256                # anchors of an anchor block
FOCUS = 6                    # focus coordinates of an anchor
GROUP = 16                   # data blocks (and anchor blocks) that meet in one group
FIRST = 16                   # the first round takes one of so many block groups
SLACK = 1e-7                 # above the rounding of the ranges; it only adds candidates

VECTORS = "vec_id bigint, label bigint, vec binary, norm double, bucket int"


def _scaled(batches):
    """Rows that take part: packed integer vectors, norms and length buckets."""
    step = np.log(LENGTH_STEP)
    for b in batches:
        rows = []
        for i, label, v in zip(*(b.column(c).to_pylist() for c in ("vec_id", "label", "embedding"))):
            a = np.array([np.nan if x is None else x for x in v], np.float64)
            if not np.isfinite(a).all():
                continue
            a = np.floor(a * SCALE)
            norm = float(np.sqrt((a ** 2).sum()))
            rows.append((i, label, a.astype("<i8").tobytes(), norm, int(np.floor(np.log(norm) / step)) if norm else -1))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.binary()), pa.array([r[3] for r in rows], pa.float64()),
             pa.array([r[4] for r in rows], pa.int32())], ["vec_id", "label", "vec", "norm", "bucket"])


def unpack(vecs: list[bytes], width: int) -> np.ndarray:
    """Integer vectors as rows; shorter ones are ended by zeros."""
    out = np.zeros((len(vecs), width), np.int64)
    for r, v in zip(out, vecs):
        r[:len(v) // 8] = np.frombuffer(v, "<i8")
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where sums stay below 2**53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class Block:
    """Rows of a run of length buckets with a sorted list of values for each coordinate."""

    def __init__(self, ids, labels, vectors):
        self.ids, self.labels = ids, labels
        most = int(np.abs(vectors).max()) if vectors.size else 0
        self.vectors = vectors.astype(np.int16 if most < 2 ** 15 else np.int32 if most < 2 ** 31 else np.int64)

        self.order = np.argsort(self._unit(), axis=0, kind="stable").astype(np.int32)
        self._sort()

    def _unit(self) -> np.ndarray:
        self.whole = self.vectors.astype(np.int64)
        norms = np.sqrt((self.whole.astype(np.float64) ** 2).sum(axis=1))
        self.longest = float(norms.max())
        self.unit = self.whole / np.where(norms > 0, norms, 1.0)[:, None]
        return self.unit

    def _sort(self):
        self.sorted = np.take_along_axis(self.unit, self.order, axis=0)

    def __getstate__(self):
        return self.ids, self.labels, self.vectors, self.order.astype(np.uint16 if len(self.ids) <= 1 << 16 else np.int32)

    def __setstate__(self, state):
        self.ids, self.labels, self.vectors, order = state
        self.order = order.astype(np.int32)
        self._unit()
        self._sort()


def feasible(q: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each coordinate of a unit vector whose cosine with ``q`` is at least
    ``cosine``: its angle to an axis differs from q's by at most the angle that the cosine allows."""
    across = np.sqrt(np.maximum(1 - q * q, 0.0)) * np.sqrt(max(1 - cosine * cosine, 0.0))
    low = np.where(q <= -cosine, -1.0, q * cosine - across)
    high = np.where(q >= cosine, 1.0, q * cosine + across)
    return low - SLACK, high + SLACK


def candidates(block: Block, q: np.ndarray, norm: float, least: float, focus: int = FOCUS) -> np.ndarray | None:
    """Rows of ``block`` that can score ``least`` or more; None where the ranges leave most of them.

    ``least`` <= 0 leaves every row: a shorter row then needs less.
    """
    if least <= 0 or norm == 0:
        return None if least <= 0 else np.zeros(0, np.int64)
    cosine = least / (norm * block.longest) if block.longest else np.inf
    if cosine > 1 + SLACK:
        return np.zeros(0, np.int64)
    unit = q / norm
    at = np.argsort(-np.abs(unit), kind="stable")[:focus]
    low, high = feasible(unit[at], cosine)
    starts = [np.searchsorted(block.sorted[:, f], x, "left") for f, x in zip(at, low)]
    ends = [np.searchsorted(block.sorted[:, f], x, "right") for f, x in zip(at, high)]
    runs = [e - s for s, e in zip(starts, ends)]
    k = int(np.argmin(runs))
    if 4 * runs[k] > 3 * len(block.ids):
        return None
    rows = block.order[starts[k]:ends[k], at[k]]
    for j, f in enumerate(at):
        if j != k and runs[j] < len(block.ids):
            values = block.unit[rows, f]
            rows = rows[(values >= low[j]) & (values <= high[j])]
    return rows


class Anchors:
    """A block of anchors: what each wants is a list of score ranges, each with the ``k`` best."""

    def __init__(self, ids, labels, vectors, low, high):
        self.ids, self.labels, self.vectors, self.low, self.high = ids, labels, vectors, low, high
        self.norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))


class Search:
    """The k best rows in each range of each anchor of a block, over the data blocks it is shown."""

    def __init__(self, anchors: Anchors, k: int, same_label: bool):
        self.a, self.k, self.same = anchors, k, same_label
        self.low = anchors.low.copy()
        self.best = [[[] for _ in range(anchors.low.shape[1])] for _ in anchors.ids]
        self.scored = self.pairs = 0

    def visit(self, block: Block):
        a, whole = self.a, []
        for i in range(len(a.ids)):
            wanted = self.low[i] <= a.high[i]
            if not wanted.any():
                continue
            self.pairs += len(block.ids)
            rows = candidates(block, a.vectors[i], a.norms[i], float(self.low[i][wanted].min()))
            if rows is None:
                whole.append(i)
            elif len(rows):
                self.take(i, block, rows, products(a.vectors[i:i + 1], block.whole[rows])[0])
        for i, scores in zip(whole, products(a.vectors[whole], block.whole)):
            self.take(i, block, None, scores)

    def take(self, i: int, block: Block, rows, scores: np.ndarray):
        self.scored += len(scores)
        ids, labels = (block.ids, block.labels) if rows is None else (block.ids[rows], block.labels[rows])
        ok = (labels == self.a.labels[i]) if self.same else (labels != self.a.labels[i])
        ok &= (ids != self.a.ids[i]) & (scores >= self.low[i].min())
        ids, scores = ids[ok], scores[ok]
        if not len(ids):
            return
        for w in range(len(self.low[i])):
            at = np.flatnonzero((scores >= self.low[i, w]) & (scores <= self.a.high[i, w]))
            if not len(at):
                continue
            at = at[np.lexsort((ids[at], -scores[at]))[:self.k]]
            best = self.best[i][w] + [(-int(scores[j]), int(ids[j])) for j in at]
            best.sort()
            self.best[i][w] = best = best[:self.k]
            if len(best) == self.k:
                self.low[i, w] = max(self.low[i, w], -best[-1][0])

    def found(self):
        for own, label, wants in zip(self.a.ids.tolist(), self.a.labels.tolist(), self.best):
            for w, best in enumerate(wants):
                for score, i in best:
                    yield own, label, w, i, -score


def _blocks(width: int):
    def run(key, table):
        block = Block(*(np.array(table.column(c).to_pylist(), np.int64) for c in ("vec_id", "label")),
                      unpack(table.column("vec").to_pylist(), width))
        at = key[0].as_py()
        return pa.table({"block": pa.array([at], pa.int64()), "first": pa.array([int(block.labels.min())], pa.int64()),
                         "last": pa.array([int(block.labels.max())], pa.int64()),
                         "longest": pa.array([block.longest], pa.float64()),
                         "data": pa.array([pickle.dumps(block, 5)], pa.binary())})
    return run


FOUND = "anchor_id bigint, label bigint, want int, vec_id bigint, score bigint"


def _found(rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))],
        ["anchor_id", "label", "want", "vec_id", "score"])


def _anchors(ids, labels, vecs, low, high, width):
    """Ranges come as lists; a missing end is without bound. Integers, so that scores compare exactly."""
    least, most = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    return Anchors(np.array(ids, np.int64), np.array(labels, np.int64), unpack(vecs, width),
                   np.array([[least if x is None else x for x in r] for r in low], np.int64),
                   np.array([[most if x is None else x for x in r] for r in high], np.int64))


def _anchor_blocks(width: int):
    def run(key, table):
        a = _anchors(*(table.column(c).to_pylist() for c in ("anchor_id", "label", "vec", "low", "high")), width)
        return pa.table({"anchors": pa.array([key[0].as_py()], pa.int64()), "first": pa.array([int(a.labels.min())], pa.int64()),
                         "last": pa.array([int(a.labels.max())], pa.int64()),
                         "reach": pa.array([float(a.norms.max())], pa.float64()),
                         "least": pa.array([float(a.low.min())], pa.float64()),
                         "queries": pa.array([pickle.dumps(a, 5)], pa.binary())})
    return run


def _searcher(k: int, same_label: bool):
    """Pairs come by group and data block: one data block and a group's anchor blocks are held at once."""
    def run(batches):
        group, block, data, open_ = None, None, None, {}
        for b in batches:
            for g, s, d, at, q, blob in zip(*(b.column(c).to_pylist() for c in ("grp", "side", "block", "anchors", "queries", "data"))):
                if (g, s) != group:
                    yield _found([row for x in open_.values() for row in x.found()])
                    group, block, open_ = (g, s), None, {}
                if d != block:
                    block, data = d, pickle.loads(blob)
                if at not in open_:
                    open_[at] = Search(pickle.loads(q), k, same_label)
                open_[at].visit(data)
        yield _found([row for x in open_.values() for row in x.found()])
    return run


def _meet(anchors: DataFrame, blocks: DataFrame, k: int, same_label: bool, width: int, groups: int) -> DataFrame:
    """Search all blocks of ``blocks`` for all ``anchors`` (anchor_id, label, vec, low, high)."""
    n = anchors.count()
    parts = max(1, -(-n // ANCHORS))
    a = positions(anchors, [F.col("label"), F.col("anchor_id")], "at").withColumn("part", F.floor(F.col("at") / ANCHORS))
    a = a.groupBy("part").applyInArrow(_anchor_blocks(width), "anchors bigint, first bigint, last bigint, reach double, "
                                       "least double, queries binary").alias("a")
    sides = max(1, -(-parts // GROUP))
    a = a.withColumn("side", F.col("anchors") % sides).withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    d = blocks.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    tasks = min(groups * sides, shuffle_partitions(anchors.sparkSession) * 8)
    a, d = a.repartition(tasks, "grp", "side").alias("a"), d.repartition(tasks, "grp", "side").alias("d")
    own = F.expr("a.first <= d.last AND a.last >= d.first" if same_label
                 else "NOT (a.first = a.last AND d.first = d.last AND a.first = d.first)")
    pairs = a.join(d.hint("merge"), ["grp", "side"]).where(own).where(
        F.expr("a.least <= 0 OR a.least <= a.reach * d.longest * 1.000001"))
    pairs = pairs.select("grp", "side", "block", "anchors", "queries", "data").sortWithinPartitions("grp", "side", "block", "anchors")
    return pairs.mapInArrow(_searcher(k, same_label), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "want").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reached(found: DataFrame, k: int) -> DataFrame:
    """``anchor_id, floors``: by want, the k-th score where k rows are known."""
    by = found.groupBy("anchor_id", "want").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    return by.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("want", "floor"))).alias("floors"))


def _raise_floors(anchors: DataFrame, found: DataFrame, k: int) -> DataFrame:
    a = anchors.join(_reached(found, k), "anchor_id", "left")
    floors = F.transform("low", lambda x, w: F.greatest(x, F.try_element_at("floors", w.cast("int"))))
    return a.withColumn("low", F.when(F.col("floors").isNull(), F.col("low")).otherwise(floors)).drop("floors")


def _search_all(anchors: DataFrame, blocks: DataFrame, n_blocks: int, k: int, same_label: bool, width: int,
                name: str) -> DataFrame:
    """The k best of every range of every anchor: a sixteenth of the block groups, then the others."""
    groups = max(1, -(-n_blocks // GROUP))
    dealt = blocks.withColumn("grp", (F.col("block") % groups).cast("int"))
    firsts = max(1, groups // FIRST)
    found = _meet(store(anchors, f"{name}-anchors"), dealt.where(F.col("grp") < firsts), k, same_label, width, groups)
    found = store(_best(found, k).drop("rank"), f"{name}-first")
    if firsts < groups:
        more = _raise_floors(anchors, found, k)
        rest = _meet(store(more, f"{name}-more"), dealt.where(F.col("grp") >= firsts), k, same_label, width, groups)
        found = found.unionAll(rest)
    return store(_best(found, k), name)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(vectors: DataFrame, every: int = ANCHOR_EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """For each anchor and positive the best rows of other labels at 30 to 90 percent of its score.

    ``vectors`` has ``vec_id, embedding, label``; other columns are ignored, whatever their names. Rows
    with a null vec_id, label, vector or component, or a component that is not finite, take no part.
    Where vec_id is divisible by 7 the label is first replaced by ``(label + 1) % 10``. Anchors are the
    rows whose vec_id is divisible by ``every``; of repeated rows the one of least label and vector is
    the anchor, and no row with its vec_id is its positive or negative, while each other repeated row
    counts. Shorter vectors are ended by zeros. Ties go to the smaller vec_id. Components must fit 64-bit
    integers when scaled, scores too. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    label = F.col("label").cast("bigint")
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                       F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
                       F.col("embedding").cast("array<double>").alias("embedding")).dropna()
    v = store(v.mapInArrow(_scaled, VECTORS), "vectors")
    n, size = v.agg(F.count(F.lit(1)), F.max(F.octet_length("vec"))).first()
    if not n:
        return spark.createDataFrame([], RESULT)
    width, n_blocks = size // 8, -(-n // BLOCK)
    placed = positions(v.withColumn("mid", F.monotonically_increasing_id()),
                       [F.col("bucket").desc(), F.col("label"), F.col("mid")], "at")      # repeated rows too are spread
    blocks = store(placed.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("block").applyInArrow(
        _blocks(width), "block bigint, first bigint, last bigint, longest double, data binary"), "blocks")
    anchors = v.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select(
        F.col("vec_id").alias("anchor_id"), "r.label", "r.vec")
    anchors = store(anchors, "anchors")

    no_end = F.array(F.lit(None).cast("bigint"))
    first = _search_all(anchors.withColumn("low", no_end).withColumn("high", no_end), blocks, n_blocks, positives, True, width,
                        "positives").select("anchor_id", "rank", F.col("vec_id").alias("positive_id"),
                                            F.col("score").alias("positive_score"))
    # smallest and greatest whole scores with LOW * p <= 100 * n <= HIGH * p
    ranges = first.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("p")).select(
        "anchor_id", F.expr(f"transform(p, x -> -((-{LOW} * x.positive_score - pmod(-{LOW} * x.positive_score, 100)) div 100))").alias("low"),
        F.expr(f"transform(p, x -> ({HIGH} * x.positive_score - pmod({HIGH} * x.positive_score, 100)) div 100)").alias("high"))
    wanting = anchors.join(ranges, "anchor_id")
    mined = _search_all(wanting, blocks, n_blocks, negatives, False, width, "negatives")
    return first.withColumnRenamed("rank", "_p").withColumnRenamed("anchor_id", "_a").join(
        mined, (F.col("_a") == F.col("anchor_id")) & (F.col("_p") == F.col("want") + 1)).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
