"""Exact top-k search by inner product with dual cover trees.

Vectors are scaled to integers. The top of the tree is a set of pivots, chosen farthest first from a
bounded sample; every vector belongs to its nearest pivot's node. Below that, each block of a node's
vectors, and each block of queries, is a cover tree of its own: every tree node has a centre, a
covering radius and a few children whose centres are apart. A pair of a query node and a data node
can't score more than ``<q, d> + r_q |d| + r_d |q| + r_q r_d``; it is skipped if that is below the
worst k-th score among its queries. Leaves are scored exactly.

Scale: queries first search their own node, which gives each its k-th score; then they are sent only
to the nodes whose bound reaches it. Blocks are bounded, a hot node has many, and blocks of queries
meet blocks of data, never rows. What the driver holds is the pivots and one radius for each.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.llm.common import store

SCALE = 1024
K = 10
QUERY_EVERY = 100
SAMPLE = 2048
PIVOTS = 64
DATA_BLOCK = 1024
QUERY_BLOCK = 256
SALTS = 8
LEAF = 32
FAN = 8
SEED = 7
SLACK = 1e-6


def _scaled(batches):
    """Valid vectors as packed integers; shorter vectors count as if ended by zeros."""
    for b in batches:
        ids, vecs = [], []
        for i, v in zip(b.column("vec_id").to_pylist(), b.column("embedding").to_pylist()):
            if i is None or v is None or any(x is None for x in v):
                continue
            a = np.array(v, np.float64)
            if np.isfinite(a).all():
                ids.append(i)
                vecs.append(np.floor(a * SCALE).astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vecs, pa.binary())], ["vec_id", "vec"])


def matrix(vecs: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(vecs), width))
    for r, v in zip(out, vecs):
        a = np.frombuffer(v, "<i8")
        r[:len(a)] = a
    return out


def farthest_first(points: np.ndarray, most: int, factor: float = 0.0):
    """Rows that cover ``points``: each is the farthest from those before, up to ``most``, or until all
    are within ``factor`` of the first radius. Returns the rows and each point's nearest."""
    chosen, near = [0], np.zeros(len(points), np.int64)
    dist = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    stop = factor * dist.max() if len(points) else 0.0
    while len(chosen) < most and dist.max() > stop:
        chosen.append(int(dist.argmax()))
        d = np.sqrt(((points - points[chosen[-1]]) ** 2).sum(axis=1))
        near[d < dist] = len(chosen) - 1
        dist = np.minimum(dist, d)
    return chosen, near


class CoverTree:
    """Rows in tree order; a node is ``(start, end, centre row, radius, norm of the centre, children)``."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF):
        self.order, self.nodes, todo = np.arange(len(ids)), [], [(0, len(ids), None)]
        while todo:
            start, end, up = todo.pop()
            rows = self.order[start:end]
            p = points[rows]
            mid = int(((p - p.mean(axis=0)) ** 2).sum(axis=1).argmin())
            radius = float(np.sqrt(((p - p[mid]) ** 2).sum(axis=1)).max())
            me = len(self.nodes)
            self.nodes.append((start, end, p[mid], radius, float(np.sqrt((p[mid] ** 2).sum())), []))
            if up is not None:
                self.nodes[up][5].append(me)
            if end - start > leaf and radius > 0:
                _, near = farthest_first(p, FAN, 0.5)
                by = np.argsort(near, kind="stable")
                self.order[start:end] = rows[by]
                ends = start + np.cumsum(np.bincount(near))
                todo += [(a, b, me) for a, b in zip([start, *ends[:-1]], ends) if b > a]
        self.ids, self.points = ids[self.order], points[self.order]


def search(queries: CoverTree, floors: np.ndarray, data: CoverTree, k: int):
    """For each query the ``(id, score)`` that can be among its k best, given scores ``floors`` known to
    be reached. Scores are exact: sums of integer products."""
    best, worst = [[] for _ in queries.ids], floors[queries.order].copy()
    todo = [(0, 0, np.inf)]
    while todo:
        qn, dn, bound = todo.pop()
        qs, qe, qc, qr, qnorm, qkids = queries.nodes[qn]
        ds, de, dc, dr, dnorm, dkids = data.nodes[dn]
        if bound < worst[qs:qe].min():
            continue
        if not qkids and not dkids:
            scores = queries.points[qs:qe] @ data.points[ds:de].T
            for r in np.flatnonzero((scores >= worst[qs:qe, None]).any(axis=1)):
                q, own = qs + r, queries.ids[qs + r]
                at = np.flatnonzero(scores[r] >= worst[q])
                got = best[q] + [(-int(scores[r, j]), int(data.ids[ds + j])) for j in at if data.ids[ds + j] != own]
                got.sort()
                best[q] = got[:k]
                if len(best[q]) == k:
                    worst[q] = max(worst[q], -best[q][-1][0])
            continue
        split_query = bool(qkids) and (not dkids or qr > dr)
        pairs = []
        for child in (qkids if split_query else dkids):
            a, b = (child, dn) if split_query else (qn, child)
            q, d = queries.nodes[a], data.nodes[b]
            top = float(q[2] @ d[2]) + q[3] * d[4] + d[3] * q[4] + q[3] * d[3]
            pairs.append((a, b, top + SLACK * (1 + abs(top))))
        todo += sorted(pairs, key=lambda x: x[2])       # the most promising pair is next
    return best


DATA = "node int, salt int, data binary"
QUERIES = "node int, queries binary"


def _tree_block(width: int, salts: int):
    def run(key, table):
        ids = np.array(table.column("vec_id").to_pylist(), np.int64)
        tree = CoverTree(ids, matrix(table.column("vec").to_pylist(), width))
        return pa.table({"node": pa.array([key[0].as_py()], pa.int32()),
                         "salt": pa.array([key[1].as_py() % salts], pa.int32()),
                         "data": pa.array([pickle.dumps(tree)], pa.binary())})
    return run


def _query_block(width: int):
    def run(key, table):
        ids = np.array(table.column("vec_id").to_pylist(), np.int64)
        floors = np.array([-np.inf if x is None else x for x in table.column("reached").to_pylist()])
        tree = CoverTree(ids, matrix(table.column("vec").to_pylist(), width))
        return pa.table({"node": pa.array([key[0].as_py()], pa.int32()),
                         "queries": pa.array([pickle.dumps((tree, floors))], pa.binary())})
    return run


FOUND = "query_id bigint, vec_id bigint, score bigint"


def _searcher(k: int):
    def run(batches):
        for b in batches:
            rows = []
            for q, d in zip(b.column("queries").to_pylist(), b.column("data").to_pylist()):
                (queries, floors), data = pickle.loads(q), pickle.loads(d)
                for own, got in zip(queries.ids.tolist(), search(queries, floors, data, k)):
                    rows += [(own, i, -s) for s, i in got]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)],
                                             ["query_id", "vec_id", "score"])
    return run


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _meet(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Search each query block in every data block of its node; a node's blocks are dealt by salt."""
    q = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # blocks are large for their number, so they are never broadcast
    return q.join(blocks.hint("merge"), ["node", "salt"]).select("queries", "data").mapInArrow(_searcher(k), FOUND)


def _blocks(df: DataFrame, counts, size: int):
    """Number of the block of a row in its node, so that a block has about ``size`` rows."""
    parts = F.lit(1)
    for node, n in counts:
        if n > size:
            parts = F.when(F.col("node") == node, -(-n // size)).otherwise(parts)
    return df.withColumn("block", F.pmod(F.xxhash64("vec_id", "vec"), parts).cast("int"))


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, pivots: int = PIVOTS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best inner products of each query, over all rows.

    ``vectors`` has ``vec_id`` and ``embedding``; queries are the rows whose vec_id is divisible by
    ``every``. Each component becomes ``floor(1024 * x)``; scores are exact while sums stay below
    2**53. Rows with a null vec_id, a null embedding, or a null or non-finite component take no part;
    shorter vectors count as if ended by zeros. A query doesn't find its own vec_id. Ties go to the
    smaller vec_id; with fewer than k others all are returned. Of repeated rows each can be found, and
    one (the least vector) is the query. Empty tables give no rows.
    """
    v = store(vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>"))
              .mapInArrow(_scaled, "vec_id bigint, vec binary"), "vectors")
    width = (v.agg(F.max(F.octet_length("vec"))).first()[0] or 0) // 8
    sample = matrix([r["vec"] for r in v.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id", "vec")
                    .limit(SAMPLE).select("vec").collect()], width)
    if not len(sample):
        return v.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    centres = sample[farthest_first(sample, pivots)[0]]
    norms = (centres ** 2).sum(axis=1)

    def assign(batches):
        for b in batches:
            m = matrix(b.column("vec").to_pylist(), width)
            far = np.maximum((m ** 2).sum(axis=1)[:, None] - 2 * m @ centres.T + norms, 0.0)
            node = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("vec"), pa.array(node, pa.int32()),
                 pa.array(np.sqrt(far[np.arange(len(node)), node]), pa.float64())], ["vec_id", "vec", "node", "far"])

    v = store(v.mapInArrow(assign, "vec_id bigint, vec binary, node int, far double"), "assigned")
    is_query = F.col("vec_id") % every == 0
    nodes = v.groupBy("node").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"),
                                  F.sum(is_query.cast("bigint")).alias("queries")).collect()
    blocks = store(_blocks(v, [(r["node"], r["n"]) for r in nodes], DATA_BLOCK).groupBy("node", "block")
                   .applyInArrow(_tree_block(width, SALTS), DATA), "blocks")
    queries = v.where(is_query).groupBy("vec_id").agg(F.min(F.struct("vec", "node")).alias("q")).select(
        "vec_id", "q.vec", "q.node", F.lit(None).cast("double").alias("reached"))
    own = _blocks(queries, [(r["node"], r["queries"]) for r in nodes], QUERY_BLOCK).groupBy("node", "block")
    near = store(_top(_meet(own.applyInArrow(_query_block(width), QUERIES), blocks, k), k), "near")
    reached = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= k).select(F.col("query_id").alias("vec_id"), F.col("least").cast("double").alias("reached"))
    radius, known = np.full(len(centres), -1.0), np.sqrt(norms)
    for r in nodes:
        radius[r["node"]] = r["radius"]

    def visits(batches):
        for b in batches:
            m, own = matrix(b.column("vec").to_pylist(), width), np.array(b.column("node").to_pylist(), np.int64)
            least = np.array([-np.inf if x is None else x for x in b.column("reached").to_pylist()])
            top = m @ centres.T + np.sqrt((m ** 2).sum(axis=1))[:, None] * radius
            go = (top + SLACK * (1 + np.abs(top)) >= least[:, None]) & (radius >= 0)
            go[np.arange(len(own)), own] = False
            q, n = np.nonzero(go)
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(pa.array(q)), b.column("vec").take(pa.array(q)),
                                              pa.array(n, pa.int32()), b.column("reached").take(pa.array(q))],
                                             ["vec_id", "vec", "node", "reached"])

    schema = "vec_id bigint, vec binary, node int, reached double"
    sent = store(queries.drop("reached").join(reached, "vec_id", "left").select("vec_id", "vec", "node", "reached")
                 .mapInArrow(visits, schema), "visits")
    counts = [(r["node"], r["n"]) for r in sent.groupBy("node").agg(F.count(F.lit(1)).alias("n")).collect()]
    others = _blocks(sent, counts, QUERY_BLOCK).groupBy("node", "block").applyInArrow(_query_block(width), QUERIES)
    found = near.select("query_id", "vec_id", "score").unionAll(_meet(others, blocks, k))
    return _top(found, k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
