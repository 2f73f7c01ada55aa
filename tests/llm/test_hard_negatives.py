"""Hard-negative mining against brute force, and the coordinate ranges against all rows."""

import numpy as np
import pytest

from threadlens.llm import hard_negatives as H


def test_ranges_and_buckets_lose_no_row():
    rng, left = np.random.default_rng(1), 0
    for _ in range(60):
        n, width = int(rng.integers(1, 200)), int(rng.integers(1, 12))
        v = rng.integers(-300, 300, (n, width)) * rng.integers(0, 2, (n, 1)) if rng.random() < 0.3 else rng.integers(-300, 300, (n, width))
        v[0] = 0
        block = H.Block(np.arange(n), np.zeros(n, np.int64), v)
        q = v[int(rng.integers(n))] + rng.integers(-20, 20, width)
        scores = v @ q
        for least in (float(np.sort(scores)[-min(5, n)]), 0.0, -10.0, float(scores.max()) + 1, float((q * q).sum())):
            rows = H.candidates(block, q, float(np.sqrt((q * q).sum())), least)
            if rows is not None:
                assert set(np.flatnonzero(scores >= least)) <= set(rows.tolist())
                left += len(rows) < n
    assert left > 20


def test_products_are_exact():
    big = np.array([[2 ** 30, 3], [2 ** 30 + 1, -7]])
    assert H.products(big, big).tolist() == [[int(a[0]) * int(b[0]) + int(a[1]) * int(b[1]) for b in big.tolist()] for a in big.tolist()]


def brute(rows):
    v = []
    for i, x, label in rows:
        if i is None or x is None or label is None or any(a is None or not np.isfinite(a) for a in x):
            continue
        v.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(a)))) for a in x]))
    anchors = {}
    for i, label, x in v:
        if i % 100 == 0:
            anchors[i] = min(anchors.get(i, (label, x)), (label, x), key=lambda r: (r[0], np.array(r[1], "<i8").tobytes()))
    out = []
    for a, (label, q) in anchors.items():
        scored = sorted((-sum(p * r for p, r in zip(q, x)), i, other) for i, other, x in v if i != a)
        for s, i, other in [r for r in scored if r[2] == label][:5]:
            near = [(n, -m) for m, n, o in scored if o != label and 30 * -s <= 100 * -m <= 90 * -s][:10]
            out += [(a, i, k + 1, n, -s, m) for k, (n, m) in enumerate(near)]
    return sorted(out)


def table(seed):
    rng, rows = np.random.default_rng(seed), []
    centres = rng.normal(size=(6, 8))
    for i in range(-100, 900):
        x = centres[i % 6] * rng.choice([0.2, 1.0, 5.0]) + rng.normal(size=8) * 0.3
        rows.append((i, [float(a) for a in x], int(rng.integers(-2, 12)) if i % 3 else 4))      # a hot label
    rows += [(1000 + i, [0.5] * 8, i % 4) for i in range(0, 300, 1)]                              # one vector, many ids
    rows += [(None, [1.0] * 8, 1), (5000, None, 1), (5001, [1.0] * 8, None), (5002, [1.0] * 7 + [None], 1),
             (5003, [float("nan")] + [1.0] * 7, 1), (5004, [float("inf")] + [1.0] * 7, 1), (5100, [0.0] * 8, 2),
             (5200, [1.0, 2.0], 3), (5300, [], 3), (77, [1.0] * 8, 4), (1200, [0.25] * 8, 3), (1200, [0.25] * 8, 3)]
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_hard_negatives_against_brute_force(spark, monkeypatch, small):
    if small:                                   # many blocks, groups and rounds
        for name, value in dict(BLOCK=64, ANCHORS=4, GROUP=2, FIRST=3).items():
            monkeypatch.setattr(H, name, value)
    rows = table(5)
    schema = "vec_id bigint, embedding array<float>, label int, block int, `at` int, norm string, grp int"
    df = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], schema).repartition(3)
    got = H.hard_negatives(df)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert H.hard_negatives(df.where("false")).count() == 0
    assert H.hard_negatives(df.where("vec_id = 100")).count() == 0
