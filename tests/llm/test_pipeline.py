"""The pipeline on a small corpus, and the resampling, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from threadlens.llm import importance

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LEAK = "Which river runs through the old town of Brenholt? The Issel runs through it, and it floods in late March."


def prose(rng, n):
    words = "the of and to in is it was for on are as with his they at be this from have or by one had not but".split()
    return " ".join(rng.choice(words) + rng.choice(["", "ly", "ing", str(rng.randrange(50))]) for _ in range(n))


def corpus():
    """Clean texts, junk, near copies of some texts, planted leaks, and rows without words."""
    rng, rows = random.Random(5), []
    for i in range(120):
        rows.append((i, prose(rng, rng.randint(60, 90)), "en", "abc"[i % 3]))
    junk = [(200 + i, "BUY!! NOW!! $$$ ### " * rng.randint(5, 9), "en", "a") for i in range(40)]
    near = [(300 + i, rows[i][1] + " tail", "en", "b") for i in range(15)] + [(330, rows[0][1], "en", None)]
    leaks = [(400 + i, prose(rng, 30) + " " + LEAK + " " + prose(rng, 30), "en", "c") for i in range(4)]
    blank = [(500, None, None, "a"), (501, "", "en", "b"), (502, " \n", None, None)]
    return [(*r, len(r[1] or "")) for r in rows + junk + near + leaks + blank]


def labels():
    return [(i, 1, 0) for i in range(0, 120, 2)] + [(200 + i, 0, 0) for i in range(0, 40, 2)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(corpus(), COLUMNS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels(), "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, LEAK), (2, None)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def expected_draw(spark, rows, marks):
    """``{doc_id: (log weight, key)}`` of the drawn documents, by counting over all texts."""
    f = importance.Featurizer(importance.BUCKETS)
    good = {i: q > 0 for i, q, _ in marks}
    grams = {r[0]: f((r[1] or "").encode()).tolist() for r in rows}
    raw = Counter(g for v in grams.values() for g in v)
    target = Counter(g for i, v in grams.items() if good.get(i) for g in v)
    n, b, s = sum(raw.values()), importance.BUCKETS, importance.SMOOTH
    m = sum(target.values())
    ratio = {g: math.log((target[g] + s) / (m + s * b)) - math.log((raw[g] + s) / (n + s * b)) for g in raw}
    weight = {i: math.fsum(ratio[g] for g in v) for i, v in grams.items() if v}
    mean = {i: w / len(grams[i]) for i, w in weight.items()}
    cut = importance.best_cut(np.array([mean[i] for i in mean if good.get(i) is True]),
                              np.array([mean[i] for i in mean if good.get(i) is False]))
    ids = spark.createDataFrame([(i,) for i in weight], "doc_id bigint")
    hashes = {r.doc_id: r.h for r in ids.withColumn("h", F.xxhash64(F.lit(importance.SEED), "doc_id")).collect()}
    key = {i: w - cut * len(grams[i]) - math.log(-math.log(((hashes[i] % 2**64 >> 11) + 0.5) / 2.0**53))
           for i, w in weight.items()}                # the draw ranks by what the cut counts
    k = sum(x > cut for x in mean.values())
    return {i: (weight[i], key[i]) for i in sorted(key, key=lambda i: (-key[i], i))[:k]}


def test_resample_against_counting(spark, folder):
    want = expected_draw(spark, corpus(), labels())
    got = importance.resample(spark.read.parquet(f"{folder}/documents.parquet"),
                              spark.read.parquet(f"{folder}/labels.parquet")).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(want) and [r["rank"] for r in got] == list(range(1, len(want) + 1))
    for r in got:
        assert (r.log_weight, r.key) == pytest.approx(want[r.doc_id], rel=1e-9, abs=1e-9)


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))}


def least_of_each_group(rows):
    """The smallest doc_id of each component of links between the rows."""
    sets, root = {r[0]: shingles(r[1]) for r in rows}, {r[0]: r[0] for r in rows}
    for _ in root:
        before = dict(root)
        for a in sets:
            for b in sets:
                if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
        if root == before:
            break
    return {i for i, r in root.items() if i == r}


def test_pipeline_against_plain_python(spark, folder):
    rows = {r[0]: r for r in corpus()}
    drawn = [rows[i] for i in expected_draw(spark, corpus(), labels())]
    kept = {i for i in least_of_each_group(drawn) if LEAK not in rows[i][1]}
    assert {r[0] for r in drawn} & set(range(400, 404)) and len(kept) >= 100   # each stage has work to do
    size = {i: len(rows[i][1].split()) for i in kept}

    got = corpus_pipeline.run(spark, folder).collect()
    copies = Counter(r.doc_id for r in got)
    assert set(copies) <= kept and max(copies.values()) <= 3
    by_source, total = defaultdict(int), sum(size.values())
    for i in kept:
        by_source[rows[i][3]] += size[i]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(by_source, key=lambda s: (s is None, s)))}
    target, open_, left = {}, set(by_source), float(total)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * by_source[s]}
        target |= {s: 3.0 * by_source[s] for s in full} if full else share
        left -= sum(3.0 * by_source[s] for s in full)
        open_ = open_ - full if full else set()
    taken = defaultdict(int)
    for i, n in copies.items():
        taken[rows[i][3]] += n * size[i]
    for s in by_source:
        assert abs(taken[s] - target[s]) <= max(size.values())

    per = Counter(r.shard for r in got)
    assert max(per.values()) - min(per.values()) <= 1 and set(per) == set(range(16))
    for shard in per:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(per[shard]))
    for r in got:
        assert r["size"] == len(rows[r.doc_id][1].encode()) + 1


def test_near_duplicates_take_five_words_and_80_percent(spark, folder):
    """One edit in 49 words: 40 of 50 five-word shingles are shared, but 42 of 50 four-word ones (84%)."""
    rows = []
    for n in (48, 49):
        w = [f"t{n}x{i}" for i in range(n)]
        rows += [(n, " ".join(w)), (1000 + n, " ".join(w[:20] + ["edit"] + w[21:]))]
    docs = spark.createDataFrame([(*r, "en", "a", 0) for r in rows], COLUMNS)
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    near = {n for n in (48, 49) if 100 * len(sets[n] & sets[1000 + n]) >= 80 * len(sets[n] | sets[1000 + n])}
    assert near == {49}
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, folder).collect()} == {48, 49, 1048}


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns
        assert stage(spark, docs.where("false"), folder).count() == 0
