"""Forests of any depth against plain Python, and reports over whole threads."""

import json
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadlens.operators import enrich as EN
from threadlens.operators import forest as FO
from threadlens.operators import report as REP
from threadlens.params import DEFAULT, Params
from threadlens.plans import pipeline as PL

SCHEMA = "post_id bigint, comment_id bigint, parent_id bigint, seq bigint"


def random_forest(seed):
    rng, rows = random.Random(seed), []
    for post in range(4):
        n = [0, 1, 60, 400][post]
        for i in range(n):
            up = rng.choice([None, i - 1, i // 2, 0, rng.randrange(n), 10_000]) if rng.random() < 0.4 else i - 1
            rows.append((post, i, None if i == 0 or up is None else up, rng.randrange(10 ** 6) * 1000 + i))
    return rows


def climb(rows):
    up, out = {(p, c): q for p, c, q, _ in rows}, {}
    for p, c, _, _ in rows:
        seen, here = [], c
        while True:
            if (p, here) not in up:
                out[p, c] = (None, None, "orphan")
                break
            if up[p, here] is None:
                out[p, c] = (here, len(seen), "ok")
                break
            if here in seen:
                out[p, c] = (None, None, "cycle")
                break
            seen.append(here)
            here = up[p, here]
    return out


def preorder(rows, ok):
    kids = defaultdict(list)
    for p, c, q, s in rows:
        if (p, c) in ok:
            kids[p, q].append((s, c))
    out = {}
    for p in {r[0] for r in rows}:
        todo, k = [c for _, c in sorted(kids[p, None], reverse=True)], 0
        while todo:
            c = todo.pop()
            k += 1
            out[p, c] = k
            todo += [x for _, x in sorted(kids[p, c], reverse=True)]
    return out


@pytest.mark.parametrize("seed", [2, 3])
def test_forest_against_plain_python(spark, seed):
    rows = random_forest(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = climb(rows)
    got = {(r.post_id, r.comment_id): (r.root_id, r.depth, r.status) for r in FO.climb(df).collect()}
    assert got == want and len({v[2] for v in want.values()}) == 3
    ok = {k for k, v in want.items() if v[2] == "ok"}
    tree = FO.forest(df)
    assert {(r.post_id, r.comment_id) for r in tree.collect()} == ok
    got = {(r.post_id, r.comment_id): r.preorder for r in FO.preorder_any(tree).collect()}
    assert got == preorder(rows, ok)
    cut = {(r.post_id, r.comment_id) for r in FO.forest(df, max_depth=3, max_roots=1).collect()}
    first = {p: min((s, c) for q, c, u, s in rows if q == p and u is None)[1] for p in {r[0] for r in rows}}
    assert cut == {k for k in ok if want[k][1] <= 3 and want[k][0] == first[k[0]]}


def test_deep_chain_and_hot_parent(spark):
    rows = [(1, i, i - 1 if i else None, i) for i in range(3000)] + [(2, i, 0 if i else None, -i) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    t = FO.preorder_any(FO.forest(df))
    assert [f.dataType.typeName() for f in t.schema.fields].count("array") == 0
    got = {(r.post_id, r.comment_id): (r.depth, r.preorder) for r in t.collect()}
    assert all(got[1, i] == (i, i + 1) for i in range(3000))
    assert got[2, 0] == (0, 1) and all(got[2, i] == (1, 3001 - i) for i in (1, 1500, 2999))     # seq is reversed
    empty = df.where("false")
    assert FO.climb(empty).count() == 0 and FO.preorder_any(FO.forest(empty)).count() == 0


def test_nested_of_any_depth(spark):
    def nest(n):
        kids = [{"id": f"{n}x", "score": None}, nest(n - 1), {"no": "id", "replies": [nest(0)]}, 7] if n else []
        return {"id": str(n), "score": n, "replies": kids}

    dump = json.dumps([nest(40), {"id": "r", "score": 5, "replies": None}])
    df = spark.createDataFrame([(1, dump), (2, "[]"), (3, "no json"), (4, None)], "post_id bigint, j string").select(
        "post_id", F.try_parse_json("j").alias("replies"))
    rows = FO.from_nested_any(df, {"score": "bigint"}).orderBy("seq").collect()
    ids = [x for n in range(40, 0, -1) for x in (str(n), f"{n}x")] + ["0", "r"]
    assert [r.comment_id for r in rows] == ids and [r.seq for r in rows] == list(range(len(ids)))
    by = {r.comment_id: r for r in rows}
    assert by["0"].depth == 40 and by["0"].parent_id == "1" and by["12x"].parent_id == "12" and by["r"].parent_id is None
    assert by["12x"].score is None and by["12"].score == 12


def threads(n=900):
    """One thread holds over a third of the comments, one is a chain deeper than any former limit."""
    rng, rows = random.Random(3), []
    words = "please try this https://x.y great wrong why? I agree because my own case was like that".split()
    for i in range(n):
        post = 1 if i % 5 < 2 else 2 if i % 5 == 2 else 3 + i % 40
        own = [r[1] for r in rows if r[0] == post]
        up = None if not own else own[-1] if post == 2 else rng.choice([None, own[0], own[-1]])
        rows.append((post, i, up, i, "u", " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))), rng.randint(-5, 300)))
    return rows


def test_report_parts_cover_whole_threads(spark):
    assert DEFAULT.max_comments is None and DEFAULT.max_depth is None
    rows = threads()
    c = spark.createDataFrame(rows, SCHEMA + ", author string, body string, score bigint").repartition(5)
    flat = PL.annotate_comments(c, with_body=False)
    whole = PL.annotate_comments(c)
    assert "body" not in flat.columns and whole.where("body is null").count() == 0 and whole.count() == len(rows)
    facts = {(r.post_id, int(r.comment_id)): r for r in flat.collect()}
    assert len(facts) == len(rows) and max(r.depth for r in facts.values()) > 100
    direct = {r.comment_id: r for r in EN.rule_facts(c).collect()}
    parts = {r.post_id: r for r in PL.thread_parts(flat, comments=c).collect()}
    for post in {r[0] for r in rows}:
        own = [facts[k] for k in facts if k[0] == post]
        p, good = parts[post], [r for r in own if r.quality_score >= 2.0]
        assert p.total_processed == len(own) and p.high_quality_count == len(good)
        assert p.sentiment_distribution == Counter(r.sentiment.toward_op for r in own)
        assert p.intent_distribution == Counter(r.intent_primary for r in own)
        assert p.tone_distribution == Counter(r.sentiment.overall_tone for r in own)
        assert p.all_insights == sorted({x for r in good for x in r.key_insights}) or (not good and p.all_insights is None)
        top = sorted(good, key=lambda r: (-(r.relevance_score * r.score), -r.heuristic, r.seq))[:10]
        assert [x.comment_id for x in p.top_comments or []] == [r.comment_id for r in top]
        assert all(x.body == x.text == direct[int(x.comment_id)].body for x in p.top_comments or [])
    limited = PL.annotate_comments(c, Params(max_comments=7, max_depth=2))
    assert limited.groupBy("post_id").count().agg(F.max("count")).first()[0] == 7 and limited.agg(F.max("depth")).first()[0] <= 2


def test_counts_are_combined_before_the_shuffle(spark):
    c = spark.createDataFrame(threads(50), SCHEMA + ", author string, body string, score bigint")
    plan = REP.label_parts(PL.annotate_comments(c))._jdf.queryExecution().sparkPlan().toString()
    assert "partial_count" in plan


def test_a_python_model_ranks_whole_threads(spark):
    c = spark.createDataFrame(threads(120), SCHEMA + ", author string, body string, score bigint")
    r = PL.annotate_comments(c, annotator=lambda prompts: ["[]" for _ in prompts])
    assert r.count() == 120
    ranks = {x.post_id: sorted(x.r) for x in r.groupBy("post_id").agg(F.collect_list("rank").alias("r")).collect()}
    assert all(v == list(range(1, len(v) + 1)) for v in ranks.values())


def test_ranking_a_list_costs_its_length(spark, monkeypatch):
    """The rows written over all rounds are a few times the elements, whatever the lists' lengths."""
    rng, n, rows, want = random.Random(5), 6000, [], {}
    ids = rng.sample(range(10 ** 9), n)
    for lst in (ids[:5500], ids[5500:5990], ids[5990:5991], ids[5991:]):
        total = 0
        for i in reversed(range(len(lst))):
            w = rng.randrange(2)
            total += w
            want[lst[i]] = total
            rows.append((lst[i], lst[i + 1] if i + 1 < len(lst) else None, w))
    rng.shuffle(rows)
    links = spark.createDataFrame(rows, "e bigint, next bigint, w bigint").repartition(4)
    written, keep = [], FO.stored

    def counted(df, *a, **kw):
        out = keep(df, *a, **kw)
        written.append(out.count())
        return out

    monkeypatch.setattr(FO, "stored", counted)
    monkeypatch.setattr(FO, "FEW", 200)
    got = [(r.e, r["rank"]) for r in FO._ranked(links).collect()]
    assert len(got) == n and dict(got) == want
    assert sum(written) < 5 * n


def test_climb_asks_only_for_ancestors(spark, monkeypatch):
    """A late round of a deep thread does not carry the leaves that have long arrived."""
    rows = [(1, i, i - 1 if i else None, i) for i in range(600)] + [(2, i, 0 if i else None, i) for i in range(5000)]
    written, keep = [], FO.stored

    def counted(df, name, *a, **kw):
        out = keep(df, name, *a, **kw)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(FO, "stored", counted)
    got = {(r.post_id, r.comment_id): (r.root_id, r.depth, r.status) for r in FO.climb(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(p, i): (0, i if p == 1 else min(i, 1), "ok") for p, i, _, _ in rows}
    above = [n for name, n in written if name == "above"]
    assert above and max(above) < 600
