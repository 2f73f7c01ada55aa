"""The operators on small tables with awkward rows, against plain Python."""

import math
import re
import time
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.llm import (chat_views, common, components, cover_search, decontaminate, importance, language_id, mixing,
                            ngram_join, ppm, sharding, site_style)

BASE = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    (1, BASE, "en", "b"), (2, BASE.upper(), "en", None), (3, BASE + " extra", "de", "a"), (4, None, None, "a"), (5, "", "en", "b"),
    (6, " \n\t", "en", "b"), (7, "two words", "de", "a"), (8, "Two  Words", "de", None), (9, "two words more", "en", "a"),
    (10, " ".join(f"v{i}" for i in range(50)), "de", "a"), (11, " ".join(f"v{i}" for i in range(4, 54)), "de", "c"),
    (11, " ".join(f"v{i}" for i in range(4, 54)), "de", "c"), (12, "éa ñ 東京 !! x" * 30, None, "c"),
    (13, " ".join(f"z{i % 700}" for i in range(30_000)), "en", "b"), (None, "two words", "en", "b"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, digest int, pos int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 0, "x", 1, 2) for r in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w.decode() for w in (t or "").encode().lower().split()]


def sets_of(t):
    w = words(t)
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def test_ngram_join_against_brute_force(docs, empty):
    sets = [(i, sets_of(t)) for i, t, _, _ in TEXTS]
    root = list(range(len(sets)))
    for _ in sets:
        for a, b in product(range(len(sets)), repeat=2):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                root[a] = root[b] = min(root[a], root[b])
    want = []
    for k, (i, s) in enumerate(sets):
        ids = [j for r, (j, _) in zip(root, sets) if r == root[k] and j is not None]
        want.append((str(i), len(s), min(ids) if s and ids else i))
    got = [(str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ngram_join.jaccard_components(empty).count() == 0


def test_ngram_join_pairs_of_a_near_group_grow_with_its_texts(spark, monkeypatch):
    """Near copies at the threshold, where leaders link few: as many pairs as texts, not as pairs of texts."""
    import random
    rnd = random.Random(5)
    base = [f"w{k}" for k in range(100)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in rnd.sample(range(100), 2):
            w[k] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    sets = [sets_of(t) for _, t in rows]
    root = list(range(len(sets)))
    for a, b in product(range(len(sets)), repeat=2):
        if a < b and root[a] != root[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            root = [root[a] if r == root[b] else r for r in root]
    least = {r: min(k for k, x in enumerate(root) if x == r) for r in set(root)}
    made, inner = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *a: made.append(pairs.count()) or inner(pairs, *a))
    monkeypatch.setattr(ngram_join, "BLOCK", 64)    # several blocks and parts
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()}
    assert got == {k: least[r] for k, r in enumerate(root)}
    assert sum(made) <= 4 * len(rows), made


def test_components(spark):
    e = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 1), (3, 2), (5, 5), (2, 3)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(e).collect()}
    assert got == {9: 1, 8: 1, 7: 1, 6: 1, 1: 1, 3: 2, 2: 2}
    assert components.components(e.where("false")).count() == 0


def test_mixing(docs, empty, spark):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(TEXTS) and mixing.mix_sources(empty).count() == 0
    sizes, weight = {}, {"a": 5, "b": 2, "c": 1, None: 5}
    for _, t, _, s in TEXTS:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    target, clamped, total = {}, set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in clamped)) / sum(w for s, w in weight.items() if s not in clamped)
        over = {s for s in weight if s not in clamped and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        clamped |= over
    target = {s: 3 * sizes[s] if s in clamped else weight[s] * level for s in weight}
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target[r.source])
        assert r.taken in {r.size * k for k in range(4)} and r["size"] <= r.source_size
    copies = mixing.mixture(docs)
    assert copies.columns == docs.columns
    assert copies.select(F.sum(F.size(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")))).first()[0] > 0


def test_hilbert_curve_is_continuous(spark):
    n, bits = 3, 3
    d = spark.range(1 << n * bits).select(*[F.expr(f"(id >> {bits * k}) & {(1 << bits) - 1}").alias(f"x{k}") for k in range(n)])
    rows = d.select("*", sharding.hilbert_index([F.col(f"x{k}") for k in range(n)], bits).alias("h")).collect()
    by = {r.h: (r.x0, r.x1, r.x2) for r in rows}
    assert sorted(by) == list(range(1 << n * bits))
    assert all(sum(abs(a - b) for a, b in zip(by[i], by[i + 1])) == 1 for i in range(len(by) - 1))


def test_shards(docs, empty, tmp_path):
    rows = sharding.hilbert_shards(docs, shards=4).collect()
    assert len(rows) == len(TEXTS) and sharding.hilbert_shards(empty).count() == 0
    counts = [sorted(r.slot for r in rows if r.shard == k) for k in range(4)]
    assert all(c == list(range(len(c))) for c in counts) and max(map(len, counts)) - min(map(len, counts)) <= 1
    own = {i: t for i, t, _, _ in TEXTS}
    for r in rows:
        t = own[r.doc_id]
        assert r["size"] == len((t or "").encode()) + 1
        assert r.text_crc32 == (None if t is None else zlib.crc32(t.encode()))


def test_shards_against_a_plain_sort(spark):
    rng = np.random.default_rng(3)
    texts = [f"text {i}" for i in range(40)] + ["", None]
    rows = [(i, texts[int(rng.integers(42))], str(rng.choice(["en", "de", "fr"])), f"a long common prefix of sources {int(rng.integers(60)):03d}")
            for i in range(900)] + [(None, "text 1", None, None), (7, "text 1", "en", "x"), (7, "text 1", "en", "x")]
    d = spark.createDataFrame([(*r, 0, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    out = sharding.hilbert_shards(d, shards=7).collect()
    assert len(out) == len(rows)
    home, kept = {}, {}
    for i, t, lang, source in rows:
        if t is not None:
            home[t] = min(home.get(t, (True, 0, "", "")), (i is None, i or 0, source or "", lang or ""))
    for r in out:
        kept.setdefault(r.text_crc32, set()).add(r.curve)
    assert all(len(v) == 1 for c, v in kept.items() if c is not None)          # equal texts: one place on the curve
    order = sorted(out, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in order] == sorted(r.curve for r in out)
    runs = [k for k in range(1, len(order)) if order[k].text_crc32 != order[k - 1].text_crc32]
    with_text = {t for _, t, _, _ in rows if t is not None}
    assert len(runs) + 1 <= len(with_text) + 1 + sum(t is None for _, t, _, _ in rows)
    parted = [t for t in with_text if len({r.shard for r in out if r.text_crc32 == zlib.crc32(t.encode())}) > 1]
    assert len(parted) <= 6                                                    # at most one a cut
    ends = [k * len(rows) // 7 for k in range(8)]
    assert sorted(sum(r.shard == k for r in out) for k in range(7)) == sorted(b - a for a, b in zip(ends, ends[1:]))
    marks = sharding._value_marks(d, "source", 5)
    assert marks == sorted(marks) and 16 <= len(marks) <= 32


def test_best_cut_and_features():
    assert importance.best_cut(np.array([1.0, 2.0]), np.array([-1.0])) == 0.0
    assert importance.best_cut(np.array([1.0]), np.array([])) == -np.inf
    f = importance.Featurizer(10_000)
    assert len(f(None)) == len(f(b"")) == 0 and len(f(b"one")) == 1 and len(f(b"a b c")) == 3 + 2 + 2


def test_resample_drops_junk(spark):
    good = [" ".join(f"{a}{b}" for b in "the of and to in is it".split()) + f" tail{a}" for a in "abcdefghij"] * 20
    junk = ["BUY!! NOW!! $$$ ### " * 6] * 40
    d = spark.createDataFrame([(i, t) for i, t in enumerate(good + junk)] + [(900, None), (901, ""), (None, good[0])],
                              "doc_id bigint, text string")
    lab = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 240, 2)] + [(None, 1, 0), (5, None, 0)],
                                "doc_id bigint, quality int, toxic int")
    kept = importance.keep_sample(d, lab)
    ids = {r.doc_id for r in kept.collect()}
    assert len(ids & set(range(200))) >= 195 and len(ids & set(range(200, 240))) <= 5 and not ids & {900, 901}
    assert kept.columns == d.columns
    assert importance.resample(d.where("false"), lab).count() == 0
    assert importance.resample(d, lab.where("false")).count() == 241      # without labels all that have words


ITEMS = [(1, "What is the colour of the sky over the wide open sea? It is blue in the morning and red at dusk."),
         (2, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (3, None), (4, " "), (None, "x y z")]


def test_decontamination(spark):
    b = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    far = " ".join(f"n{i % 97}" for i in range(70_000))
    rows = [(1, "before " + ITEMS[0][1].upper() + " after"), (2, far + " " + ITEMS[1][1] + " " + far),
            (3, "the colour of the sky is not here"), (4, None), (5, ""), (None, ITEMS[1][1]), (6, ITEMS[1][1][:30]), (1, "clean")]
    d = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, score string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    assert got == {(1, 1), (2, 2), (None, 2)}
    left = decontaminate.without_leaks(d, b)
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "4", "5", "6"]
    assert decontaminate.leaks(d, b.where("false")).count() == 0 and decontaminate.leaks(d.where("false"), b).count() == 0


def test_leaks_of_parts_far_from_each_other(spark):
    items = [(1, ITEMS[0][1]), (2, "Which town lies at the mouth of the river Issel? Old Brenholt harbour town")]
    (q1, a1), (q2, a2) = [t.split("?") for _, t in items]
    far = " ".join(f"n{i % 97}" for i in range(3000))
    rows = [(1, f"{q1}? {far} {a1}"), (2, f"{a1} {far} {q1}"), (3, f"{q1}? {far}"), (4, f"{far} {a1}"),
            (5, f"{q2}? {q1}? {far} {a2} {a1}"), (6, f"{q2}? {far}")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {(1, 1), (2, 1), (5, 1), (5, 2)}
    for more in ([], [(9, " ".join(f"long{i}" for i in range(900)))]):
        b = spark.createDataFrame(items + more, "item_id bigint, text string")
        assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()} == want
        assert {r.doc_id for r in decontaminate.without_leaks(d, b).collect()} == {3, 4, 6}


def test_block_bounds_lose_nothing(spark):
    """The pruned retrieval finds just what scoring every item in every window finds."""
    rng = np.random.default_rng(3)
    vocab = [f"t{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, 12))) for i in range(40)]
    index = decontaminate.indexes(spark.createDataFrame(items, "item_id bigint, text string"), 0.3)[0]
    text = [w.encode() for w in rng.choice(vocab, 400)]
    got = {(index.items[k], s): v for k, v, s in index.retrieve(text)}
    half, want = index.window // 2, {}
    own = {k: sum(v * 1.0 for t in index.postings for blk in t for i, v in blk if i == k) for k in range(len(items))}
    for s in range(0, max(1, len(text) - half), half):
        held = {index.terms[w] for w in text[s:s + index.window] if w in index.terms}
        for k in own:
            v = sum(x for t in held for blk in index.postings[t] for i, x in blk if i == k)
            if v >= 1 - 1e-9:
                want[index.items[k], s] = v * 0.3
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in got) and got


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header>
<nav><a href=/>Home</a></nav><div id="cookie-notice">We use cookies</div><div class=promo>Same on all</div>
<article class=post><header><h1>Head &amp; tail</h1></header><p>One <b>bo</b>ld&nbsp;text<br>next<p title="a>b">Two %d
<article><p>Inner</p></article><section class="comments"><article><p>Nice!</p></article></section><p>Last &#8217;</article>
<form>Name <input></form><aside>Side</aside><script>if (a < b) x("</p>")</script><footer>Foot</footer>"""


def test_page_text():
    assert site_style.Page(PAGE % 7).main_text() == "Head & tail One bold text next Two 7 Inner Last ’"
    assert site_style.Page("").main_text() == "" and site_style.Page("plain text < 5").main_text() == "plain text < 5"
    assert site_style.Page("<div>" * 3000 + "deep").main_text() == "deep"
    assert site_style.host("https://User@A.example:80/x") == "a.example" and site_style.host(None) == ""


def test_names_and_forms_around_the_article():
    text = lambda h: site_style.Page(h).main_text()
    for name in ("site right-sidebar", "no-sidebar", "layout with-sidebar", "sidebar", "page-header"):
        assert text(f"<body><div class='{name}'><article><p>Own text</p></article></div><div class=sidebar>Side</div>") == "Own text"
    assert text("<article><p>Shares.</p><div class=share-price>42</div><p class=social-history>Old</p></article>") == "Shares. 42 Old"
    assert text("<body><form id=aspnet><nav>Home</nav><div>All the text of this page</div><form>Name</form></form>") == "All the text of this page"
    assert text("<form><main><p>Text</p></main><div class=comments><article>Long long long talk</article></div></form>") == "Text"
    assert text("<article><p>Text</p></article><div id=comment-list><article>Long long long talk</article></div>") == "Text"
    assert text("<div>Text of the page</div><div class='newsletter-signup'>Sign</div><form>Name</form>") == "Text of the page"


def test_an_article_keeps_its_own_headings_and_attributes():
    art = "<html><body><article>%s</article></body></html>"
    for page, want in (
            (art % '<h2 class="section-header">Own</h2><p>t</p>', "Own t"),
            (art % '<p data-role="navigation">a</p><p data-id="menu">b</p><p data-role=banner>c</p>', "a b c"),
            (art % "<p title='see class=comments'>c</p>", "c"), (art % '<div class="comments">no</div><p>y</p>', "y"),
            ('<body><div class="header">m</div><h1 class="page-header">T</h1><p>x</p></body>', "T x"),
            ('<p title="a > b">q</p> 1 < 2 <p', "q 1 < 2 <p"), ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes")):
        assert site_style.Page(page).main_text() == want


def test_long_awkward_pages_take_linear_time():
    def seconds(unit, n):
        began = time.process_time()
        site_style.Page(unit * n).main_text()
        return time.process_time() - began

    for unit, n in (("<div>x", 40_000), ('<a href="x ', 25_000), ("<div>x</b>", 25_000), ("<li><div>x", 25_000), ("<!x ", 60_000)):
        assert seconds(unit, 4 * n) < 12 * max(seconds(unit, n), 0.05), unit


def test_site_style(spark):
    body = "<html><body><div class=box>Boiler plate</div><div class=text>Story %d</div></body></html>"
    rows = [(i, f"http://h.example/{i}", body % i) for i in range(8)] + [
        (90, "http://other.example/", body % 1), (91, None, None), (92, "x", ""), (92, "x", "")]
    p = spark.createDataFrame([(*r, "z") for r in rows], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in site_style.main_text(p).collect())
    assert got[:8] == [(i, f"Story {i}", 7) for i in range(8)]              # the box is the same on all pages
    assert got[8:] == [(90, "Boiler plate Story 1", 20), (91, "", 0), (92, "", 0), (92, "", 0)]
    assert site_style.main_text(p.where("false")).count() == 0


def test_site_style_keeps_unique_text(spark):
    fields = "".join(f"<div class=f{k}><b>Field:</b> %d-{k}</div>" for k in "abcdefghijklmnop")
    record = "<body><div class=box>Boiler plate</div><div id=content>" + fields + "</div></body>"
    copied = "<body><div class=top>Boiler plate</div><article><div class=body>%s</div></article></body>"
    rows = [(i, f"http://records.example/{i}", record.replace("%d", str(i))) for i in range(9)]
    rows += [(100 + i, f"http://copies.example/{i}", copied % ("The one story" if i < 40 else f"Story {i}")) for i in range(44)]
    p = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in site_style.main_text(p).collect()}
    for i in range(9):
        assert got[i] == " ".join(f"Field: {i}-{k}" for k in "abcdefghijklmnop")
    assert all(got[100 + i] == ("The one story" if i < 40 else f"Story {i}") for i in range(44))
    tree = {(r.pages, round(r.content, 6)) for r in site_style.style_tree(p.where("page_id >= 100")).collect()}
    assert tree == {(5, 0.0), (5, 1.0)}


def test_language_id(spark):
    text = {"en": "the cat and the dog went over the hill to see what they had there ",
            "de": "der hund und die katze gingen über den berg um zu sehen was dort ist "}
    rows = [(i, text[k][i % 20:] * (1 + i % 3), k) for k in text for i in range(60)]
    rows += [(200, None, "en"), (201, "12 !?", "en"), (202, "der berg und die katze", None), (None, "the dog", None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = language_id.identify(d).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert by[200] == by[201] == "und" and by[202] == "de"
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert {r.lang_pred for r in language_id.identify(d.where("lang is null")).collect()} == {"und"}


def brute_ppm(train, text):
    """PPM with exclusion, one symbol at a time."""
    counts = {}
    for t in train:
        f = ppm.framed(t)
        for i in range(ppm.ORDER, len(f)):
            for o in range(ppm.ORDER + 1):
                c = counts.setdefault((o, f[i - o:i]), {})
                c[f[i]] = c.get(f[i], 0) + 1
    total, f = 0.0, ppm.framed(text)
    for i in range(ppm.ORDER, len(f)):
        out, p = set(), 1.0
        for o in range(ppm.ORDER, -1, -1):
            c = {s: n for s, n in counts.get((o, f[i - o:i]), {}).items() if s not in out}
            if not c:
                continue
            whole = sum(c.values()) + (len(c) if len(out) + len(c) < 256 else 0)
            if f[i] in c:
                p *= c[f[i]] / whole
                break
            p *= len(c) / whole
            out |= set(c)
        else:
            p /= 256 - len(out)
        total += math.log10(p)
    return total


def test_ppm_scores(spark):
    rows = [(i, ("abra cadabra " * (1 + i % 3)) + f"x{i}") for i in range(12)] + [(50, None), (51, ""), (52, "ÉA zz"), (None, "abra")]
    d = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, score string")
    got = {r.doc_id: r for r in ppm.ppm_scores(d).collect()}
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    train = [(t or "").encode() for i, t in rows if not held[i]]
    c = {}
    for t in train:
        for w in [*t.lower().split(), "end"]:
            c[w] = c.get(w, 0) + 1
    n = sum(c.values())
    for i, t in rows:
        w = [*(t or "").encode().lower().split(), "end"]
        base = sum(math.log10((c.get(x, 0) + 0.5) / (n + 0.5 * (len(c) + 1))) for x in w)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(x in c for x in w), n)
        assert math.isclose(r.base_score, base) and math.isclose(r.score, brute_ppm(train, (t or "").encode()), rel_tol=1e-4)
    assert ppm.ppm_scores(d.where("false")).count() == 0


def test_ppm_keeps_every_context(spark):
    rng = np.random.default_rng(11)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789 .,;:-+*/=()"))
    rows = [(i, "".join(rng.choice(letters, 3000))) for i in range(40)]
    rows += [(100 + i, rows[i][1][500:900]) for i in range(6)]
    got = {r.doc_id: r for r in ppm.ppm_scores(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    train = [t.encode() for i, t in rows if not got[i].held_out]
    assert len({t[k:k + 5] for t in train for k in range(len(t) - 4)}) > 80_000
    for i, t in rows[::9] + rows[40:]:
        assert math.isclose(got[i].score, brute_ppm(train, t.encode()), rel_tol=1e-5)


def test_ppm_chances_across_bucket_edges(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [bytes(rng.choice(np.frombuffer(b"ab c", np.uint8), 300)) for _ in range(8)]
    monkeypatch.setattr(ppm, "SLAB", 1000)
    grams, n = np.unique(np.concatenate([g for g, _ in ppm.slabs(texts)]), return_counts=True)
    whole = ppm.chances(grams, n, ppm.Shared(np.zeros(0, np.uint64)))
    edges = grams[5::7]
    shared, cuts = ppm.Shared(edges), ppm._cuts(grams, edges)
    for g, _ in ppm.slabs(texts):
        shared.add(np.sort(g))
    parts = [ppm.chances(grams[i:j], n[i:j], shared) for i, j in zip(cuts, cuts[1:]) if j > i]
    assert len(parts) > 50 and np.allclose(np.concatenate(parts), whole, atol=1e-12)
    assert math.isclose(ppm._scores(texts, whole)[3], brute_ppm(texts, texts[3]), rel_tol=1e-9)
    long = [texts[0] * 9, b"", texts[1]]                # a text longer than a slab is read in parts
    grams = np.unique(np.concatenate([g for g, _ in ppm.slabs(long)]))
    monkeypatch.setattr(ppm, "SLAB", 1 << 20)
    assert (grams == np.unique(np.concatenate([g for g, _ in ppm.slabs(long)]))).all()


def test_trie_chances_sum_to_one():
    t = ppm.Trie([(0, 0, [97, 98, 255], [5, 3, 1]), (1, 97, [98], [4]), (1, 98, [97, 255], [2, 1])])
    t.build()
    assert np.allclose((10.0 ** t.log.astype(float)).sum(axis=1), 1, atol=1e-5)


def test_cover_search(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(0, 0.3, (300, 6))
    m[40:140] = m[40]                                   # a hot vector: ties go to the smaller id
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    rows += [(900, None), (1000, [0.1, None]), (1100, [float("nan")] * 6), (1200, [0.5]), (None, [0.1] * 6), (1201, [])]
    got = cover_search.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), pivots=8).collect()
    ok = [(i, np.floor(np.array(v, np.float32).astype(float) * 1024)) for i, v in rows
          if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    ok = [(i, np.concatenate([v, np.zeros(6 - len(v))])) for i, v in ok]
    want = []
    for q, v in ok:
        if q % 100 == 0:
            best = sorted((-int(v @ u), i) for i, u in ok if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(want)


def test_perspectives(spark):
    rows = [(1, 0, "System", "be kind"), (1, 1, "Ann", "hi"), (1, 2, "bob b", None), (1, 3, None, "?"), (1, 3, None, "?"),
            (2, 0, "system", "alone"), (None, 1, "ann", "lost")]
    t = spark.createDataFrame([(*r, 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, position int")
    got = chat_views.rotate(t).collect()
    assert {(r.conv_id, r.perspective) for r in got} == {(1, "ann"), (1, "bob b"), (None, "ann")} and len(got) == 11
    for c, p in {(r.conv_id, r.perspective) for r in got}:
        own = sorted((r for r in got if (r.conv_id, r.perspective) == (c, p)), key=lambda r: r.position)
        whole = "".join(r.segment for r in own)
        assert [r.position for r in own] == list(range(len(own)))
        for r in own:
            assert whole[r.start:].startswith(r.segment)
            if r.role == "assistant":
                assert r.speaker == p and whole[r.mask_start:r.mask_end] in ("hi", "", "lost")
            else:
                assert r.mask_start is None and r.mask_end is None
    assert "<|im_start|>user name=bob_b\n" in [r.segment for r in got if r.perspective == "ann" and r.speaker == "bob b"][0]


def test_positions(spark):
    d = spark.range(500).select((F.col("id") % 7).alias("k"), "id")
    got = sorted((r.k, r.id, r.pos) for r in common.positions(d, ["k", "id"]).collect())
    assert [x[2] for x in got] == list(range(500))


def test_no_operator_swallows_import_errors():
    import corpus_pipeline
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]
    assert not re.search(r"except", open(corpus_pipeline.__file__).read())
