"""Randomised brute-force checks: many generated inputs per rule in one Spark job each,
compared with plain-Python statements of the same rules."""

import random
import re
from fractions import Fraction
from urllib.parse import urlparse

from pyspark.sql import functions as F

from threadlens.functions import rounding as rd
from threadlens.functions import text as tx
from threadlens.functions import urls as U

ALPHABET = ["a", "b", "Z", ".", ".", " ", "  ", "\n", "\t", "é", "!", "?", " ", " ", "x.y", "\u3000", "\x0b", "\x0c", "\r\n"]


def rand_text(rnd, n):
    return "".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, n)))


def test_text_rules(spark):
    rnd = random.Random(11)
    texts = [rand_text(rnd, 160) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r for r in df.select("i", tx.word_count("t").alias("wc"), tx.clean_text("t").alias("clean"),
                                     tx.text_preview("t", 50).alias("prev"),
                                     tx.truncate_text("t", 20).alias("trunc")).collect()}
    for i, t in enumerate(texts):
        assert got[i].wc == len(t.split()), repr(t)
        assert got[i].clean == " ".join(t.split()), repr(t)
        if len(t) <= 50:
            prev = t
        else:
            cut = t[:50]
            lp = cut.rfind(".")
            prev = cut[:lp + 1] if lp > 50 * 0.7 else cut + "..."
        assert got[i].prev == prev, repr(t)
        assert got[i].trunc == (t if len(t) <= 20 else t[:17] + "..."), repr(t)


def exact_tenths(c, n):
    """round_half_even(1000 * c / n) with exact rational arithmetic."""
    if n == 0:
        return 0
    return round(Fraction(1000 * c, n))   # Python's round on a Fraction is half-even


def test_rounding_and_scores(spark):
    rnd = random.Random(5)
    pairs = [(c, n) for n in range(1, 160) for c in range(0, n + 1)] + [(rnd.randint(0, 10**6), 10**6 + 7) for _ in range(300)]
    df = spark.createDataFrame(pairs, "c bigint, n bigint")
    for r in df.select("c", "n", rd.pct_tenths("c", "n").alias("t")).collect():
        assert r.t == exact_tenths(r.c, r.n), (r.c, r.n)
    scores = list(range(-20, 3000, 7)) + [rnd.randint(0, 10**8) for _ in range(300)] + [1050, 1150, 999_950, 1_050_000]
    sd = spark.createDataFrame([(s,) for s in scores], "s bigint")

    def fmt(s):
        if s >= 1_000_000:
            t = round(Fraction(s, 100_000))
            return f"{t // 10}.{t % 10}M"
        if s >= 1_000:
            t = round(Fraction(s, 100))
            return f"{t // 10}.{t % 10}k"
        return str(s)

    for r in sd.select("s", tx.format_score("s").alias("f")).collect():
        assert r.f == fmt(r.s), r.s


def test_stats_random(spark):
    from collections import Counter
    from threadlens.operators import stats as S
    rnd = random.Random(29)
    labels = ["supportive", "critical", "neutral", None]
    intents = ["ASK", "ADVICE", "STORY", "JOKE", "META", "RANT", None]
    rows = []
    for p in range(30):
        for s in range(rnd.randint(1, 40)):
            rows.append((p, s, rnd.choice(labels), rnd.choice(intents), rnd.choice([None, 0.5, 2.0, 5.0, 9.5]),
                         [rnd.choice(["Tip", "tip ", "Other", " other", "x"]) for _ in range(rnd.randint(0, 3))]))
    df = spark.createDataFrame(rows, "post_id bigint, seq bigint, toward_op string, intent_primary string, "
                                     "quality_score double, l array<string>")
    by_post = {}
    for r in rows:
        by_post.setdefault(r[0], []).append(r)
    sent = {(r.post_id, r.toward_op): r.n for r in S.sentiment_distribution(df).collect()}
    themes = {}
    for r in S.theme_percentages(df).orderBy("post_id", "rank").collect():
        themes.setdefault(r.post_id, []).append((r.theme, r.pct))
    qc = {r.post_id: (r.total_processed, r.high_quality_count, r.high_quality_percentage)
          for r in S.quality_counts(df, 2.0).collect()}
    merged = {}
    for r in S.merge_insights(df, "l", "seq").orderBy("post_id", "first_src", "first_pos").collect():
        merged.setdefault(r.post_id, []).append(r.insight)
    for p, rs in by_post.items():
        c = Counter(r[2] or "neutral" for r in rs)
        assert {k: v for (pp, k), v in sent.items() if pp == p} == dict(c)
        ic = Counter(r[3] or "UNKNOWN" for r in rs)
        top = sorted(ic.items(), key=lambda kv: (-kv[1], kv[0]))[:5]
        assert themes[p] == [(k, round(Fraction(1000 * v, len(rs))) / 10) for k, v in top]
        hq = sum(1 for r in rs if (r[4] or 0) >= 2.0)
        assert qc[p] == (len(rs), hq, round(Fraction(1000 * hq, len(rs))) / 10)
        seen, first = set(), []
        for r in sorted(rs, key=lambda r: r[1]):
            for x in r[5]:
                if x.lower().strip() not in seen:
                    seen.add(x.lower().strip())
                    first.append(x)
        assert merged.get(p, []) == first


def test_memo_random(spark):
    import datetime as dt
    from threadlens.operators import memo as M
    rnd = random.Random(41)
    base = dt.datetime(2024, 1, 20)
    as_of = dt.datetime(2024, 1, 31)

    def log(n, v0):
        out = []
        for v in range(n):
            ts = None if rnd.random() < 0.05 else base + dt.timedelta(hours=rnd.randint(0, 24 * 12))
            out.append((f"k{rnd.randint(0, 60)}", f"p{v0 + v}", ts, v0 + v))
        return out

    old, new = log(400, 0), log(150, 1000)
    schema = "url string, payload string, cached_at timestamp_ntz, version bigint"
    o, n = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)

    def latest(rows):
        best = {}
        for r in rows:
            key = (r[2] is not None, r[2] or dt.datetime.min, r[3])
            if r[0] not in best or key > best[r[0]][0]:
                best[r[0]] = (key, r)
        return {k: v[1] for k, v in best.items()}

    cur = latest(old)
    got = {r.url: (r.payload, r.version) for r in M.current(o, "url", ("cached_at", "version")).collect()}
    assert got == {k: (v[1], v[3]) for k, v in cur.items()}
    up = dict(cur)
    up.update(latest(new))
    got = {r.url: r.payload for r in M.memo_upsert(o, n, "url", ("cached_at", "version")).collect()}
    assert got == {k: v[1] for k, v in up.items()}

    def expired(ts, hours=24):
        return ts is None or ts < as_of - dt.timedelta(hours=hours)

    keys = spark.createDataFrame([(f"k{i}",) for i in range(0, 80)], "url string")
    state = M.current(o, "url", ("cached_at", "version"))
    look = {r.url: (r.hit, r.payload) for r in M.memo_lookup(keys, state, "url", as_of, 24).collect()}
    for i in range(80):
        k = f"k{i}"
        live = k in cur and not expired(cur[k][2])
        assert look[k] == ((True, cur[k][1]) if live else (False, None)), k
    miss = {r.url for r in M.memo_misses(keys, state, "url", as_of, 24).collect()}
    assert miss == {k for k, v in look.items() if not v[0]}
    _, counts = M.memo_purge({"posts": state}, as_of, 24)
    c = counts.first()
    assert (c.purged, c.kept) == (sum(expired(v[2]) for v in cur.values()), sum(not expired(v[2]) for v in cur.values()))
