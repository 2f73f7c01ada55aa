"""Annotator boundary: parsing rules, positional matching, defaults, Python annotators."""

from pyspark.sql import functions as F

from threadlens.operators import enrich as EN

OBJ = '{"comment_id": "1", "quality_score": 7, "intent_primary": "ASK", "relevance_score": 3}'


def test_parse_rules(spark):
    long_obj = '{"a": "' + "x" * 60 + '"}'
    rows = [("[1, 2]",), ("text ```json\n[" + OBJ + "]\n``` more",), ("see " + long_obj + " ok",),
            ('tiny {"a": 1} only',), ("nothing here",), ("prefix [" + OBJ + "] suffix",)]
    df = spark.createDataFrame(rows, "t string")
    got = [tuple(r) for r in df.select(EN.parse_rule("t"), EN.extract_json_text("t")).collect()]
    assert got[0] == ("whole", "[1, 2]")
    assert got[1] == ("fenced", "[" + OBJ + "]")
    assert got[2] == ("embedded", long_obj)
    assert got[3] == (None, None)          # the embedded object is too short
    assert got[4] == (None, None)
    assert got[5] == ("embedded", OBJ)     # objects are tried before arrays


def test_long_responses(spark):
    """Long answers parse or become null; none of them ends the JVM."""
    body, nested = "x" * 1_000_000, "{" * 10_000 + "}" * 10_000
    rows = [("so " + '{"a": "' + "y" * 4_000 + '"} end',), ("so " + '{"a": "' + body + '"} end',),
            ("open { " + body,), (nested,), ("[" * 10_000 + " " + body,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(EN.extract_json_text("t")).collect()]
    assert got == ['{"a": "' + "y" * 4_000 + '"}', '{"a": "' + body + '"}', None, None, None]


def test_match_and_defaults(spark):
    batched = spark.createDataFrame(
        [(1, 0, p, 100 + p) for p in range(3)] + [(2, 0, p, 200 + p) for p in range(2)] +
        [(3, 0, 0, 300)], "post_id bigint, batch_id bigint, pos bigint, comment_id bigint")
    responses = spark.createDataFrame(
        [(1, 0, "[" + OBJ + ", 42]"),          # one element short, one not an object
         (2, 0, "not json"),
         (3, 0, "[]")], "post_id bigint, batch_id bigint, response string")
    m = EN.merge_annotation(EN.match_annotations(batched, responses)).orderBy("post_id", "pos").collect()
    got = [(r.post_id, r.pos, r.comment_id, r.quality_score, r.intent_primary, r.annotation_status) for r in m]
    assert got == [(1, 0, "1", 7.0, "ASK", "parsed"), (1, 1, "101", 5.0, "UNKNOWN", "default_element"),
                   (1, 2, "102", 5.0, "UNKNOWN", "default_missing"),
                   (2, 0, "200", 5.0, "UNKNOWN", "default_batch"), (2, 1, "201", 5.0, "UNKNOWN", "default_batch"),
                   (3, 0, "300", 5.0, "UNKNOWN", "default_batch")]


def test_prompts(spark):
    df = spark.createDataFrame([(1, 1, 5, "hello", 0), (1, 2, -3, "x" * 1200, 1)],
                               "post_id bigint, rank bigint, score bigint, body string, x int")
    b = EN.assign_batches(df, 1)
    assert [(r.batch_id, r.pos) for r in b.orderBy("rank").collect()] == [(0, 0), (1, 0)]
    p = EN.comments_prompt(EN.assign_batches(df, 20)).first()
    assert p.comments_text == '1. [Score: 5] "hello"\n\n2. [Score: -3] "' + "x" * 1200 + '"'
    short = EN.comments_prompt(EN.assign_batches(df, 20), body_cut=1000).first()
    assert short.comments_text.endswith('"' + "x" * 1000 + '"')
    assert p.prompt.startswith("Post context: \n\nComments:\n1. [Score: 5]")


def test_python_annotator_failure_isolation(spark):
    ranked = spark.createDataFrame([(p, r, p * 10 + r, "BOOM" if p == 2 else "fine", 1)
                                    for p in (1, 2) for r in (1, 2, 3)],
                                   "post_id bigint, rank bigint, comment_id bigint, body string, score bigint")

    def flaky(prompts):
        if any("BOOM" in p for p in prompts):
            raise RuntimeError("model error")
        return ["[" + ", ".join([OBJ] * p.count("[Score")) + "]" for p in prompts]

    m = EN.enrich_comments(ranked, flaky, batch_size=2, partitions=2).collect()
    assert len(m) == 6                      # a failing call never drops or fails rows
    status = {(r.post_id, r.annotation_status) for r in m}
    assert status == {(1, "parsed"), (2, "default_batch")}


def test_default_structs(spark):
    r = spark.range(1).select(EN.default_post_annotation().alias("p"), EN.default_synthesis().alias("s"),
                              EN.post_annotation_from(F.lit("garbage")).alias("q")).first()
    assert r.p.core_issue == "Unable to analyze" and r.p.summaries.one_sentence == "Analysis unavailable"
    assert r.s.executive_summary == "Synthesis unavailable" and r.s.community_consensus.validation_status == "unknown"
    assert r.q == r.p


def test_rule_quality(spark):
    df = spark.createDataFrame([(" ".join(["word"] * 20) + " you should try http://x.y", 100), ("meh", -5)],
                               "body string, score bigint")
    got = [r[0] for r in df.select(EN.rule_quality()).collect()]
    assert got == [10.0, 4.0 * (1 / 20)]


def test_rule_words_are_found_as_whole_tokens(spark):
    """Only the rule words of a text are kept, and the same ones as among all its tokens."""
    import random
    import re
    words = {*EN.ADVICE_WORDS, *EN.EXPERIENCE_WORDS, *EN.SUPPORT_WORDS, *EN.CRITIC_WORDS}
    rng = random.Random(4)
    parts = [*words, "tries", "me2", "my_own", "_i", "usé", "isé", "ſhould", " ", "\n", "-", "'", "é", "日本", "", ".", "i", "i"]
    texts = ["", "i", "I,i.ME", "should-try", "use" * 2] + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 25))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", EN.tokens_of(F.lower("t")).alias("k"))
    for r in df.collect():
        assert r.k == [w for w in re.split("[^a-z0-9_]+", r.t.lower()) if w in words], r.t
