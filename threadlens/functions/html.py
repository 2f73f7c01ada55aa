"""TX5: readable title and main text of an HTML page, as native expressions.

The page is cut into tokens by one regular expression (comments, whole script and style
elements, tags, text) and folded once with its stack of open elements, so elements nest to any
depth: an end tag closes the nearest open element of its name, one that closes nothing is
ignored, void elements are never open, and what is open at the end runs to the end. Text under
script/style/nav/footer/header is left out; the main element is the first <article> outside
those, else the first <main>, else the first <body>. Text nodes are joined by single spaces;
character references (numeric ones, and all named ones of HTML 5) are decoded once, after the
tags are gone. A tag starts with a letter, '/', '!' or '?' after '<' and ends at the first '>'
outside quotes. The noncharacters U+FDD0 to U+FDD5 mark places in the fold; such characters in
a page become U+FFFD.

The fold takes the tokens in blocks of about the square root of their number: a string grows
by appending a copy, so the text is built per block and the blocks are put together, which keeps
the copying of a page of n tokens near n * sqrt(n).
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadlens.functions.urls import source_domain

# Removed elements, main-content candidates, elements without an end tag.
REMOVED_TAGS = ["script", "style", "nav", "footer", "header"]
MAIN_TAGS = ["article", "main", "body"]
VOID_TAGS = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
# Named references: the standard's table as Python carries it; those without a semicolon are
# also read at the start of a longer name.
NAMED = json.dumps({"&" + name: chars for name, chars in html5.items()})
SHORT = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
UNCLOSED = "^(&(?:" + "|".join(SHORT) + "))(.*)$"
# Possessive, so a long attribute costs no stack.
TAG_END = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
PIECES = r"&#[0-9]{1,7};?|&#[xX][0-9a-fA-F]{1,6};?|&[a-zA-Z][a-zA-Z0-9]{1,31};?|[^&]++|&"
TOKENS = (r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b" + TAG_END + r".*?(?:</\1\s*>|\z)|<[a-zA-Z/!?]" + TAG_END
          + "|[^<]++|<")
# Marks of the fold: where the first article, main and body open and close.
OPENS, CLOSES, REMOVED = "\ufdd0\ufdd1\ufdd2", "\ufdd3\ufdd4\ufdd5", "\ufdd6"
OPEN, CLOSE = dict(zip(MAIN_TAGS, OPENS)), dict(zip(MAIN_TAGS, CLOSES))
MARKS = OPENS + CLOSES
# References to C1 controls mean the Windows-1252 characters at those places.
C1 = {chr(b): c for b in range(128, 160) if (c := bytes([b]).decode("cp1252", "ignore"))}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _referenced(piece: Column) -> Column:
    """The character of a numeric reference."""
    digits = F.regexp_extract(piece, "^&#[xX]?([0-9a-fA-F]+)", 1)
    code = F.when(piece.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.translate(char, "".join(C1), "".join(C1.values()))


def _named(piece: Column) -> Column:
    """The characters of a named reference; an unknown name stays, but for a known start of it."""
    whole = F.try_element_at(F.from_json(F.lit(NAMED), "map<string,string>"), piece)
    start = F.regexp_extract(piece, UNCLOSED, 1)
    known = F.try_element_at(F.from_json(F.lit(NAMED), "map<string,string>"), start)
    return F.coalesce(whole, F.concat(known, F.regexp_extract(piece, UNCLOSED, 2)), piece)


def decode_entities(t) -> Column:
    """Every character reference, with or without its semicolon, decoded once."""
    t = _c(t)
    whole = F.array_join(F.transform(
        F.regexp_extract_all(t, F.lit(PIECES), F.lit(0)),
        lambda p: (F.when(p.rlike("^&#[xX]?[0-9a-fA-F]"), _referenced(p))
                    .when(p.rlike("^&[a-zA-Z]"), _named(p)).otherwise(p))), "")
    return F.when(F.contains(t, F.lit("&")), whole).otherwise(t)


def strip_unicode(t) -> Column:
    return F.regexp_replace(_c(t), r"(?U)^\s+|\s+$", "")


def raw_title(html) -> Column:
    return F.regexp_extract(_c(html), rf"(?is)<title\b{TAG_END}(.*?)</title\s*>", 1)


def page_tokens(html) -> Column:
    """Comments, script and style elements, tags and texts of a page, in order, as ``_token`` structs."""
    h = _c(html)
    free = F.when(F.rlike(h, F.lit(f"[{MARKS}]")), F.translate(h, MARKS, "\ufffd" * len(MARKS))).otherwise(h)
    texts = F.regexp_extract_all(free, F.lit(TOKENS), F.lit(0))
    return F.transform(F.transform(texts, _named_token), _token)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda a, _: a, use)


def _named_token(text: Column) -> Column:
    tag = F.rlike(text, F.lit("^<[a-zA-Z/!?]"))
    return F.struct(text.alias("text"), F.when(tag, F.lower(F.regexp_extract(text, r"^</?([a-zA-Z][^\s/>]*)", 1))).alias("name"))


def _token(t: Column) -> Column:
    """A token's kind ('text', 'open', 'close', 'empty': opens and closes, or 'gap'), element name,
    text, and the mark of a main candidate, or of a removed element."""
    text, name = t["text"], t["name"]
    kind = (F.when(name.isNull(), "text").when((name == "") | F.startswith(text, F.lit("<!")), "gap")
             .when(F.startswith(text, F.lit("</")), "close").when(name.isin("script", "style", *VOID_TAGS), "gap")
             .when(F.endswith(text, F.lit("/>")), "empty").otherwise("open"))
    mark = F.when(name.isin(REMOVED_TAGS), REMOVED)
    for tag in MAIN_TAGS:
        mark = mark.when(name == tag, OPEN[tag])
    return F.struct(kind.alias("kind"), name.alias("name"), text.alias("text"), mark.otherwise("").alias("mark"))


def _state(stack, size, cut, seen, out, done) -> Column:
    """``stack``: '/html/body/', the open elements, a main candidate followed by its mark; ``size``: its
    length. ``cut``: the length when the outermost open removed element opened, else 0. ``seen``: the
    marks given out. ``out``: the text of this block, ``done``: that of the blocks before it."""
    return F.struct(stack.alias("stack"), size.cast("int").alias("size"), cut.cast("int").alias("cut"),
                    seen.alias("seen"), out.alias("out"), done.alias("done"))


def _with_out(s: Column, out: Column, done: Column) -> Column:
    return _state(s["stack"], s["size"], s["cut"], s["seen"], out, done)


def _tag(s: Column, t: Column) -> Column:
    """The state after an 'open', 'close' or 'empty' tag."""
    name, kind, shown = t["name"], t["kind"], s["cut"] == 0
    here = F.concat(F.lit("/"), name, F.lit("/"))
    behind = F.when(F.endswith(s["stack"], here), 1).otherwise(F.instr(F.reverse(s["stack"]), F.reverse(here)))
    first = (kind != "close") & shown & (t["mark"] != REMOVED) & ~F.contains(s["seen"], t["mark"])
    pushed = F.concat(name, F.lit("/"), F.when(first, F.concat(t["mark"], F.lit("/"))).otherwise(""))
    change = F.when(kind == "open", pushed).otherwise("")
    kept = (F.when((kind == "close") & F.contains(s["stack"], here), s["size"] - behind - F.length(name))
             .otherwise(s["size"]))

    def after(v: Column) -> Column:
        popped = F.substring(s["stack"], v["kept"] + 1, s["size"])
        size = v["kept"] + F.length(v["push"])
        cut = (F.when(v["kept"] < s["cut"], 0)
                .when(shown & (kind == "open") & (t["mark"] == REMOVED), size).otherwise(s["cut"]))
        out = (F.when(v["mark"] != "", F.concat(v["mark"], F.when(kind == "empty", F.translate(v["mark"], OPENS, CLOSES))
                                                .otherwise("")))
                .when(v["kept"] < s["size"], F.translate(F.regexp_replace(popped, f"[^{OPENS}]", ""), OPENS, CLOSES))
                .otherwise(""))
        stack = F.when(v["kept"] < s["size"], F.left(s["stack"], v["kept"])).otherwise(F.concat(s["stack"], v["push"]))
        return _state(stack, size, cut, F.concat(s["seen"], v["mark"]), F.concat(s["out"], F.lit(" "), out), s["done"])

    return _let(F.struct(kept.alias("kept"), change.alias("push"),
                         F.when(first, t["mark"]).otherwise("").alias("mark")), after)


def _step(s: Column, t: Column) -> Column:
    text = F.when(t["kind"] == "gap", " ").when(s["cut"] == 0, t["text"]).otherwise("")
    return (F.when(t["kind"].isin("text", "gap"), _with_out(s, F.concat(s["out"], text), s["done"]))
             .otherwise(_tag(s, t)))


def page_marked(tokens) -> Column:
    """The text without the removed elements, with the marks of the main candidates, from the
    column of ``page_tokens``."""
    tokens, none = _c(tokens), F.lit("")
    block = F.ceil(F.sqrt(F.size(tokens))).cast("int")
    blocks = F.sequence(F.lit(0), F.ceil(F.size(tokens) / block).cast("int") - 1)
    whole = F.aggregate(
        blocks, _state(F.lit("/"), F.lit(1), F.lit(0), none, none, none),
        lambda s, i: F.aggregate(F.slice(tokens, i * block + 1, block), s, _step,
                                 lambda r: _with_out(r, none, F.concat(r["done"], r["out"]))),
        lambda s: s["done"])
    return F.when(F.size(tokens) > 0, whole)


def _cut(text: Column, cut: int | None) -> Column:
    """The whole text, or its first ``cut`` characters and an ellipsis."""
    if cut is None:
        return text
    return F.when(F.length(text) > cut, F.concat(F.substring(text, 1, cut), F.lit("..."))).otherwise(text)


def extract_page(df, url_col: str = "url", html_col: str = "html", cut: int | None = None):
    """TX5 over a pages(url, html) table: adds title, text (whole unless ``cut`` is given),
    source_domain, found.

    The marked text and the main element are computed once per row in their own projections
    (they feed several expressions).
    """
    marked, main = F.col("_marked"), F.lit(None).cast("string")
    for tag in reversed(MAIN_TAGS):
        inner = F.substring_index(F.substring_index(marked, OPEN[tag], -1), CLOSE[tag], 1)
        main = F.when(F.contains(marked, F.lit(OPEN[tag])), inner).otherwise(main)
    m = (df.withColumn("_tokens", page_tokens(html_col)).withColumn("_marked", page_marked("_tokens"))
           .withColumn("_main", F.translate(main, MARKS, "")).withColumn("_title", raw_title(html_col)))
    t = m.withColumn("_t", F.trim(F.regexp_replace(decode_entities("_main"), r"(?U)\s+", " ")))
    return (t.withColumn("title", strip_unicode(decode_entities("_title")))
             .withColumn("text", _cut(F.col("_t"), cut))
             .withColumn("source_domain", source_domain(url_col))
             .withColumn("found", F.col("_main").isNotNull())
             .drop("_tokens", "_marked", "_main", "_t", "_title"))
