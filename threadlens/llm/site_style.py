"""HTML extraction with a site style tree.

The pages of a host are merged into one style tree: a node is a path of element styles (tag,
class, id, role), and it keeps how the pages vary in it. The importance of a node is
``(1 - g**l) * presentation + g**l * content``: the entropy of the child sequences that pages show
there, and one minus the mean entropy of its contents over the pages (a content found on every
page tells nothing, one found on a single page is worth most); ``l`` is the mean number of
children. Pages of a host with the same text count once: copies say nothing about the template.
Branches of low importance, whose contents are of low importance too, are cut from each page, as are those whose tag or name says
what they are (menus, forms, adverts, comments ...), unless a name or form holds the page's article
or most of its text, which is left to its importance; plain text elements inside an article are
never cut, for copied articles would look like boilerplate. The main text is what is left of the
page's articles, or of its body if it has none.

Scale: a page's part of the tree is packed into one row, and a host's copies of it meet in a combine
by host and text. Both entropies are sums over pages, so the tree is built by grouped sums with a map-side
combine, and neither a host nor its tree is ever in one task. Only the cut nodes of each host, a
few template branches, are joined back to its pages; Spark splits the hot host.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.llm.common import store

DECAY = 0.9
LEAST_IMPORTANCE = 0.3
LEAST_PAGES = 3
COMBINE_KEYS = 200_000

MARKUP = re.compile(
    r"<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
START = re.compile(r"<(?:[!?]|(/?)([a-zA-Z][^\s/>]*+))")
TAG_CHARS = 4096        # quotes are paired within so many characters of a tag; a longer tag ends at the next ">"
ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?")
RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "xmp")}

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol option p pre
    section select summary table tbody td template tfoot th thead title tr ul""".split())
PLAIN = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table thead tbody tfoot tr td th section div figure figcaption".split())
CUT_TAGS = set("""script style noscript template head title nav footer aside button select textarea iframe svg dialog
    menu object canvas audio video map option math""".split())
CUT_ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar toolbar alertdialog".split())
CUT_WORD = (r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|gdpr|login|masthead|menu|modal|"
            r"nav\w*|newsletter|notices?|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|signup|social|"
            r"sponsor\w*|subscribe|toolbar|topbar|widgets?|header)")
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BESIDE = (r"(?:area|bar|block|bottom|box|buttons?|container|form|icons?|inner|items?|left|links?|list|main|page|posts?|"
          r"primary|right|secondary|section|site|slot|top|unit|wrap|wrapper)")
#: Whole names, all of whose parts say so: "cookie-notice" and "comment-list", but not "no-sidebar" or "share-price".
CUT_NAMES = re.compile(rf"(?:^|\s)(?:{BESIDE}[_-]+)*{CUT_WORD}(?:[_-]+(?:{CUT_WORD}|{BESIDE}))*(?=$|\s)", re.I)
#: The same inside an article, and for headings: there a "section-header" is the article's own.
CUT_INSIDE = re.compile(CUT_NAMES.pattern.replace("|header)", ")"), re.I)
TALK = re.compile(r"\b(?:comments?|disqus|related|replies|respond)\b", re.I)    # may well be most of a page's text
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"),
          "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


class Node:
    __slots__ = ("tag", "style", "hard", "soft", "talk", "noisy", "inside", "up", "parent", "children", "cut", "size", "holds")

    def __init__(self, tag, style, hard, soft, talk, noisy, inside, up, parent):
        """``hard`` and ``soft``: cut by its tag or role, by its name or as a form; ``noisy``: by its importance."""
        self.tag, self.style, self.hard, self.soft, self.talk, self.noisy = tag, style, hard, soft, talk, noisy
        self.inside, self.up, self.parent, self.children = inside, up, parent, []
        self.cut, self.size, self.holds = False, 0, None


def _signed(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class Page:
    """A page as its blocks ``(element, text)`` in order; elements of ``noisy`` styles are cut."""

    def __init__(self, source: str, noisy=frozenset()):
        self.blocks, self.nodes, self.noisy = [], [], noisy
        root = Node("", 0, False, False, False, False, False, None, None)
        self.every = [root]
        self.stack, self.text, self.open_tags = [root], [], Counter()
        for text, closing, tag, attributes in self.pieces(source):
            self.add(text)
            if tag and closing:
                self.close(tag)
            elif tag:
                self.open(tag, attributes)
                if tag in RAW and not attributes.endswith("/"):
                    end = RAW[tag].search(source, self.at)
                    self.at = end.end() if end else len(source)
                    self.close(tag)
        self.flush()
        self.decide()

    def pieces(self, source: str):
        """``(text, closing, tag, attributes)``: each tag, and the text before it; once through the page."""
        self.at, look, n, gt = 0, 0, len(source), -1
        while True:
            lt = source.find("<", look)
            if lt < 0:
                break
            if source.startswith("<!--", lt):
                end = source.find("-->", lt + 4)
                end = n if end < 0 else end + 3
                closing = tag = attributes = ""
            else:
                m = MARKUP.match(source, lt, min(n, lt + TAG_CHARS))
                if m:
                    end, closing, tag = m.end(), m[1] or m[4], m[2] or m[5] or ""
                    attributes = m[3] or m[6] or ""
                else:
                    m = START.match(source, lt)
                    if m and gt < lt:
                        gt = source.find(">", lt)
                        gt = n if gt < 0 else gt
                    if not m or gt == n:        # a bare "<", or a tag that never ends: text
                        look = lt + 1
                        continue
                    end, closing, tag, attributes = gt + 1, m[1], m[2] or "", source[m.end():gt]
            text, self.at = source[self.at:lt], end
            yield text, closing, tag.lower(), attributes
            look = self.at
        yield source[self.at:], "", "", ""

    def decide(self) -> None:
        """Which elements are cut: a name or form that holds the article or most of the text is not."""
        for node in self.every[1:]:
            node.cut = node.hard or node.parent.cut
        total = 0
        for node, text in self.blocks:
            if not node.cut:
                total += len(text)
                node.size += len(text)
        for node in reversed(self.every[1:]):       # children come after their parents
            node.parent.size += node.size
        for node in self.every:
            if node.soft and not node.talk and 2 * node.size > total:
                node.soft = False
        articles = [x for x in self.every if x.tag in ("article", "main") and not x.parent.inside and x.size]
        while articles:
            for node in self.every:                 # ``holds``: the outermost of those around it that are cut by name
                node.holds = (node.parent and node.parent.holds) or (node if node.soft else None)
            tops = [x.holds for x in articles]
            if None in tops:
                break
            max(tops, key=lambda x: x.size).soft = False
        for node in self.every[1:]:
            node.cut = node.hard or node.soft or node.noisy or node.parent.cut

    def add(self, text: str) -> None:
        if text:
            self.text.append(html_lib.unescape(text) if "&" in text else text)

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                self.blocks.append((self.stack[-1], text))

    def open(self, tag: str, attributes: str) -> None:
        if tag in ("br", "hr"):
            self.text.append(" ")
        block = tag in BLOCKS or tag in CUT_TAGS
        if tag in VOID or not block and not attributes:
            return                      # plain inline markup is part of the text around it
        if block:
            self.flush()
        if tag in BLOCKS and any(x.tag == "p" for x in self.stack[-4:]):
            self.close("p")
        if tag in CLOSES and any(self.open_tags[t] for t in CLOSES[tag]):
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in SCOPES[tag]:
                    break
                if self.stack[k].tag in CLOSES[tag]:
                    self.flush()
                    self.leave(k)
                    break
        up, names, roles = self.stack[-1], "", ""
        if attributes:
            found = [(k.lower(), a or b or c) for k, a, b, c in ATTRIBUTE.findall(attributes)]
            names = " ".join(v for k, v in found if k in ("class", "id") and v)
            roles = " ".join(v for k, v in found if k == "role" and v)
        hard = (tag in CUT_TAGS or (tag == "header" and not up.inside)
                or bool(roles and CUT_ROLES & set(roles.lower().split())))
        named = bool(names and tag not in ("html", "body", "article", "main")
                     and (CUT_INSIDE if up.inside or tag in HEADINGS else CUT_NAMES).search(names))
        soft = named or tag == "form" or "form" in roles.lower().split()
        talk = named and bool(TALK.search(names))
        if not block:
            if hard or soft:            # an inline advert or menu
                self.flush()
                self.enter(Node(tag, up.style, hard, soft, talk, False, up.inside, up.up, up))
            return
        inside = up.inside or tag in ("article", "main") or roles.lower() == "main"
        plain = tag in ("article", "main", "body", "html") or inside and tag in PLAIN and not names
        style = _signed(f"{up.style}>{tag}.{re.sub(r'[0-9]+', '0', names)}")
        up.children.append(tag)
        node = Node(tag, style, hard, soft, talk, not plain and style in self.noisy, inside, up, up)
        self.enter(node)
        if tag not in ("html", "body"):
            self.nodes.append(node)

    def enter(self, node: Node) -> None:
        self.stack.append(node)
        self.every.append(node)
        self.open_tags[node.tag] += 1

    def leave(self, k: int) -> None:
        for node in self.stack[k:]:
            self.open_tags[node.tag] -= 1
        del self.stack[k:]

    def close(self, tag: str) -> None:
        if not self.open_tags[tag]:
            return
        k = len(self.stack) - 1
        while self.stack[k].tag != tag:
            k -= 1
        if tag in BLOCKS or tag in CUT_TAGS or self.stack[k].hard or self.stack[k].soft:
            self.flush()
        self.leave(k)

    def main_text(self) -> str:
        """Text of the blocks that aren't cut, of those in articles if there are any."""
        good = [(b, t) for b, t in self.blocks if not b.cut]
        inside = [t for b, t in good if b.inside]
        return " ".join(inside if inside else [t for _, t in good])


def host(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m.group(1).lower() if m else ""


TREE = "host string, node bigint, kind int, feature bigint, n double, spread double, pages bigint, children double"


PART = np.dtype([("node", "<i8"), ("kind", "<i4"), ("feature", "<i8"), ("n", "<f8")])


def _parts(batches):
    """A page's part of its host's tree, and the digest of its text: the main one, without the tree."""
    for b in batches:
        hosts, digests, packed = [], [], []
        for url, source in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
            page = Page(source or "")
            shown, held = defaultdict(list), defaultdict(int)
            for node in page.nodes:
                shown[node.style].append(" ".join(node.children))
            for node, text in page.blocks:
                f = _signed(text)
                while node is not None and node.tag not in ("", "html", "body"):
                    held[node.style, f] += 1
                    node = node.up
            rows = [(style, 0, _signed("|".join(x)), sum(len(s.split()) for s in x) / len(x)) for style, x in shown.items()]
            rows += [(style, 1, f, n) for (style, f), n in held.items()]
            hosts.append(host(url))
            digests.append(_signed(page.main_text()))
            packed.append(np.array(rows, PART).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()),
                                          pa.array(packed, pa.binary())], ["host", "digest", "packed"])


def _tree(batches):
    """What each page adds to its host's tree, summed over a bounded number of keys before it is sent."""
    sums = defaultdict(lambda: [0.0, 0.0, 0, 0.0])

    def out():
        keys, vals = list(sums), list(sums.values())
        cols = [[k[i] for k in keys] for i in range(4)] + [[v[i] for v in vals] for i in range(4)]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64())
        sums.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                          [c.split()[0] for c in TREE.split(", ")])

    for b in batches:
        for h, packed in zip(b.column("host").to_pylist(), b.column("packed").to_pylist()):
            for style, kind, f, n in np.frombuffer(packed, PART).tolist():
                row = sums[h, style, kind, f]
                row[2] += 1
                if kind:
                    row[0] += n
                    row[1] += n * math.log(n)
                else:
                    row[3] += n
            if len(sums) > COMBINE_KEYS:
                yield out()
    yield out()


def style_tree(pages: DataFrame, decay: float = DECAY) -> DataFrame:
    """``host, node, pages, presentation, content, importance`` for every node of each host's tree.

    Pages are those of different text. A node on one page has importance 1; one without any text has
    content importance 0.
    """
    p = pages.select(F.col("url").cast("string"), F.col("html").cast("string"))
    p = p.mapInArrow(_parts, "host string, digest bigint, packed binary").groupBy("host", "digest").agg(
        F.min("packed").alias("packed"))
    f = p.mapInArrow(_tree, TREE).groupBy("host", "node", "kind", "feature").agg(
        F.sum("n").alias("n"), F.sum("spread").alias("spread"), F.sum("pages").alias("pages"),
        F.sum("children").alias("children"))
    shown, content = F.col("kind") == 0, F.col("kind") == 1
    t = f.groupBy("host", "node").agg(
        F.sum(F.when(shown, F.col("pages"))).alias("pages"),
        F.sum(F.when(shown, F.col("pages") * F.log("pages"))).alias("same"),
        F.sum(F.when(shown, F.col("children"))).alias("children"),
        F.avg(F.when(content, F.log("n") - F.col("spread") / F.col("n"))).alias("entropy"))
    log_m, weight = F.log("pages"), F.pow(F.lit(decay), F.col("children") / F.col("pages"))
    t = t.withColumn("presentation", F.when(F.col("pages") > 1, 1 - F.col("same") / F.col("pages") / log_m).otherwise(1.0))
    t = t.withColumn("content", F.when(F.col("entropy").isNull(), 0.0).when(
        F.col("pages") > 1, 1 - F.least(F.col("entropy") / log_m, F.lit(1.0))).otherwise(1.0))
    return t.select("host", "node", "pages", "presentation", "content",
                    F.when(F.col("pages") > 1, (1 - weight) * F.col("presentation") + weight * F.col("content"))
                    .otherwise(1.0).alias("importance"))


def _extract(batches):
    for b in batches:
        noisy = [set(x or ()) for x in b.column("noisy").to_pylist()]
        texts = [Page(h or "", x).main_text() for h, x in zip(b.column("html").to_pylist(), noisy)]
        yield pa.RecordBatch.from_arrays(
            [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def _hosts(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays(
            [*b.columns, pa.array([host(u) for u in b.column("url").to_pylist()], pa.string())],
            [*b.schema.names, "host"])


def main_text(pages: DataFrame, least: float = LEAST_IMPORTANCE, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages`` (``page_id, url, html``).

    A null or empty html has an empty text. Pages without a url share the host "". Broken markup is
    read as far as it goes. Repeated rows each get a row; an empty table gives none.
    """
    noisy = store(style_tree(pages).where((F.col("importance") < least) & (F.col("content") < least)
                                        & (F.col("pages") >= least_pages))
                  .groupBy("host").agg(F.collect_list("node").alias("noisy")), "noisy")
    p = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    p = p.mapInArrow(_hosts, "page_id bigint, url string, html string, host string")
    return p.join(noisy, "host", "left").select("page_id", "url", "html", "noisy").mapInArrow(
        _extract, "page_id bigint, url string, text string, n_chars bigint")
