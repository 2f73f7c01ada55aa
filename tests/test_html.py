"""TX5 on nested, unclosed and oddly closed pages, against a tree built by the stdlib parser."""

import html
import random
import time
from html.parser import HTMLParser

from threadlens.functions import html as H

SCHEMA = "page_id bigint, url string, html string"


class Tree(HTMLParser):
    """Nodes as [tag, children]; an end tag closes the nearest open element of its name."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.root = [None, []]
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in H.VOID_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1][1].append([tag, []])

    def handle_endtag(self, tag):
        names = [n[0] for n in self.open]
        if tag in names:
            del self.open[len(names) - 1 - names[::-1].index(tag):]

    def handle_data(self, data):
        self.open[-1][1].append(data)


def kept(node):
    for c in node[1]:
        if isinstance(c, str) or c[0] not in H.REMOVED_TAGS:
            yield c
            if not isinstance(c, str):
                yield from kept(c)


def main_text(page):
    root = Tree(page).root
    for tag in H.MAIN_TAGS:
        for node in kept(root):
            if node[0] == tag and not isinstance(node, str):
                return " ".join(" ".join(c for c in kept(node) if isinstance(c, str)).split())
    return None


def texts(spark, pages):
    df = spark.createDataFrame([(i, "http://h.org/", p) for i, p in enumerate(pages)], SCHEMA)
    return [r.text for r in H.extract_page(df).orderBy("page_id").collect()]


def random_page(rng):
    names = ["div", "p", "nav", "article", "main", "body", "header", "footer", "span", "br"]
    out = []
    for _ in range(rng.randrange(40)):
        n = rng.choice(names)
        out.append(rng.choice([f"<{n}>", f"<{n} a='>'>", f"</{n}>", f"</{n}>", f"<{n.upper()}>", f"<{n}/>", "<!-- <p> -->",
                               "<script>if (a<b) '</p>'</script>", "<style>nav</style>",
                               f"w{rng.randrange(99)} ", "&eacute;t&eacute; ", "&amp;lt; ", "&notit; ", "1 < 2 ", "&#233; "]))
    return "".join(out)


def test_random_pages_equal_the_tree(spark):
    rng = random.Random(5)
    pages = [random_page(rng) for _ in range(400)]
    for page, got in zip(pages, texts(spark, pages)):
        assert got == main_text(page), page


def test_nesting_and_marks(spark):
    pages = ["<article>a<article>b</article>c</article>d",
             "<nav>x<nav>y</nav>z</nav><main>m<header>h<header>i</header>j</header>n</main>",
             "<nav><article>menu</nav><article>real", "<div><main>a</div>b</main>", "<article/><main>m</main>",
             "<body>\ufdd0a\ufdd3b</body>", "<body></body>", "<p>none", "", None]
    assert texts(spark, pages) == ["a b c", "m n", "real", "a", "", "\ufffda\ufffdb", "", None, None, None]


def test_every_named_reference(spark):
    refs = ["&" + n for n in sorted(H.html5)] + ["&ampx;", "&notit;", "&nosuch;", "&amp;eacute;", "&", "&;", "a&copyb"]
    df = spark.createDataFrame([(r,) for r in refs], "r string")
    for r in df.select("r", H.decode_entities("r").alias("d")).collect():
        assert r.d == html.unescape(r.r), r.r


def test_long_awkward_pages(spark):
    pages = ["<body>" + "<div>x" * 20_000, "<body>" + "<nav>q<nav>r</nav>s</nav>t " * 20_000 + "</body>",
             "<body>" + "</b>y " * 50_000]
    begin = time.time()
    got = texts(spark, pages)
    assert time.time() - begin < 60
    assert [len(t.split()) for t in got] == [20_000, 20_000, 50_000]
