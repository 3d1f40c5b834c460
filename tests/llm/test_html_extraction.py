"""Main texts against an independent reading of the pages' own markup, and on pages without it."""

import html
import random
import re
import time
from collections import Counter

import numpy as np

from routeforge.llm import dom, html_extraction, queries

BOILER = ("Home News Contact", "Buy now, big sale!", "Copyright of all.", "We use cookies. Accept.", "Nice article, said a reader.", "Enter your name")


def brute(page):
    """The article of the test tables' pages by pattern: all text between its tags, blocks at tags other than b."""
    if not page:
        return ""
    body = re.search(r"<article>(.*)</article>", page, re.S)
    if not body:
        return ""
    text = re.sub(r"</?b>", "", body[1])
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", text)).split())


def test_query(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = queries.QUERIES["op10_html_extraction"](spark, folder).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == brute(pages[r.page_id].html)
        assert r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def variant(article, outer="div", attrs=' class="wrap"'):
    nav, ad, foot, cookie, comment, form = BOILER
    return (
        f"<html><head><title>T</title><style>p{{}}</style></head><body><header><h2>Site name</h2></header><nav><ul>"
        + "".join(f"<li><a href='#'>{w}</a></li>" for w in nav.split())
        + f"</ul></nav><div class='cookie-notice'>{cookie}</div><{outer}{attrs}>{article}</{outer}><aside class='sidebar'><a href=x>{ad}</a></aside>"
        f"<div id='comments'><p>{comment}</p></div><form><label>{form}</label><input></form><footer>{foot}</footer><script>var a='<p>x</p>'</script></body></html>"
    )


PARAGRAPHS = ["The first sentence stands here, and it is long enough to be read &amp; kept. " * 3, "A second one follows it, with a comma or two, and then it ends. " * 4, "Short one."]
ARTICLE = "<h1>Title here</h1>" + "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
TEXT = " ".join(("Title here " + " ".join(html.unescape(p) for p in PARAGRAPHS)).split())


def test_pages_without_explicit_markup(spark):
    """Trees learned from the test tables leave boilerplate out of other layouts."""
    trees = html_extraction.learn_trees(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    rows = [
        (1, "u", variant(ARTICLE, "article", "")), (2, "u", variant(ARTICLE, "main", ' role="main"')),
        (3, "u", variant(ARTICLE, "div", ' class="post-content"')),
        (4, "u", variant(ARTICLE + "<aside>Related: more</aside><div class='advert'>Buy!</div>", "article", "")),
    ]
    got = {r.page_id: r.text for r in html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), trees).collect()}
    assert got[1] == got[2] == got[4] == TEXT
    assert "The first sentence" in got[3] and "second one" in got[3]
    for text in got.values():
        assert not any(b in text for b in BOILER)


def test_main_texts_inside_misleading_markup(spark):
    """A head without its end tag, and words or forms around the article, don't take it away."""
    trees = html_extraction.learn_trees(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    page = variant(ARTICLE, "article", "")
    wide = page.replace("<body>", "<body><form id='aspnet'>").replace("</body>", "</form></body>")
    share = variant(f"<article>{ARTICLE}</article>", "div", " class='share related'")
    htmls = [
        page.replace("</head>", ""), page.replace("</head><body>", ""), page.replace("<body>", "<body class='has-sidebar ad'>"), wide, share,
        page.replace("<article>", "<article class='with-sidebar'>"), page.replace("<html>", "<html class='cookie'>"),
    ]
    rows = [(k, "u", h) for k, h in enumerate(htmls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract(pages, trees).collect()}
    assert [k for k in got if got[k] != TEXT] == []


def test_asides_and_labels():
    def labelled(html):
        page = dom.Page(html)
        x, _ = dom.features(page)
        return dom.main_text(page, dom.explicit_labels(x) == 1)

    page = variant(ARTICLE, "article", "")
    for html in (page, page.replace("<body>", "<body class='has-sidebar'>"), page.replace("</head>", "")):
        assert labelled(html) == TEXT
    many = f"<div id='comments'>{'<p>A reader says so, and more.</p>' * 60}</div><aside><article>Card</article></aside>"
    assert labelled(page.replace("<aside", many + "<aside")) == TEXT
    everything = dom.Page("<head><title>t</title><p>a")
    assert dom.main_text(everything, np.ones(len(everything.tags), bool)) == "a"
    words = dom.Page("<head><style>p{}</style>a <b>b</b>")
    assert dom.main_text(words, np.ones(len(words.tags), bool)) == "a b"


def test_parser_mends_and_decodes():
    page = dom.Page("<p>a<b>b<p>c &lt;&eacute;&#x41; <br>d<ul><li>e<li>f</ul><script>if(a<b){}</script>g</x>h<!-- no -->i<td>j")
    everything = np.ones(len(page.tags), bool)
    assert dom.main_text(page, everything) == "ab c <éA d e f g hi j"
    deep = dom.Page("<div>" * 3000 + "x")
    assert dom.main_text(deep, np.ones(len(deep.tags), bool)) == "x"
    assert dom._words([("class", "mainContent side-bar_2 x"), ("href", "nav")]) == {"main", "content", "side", "bar", "x"}


def test_decoding_is_consistent_and_best():
    rng = np.random.default_rng(1)
    for _ in range(50):
        n = 7
        parents = [-1] + [int(rng.integers(0, k)) for k in range(1, n)]
        scores = rng.normal(size=n)
        chosen = dom.decode(parents, scores)
        best = None
        for states in np.ndindex(*([3] * n)):
            if states[0] == 2 or any((states[parents[k]], states[k]) in ((0, 2), (1, 0), (2, 0), (2, 1)) for k in range(1, n)):
                continue
            value = sum(s if t == 1 else -s for s, t in zip(scores, states))
            best = value if best is None else max(best, value)
        assert np.isclose(sum(s if c else -s for s, c in zip(scores, chosen)), best)


def test_trees_equal_spark(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    elements = html_extraction.training_elements(pages, 50)
    table = VectorAssembler(inputCols=list(dom.FEATURES), outputCol="features").transform(elements).cache()
    model = GBTClassifier(maxIter=4, maxDepth=3, seed=1).fit(table)
    rows = model.transform(table).select("rawPrediction", *dom.FEATURES).toPandas()
    mine = html_extraction.Trees.of(model).log_odds(rows[list(dom.FEATURES)].to_numpy())
    assert np.allclose(mine, 2 * rows["rawPrediction"].map(lambda v: v[1]))
    table.unpersist()


def test_edges(spark):
    rows = [(1, "u", None, "t"), (1, "u", "", "t"), (None, None, "plain words", "t"), (2, "u", "<p>a</p>" * 3000, "t"), (2, "u", "<p>a</p>" * 3000, "t"), (3, "u", "<", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_extraction.main_texts(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 11), (1, 0), (1, 0), (2, 5999), (2, 5999), (3, 1)]
    assert html_extraction.main_texts(pages.limit(0)).count() == 0


def test_pages_stripped_of_their_article(spark):
    """The test tables' pages with their article turned into a plain element, in all layouts of the end of head and body."""
    source = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    trees = html_extraction.learn_trees(source)
    pages = {r.page_id: r.html for r in source.collect()}
    plain = [(k, "u", h.replace("<article>", "<div>").replace("</article>", "</div>")) for k, h in pages.items()]
    frame = spark.createDataFrame(plain, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extraction.extract(frame, trees).collect()}
    words, kept, extra = 0, 0, 0
    for k, h in pages.items():
        expected, found = brute(h).split(), got[k].split()
        words += len(expected)
        common = sum((Counter(expected) & Counter(found)).values())
        kept += common
        extra += len(found) - common
    assert kept > 0.97 * words and extra < 0.03 * words, (kept / words, extra / words)


def test_no_page_ends_the_job(spark):
    malformed = [
        "a<![endif-->b", "a<![foo[..]]>b", "a<![ >b", "a<![CDATA[x]]>b", "<!b", "<![", "<!--", "</", "<a <b <c", "<p a='x", "&#" + "9" * 5000 + ";x",
        "<script>a", "<title>a", "\x00<p>İ</p>", "<div>" * 20000 + "deep",
    ]
    rows = [(k, "u", h) for k, h in enumerate(malformed)]
    got = html_extraction.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.page_id for r in got) == list(range(len(malformed)))
    texts = {r.page_id: r.text for r in got}
    assert [texts[k] for k in (0, 1, 2, 3)] == ["ab"] * 4 and texts[10] == "\ufffdx" and texts[14] == "deep"
    rng = random.Random(5)
    parts = ["<", "<!", "<![", "]]>", "-->", "<!--", "<p>", "</p>", "<b>", "<svg>", "</svg>", "<button>", "text ", "&amp", "&#x", "<script>", "</script>", "<a href='", '"', ">", "/>", "<?", "<li>", "</"]
    for _ in range(3000):
        page = dom.Page("".join(rng.choice(parts) for _ in range(rng.randint(1, 30))))
        dom.features(page)


def test_texts_in_open_elements_and_formulas():
    def text(html):
        page = dom.Page(html)
        return dom.main_text(page, np.ones(len(page.tags), bool))

    assert text("<p>E = <math><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup></math> ok") == "E = mc2 ok"
    assert text("<math><semantics><mi>x</mi><annotation>\\\\x</annotation></semantics></math>") == "x"
    assert text("<div><p>a<svg><path><p>b</p>c</div>d") == "a b c d"
    assert text("<div><button>x<p>b</p></div>d") == "b d"
    assert text("<div><button>x<p>b</p></button>d</div>") == "d"
    assert text("<svg><text>no</text></svg>yes") == "yes"
    assert text("<textarea><p>no</textarea>yes<!-- no --!> no -->.") == "yes."


def test_a_megabyte_of_anything_takes_seconds():
    pages = [
        "<b>" * 80_000 + "<p>x</p>" * 80_000, "<div>" * 30_000 + "</span>" * 100_000, "<ul>" + "<div>" * 30_000 + "<li>a</li>" * 50_000, "<!--" * 250_000,
        "<![x" * 250_000, "<" * 1_000_000, "&" * 1_000_000, "<a " + "x='" * 300_000, '<a x="' * 150_000, "</" * 400_000, "<script></" * 100_000,
        "<table><tr><td>" * 60_000, "<svg><p>x" * 80_000, "&#" + "0" * 1_000_000 + "65;",
    ]
    for html in pages:
        started = time.process_time()
        page = dom.Page(html)
        x, _ = dom.features(page)
        dom.main_text(page, dom.explicit_labels(x) == 1)
        assert time.process_time() - started < 15, html[:40]


def test_sample_depends_on_pages_alone(spark):
    source = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    twice = source.repartition(9, "url").unionByName(source)
    one = html_extraction.training_elements(source, 10)
    other = html_extraction.training_elements(twice, 10)
    assert one.count() > 100 and one.exceptAll(other).count() == 0 and other.exceptAll(one).count() == 0


def test_planted_asides_are_labelled_out():
    page = variant(ARTICLE, "article", "")
    seen = set()
    for number in range(60):
        more = dom.with_asides(page, number)
        tree = dom.Page(more)
        x, _ = dom.features(tree)
        assert len(more) > len(page) and dom.main_text(tree, dom.explicit_labels(x) == 1) == TEXT
        seen |= {(t, *sorted(w)) for t, w in zip(tree.tags, tree.words, strict=True)}
    assert {("div", "advert"), ("nav",), ("div", "newsletter")} <= seen
    assert dom.with_asides("<article>no paragraph</article>", 3) == "<article>no paragraph</article>"
