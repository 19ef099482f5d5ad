import random
import time

import pytest

from evidentia.llm.html_text import Page, extract_text, main_text

ARTICLE = "<h1>Title &amp; more</h1><p>First, a paragraph, with commas, that is long enough to count.</p><p>Second&nbsp;one\n  with   space<br>and a break.</p><p>Ti.</p>"
LINES = "Title & more\nFirst, a paragraph, with commas, that is long enough to count.\nSecond one with space and a break.\nTi."
LONG = "Words, words, words, and again words, that go on, and on, for quite a while, as adverts and comments do. " * 4


def test_keeps_the_article_alone():
    around = f"<nav><a href=/>Home</a></nav><header><h2>{LONG}</h2></header><div class='ad'>{LONG}</div><div id='sidebar'><p>{LONG}</p></div><form><p>{LONG}</p></form><script>var t='</p>';if(a<b){{}}</script><style>p{{}}</style><!-- <p>{LONG}</p> -->"
    after = f"<section class='comments'><article><p>{LONG}</p></article></section><div class='cookie-notice'><p>{LONG}</p></div><footer>&copy; {LONG}</footer>"
    for wrap in ("<article>{}</article>", "<main><div>{}</div></main>", "<div class='post-content has-sidebar'>{}</div>", "<div><div id=content>{}</div></div>"):
        assert main_text(f"<html><head><title>T</title></head><body>{around}{wrap.format(ARTICLE)}{after}</body></html>") == LINES


def test_unclosed_and_cut_pages():
    assert main_text("<article><h1>T</h1><p><b>One, two, three, four, five, six.<br><p>Next one") == "T\nOne, two, three, four, five, six.\nNext one"
    assert main_text("<ul><li>a<li>b</ul>text, with, commas, and enough letters") == "a\nb\ntext, with, commas, and enough letters"
    assert main_text("<table><tr><td>x<td>y<tr><td>z</table>") == "x\ny\nz"
    assert main_text("<p>&#233; &lt;b&gt; &unknown; &amp;amp; é</p>") == "é <b> &unknown; &amp; é"
    assert main_text("a < b <3 c <") == "a < b <3 c <"
    for empty in (None, "", "   ", "<p>", "<html><body><script>x</script>"):
        assert main_text(empty) == ""


def test_short_pages_fall_back():
    assert main_text("<body><nav>menu</nav><article>Short.</article><div class=ad>A much longer advert, with commas, and words.</div></body>") == "Short."
    assert main_text("just text") == "just text"


def test_depth_and_length_take_linear_time():
    begin = time.process_time()
    assert main_text("<div>" * 30_000 + "deep" + "</div>" * 30_000) == "deep"
    assert len(main_text("<b>x" * 30_000)) == 30_000
    assert main_text("<" * 50_000).count("<") == 50_000
    assert len(main_text("<p>some words, more words, and the like of words</p>" * 20_000).split("\n")) == 20_000
    assert time.process_time() - begin < 30


def test_query_columns(spark):
    rows = [(1, "u", "<article><p>Hi &#x1F600; there</p></article>"), (1, "u", "<article><p>Hi &#x1F600; there</p></article>"), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = sorted(map(tuple, extract_text(pages).collect()), key=str)
    assert got == [(1, "u", "Hi \U0001f600 there", 10)] * 2 + [(None, None, "", 0)]
    assert extract_text(pages.limit(0)).count() == 0


def test_wrappers_with_unwanted_names_keep_the_article():
    after = f"<section class='comments'><article><p>{LONG}</p></article></section><div id='sidebar'><p>{LONG}</p></div>"
    for name in ("class='content-sidebar-wrap'", "class='page-with-sidebar'", "id='site-header-fixed'", "class='overflow-hidden'"):
        for inner in ("<article>{}</article>", "<div id=content>{}</div>"):
            page = inner.format(ARTICLE)
            assert main_text(f"<body><div {name}>{page}</div></body>") == LINES
            if "article" in inner:
                assert main_text(f"<body><div {name}>{page}{after}</div></body>") == LINES
    assert main_text(f"<body><form id=aspnetForm><div class='site-header-fixed'><main>{ARTICLE}</main></div></form></body>") == LINES
    assert main_text(f"<body><div>{ARTICLE}</div>{after}</body>") == LINES
    begin = time.process_time()
    assert main_text("<div class=sidebar>" * 30_000 + LONG + "</div>" * 30_000) == LONG.strip()
    assert time.process_time() - begin < 10


LAYOUTS = (
    "<div class='content sidebar-right'>{}</div>", "<div class='layout-sidebar'>{}</div>", "<div class='content-with-sidebar'>{}</div>",
    "<div class='site sidebar-left'><article>{}</article></div>", "<div class='article-body search-results-page'>{}</div>",
    "<form id='aspnetForm'>{}</form>", "<article><section id='copyright-law'>{}</section></article>", "<main><div class='layout-sidebar'>{}</div></main>",
    "<main><div class='page-with-sidebar'><article>{}</article></div></main>", "<div id=content><div class='notice-text'>{}</div></div>",
)


def test_layouts_keep_the_article():
    paragraphs = [LONG.strip() + f" {k}." for k in range(3)]
    inner = "".join(f"<p>{x}</p>" for x in paragraphs)
    for layout in LAYOUTS:
        assert main_text(f"<body>{layout.format(inner)}</body>") == "\n".join(paragraphs), layout
        page = f"<body><nav><p>{LONG}</p></nav>{layout.format(inner)}<div class=ad><p>{LONG}</p></div><footer>{LONG}</footer></body>"
        assert main_text(page) == "\n".join(paragraphs), layout
    for apart in ("comments", "ad", "newsletter", "related", "cookie-bar", "sidebar"):
        page = f"<article>{inner}<div class='{apart}'><p>{LONG}</p><p>{LONG}</p></div></article>"
        assert main_text(page) == "\n".join(paragraphs), apart


def test_of_equal_containers_the_first_counts():
    one = "<div><p>Words, words, and more words of one text, that are long.</p></div>"
    page = f"<body><div>{one}</div><div>{one.replace('one', 'two')}</div></body>"
    assert Page(page).kept()[0] == min(k for k in range(len(Page(page).tag)) if Page(page).tag[k] == "p") - 1


def plain_container(tree):
    """The place of the element that the rules of scoring choose, computed from each paragraph up to all its ancestors.

    A tree is (tag, class, parts), a part a tree or a text; places are tuples of child numbers.
    """
    points, total, linked, named = {}, {}, {}, {}

    def walk(node, at, above, inside):
        tag, name, parts = node
        named[at] = name
        flat = [q for p in parts for q in (p[2] if not isinstance(p, str) and p[0] == "a" else [p])]
        own = [p for p in flat if isinstance(p, str)]  # a link's text is its block's
        length, commas = sum(len(p) for p in own), sum(p.count(",") for p in own)
        direct = sum(len(p) for p in parts if isinstance(p, str))
        for place in [at, *above]:
            total[place] = total.get(place, 0) + direct
            linked[place] = linked.get(place, 0) + direct * inside
        if tag in ("p", "div") and length >= 25:
            worth = 1 + commas + min(length / 100, 3)
            if tag == "div":
                points[at] = points.get(at, 0) + worth
            for step, place in enumerate(above):
                points[place] = points.get(place, 0) + worth / 2**step
        for k, part in enumerate(parts):
            if not isinstance(part, str):
                walk(part, (*at, k), [at, *above], inside or part[0] == "a")

    walk(tree, (), [], False)
    score = lambda at: (points.get(at, 0) + (25 if named[at] and points.get(at, 0) else 0)) * (1 - (linked[at] / total[at] if total[at] else 0))
    return score, points


def test_the_best_container_equals_a_plain_scorer():
    rng = random.Random(4)
    for _ in range(200):
        mark = iter(range(1000))
        text = lambda n: " ".join(f"w{next(mark)}" + "," * (rng.random() < 0.2) for _ in range(n))  # noqa: E731, B023

        def tree(depth):
            parts = []
            for _ in range(rng.randint(1, 4)):
                kind = rng.random()
                if kind < 0.45 or not depth:
                    parts.append(("p", "", [text(rng.randint(1, 30))]))
                elif kind < 0.55:
                    parts.append(("div", "", [("a", "", [text(rng.randint(5, 20))])]))
                else:
                    parts.append(tree(depth - 1))
            return ("div", rng.choice(["", "", "", "story"]), parts)

        made = ("body", "", [tree(3), tree(2)])
        render = lambda t: t if isinstance(t, str) else f"<{t[0]}{' class=' + t[1] if t[1] else ''}>" + "".join(map(render, t[2])) + f"</{t[0]}>"
        score, points = plain_container(made)
        page = Page(render(made))
        best, _ = page.kept()
        # the element's place, read off the tree
        path, node = [], best
        while page.tag[node] != "body":
            above = page.parent[node]
            path.append([k for k in range(1, len(page.tag)) if page.parent[k] == above].index(node))
            node = above
        if not points:
            continue
        top = max(map(score, points))
        assert abs(score(tuple(reversed(path))) - top) < 1e-9


LONG = "This is a long paragraph of an article, with commas, and many words, so that it is found as the text of the page. " * 3


@pytest.mark.parametrize(("part", "told"), [
    ('<p>We looked for the word <span class="search-term">penguin</span> in the sea.</p>', "We looked for the word penguin in the sea."),
    ('<pre><code>x = 1 <span class="hljs-comment"># note</span></code></pre>', "x = 1 # note"),
    ('<h2 id="related-work">Related work</h2>', "Related work"), ('<h2 id="search">Search</h2>', "Search"), ('<h2 id="comments-on-the-law">Comments</h2>', "Comments"),
    ('<p class="search-demo">demo words</p>', "demo words"), ('<p class="advert">buy this</p>', None), ("<p>So <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds.</p>", "So a=b holds."),
    ('<section id="copyright-law"><p>Of rights.</p></section>', "Of rights."), ('<section id="related-work"><p>Of others.</p></section>', "Of others."),
    ('<section id="comments"><p>A reader says this.</p></section>', None), ('<section class="related"><p>See also.</p></section>', None),
])
def test_names_inside_an_article(part, told):
    got = main_text(f"<html><body><article><p>{LONG}</p>{part}<p>{LONG}</p></article></body></html>").split("\n")
    assert got == [LONG.strip(), *([told] if told else []), LONG.strip()]
