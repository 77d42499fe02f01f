import itertools
import random
import re
import time

import pytest

from fluxtrace.llm import html_extract as H
from fluxtrace.llm import url_filter as U
from fluxtrace.llm.workspace import Workspace

P = H.ExtractParams()


def text_of(page):
    return H.main_text(page, [0.0] * H.N_LOOKS, P)


def test_article_without_its_surroundings():
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies.</div>
    <article><header><h1>Head &amp; line</h1></header><p><b>Bold<br>start<p>Second &eacute;&#233;&nbsp;x   y<script>bad()</script> end<ul><li>one<li>two</ul>
    <div class="ad">Buy!</div><aside>Side</aside><form><p>Mail</p><input></form><p>Last.</p>
    <section id="comments"><p>First!</p></section></article><div class=sidebar><p>Links.</p></div><footer>&copy; me</footer>"""
    assert text_of(page) == "Head & line\nBold start\nSecond éé x y end\none\ntwo\nLast."


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<!-- x", "<script>alert(1)", "<div title='a>b", "</p></div>", "&amp;&#x110000;&bogus;"])
def test_odd_pages_do_not_fail(page):
    assert isinstance(text_of(page), str)


def test_deep_and_long_pages():
    assert text_of("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    assert text_of("<main>" + "<p>para.</p>" * 2000 + "</main>").count("para.") == 2000


def test_minimum_cut_is_minimal():
    rng = random.Random(7)
    for _ in range(150):
        n = rng.randint(1, 8)
        odds = [rng.choice([-3, -1, 0.5, 1, 2]) * rng.random() for _ in range(n)]
        edges = [(i, j, rng.random()) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def cost(labels):
            return sum(abs(x) for x, y in zip(odds, labels, strict=True) if (x > 0) != y) + sum(w for i, j, w in edges if labels[i] != labels[j])

        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert cost(H.minimum_cut(odds, edges)) == pytest.approx(best)


def test_blocks_between_sure_ones_follow_their_neighbours():
    assert H.minimum_cut([5, -0.5, 5, -5, 0.5, -5], [(i, i + 1, 1.0) for i in range(5)]) == [True, True, True, False, False, False]


def test_extract(spark):
    pages = spark.createDataFrame([(1, "u", "<article><p>a</p></article>", 3), (2, None, None, 4), (None, "v", "<nav>x</nav>", 5), (1, "u", "<article><p>a</p></article>", 3)], "page_id long, url string, html string, text int")
    rows = sorted(map(tuple, H.extract_text(pages).collect()), key=str)
    assert rows == sorted([(1, "u", "a", 1), (2, None, "", 0), (None, "v", "", 0), (1, "u", "a", 1)], key=str)
    assert H.extract_text(pages.limit(0)).count() == 0


def brute_verdict(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest)[0]
        path = re.split(r"[?#]", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fit = [(len(a + b), a + b, v) for a, b, v in U.RULES if (host == a or host.endswith("." + a)) and path.startswith(b)]
    rule = max(fit)[1:] if fit else (None, "block" if set(host.split(".")) & set(U.BLOCKED_NAMES) else "allow")
    return host, path, *rule


def test_urls_match_brute_force(spark):
    rng = random.Random(3)
    hosts = ["example.org", "Sub.EXAMPLE.org", "badexample.org", "org", "a.com", "com", "x.adult-x.net", "adult-xy.net", "spam-farm.example.org", "a..org", "", "org.", "user@x.com:80", "ÉX.com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/x", "/fr/a", "/de/", "/De/", "/de/?q=/fr/", "#/fr/"]
    urls = [f"{rng.choice(['http', 'https', ''])}://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?x=1", "#t")] + [None, "", "no scheme/de/", "http:///de/", "a://b://com/de/", "x\n://org/\n"]
    frame = spark.createDataFrame([(i, u, "k") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(frame).collect()}
    assert got == {i: brute_verdict(u) for i, u in enumerate(urls)}
    assert U.judge_urls(frame.limit(0)).count() == 0


def test_cascade_is_exact_and_deep(spark):
    listed = [f"k{i}" for i in range(0, 3000, 3)]
    table = lambda keys: spark.createDataFrame([(k,) for k in keys], "key string")
    rules = U.UrlRules(error=0.3)
    cascade = U.build_cascade(table(listed), table([f"k{i}" for i in range(3000)]), rules, Workspace(spark, "t"), "t")
    assert [cascade.has(f"k{i}") for i in range(3000)] == [i % 3 == 0 for i in range(3000)]
    assert len(cascade.levels) > 2
    with pytest.raises(ValueError):
        U.build_cascade(table(listed), table(listed), U.UrlRules(most_bytes=8), Workspace(spark, "t"), "t")


@pytest.mark.parametrize(
    ("inside", "text"),
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math>.</p>", "so x=2."),
        ("<xmp>if a < b: <b>&amp;</b></xmp><p>z", "if a < b: <b>&amp;</b>\nz"),
        ("<p>a<object data=x>other <b>text</b></object><canvas>drawn</canvas> z", "a other text drawn z"),
        ("<map name=m><p>map text</p></map><noscript><p>plain</p></noscript><video src=x>film</video>", "map text\nplain\nfilm"),
        ("<p>a<svg aria-hidden=true class=menu><path d=x></svg>b<p>c", "a b\nc"),
        ("<p>a<svg><title>t</title><text>label</text></svg>b", "a label b"),
    ],
)
def test_embedded_text_is_read(inside, text):
    assert text_of(f"<article>{inside}</article>") == text


@pytest.mark.parametrize("tag", sorted(H.EMBEDDED))
def test_unclosed_embedded_elements_leave_the_page(tag):
    assert text_of(f"<article><p>a</p><{tag} aria-hidden=true><p>b</p><p>c</p></article>") == "a\nb\nc"


def test_training_reads_whole_pages(spark):
    page = "<article>" + "<p>A long sentence, and more.</p>" * 450 + "</article><footer>" + "<p><a href=x>Link</a></p>" * 30 + "</footer>"
    weights = H.train_looks(spark.createDataFrame([(1, page)], "page_id long, html string"), P, "page_id", "html")
    assert weights[1] < 0


#: Weights as a fit gives them: links and separators speak against a block, length and a full stop for it.
WEIGHTS = [0.0, -2.2, 1.0, 0.9, -0.1, -1.0]
P1, P2 = "<p>The first paragraph, which says something.</p>", "<p>The last one, which says more than that.</p>"
T1, T2 = "The first paragraph, which says something.", "The last one, which says more than that."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<nav><a href=x>Menu</a></nav><article>{P1}<p class='related-work'>Prior studies, and more.</p>{P2}</article>", f"{T1}\nPrior studies, and more.\n{T2}"),
        (f"<article>{P1}<section id='search-methods'><p>We searched.</p></section>{P2}</article>", f"{T1}\nWe searched.\n{T2}"),
        (f"<article>{P1}<div class='side-by-side'>Two figures.</div>{P2}</article>", f"{T1}\nTwo figures.\n{T2}"),
        (f"<article><h2 id='notice-period'>Notice period</h2>{P1}</article>", f"Notice period\n{T1}"),
        (f"<article>{P1}<p><code class='text-reply'>x = 1</code></p>{P2}</article>", f"{T1}\nx = 1\n{T2}"),
        (f"<article>{P1}<div class='cookie-notice'>We use cookies, as all do.</div>{P2}</article>", f"{T1}\n{T2}"),
        (f"<article>{P1}<div class='ad-banner'><p>Buy our things, they are good.</p></div>{P2}</article>", f"{T1}\n{T2}"),
        (f"<article>{P1}<section id=comments><p>I think so too, and thanks.</p><p>Me too.</p></section></article>", T1),
        (f"<main>{P1}<div hidden>Not shown.</div><p style='display: none'>Nor this.</p></main>", T1),
        (f"<body><div>{T1}</div><div>{T2}</div></body>", f"{T1}\n{T2}"),
        ("<body><table><tr><td>cell one<td>cell two</table><ul><li>item<li>other item</ul></body>", "cell one\ncell two\nitem\nother item"),
        (f"<body><ul><li><a href=a>Home</a><li><a href=b>About us</a></ul><div>{T1}</div></body>", T1),
        (f"<header>Site</header><div class='content'>{P1}{P2}</div><footer>Imprint</footer>", f"{T1}\n{T2}"),
        (f"<div role=main>{P1}</div><div role=complementary>{P2}</div>", T1),
        (f"<div class='sidebar'>{P2}</div><article>{P1}</article><div class='share-buttons'><a href=s>Share</a></div>", T1),
        (f"<article><header><h1>Title</h1><p class=byline>By me.</p></header>{P1}</article>", f"Title\nBy me.\n{T1}"),
        (f"<body class='search form'>{P1}</body>", T1),
        (f"<article>{P1}<blockquote>Quoted words.</blockquote><pre>a  b\n c</pre></article>", f"{T1}\nQuoted words.\na b c"),
        (f"<article>{P1}<figure><img><figcaption>A figure.</figcaption></figure><aside>Aside.</aside></article>", f"{T1}\nA figure."),
        (f"<form><p>Your name</p></form><article>{P1}<button>Send</button></article>", T1),
    ],
)
def test_varied_pages(page, text):
    assert H.main_text(page, WEIGHTS, P) == text


def test_neighbours_move_what_part_of_a_name_says():
    page = f"<article>{P1}<p class='promo-code'>Ten | two</p>{P2}</article>"
    odds, edges = H.costs(H.blocks_of(page), WEIGHTS, H.ExtractParams(in_article=1.0, next_block=2.0))
    assert odds[1] < 0 and H.minimum_cut(odds, edges) == [True, True, True]
    alone = H.costs(H.blocks_of(page.replace("promo-code", "promo")), WEIGHTS, P)
    assert H.minimum_cut(*alone) == [True, False, True]


def test_labels_of_pages_are_of_least_cost():
    rng = random.Random(2)
    for _ in range(60):
        parts = [rng.choice([P1, "<p class='promo-box'>x | y</p>", "<div class=ad>z</div>", "<li><a href=x>a</a>", "<h2>Head</h2>", "<td>cell"]) for _ in range(rng.randint(1, 7))]
        page = "".join(parts)
        odds, edges = H.costs(H.blocks_of(rng.choice(["{}", "<article>{}</article>", "<div class=content>{}</div>"]).format(page)), WEIGHTS, P)

        def cost(labels, odds=odds, edges=edges):
            return sum(abs(x) for x, y in zip(odds, labels, strict=True) if (x > 0) != y) + sum(w for i, j, w in edges if labels[i] != labels[j])

        assert cost(H.minimum_cut(odds, edges)) == pytest.approx(min(map(cost, itertools.product([False, True], repeat=len(odds)))))


@pytest.mark.parametrize("piece", ["<a ", "<a '>", '<a ">" ', "<ul>x", "<div>x", "</section>", "<!-- ", "<b>x", "<svg><p>"])
def test_time_grows_with_the_page(piece):
    def seconds(n):
        start = time.process_time()
        H.main_text(piece * n, WEIGHTS, P)
        return time.process_time() - start

    seconds(1000)
    assert seconds(40_000) < 12 * max(seconds(10_000), 0.05)


def test_training_takes_one_page_an_id_and_no_null_id(spark):
    good = "<article><p>A long sentence, and more.</p></article><footer><a href=x>Link</a></footer>"
    pages = spark.createDataFrame([(1, good), (1, good), (None, "<article>" + "x " * 50 + "</article>"), (2, None)], "page_id long, html string")
    assert H.train_looks(pages, P, "page_id", "html").tolist() == pytest.approx(H.train_looks(pages.where("page_id = 1").limit(1), P, "page_id", "html").tolist())


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><form id="aspnetForm"><nav>menu</nav><article><h1>Title</h1><p>Some prose, long enough.</p></article><footer>f</footer></form></body>', "Title\nSome prose, long enough."),
        ("<body><form action=x><input><div><article><p>Prose after an unclosed form.</p></article></div></body>", "Prose after an unclosed form."),
        ('<div class="overlay"><article><p>In an overlay.</p></article></div>', "In an overlay."),
        ("<dialog open><main><p>A page in a dialog, whole.</p></main></dialog>", "A page in a dialog, whole."),
        ('<article><h2 id="notice">Notice</h2><p>Words of it.</p></article>', "Notice\nWords of it."),
        ('<article><p>First.</p><p>Choose <select><option>one</select> or not.</p><p>Third one.</p></article>', "First.\nChoose or not.\nThird one."),
        ("<article><p>First.</p><datalist><p>Second para.</p><p>Third one.</p></article>", "First.\nSecond para.\nThird one."),
        ('<article><p>Own text.</p></article><div class="comments"><article><p>A comment.</p></article></div><aside><article>Related.</article></aside><form><article class="ad">Buy.</article></form>', "Own text."),
        ("<article><p>Own text.</p><form><p>Subscribe now.</p></form></article><form><nav><article>Menu.</article></nav></form>", "Own text."),
    ],
)
def test_articles_inside_what_stands_around_pages(page, text):
    """Forms, dialogs and overlays may hold a page; what they hold besides an article stays boilerplate."""
    assert H.main_text(page, WEIGHTS, P) == text
