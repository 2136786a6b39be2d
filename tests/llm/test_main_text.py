"""The content region: the scan against all regions, pages that only the scan can settle, and awkward markup."""

import itertools
import random
import time
from collections import defaultdict

import pytest

from eventflow.llm import html

BODY = "<p>some words of an article that goes on for a while here</p>" * 3
TEXT = "\n".join(["some words of an article that goes on for a while here"] * 3)
LABELLED = [f"<body><nav><a>Home</a></nav><div class=ad>buy now</div><article><h1>A title</h1>{BODY}</article><div>about us</div><footer>the end</footer></body>"] * 20


@pytest.fixture(scope="module")
def weights():
    total = defaultdict(int)
    for source in LABELLED:
        for key, n in html.page_counts(html.read_page(source)).items():
            total[key] += n
    return html.Weights(total)


def whole(score):
    return 0, len(score)


def test_scan_against_all_regions():
    rng = random.Random(3)
    for _ in range(300):
        score = [rng.choice([-2.0, -1.0, -0.5, 0.0, 0.25, 1.0, 1.5]) for _ in range(rng.randint(0, 14))]
        every = {(i, j): sum(score[i:j]) for i, j in itertools.combinations(range(len(score) + 1), 2)}
        i, j = html.best_region(score)
        assert sum(score[i:j]) == max([0.0, *every.values()])
        assert (i, j) == (0, 0) or all(sum(score[i:k]) > 0 for k in range(i + 1, j + 1))


def test_weights(weights):
    assert all(w < 0 for w in weights.tags.values())
    assert weights.words[0, 0, 0, 0] > weights.words[1, 0, 0, 0] > weights.words[2, 0, 0, 0]
    assert weights.words[1, 1, 2, 0] > 0 > weights.words[3, 3, 0, 2]


def test_what_is_said_around_an_article_does_not_silence_it(weights):
    for source in (
        f"<div class='layout has-sidebar'><article>{BODY}</article></div>",
        f"<div id='page' class='no-header site'><main>{BODY}</main></div>",
        f"<div class='sidebar'><article>{BODY}</article></div>",
        f"<div class='more-content'>{BODY}</div>",
        f"<svg><path d='x'><article>{BODY}</article>",
        f"<object><param><div>{BODY}</div>",
        f"<textarea><article>{BODY}</article>",
        f"<main><section>{BODY}</section></main>",
        f"<p>{'</i>' * 30}<article>{BODY}</article>",
    ):
        assert html.main_text(source, weights) == TEXT, source


def test_short_paragraphs_and_two_articles(weights):
    short = [f"Short paragraph number {i} here." for i in range(20)]
    assert html.main_text("".join(f"<div>{s}</div>" for s in short), weights) == "\n".join(short)
    two = html.main_text(f"<article>{BODY}</article><div>{'in between ' * 40}</div><article><p>and a second article of some length</p></article>", weights)
    assert two == f"{TEXT}\nand a second article of some length"


SCANNED = f"<div><a>Home</a> <a>News</a> <a>Sport</a></div><div><a>One more</a></div><h1>A title of this page</h1>{BODY}<div><a>Privacy</a> | <a>Terms</a></div><div><a>About us</a></div>"


def test_the_scan_decides_where_nothing_is_named(weights):
    assert html.main_text(SCANNED, weights) == f"A title of this page\n{TEXT}"
    assert html.main_text(SCANNED, weights, whole) != html.main_text(SCANNED, weights)


def test_boilerplate_of_all_kinds(weights):
    source = f"""<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>"<p>no</p>"</script></head><body class="has-sidebar">
    <header><h1>Site name</h1></header><div id="top-nav"><ul><li><a>Home</a><li><a>About</a></ul></div><div role="alert">A notice to all readers of this site.</div>
    <div class="wrapper"><div class="post"><h2>The title</h2><p>First paragraph of the text, with <a>a link</a> in it.</p><div class="ad-container">Buy cheap things now, today only, here.</div>
    <p>Second paragraph of the text &amp; more.</p><form><label>Your mail</label><input><button>Send</button></form><div hidden>unseen</div><noscript>turn it on</noscript></div>
    <div id="comments"><h3>Two comments</h3><article class="comment"><p>I liked this very much, it was a good and long read indeed.</p></article></div></div>
    <aside><p>Popular posts of this month, as chosen by our readers all over the world.</p></aside><div class="cookie-banner">We use cookies to make this site better for you.</div><footer>&copy; us</footer></body></html>"""
    assert html.main_text(source, weights) == "The title\nFirst paragraph of the text, with a link in it.\nSecond paragraph of the text & more."


def test_names():
    chrome = "sidebar left-sidebar sidebar_content ad ad-slot navMenu site-footer newsletter-signup share-buttons related-posts widget-area main-nav page-header".split()
    content = "article post-content entry_body mainContent more-content story".split()
    neither = "has-sidebar no-header layout wrapper with-ads download shadow loading adapt header-free".split()
    assert {html.own_words(f' class="{n}"') for n in chrome} == {html.SAYS_CHROME}
    assert {html.own_words(f" id='{n}'") for n in content} == {html.SAYS_CONTENT}
    assert {html.own_words(f" class={n}") for n in neither} == {html.NOTHING}
    assert html.own_words(' class="comments-area"') == html.own_words(' id="article-comments"') == html.SAYS_COMMENTS


@pytest.mark.parametrize("page", ["<div><span>" * 100_000 + "x", "<b>" * 80_000 + "</i></p>" * 80_000, "<li>a" * 200_000, "<a '" * 200_000, "<textarea>" * 100_000, "<!-- " * 200_000, "<" * 500_000, "&" * 500_000, "<svg><p>" * 60_000])
def test_long_pages_take_linear_time(weights, page):
    began = time.perf_counter()
    html.main_text(page, weights)
    assert time.perf_counter() - began < 20


def test_repeated_and_odd_rows(spark):
    rows = [(1, "u", LABELLED[0], 7)] * 3 + [(None, None, None, 7), (2, "v", "", None), (3, "w", "no tag at all but words", 1)]
    got = html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, `__html` int"), ("page_id", "url", "__html")).collect()
    want = [(1, f"A title\n{TEXT}", 7)] * 3 + [(0, "", 7), (2, "", None), (3, "no tag at all but words", 1)]
    assert sorted(map(str, ((r.page_id or 0, r.text, r["__html"]) for r in got))) == sorted(map(str, want))
    assert all(r.n_chars == len(r.text) for r in got)
    with pytest.raises(ValueError):
        html.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), ("page_id", "text"))
