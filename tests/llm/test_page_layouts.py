"""Whole page layouts and what is left of them."""

import pytest

from voxmill.llm import html

LONG = "The council met on Tuesday and spoke for a long time about the new bridge over the river, its cost, and the people who will use it every day. "
NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
FOOT = "<footer>Copyright 2024, all rights reserved</footer>"
PAGE = "<html><body>{}</body></html>"
P1, P2 = f"<p>{LONG * 2}</p>", f"<p>Second. {LONG}</p>"
T1, T2 = (LONG * 2).strip(), f"Second. {LONG}".strip()
CASES = {
    "form around the page": (f'<form method="post">{NAV}<div><h1>The new bridge</h1>{P1}{P2}</div>{FOOT}</form>', ["The new bridge", T1, T2]),
    "form around an article": (f"<form>{NAV}<article><h1>The new bridge</h1>{P1}</article>{FOOT}</form>", ["The new bridge", T1]),
    "search form": (f'{NAV}<form action="/s">Search this site for <input name="q"></form><div><h1>The new bridge</h1>{P1}{P2}</div>', ["The new bridge", T1, T2]),
    "form in the article": (f"<article><h1>The new bridge</h1>{P1}<form>Leave your mail address here</form></article>", ["The new bridge", T1]),
    "marked article": (f'{NAV}<article class="post newsletter"><h1>The new bridge</h1>{P1}</article>{FOOT}', ["The new bridge", T1]),
    "marked teaser": (f'<article><h1>The new bridge</h1>{P1}{P2}</article><article class="promo"><p>Buy one of our pens today.</p></article>', ["The new bridge", T1, T2]),
    "teasers after main": (f"{NAV}<main><h1>The new bridge</h1>{P1}{P2}</main><article><h2>More rain</h2><p>It will rain again this week.</p></article><article><h2>A new school</h2><p>The school opens soon.</p></article>", ["The new bridge", T1, T2]),
    "several posts": (f"<article><h2>First post</h2>{P1}</article><article><h2>Other post</h2>{P2}</article>", ["First post", T1, "Other post", T2]),
    "list in an article": (f'<article>{P1}<ul><li><a href="/1">One</a></li><li>Two boats were lost in the storm of last week</li><li>Three</li></ul>{P2}</article>', [T1, "One", "Two boats were lost in the storm of last week", "Three", T2]),
    "list without an article": (f"<div>{P1}<ul><li>The first of them is a rather long one of many words</li><li>short item</li><li>The third of them is long as well, as one can see</li></ul>{P2}</div>", [T1, "The first of them is a rather long one of many words", "short item", "The third of them is long as well, as one can see", T2]),
    "related links": (f'<article>{P1}<ul><li><a href="/a">The old bridge</a></li><li><a href="/b">The river</a></li><li><a href="/c">All about boats</a></li></ul></article>', [T1]),
    "comments": (f'<article>{P1}<section class="comments"><article class="comment"><p>{LONG}</p></article></section></article>', [T1]),
    "comment articles after it": (f'<article>{P1}{P2}</article><div id="comments"><article><p>{LONG}</p></article></div>', [T1, T2]),
    "aside in the article": (f"<article>{P1}<aside>Read this too: the weather</aside>{P2}</article>", [T1, T2]),
    "layout words on the body": (f'<article class="has-sidebar">{P1}</article><div class="sidebar">Popular today: the bridge</div>', [T1]),
    "role main": (f'{NAV}<div role="main"><h1>The new bridge</h1>{P1}</div>{FOOT}', ["The new bridge", T1]),
    "cookie notice": (f'<div class="cookie-notice">We use cookies on this site</div><article>{P1}</article>', [T1]),
    "scripts and comments": (f"<article><script>var a = '<p>no</p>';</script><!-- <p>no</p> -->{P1}<style>p {{}}</style></article>", [T1]),
    "character references": (f"<article><h1>Fish &amp; chips</h1><p>A&nbsp;b &#233; {LONG}</p></article>", ["Fish & chips", f"A b é {LONG}".strip()]),
    "newsletter sign-up": (f'<article>{P1}<div class="newsletter">Get our news by mail each week</div>{P2}</article>', [T1, T2]),
}


@pytest.fixture(scope="module")
def texts(spark):
    pages = [(k, name, PAGE.format(body)) for k, (name, (body, _)) in enumerate(CASES.items())]
    return {r.url: r.text for r in html.extract_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


@pytest.mark.parametrize("name", CASES)
def test_layout(texts, name):
    assert texts[name].split("\n\n") == CASES[name][1]
