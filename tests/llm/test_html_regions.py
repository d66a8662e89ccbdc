"""Main text where names leave the decision to the ratios."""

import pytest

from corpusmill.llm import html_text

LONG = "This paragraph of the body is long enough to stand well over any threshold of the page. " * 3
P = LONG.strip()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # topics that sound like furniture keep their text
        (f"<article><h1>T</h1><p>{LONG}</p><section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section></article>", f"T {P} Discussion {P}"),
        (f"<article><p>{LONG}</p><div class='related-work'><h2 id='related'>Related work</h2><p>{LONG}</p></div></article>", f"{P} Related work {P}"),
        (f"<article><p>{LONG}</p><div class='share-price'><p>{LONG}</p></div></article>", f"{P} {P}"),
        (f"<article><p>{LONG}</p><section id='notices'><p>{LONG}</p></section><h2 id='login'>Login</h2><p>{LONG}</p></article>", f"{P} {P} Login {P}"),
        # lists of links under the same names go, and blocks of them outside the article
        (f"<article><p>{LONG}</p><div class='related'><a href='x'>One more article</a> <a href='y'>And another</a></div></article>", P),
        (f"<article><p>{LONG}</p><div class='share'><a>f</a><a>t</a></div></article><div class='related'><p>{LONG}</p></div>", P),
        # comments, adverts and notices go even if they are long
        (f"<article><p>{LONG}</p><section id='comments'><p>{LONG}</p></section><div class='ad'><p>{LONG}</p></div><div class='cookie-notice'>{LONG}</div></article>", P),
        # an article in parts
        (f"<article><h1>T</h1><article><p>{LONG}</p></article><article><h2>U</h2><p>{LONG}</p></article></article>", f"T {P} U {P}"),
        # articles within one that has a text of its own are comments on it
        (f"<article><h1>T</h1><p>{LONG}</p><article><p>{LONG}</p></article></article>", f"T {P}"),
        (f"<article><p>{LONG}</p><div class='comments'><article><p>{LONG}</p></article></div></article>", P),
        # a card with a sentence beside the article, and articles of a length
        (f"<article><p>{LONG}</p><p>{LONG}</p></article><article><h3>Next</h3><p>A teaser of one sentence that says little.</p></article>", f"{P} {P}"),
        (f"<article><p>{LONG}</p></article><article><p>{LONG}</p></article>", f"{P} {P}"),
        # each block in a container of its own
        (f"<div><div><h1>Title</h1></div><div><p>{LONG}</p></div><div><p>Short one.</p></div><div><p>{LONG}</p></div><div><p>The end.</p></div><div><a>Home</a></div></div>", f"Title {P} Short one. {P} The end."),
        (f"<div><ul><li><a>x</a></ul></div><div><p>{LONG}</p></div><div><a>more</a> <a>links</a></div><div><p>{LONG}</p></div><div>Menu</div>", f"{P} {P}"),
    ],
)
def test_ratios_decide(html, text):
    assert html_text.main_text(f"<html><body><nav><a>n</a></nav>{html}<footer>f</footer></body></html>") == text


def test_threshold_and_smoothing_change_results(monkeypatch):
    """On a page without names that tell, the threshold alone parts the text from lines with many tags."""
    links = "<div><span>a</span><span>b</span><span>c</span><span>d</span></div>" * 3
    page = f"<body>{links}<div><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>{links}</body>"
    assert html_text.main_text(page) == f"{P} Short. {P}"
    monkeypatch.setattr(html_text, "threshold", lambda lines: ([x.ratio for x in lines], 0.0))
    assert html_text.main_text(page) != f"{P} Short. {P}"
