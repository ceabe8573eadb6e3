"""Furniture words in names of elements that hold content, and content inside furniture elements."""

from __future__ import annotations

import pytest

from folio.llm.html_extract import main_text, marks_furniture

LONG = "A paragraph of the article, long enough to be taken for content by its ratio."
ARTICLE = f"<article><h1>Title</h1><p>{LONG}</p></article>"


@pytest.mark.parametrize("name", ["content no-sidebar", "main has-header", "single-post with-sidebar", "article-share-free", "social-science", "elementor-widget", "elementor-widget-container", "has-left-sidebar", "shared", "footnotes"])
def test_names_of_content(name):
    assert not marks_furniture(name) and main_text(f'<body><div class="{name}"><p>{LONG}</p></div></body>') == LONG


@pytest.mark.parametrize("name", ["ad", "x Sidebar", "cookie-notice", "site_footer", "share-buttons", "related-posts", "comment-list", "ad-slot-2", "widget", "main-nav"])
def test_names_of_furniture(name):
    assert marks_furniture(name) and main_text(f'<body>{ARTICLE}<div class="{name}"><p>{LONG} Not this one.</p></div></body>') == f"Title\n\n{LONG}"


def test_what_holds_the_article_is_no_furniture():
    for outer, end in (("<form>", "</form>"), ('<div class="sidebar">', "</div>"), ('<form><div class="page-header">', "</div></form>"), ('<div role="dialog">', "</div>")):
        assert main_text(f"<body>{outer}{ARTICLE}<aside><p>{LONG} Aside.</p></aside>{end}</body>") == f"Title\n\n{LONG}"
    assert main_text(f"<body><div class=header><h1>Title</h1></div><p>{LONG}</p></body>") == f"Title\n\n{LONG}"
    # text ahead of the article in the same element
    assert main_text(f"<form><p>{LONG} First.</p>{ARTICLE}</form>") == f"{LONG} First.\n\nTitle\n\n{LONG}"


def test_teasers_and_hidden_articles_stay_out():
    assert main_text(f'<body>{ARTICLE}<aside><article><p>{LONG} Teaser.</p></article></aside></body>') == f"Title\n\n{LONG}"
    assert main_text(f'<form>{ARTICLE}<div class="related"><article><p>{LONG} Teaser.</p></article></div></form>') == f"Title\n\n{LONG}"
    assert main_text(f'<body>{ARTICLE}<div hidden><article><p>{LONG} Hidden.</p></article></div><template><h1>No</h1></template></body>') == f"Title\n\n{LONG}"


def test_math_stays():
    assert main_text(f"<p>{LONG} So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math> holds.</p>") == f"{LONG} So x=1 holds."


def test_time_grows_with_the_page():
    """Tags left open, end tags without a start, and articles in barred elements cost no search each."""
    import time

    def seconds(n: int) -> float:
        pages = ["<div>" + "<b>x" * n + "</i>" * n, "<p>" + "<b>" * n + "<div>y" * n, "<nav>" * 50 + "<article>" * n, "<body>" + "<span><p>z</i>" * n, "<div>" + "<b>" * n + "<table><tr><td>c" * n]
        began = time.perf_counter()
        for page in pages:
            main_text(page)
        return time.perf_counter() - began

    seconds(500)
    assert seconds(16_000) < 40 * max(seconds(1_000), 0.01)  # 16 times the tags; 256 times if each were a search
