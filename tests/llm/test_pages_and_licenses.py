"""URL filter, HTML extraction and licence scan."""

from __future__ import annotations

import hashlib
import re

from folio.llm.html_extract import extract_pages, main_text
from folio.llm.license_scan import known_digests, scan_licenses
from folio.llm.license_texts import KNOWN, MIT_BODY
from folio.llm.url_filter import HostModel, url_verdicts

URLS = [
    (1, "https://a.ORG/x?y", "a.org", "/x", "org/", "allow"), (2, "http://www.example.org/es/1", "www.example.org", "/es/1", "example.org/es/", "block"), (3, "http://example.org/en/12#t", "example.org", "/en/12", "example.org/en/1", "block"),
    (4, "http://example.org/en/2", "example.org", "/en/2", "org/", "allow"), (5, "http://x.com/fr/1", "x.com", "/fr/1", "com/fr/", "allow"), (6, "http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
    (7, "http://a.org", "a.org", "", None, "allow"), (8, None, "", "", None, "allow"), (9, "no scheme.org/x", "", "", None, "allow"), (10, "http://freecasinobets.net/", "freecasinobets.net", "/", None, "block"),
    (11, "x://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), (12, "http://h?a://b/c", "h", "", None, "allow"), (13, "", "", "", None, "allow"), (14, "http://ÄB.net/Q", "Äb.net", "/Q", None, "allow"), (7, "http://a.org", "a.org", "", None, "allow"),
    (None, "http://cheap-pills.example.net/en", "cheap-pills.example.net", "/en", None, "block"),
]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u, *_ in URLS], "page_id long, url string, host string")
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_verdicts(pages).collect()), key=str)
    assert got == sorted(((i, *rest) for i, _, *rest in URLS), key=str)
    assert url_verdicts(pages.filter("false")).count() == 0


def test_segmentation_takes_the_likeliest_words():
    m = HostModel()
    assert m.segment("freebetsonline") == ("free", "bets", "online") and m.segment("zzqk") == ("zzqk",) and m.segment("") == ()

    def best(name: str) -> float:
        """Every way to cut a name, priced as the search prices it."""
        if not name:
            return 0.0
        return max([m.unknown - 3.0 + best(name[1:]), *(m.unigram[name[:k]] + best(name[k:]) for k in range(1, len(name) + 1) if name[:k] in m.unigram)])

    for name in ("casinox", "bestbets", "newsblogm", "sexdating", "abc"):
        cost = sum(m.unigram[w] if w in m.unigram else len(w) * (m.unknown - 3.0) for w in m.segment(name))
        assert abs(cost - best(name)) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><p>Site head, with a long enough line of text to be content.</p></header>
<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class="cookie-notice">We use cookies on this site and would like you to agree to all of them.</div>
<article><h1>Title &amp; more</h1><p>First   <b>bold</b>
paragraph&nbsp;here.<p>Short.<br>Next line.</p><div class="ad">Buy this now, it is very good and cheap.</div><ul><li>item one</li><li>item two</ul><script>var x = "<p>no</p>";</script>
<form><p>Search form text</p></form><p>Last paragraph of the piece, somewhat longer than others.</p></article><aside><p>Sidebar</p></aside><section id="comments"><p>A reader's comment that is rather long, too.</p></section>
<footer>&copy; foot</footer></body></html>"""


def test_main_text():
    assert main_text(PAGE) == "Title & more\n\nFirst bold paragraph here.\n\nShort. Next line.\n\nitem one\n\nitem two\n\nLast paragraph of the piece, somewhat longer than others."
    assert main_text(None) == main_text("") == main_text("<script>x</script>") == ""
    assert main_text("just text") == "just text" and main_text("<p>open <b>never closed<p>next") == "open never closed\n\nnext"
    assert main_text("<p>a</p>" * 3_000).count("a") == 3_000


def test_pages_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (None, "v", "<p>é🙂</p>", 1)], "page_id long, url string, html string, n_chars int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in extract_pages(pages).collect()), key=str)
    assert got == sorted([(1, "u", main_text(PAGE), len(main_text(PAGE)))] * 2 + [(2, None, "", 0), (None, "v", "é🙂", 2)], key=str)
    assert extract_pages(pages.filter("false")).count() == 0


def test_every_article_of_the_table_is_whole(spark, sf_dir):
    import html

    for r in extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(filter(None, blocks))


def test_licenses(spark):
    messy = "Copyright (c) 2020 Somebody\n\n" + MIT_BODY.replace("sublicense", "sub-license").replace("Software", "SOFTWARE").replace("\n\n", "\n").replace(" to ", "  to\t")
    docs = spark.createDataFrame(
        [(1, messy, "c"), (2, "Licenced under the apache LICENCE, version 2.0!\nSome prose.\nReleased under the MIT License.", "c"), (3, None, "c"), (4, "© 2020 X\nAll rights reserved.", "c"), (5, "prose only", "c"), (5, "prose only", "c"), (None, MIT_BODY, "c"), (6, "w " * 50_000, "c")],
        "doc_id long, text string, digest string",
    )
    known = known_digests(spark)
    got = {r.doc_id: (r.licence, r.line_licences) for r in scan_licenses(docs, known).collect()}
    assert got[1] == ("MIT", "") and got[2] == (None, "Apache-2.0,MIT") and got[None] == ("MIT", "")
    assert {k: v for k, v in got.items() if k in (3, 4, 5, 6)} == {k: (None, "") for k in (3, 4, 5, 6)}
    rows = {r.doc_id: r.digest for r in scan_licenses(docs, known).collect()}
    assert rows[3] is None and rows[4] is None and rows[5] == hashlib.sha256(b"prose only").hexdigest()
    assert scan_licenses(docs, known).count() == 8 and scan_licenses(docs.filter("false"), known).count() == 0
    texts = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(KNOWN)], "doc_id long, text string")
    assert {r.doc_id: r.licence for r in scan_licenses(texts, known).collect()} == {k: n for k, (n, _) in enumerate(KNOWN)}
