"""Names of branches against what the host's tree says, and whole extraction against a naive tree."""

import math
import os
from collections import Counter, defaultdict

import pytest

from panelspark.llm import html_extract

SF = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string"


def article(i):
    return f"<h1>Title {i}</h1><p>This is text {i} of {i * 7} things.</p><p>And {i * 3} words more.</p>"


def plain(i):
    return f"Title {i}\nThis is text {i} of {i * 7} things.\nAnd {i * 3} words more."


WRAPPED = [
    '<div class="site no-sidebar"><nav>Home</nav>{}</div>', '<div class="page has-sidebar">{}<aside>Aside</aside></div>', '<div id="content" class="no-sidebar">{}</div>',
    '<article class="post comment-open">{}</article>', '<article class="post category-promo">{}</article>', '<main><section id="related-work">{}</section></main>',
    '<div class="content-sidebar-wrap">{}</div>', '<form action="x"><div><main>{}</main></div><footer>End</footer></form>', '<form><article>{}</article></form>',
    '<div class="sidebar"><main>{}</main></div>', '<div class="js-menu with-ads">{}</div>', '<div class="menu"><div>{}</div></div>',
]
DROPPED = [
    '<div class="share-buttons">{}</div>', '<ul class="nav-menu">{}</ul>', '<div class="comment-list">{}</div>', '<section id="related-posts">{}</section>', '<div class="ad-300x250">{}</div>',
    '<div class="newsletter_signup">{}</div>', '<div id="comments"><article>{}</article></div>', '<article class="comment">{}</article>', '<form>{}</form>', '<div class="cookie-banner">{}</div>', '<nav><main>{}</main></nav>',
]


def test_names_alone_remove_no_article(spark):
    rows = [(100 * w + i, f"http://h{w}.example.org/{i}", f"<html><body>{form.format(article(i))}</body></html>") for w, form in enumerate(WRAPPED) for i in range(30)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert found == {100 * w + i: plain(i) for w in range(len(WRAPPED)) for i in range(30)}


def test_names_whose_words_agree_remove_what_differs(spark):
    rows = [(100 * w + i, f"http://h{w}.example.org/{i}", f"<html><body><main>{article(i)}</main>{form.format(f'<p>own {i * 11}</p>')}</body></html>") for w, form in enumerate(DROPPED) for i in range(30)]
    found = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, PAGE)).collect()}
    assert found == {100 * w + i: plain(i) for w in range(len(DROPPED)) for i in range(30)}


def naive(pages):
    """Texts of (page_id, url, html) by dictionaries: entropies over each host's different pages."""
    hosts = defaultdict(set)
    site = lambda url: url.split("/")[2].lower() if url else ""
    for _, url, html in pages:
        hosts[site(url)].add(html)
    evidence = {}
    for name, own in hosts.items():
        texts, counts = defaultdict(Counter), defaultdict(list)
        for html in own:
            found = html_extract.blocks(html)
            for path, text in {(b.path, b.text) for b in found}:
                texts[path][text] += 1
            for path, n in Counter(b.path for b in found).items():
                counts[path].append(n)
        evidence[name] = {}
        for path, c in texts.items():
            m, weight = len(counts[path]), sum(c.values())
            if m > 1:
                said = 1 - sum(n / weight * math.log(n) / math.log(m) for n in c.values())
                shown = sum(-n / m * math.log(n / m) for n in Counter(counts[path]).values()) / math.log(m)
                evidence[name][path] = (m - 1) / (m + 1) * (2 * (0.9 * max(said, 0) + 0.1 * shown) - 1)
    return {i: html_extract.main_text(html, evidence[site(url)]) for i, url, html in pages}


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_extraction_against_a_naive_tree(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    rows = [tuple(r) for r in pages.collect()]
    assert {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()} == naive(rows)
    mixed = [(i, f"http://s{i % 3}.example.org/{i}", "<body>" + "".join(f.format(article(i * 7 + k)) for k, f in enumerate((WRAPPED + DROPPED)[i % 5 :: 4])) + "<div>All rights</div></body>") for i in range(60)]
    found = html_extract.extract(spark.createDataFrame(mixed, PAGE)).collect()
    assert {r["page_id"]: r["text"] for r in found} == naive(mixed)
