"""Main text of pages on which the density threshold, not an article element, decides."""

from __future__ import annotations

import math
import time

import pytest
from corvane.llm import html_text


def words(n, at):
    return " ".join(f"word{at + i}" for i in range(n))


def test_equal_sections():
    parts = [[words(30, 100 * s + 10 * k) + "." for k in range(5)] for s in range(3)]
    sections = "".join("<div class='section'>" + "".join(f"<p>{p}</p>" for p in part) + "</div>" for part in parts)
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i}</a></li>" for i in range(12)) + "</ul>"
    page = f"<html><body><div>{links}</div><div>{sections}</div><div>{links}</div></body></html>"
    assert html_text.main_text(page) == "\n".join(p for part in parts for p in part)


ARTICLE = "".join(f"<p>{words(30, 10 * k)}.</p>" for k in range(5))
TEXT = "\n".join(f"{words(30, 10 * k)}." for k in range(5))


@pytest.mark.parametrize("before", ["<svg class='icon'/>", "<svg><path d='M0'/></svg>", "<svg><title>x</title><path>", "<p><math/></p>", "<select><option>one<option>two</select>"])
def test_drawing_before_the_text(before):
    assert html_text.main_text(f"<body><div>{before}</div><div>{ARTICLE}</div></body>") == TEXT
    assert html_text.main_text(f"<body>{before}<article>{ARTICLE}</article></body>") == TEXT


def test_math_is_text():
    page = f"<body><article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> be <svg/>given.</p>{ARTICLE}</article></body>"
    assert html_text.main_text(page) == "Let x=2 be given.\n" + TEXT


@pytest.mark.parametrize("label", ["content with-sidebar", "page no-comments", "has-header", "content-sidebar-wrap"])
def test_label_within_a_class(label):
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(5)) + "</ul>"
    assert html_text.main_text(f"<body><div class='{label}'><div>{ARTICLE}</div></div></body>") == TEXT
    assert html_text.main_text(f"<body><div class='site-header'>{links}</div><div id='{label}'>{ARTICLE}<div class='post-related'>{links}</div><div class='x cookie-notice'>We use cookies</div></div></body>") == TEXT


def plain_density(node, page):
    """Composite text density from its definition, by recursion."""

    def counts(x, link):
        if x.name == "#text":
            n = len(" ".join(x.text.split()))
            return n, 0, n if link else 0, 0
        out = [0, 0, 0, 0]
        for c in x.children:
            if not c.skip:
                chars, tags, link_chars, link_tags = counts(c, link or c.name == "a")
                out = [out[0] + chars, out[1] + tags + (c.name != "#text"), out[2] + link_chars, out[3] + link_tags + (c.name == "a")]
        return tuple(out)

    above, link = node, False
    while above is not None:
        link, above = link or above.name == "a", above.parent
    c, t, lc, lt = counts(node, link)
    body_c, _, body_lc, _ = counts(page, False)
    t = max(1, t)
    return c / t * math.log(max(c / max(1, lc) * t / max(1, lt), 1 + 1e-9)) / math.log(c / max(1, c - lc) * lc + body_lc / body_c * c + math.e) if c else 0.0


def test_densities(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").limit(20).collect():
        root = html_text.tree(r.html)
        html_text.judge(root)
        stack, seen = [root], 0
        while stack:
            x = stack.pop()
            if x.name != "#text" and not x.skip:
                assert x.density == pytest.approx(plain_density(x, root), rel=1e-12)
                seen += 1
                stack += x.children
        assert seen > 10


def test_density_decides(spark, sf, monkeypatch):
    """No article, no navigation element, no label: the link list goes by its density, and stays where densities are gone."""
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    want = [html_text.main_text(p) for p in pages]
    bare = [p.replace("<article>", "<div>").replace("</article>", "</div>").replace("<nav>", "<div>").replace("</nav>", "</div>") for p in pages]
    assert [html_text.main_text(p) for p in bare] == want and "<article" not in "".join(bare)
    monkeypatch.setattr(html_text, "density", lambda *counts: 0.0)
    assert all(html_text.main_text(p) != w for p, w in zip(bare, want, strict=True))


def test_equal_sums_take_the_first():
    part = "".join(f"<p>{words(20, 10 * k)}.</p>" for k in range(3))
    links = "<ul>" + "".join(f"<li><a href=/{i}>Link number {i} of the list</a></li>" for i in range(30)) + "</ul>"
    root = html_text.tree(f"<body>{links}<div id=a>{part}</div>{links}<div id=b>{part}</div></body>")
    html_text.judge(root)
    found, _ = html_text.anchor(root)
    assert found.parent.children.index(found) == 1


def test_names_inside_the_article():
    assert html_text.main_text(f"<body><header><h1>Site</h1></header><article><header><h1>Title</h1></header>{ARTICLE}</article></body>") == "Title\n" + TEXT
    assert html_text.main_text(f"<body><div class='post'><div class='share-price widget'><p>{words(40, 500)}.</p></div>{ARTICLE}</div></body>") == f"{words(40, 500)}.\n" + TEXT
    assert html_text.main_text(f"<body><div>{ARTICLE}<p>See <a href=foo/>this</a> and that.</p></div></body>") == TEXT + "\nSee this and that."


def test_comments_longer_than_the_article():
    page = f"<body><div><h1>T</h1>{ARTICLE}</div><section class=comments>{''.join(f'<div><p>{words(40, 900 + 50 * k)}</p></div>' for k in range(5))}</section></body>"
    assert html_text.main_text(page) == "T\n" + TEXT


@pytest.mark.parametrize("shape", ["<b>{n}</i>{n}", "<p><button><i>{n}<h1></h1>{n}", "<i>{n}<div><p>x</i>{n}", "<a href='{n}", "<svg><foreignobject>{n}<p>{n}"])
def test_time_is_linear_in_stray_markup(shape):
    def took(n):
        page = "".join(tag * n for tag in shape.split("{n}"))
        best = math.inf
        for _ in range(3):
            start = time.process_time()
            html_text.main_text(page)
            best = min(best, time.process_time() - start)
        return best

    assert took(12000) < 10 * took(3000) + 0.2  # four times the page; a quadratic walk takes sixteen times as long


JUNK = (
    "comment-body comments-area comment-section user-comments reader-comments disqus_thread site-footer site-header footer-inner ad-container ad-slot adsbox left-sidebar sidebar-left "
    "cookie-notice-text newsletter-box related-posts related-articles promo-box site-notice alert-box share-bar legal copyright feedback responses discussion post-comments ad banner comments"
).split()


@pytest.mark.parametrize("label", JUNK)
def test_labelled_blocks_beside_the_article(label):
    """Two paragraphs, fewer or many more than the article's, under a usual label: never text, in an article element or without."""
    for n in (2, 12):
        block = f"<div class='x {label}'>" + "".join(f"<p>{words(30, 900 + 40 * k)}.</p>" for k in range(n)) + "</div>"
        assert html_text.main_text(f"<body><div><h1>T</h1>{ARTICLE}</div>{block}</body>") == "T\n" + TEXT
        assert html_text.main_text(f"<body><article><h1>T</h1>{ARTICLE}</article>{block}</body>") == "T\n" + TEXT


@pytest.mark.parametrize("long", ["<div class=ad>{}</div>", "<footer>{}</footer>", "<aside>{}</aside>"])
def test_short_article_beside_long_furniture(long):
    page = "<body><article><h1>Tiny</h1><p>One line.</p></article>" + long.replace("{}", f"<p>{words(60, 500)}.</p>") + "</body>"
    assert html_text.main_text(page) == "Tiny\nOne line."


@pytest.mark.parametrize("mark", ["class=related", "class=alert", "class=social", "class=share", "class=promo", "class=toolbar", "class=skip", "class=login", "id=menu", "role=alert", "role=form", "class='site-notice'"])
def test_labelled_paragraph_of_the_article(mark):
    page = f"<body><article>{ARTICLE}<p {mark}>{words(30, 700)}.</p>{ARTICLE}</article></body>"
    assert html_text.main_text(page) == f"{TEXT}\n{words(30, 700)}.\n{TEXT}"


def test_page_that_labels_would_empty():
    assert html_text.main_text(f"<body><div class='comments-area'>{ARTICLE}<div class=ad><p>buy</p></div></div></body>") == TEXT
    assert html_text.main_text(f"<body><article><header class='entry-header'><h1>T</h1></header>{ARTICLE}</article></body>") == "T\n" + TEXT
