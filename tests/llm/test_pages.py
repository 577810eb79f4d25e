"""Main text of pages that give no hints, or wrong ones."""

import re

import pytest

from tidemark.llm.html_text import main_text

LINE = "A sentence of plain text that goes on and on for a while. "


def said(html):
    return main_text(html).replace(LINE.strip(), "S").split("\n\n")


@pytest.mark.parametrize("link", ["<a name=top>", "<a id=top>", "<a href=x>Go", "<a href=x>Go<a href=y>on", "<p><a href=x>Go</p>"])
def test_a_link_that_is_never_closed_takes_no_text(link):
    for shape in ("<body>{0}<article><h1>T</h1>{1}</article></body>", "<body><article>{0}<h1>T</h1>{1}</article></body>", "<body><div>{0}{1}</div></body>"):
        got = said(shape.format(link, "".join(f"<p>{LINE * 3}</p>" for _ in range(5))))
        assert got.count("S S S") == 5


def test_links_around_blocks_stay_links():
    teasers = "".join(f"<a href={i}><div><h3>Look</h3><p>At this</p></div></a>" for i in range(6))
    assert said(f"<body><div>{teasers}</div><article><p>{LINE * 6}</p><p>{LINE * 5}</p></article></body>") == ["S S S S S S", "S S S S S"]


def test_a_second_short_article_stays():
    page = f"<body><article><h1>One</h1><p>{LINE * 8}</p><p>{LINE * 6}</p></article><article><h2>Two</h2><p>Brief news.</p></article><article><a href=1>Read more about it</a></article></body>"
    assert said(page) == ["One", "S S S S S S S S", "S S S S S S", "Two", "Brief news."]


@pytest.mark.parametrize("name", ["id=legal", "class=search", "class='promo box'", "id=copyright", "class=related", "class=form", "class='overlay panel'", "id=notice"])
def test_the_ratio_overrules_names(name):
    page = f"<body><article><h1>T</h1><p>{LINE * 4}</p><{{0}} {name}>{LINE * 4}</{{0}}><p>{LINE * 4}</p></article></body>"
    assert said(page.format("div")) == said(page.format("p")) == ["T", *["S S S S"] * 3]
    short = f"<body><article><h1>T</h1><p>{LINE * 4}</p><div {name}><a href=1>go</a> there</div><p>{LINE * 4}</p></article></body>"
    assert said(short) == ["T", "S S S S", "S S S S"]


@pytest.mark.parametrize("name", ["class=ad", "id=comments", "class=cookie-consent", "class='sidebar left'"])
def test_what_is_never_the_article_goes_however_long(name):
    page = f"<body><article><h1>T</h1><p>{LINE * 4}</p><div {name}><p>{LINE * 6}</p></div><p>{LINE * 4}</p></article><div {name}>{LINE * 9}</div></body>"
    assert said(page) == ["T", "S S S S", "S S S S"]


def test_pages_without_article_elements(spark):
    """The pages at hand with their article as a plain division: nearly all words are still told."""
    good = total = extra = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        want = main_text(r.html).split()
        got = main_text(re.sub(r"(</?)(?:article|main)\b", r"\1div", r.html or "")).split()
        have = set(got)
        good, total, extra = good + sum(w in have for w in want), total + len(want), extra + len(set(got) - set(want))
    assert good >= 0.95 * total and extra <= 0.05 * total
