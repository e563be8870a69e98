"""Tag-path ratios: the path table against brute force, and what the ratios decide."""

import re

import pytest

from cuespark.llm import html_main

LONG = "Words of a long part, and more of them here. " * 6
INNER = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><ul><li>one item</li><li>two</li></ul><h2>Between</h2><p>{LONG}</p>"
TEXT = f"Title {LONG}Short. one item two Between {LONG.strip()}"
PAGE = "<html><body><nav><ul><li><a href=x>Home</a></li><li><a href=y>News</a></li></ul></nav>{}<footer>(c) x, y.</footer></body></html>"


def test_path_table_against_brute_force():
    page = PAGE.format(f'<div class="a"><p>One, two.</p><p>Three <a href=x>four</a>; five.</p><ul><li>{LONG}</li></ul></div>')
    found = html_main.blocks(page)
    paths = html_main.Paths()
    own, below = (html_main.path_ratios(found), html_main.raw_ratios(found, _number(found, paths)))[1]
    chars = sum(len(b.text) for b in found)
    where = {b.node.path: paths.text(b.node.path) for b in found}
    assert set(where.values()) == {"/html/body/nav!/ul/li", "/html/body/div.a/p", "/html/body/div.a/ul/li", "/html/body/footer!"}

    def brute(some):
        n = len(some)
        text = sum(min(len(b.text), 400) for b in some) / n
        punct = sum(min(len(re.findall(r"[.,;:!?]", b.text)), 8) for b in some) / n
        size = sum(len(b.text) for b in some)
        return text * (1 + punct) * max(0.02, 1 - sum(b.linked for b in some) / size) * (size / chars) ** 0.5

    for p, name in where.items():
        assert own[p] == pytest.approx(brute([b for b in found if where[b.node.path] == name]))
    for p in range(len(below)):
        name = paths.text(p)
        assert below[p] == pytest.approx(brute([b for b in found if (where[b.node.path] + "/").startswith(name + "/")]))


def _number(found, paths):
    for b in found:
        for n in html_main._line(b.node):
            n.path = -1
    for b in found:
        paths.of(b.node)
    return paths


def test_ratios_decide(monkeypatch):
    """Without any name of furniture or of an article, ratios leave out what is no article; constant ones keep it."""
    page = f"<body><div><div><a href=x>Home</a></div><div><a href=y>News</a></div></div><div>Buy now.</div><div>{INNER}</div><div>(c) x, y.</div></body>"
    assert html_main.main_text(page) == TEXT
    inside = PAGE.format(f"<article>{INNER}<div><div><a href=x>More news</a></div><div><a href=y>Most read</a></div></div></article>")
    assert html_main.main_text(inside) == TEXT  # paths under the threshold go inside an <article> as well
    real = html_main.path_ratios
    monkeypatch.setattr(html_main, "path_ratios", lambda found: dict.fromkeys(real(found), 1.0))
    assert html_main.main_text(page) == f"Home News Buy now. {TEXT} (c) x, y."
    assert html_main.main_text(inside) == f"Home News {TEXT} More news Most read (c) x, y."


@pytest.mark.parametrize(
    "around",
    [
        "<article>{}</article>", "<div>{}</div>", '<div class="layout has-sidebar">{}<aside class="sidebar"><p>Side text, short.</p></aside></div>',
        '<div class="content no-sidebar">{}</div>', '<div class="page-with-footer">{}<div class="footer">Foot, note.</div></div>',
        '<div class="discussion-body">{}</div>', '<div class="search-results">{}</div>', '<article><div class="article-body ad-free">{}</div></article>',
        "<form>{}</form>", '<div id="x">{}</div><div id="comments"><p>I disagree, with all of it, really. I do, so there.</p></div>',
        '<main>{}</main><div class="sidebar-left"><h3>Links</h3><p>' + LONG + "</p></div>", '<article>{}<div class="related"><h3>Related</h3><p>Other, things.</p></div></article>',
        '<div class="cookie-notice">We use cookies, here and there.</div><div class="post">{}</div>', '<div role="dialog"><p>Sign up, now.</p></div><section>{}</section>',
        '<div class="widget menu comments footer">{}</div>',
    ],
)
def test_names_are_one_signal(around):
    assert html_main.main_text(PAGE.format(around.replace("{}", INNER))) == TEXT


def test_edges(spark):
    assert html_main.main_text("<nav><a href=x>only links</a></nav>") == "only links"
    assert html_main.main_text("<p></p><div> </div>") == ""
    deep = "<div class='comments x'>" * 2000 + f"<p>{LONG}</p>" + "</div>" * 2000
    assert html_main.main_text(deep) == LONG.strip()
    long = "<article>" + f"<p>{LONG}</p>" * 40_000 + "</article>"
    assert len(html_main.main_text(PAGE.format(long))) == 40_000 * len(LONG) - 1
    kind = "page_id bigint, url string, html string, text string, n_chars string, place int, cs_html string"
    rows = [(1, "u", PAGE.format(INNER), "z", "z", 1, "z"), (1, "u", PAGE.format(INNER), "z", "z", 1, "z"), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    got = html_main.extract(df).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [(0, "", "", 0), (1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT))]
    assert html_main.extract(df.limit(0)).collect() == []
