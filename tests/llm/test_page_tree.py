"""The style tree's importance against brute force, and what it decides on sites whose pages mark no article."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import sitetree

MENU = "<ul class='m'><li><a href='/a'>Home</a></li><li><a href='/b'>Topics</a></li></ul>"


def page(i, classes="c", note=""):
    body = "".join(f"<p>Paragraph {k} of page {i} says {i * 31 + k}.</p>" for k in range(1 + i % 3))
    return f"<html><body>{MENU}<div class='{classes}'><h2>Title {i}</h2>{body}{note}</div><div class='b'>All rights reserved by the site</div></body></html>"


def brute(pages):
    """Importance of each path of (name, class) of simple pages, from the entropies of its definition."""
    seen = defaultdict(list)  # path -> (children, text) of each page
    children_of = defaultdict(set)
    for html in pages:
        styles, texts, path = defaultdict(list), defaultdict(str), []
        for m in re.finditer(r"<(/?)(\w+)(?: (?:class|href)='(\w*|/\w)')?>|([^<]+)", html):
            if m[4]:
                for k in range(1, len(path) + 1):
                    texts[tuple(path[:k])] += " ".join(m[4].split())
            elif m[1]:
                path.pop()
            else:
                step = (m[2], m[3] if m[3] and not m[3].startswith("/") else "")
                children_of[tuple(path)].add((*path, step))
                if not styles[tuple(path)] or styles[tuple(path)][-1] != step:
                    styles[tuple(path)].append(step)
                path.append(step)
                styles[tuple(path)] += []
        for p in styles:
            if p:
                seen[p].append((tuple(styles[p]), texts[p]))
    value = {}

    def entropy(counts, m):
        return -sum(n / m * math.log(n / m) for n in counts.values()) / math.log(m)

    for p in sorted(seen, key=len, reverse=True):
        m = len(seen[p])
        if m < sitetree.LEAST_PAGES or p[-1][0] in sitetree.ROOTS:
            continue
        style, said = Counter(s for s, _ in seen[p]), Counter(t for _, t in seen[p])
        content = 1 - sum(math.log(n) / math.log(m) for n in said.values()) / len(said)
        below = [(value[c], len(seen[c])) for c in children_of[p] if c in value]
        share = sitetree.GAMMA ** len(style)
        value[p] = max((1 - share) * entropy(style, m) + share * sum(v * n for v, n in below) / sum(n for _, n in below), content) if below else content
    return value


def test_importance_against_brute_force(spark):
    pages = [page(i, note="<i>and more</i>" if i % 4 == 0 else "") for i in range(14)]
    frame = spark.createDataFrame([("h", p) for p in pages], "host string, html string")
    row = sitetree.node_importance(frame).first()
    want = sorted(brute(pages).values())
    assert len(want) == len(row["nodes"]) >= 7
    assert sorted(row["importance"]) == pytest.approx(want, abs=1e-9)


def texts(spark, sites):
    """page_id -> text of sites {number: [html]}, page_id being 1000 * site + place."""
    rows = [(1000 * k + i, f"http://s{k}.example.com/{i}", p) for k, pages in sites.items() for i, p in enumerate(pages)]
    return {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def said(i):
    return " ".join(f"Paragraph {k} of page {i} says {i * 31 + k}." for k in range(1 + i % 3))


SIZES = (2, 4, 5, 14, 50)


def test_tree_decides_where_no_article_is_marked(spark):
    got = texts(spark, {n: [page(i) for i in range(n)] for n in (1, *SIZES)})
    for n in SIZES:  # at any number of pages of the site
        assert [got[1000 * n + i] for i in range(n)] == [f"Title {i} {said(i)}" for i in range(n)]
    assert got[1000] == f"Home Topics Title 0 {said(0)} All rights reserved by the site" == sitetree.Page(page(0)).text()  # a page alone


def noisy(i, article=True):
    """Comments, related stories, adverts and notices, each with words of its own on every page, around and inside of the article."""
    own = lambda kind: f"{kind} number {i * 37} by reader {i * 11} on {kind} {i}"
    inner = f"<h1>Title {i}</h1><p>{said(i)}</p><section class='comments'><p>{own('comment')}</p></section><div class='c'><p>More of page {i}.</p></div><div class='advert-box'>{own('advert')}</div>"
    main = f"<article>{inner}</article>" if article else f"<div class='content'>{inner}</div>"
    beside = f"<div class='right-sidebar'>{own('sidebar')}</div><div id='related'>{own('story')}</div><div class='cookie-notice'>{own('notice')}</div>"
    around = f"<div class='x7'>{own('teaser')}</div>" if article else ""
    return f"<html><body>{MENU}{around}{main}{beside}<div class='b'>All rights reserved</div></body></html>"


@pytest.mark.parametrize("article", [True, False])
def test_noise_does_not_come_back_because_it_varies(spark, article):
    got = texts(spark, {n: [noisy(i, article) for i in range(n)] for n in SIZES})
    for n in SIZES:
        assert [got[1000 * n + i] for i in range(n)] == [f"Title {i} {said(i)} More of page {i}." for i in range(n)]


def test_tree_decides_inside_of_marked_articles(spark):
    """What says the same on every page of a site goes from its articles too, though no name or element tells it apart."""
    line = "<div class='k'><p>This story is part of our series about rivers.</p></div>"
    story = lambda i: f"<html><body><header>Site</header><article><h1>Title {i}</h1>{line}<p>{said(i)}</p><p>{long(i)}</p></article></body></html>"
    long = lambda i: f"What page {i} says at more length than the line that all have, {i * 7}."
    got = texts(spark, {n: [story(i) for i in range(n)] for n in SIZES})
    for n in SIZES:
        assert [got[1000 * n + i] for i in range(n)] == [f"Title {i} {said(i)} {long(i)}" for i in range(n)]
    assert "rivers" in sitetree.Page(story(1)).text()


def test_articles_that_pages_share_stay(spark):
    """An article on all pages of its site, beside what differs, is most of each page; and a small article element is not the page's article."""
    body = "".join(f"<p>Sentence {k} of the one article of this site.</p>" for k in range(6))
    same = [f"<html><body><div class='n'>Page {i}</div><div class='c'>{body}</div></body></html>" for i in range(5)]
    cards = [f"<html><body><div class='c'><p>{said(i)}</p><p>{'and so on ' * 40}{i}</p></div><article class='card'>Next {i}</article></body></html>" for i in range(5)]
    got = texts(spark, {1: same, 2: cards})
    for i in range(5):
        assert "Sentence 0 of the one article" in got[1000 + i] and "Sentence 5" in got[1000 + i]
        assert said(i) in got[2000 + i]
