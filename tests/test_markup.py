"""Markup and JSON as rows: against the standard library's parser, on broken pages, and in SQL."""

import json
import random
from html.parser import HTMLParser

import pytest

from lectern.functions import register
from lectern.operators import access, markup, nested


class Second(HTMLParser):
    """Start tags with attributes, and the text after each, as another parser sees them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.said = [], []

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.tags.append((tag, first))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_data(self, data):
        self.said.append(data)


def page(rng, depth=0):
    out = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["div", "p", "ul", "li", "span", "a", "b", "h2", "table", "section", "EM"])
        value = rng.choice(["x", "a b", "q=1&amp;r=2", "it&#39;s", "&lt;5&gt;"])
        quoted = rng.choice([f'"{value}"', f"'{value}'", value.replace(" ", "_").replace("&lt;5&gt;", "n")])
        more = rng.choice(["", " hidden", " DATA-x = 'y>z'", f" class={quoted} class=second", "\n id=\"i\""])
        inner = page(rng, depth + 1) if depth < 4 and rng.random() < 0.7 else rng.choice(["text", " some &amp; more ", "5 &lt; 6", "", "é日本"])
        out.append(f"<{tag} title={quoted}{more}>{inner}</{tag}>" + rng.choice(["", " tail ", "<br>", "<img src=x>", "<!-- <a href=no> -->"]))
    return "".join(out)


def test_tags_attributes_and_texts_agree_with_a_second_parser():
    rng = random.Random(4)
    for _ in range(400):
        html = page(rng)
        second = Second()
        second.feed(html)
        second.close()
        found = markup.parse(html)
        assert [(e.name, e.attributes) for e in found] == second.tags
        mine = "".join(rest for kind, _, rest in markup.tags(html) if kind == "text")
        assert markup.references.unescape(mine) == "".join(second.said)


@pytest.mark.parametrize("html, names", [
    ("<p>one<p>two", ["p", "p"]), ("<a href='x'>un<b>closed", ["a", "b"]), ("<div", []), ("a < b <c", []), ("<!-- never <a> closed", []), ("</p></div><i>x", ["i"]), ("<?xml v?><!DOCTYPE html><html>", ["html"]),
    ("<script>if (a<b) '</div>'</script><p>", ["script", "p"]), ("<textarea><b></textarea><u>", ["textarea", "u"]), ("<style>a>b</style", ["style"]), ("<>x<3", []), ("<br/><img src=a/>", ["br", "img"]), ("", []), ("\x00<i>\x00</i>", ["i"]),
])
def test_broken_markup(html, names):
    assert [e.name for e in markup.parse(html)] == names


def test_places_of_elements():
    html = "<ol id=r><li>1<li class='k m'>2<ul><li>2.1</ul><a href=/x>t <b>u</b></a></ol><table><tr><td class=a>A<table><tr><td class=b>B</table>C<td>D<tr><td>E</table><div hidden><p>no</p></div>"
    found = markup.parse(html, {"results": {"id": {"r"}}})
    at = {(e.name, "".join(e.own).strip()): e for e in found}
    assert [e.regions for e in found if e.name in ("li", "a", "b")] == [("results",)] * 5 and at["td", "E"].regions == ()
    link = at["a", "t"]
    assert link.values()[7] == "t u" and found[link.row].classes == ["k", "m"] and found[link.parent].name == "li"
    assert at["li", "2.1"].depth == 4 and found[at["li", "2.1"].parent].name == "ul"
    assert at["td", "AC"].values()[7] == "AC" and at["td", "B"].values()[7] == "B" and at["td", "B"].cell == ("b",)
    assert at["td", "D"].row == at["td", "AC"].row != at["td", "E"].row
    assert [e.visible for e in found if e.name == "p"] == [False]


def test_deep_pages_and_rows_of_all_kinds(spark):
    deep = "<div>" * 20_000 + "x"
    rows = [(1, deep), (2, None), (3, ""), (3, "<p a=1>x"), (None, "<p>y</p>")]
    found = markup.elements(spark.createDataFrame(rows, "page_id long, html string")).groupBy("page_id").count().collect()
    assert {r["page_id"]: r["count"] for r in found} == {1: 20_000, 3: 1, None: 1}


def test_article_fallbacks(spark):
    pages = [
        (1, "<META NAME=\"OG:Title\" content=' T '><meta name=citation_author content=''>", None),
        (2, '<script type="application/ld+json">{"@type": "WebPage", "name": "no"}</script><script type="application/ld+json">[{"@graph": [{"@type": "article", "name": "N", "author": "Solo"}]}]</script>', "https://x/doi/10.1000/AB?x"),
        (3, "<script type='application/ld+json'>{broken</script><h1>H <b>i</b></h1>", None),
        (4, None, None),
    ]
    got = {r["page_id"]: r for r in markup.article(spark.createDataFrame(pages, "page_id int, html string, url string"), access.F.col("url")).collect()}
    assert (got[1]["title"], got[1]["authors"], got[1]["status"]) == ("T", [], "Unknown")
    assert (got[2]["title"], got[2]["authors"], got[2]["doi"]) == ("N", ["Solo"], "10.1000/ab")
    assert (got[3]["title"], got[3]["authors"]) == ("H i", []) and got[4]["title"] is None and len(got) == 4


def test_walk_of_any_json():
    rng = random.Random(1)

    def value(depth):
        kind = rng.randrange(7 if depth < 5 else 5)
        return [None, True, rng.randrange(9), "s/~", ""][kind] if kind < 5 else {rng.choice("abc/~"): value(depth + 1) for _ in range(3)} if kind == 5 else [value(depth + 1) for _ in range(3)]

    def rebuilt(found):
        made = {}
        for _, path, parent, name, kind, atom in reversed(found):
            inside = [(n, made[p]) for _, p, q, n, *_ in found if q == path]
            made[path] = dict(inside) if kind == "object" else [v for _, v in inside] if kind == "array" else None if kind == "null" else atom if kind == "string" else json.loads(atom)
        return made[""]

    for _ in range(150):
        v = value(0)
        assert rebuilt(list(nested.walk(json.dumps(v)))) == v
    assert [x[1] for x in nested.walk('{"a": "{\\"b\\": \\"[1]\\"}"}')] == ["", "/a", "/a/b", "/a/b/0"]
    assert list(nested.walk("{")) == list(nested.walk(None)) == []
    assert len(list(nested.walk("[" * 600 + "]" * 600))) == 600


def test_scope_is_never_lost(spark):
    texts = ['{"Field":"SCOPE","Title":"x","Value":"THESIS"}', '{"Value": "JOURNAL", "Field": "SCOPE"}', '{"Field": "TI", "Operator": "AND", "Value": "say \\"hi\\" now"}', None, "{", '[{"field": "scope", "value": "journal"}, {"field": "scope", "value": "book"}]']
    requests = spark.createDataFrame(list(enumerate(texts)), "request long, json string")
    said = access.scope(requests)
    assert {(r["request"], r["field"], r["value"]) for r in said.collect()} >= {(0, "SCOPE", "THESIS"), (2, "TI", 'say "hi" now')}
    assert {r["request"]: r["refused"] for r in access.journals_only(requests, said).collect()} == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True}


def test_withheld():
    text = '{"z": {"Client-Secret": {"a": 1}, "ok": [{"COOKIE": null, "otp": false}, "password=x y"]}, "currentSessionDownloadVerified": true}'
    assert json.loads(nested.withheld(text)) == {"z": {"Client-Secret": "<REDACTED>", "ok": [{"COOKIE": None, "otp": False}, "password=<REDACTED> y"]}, "currentSessionDownloadVerified": True}
    assert nested.withheld("no json") is None and nested.withheld(None) is None


def test_in_sql(spark):
    register.register(spark)
    spark.createDataFrame([(1, "<p>a<a href='/x'>b</a>", '{"a": [1, {"token": "t"}]}')], "k int, html string, j string").createOrReplaceTempView("made")
    assert spark.sql("SELECT e.name, e.attributes['href'] AS h, e.whole FROM made, LATERAL html_elements(html) e ORDER BY node").collect()[1][:] == ("a", "/x", "b")
    assert [r[0] for r in spark.sql("SELECT n.path FROM made, LATERAL json_nodes(j) n ORDER BY place").collect()] == ["", "/a", "/a/0", "/a/1", "/a/1/token"]
    assert spark.sql("SELECT redact_json(j) AS r FROM made").first()["r"] == '{"a":[1,{"token":"<REDACTED>"}]}'
