"""Articles that several pages of a host carry, and names that hold noise words without being noise."""

from lectern.llm import sitetree


def test_host_of_equal_pages_keeps_its_text(spark):
    page = "<html><body><div class='c'><h1>Title</h1><p>The one article of this host.</p></div></body></html>"
    menu = "<div class='m'>Same words</div>"
    other = lambda i: f"<html><body>{menu}<div class='c'><h1>Title</h1><p>The one article of this host, on every page.</p></div><div class='n'>{i}</div></body></html>"
    rows = [(i, f"http://a.example.com/{i}", page) for i in range(12)] + [(100 + i, f"http://b.example.com/{i}", other(i)) for i in range(12)]
    text = {r["page_id"]: r["text"] for r in sitetree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {text[i] for i in range(12)} == {"Title The one article of this host."}
    assert all(text[100 + i] == f"Title The one article of this host, on every page. {i}" for i in range(12))


def test_names_of_wrappers_and_headings():
    assert sitetree.Page('<div class="content-sidebar-wrap"><main>a</main><div class="sidebar">b</div></div>').text() == "a"
    assert sitetree.Page('<div class="sidebar-layout"><nav>n</nav><main>a</main></div>').text() == "a"
    assert sitetree.Page('<div class="sidebar-layout"><nav>n</nav><article>a</article></div>').text() == "a"
    assert sitetree.Page('<article><h2 id="search">a</h2><section id="related-work">b</section><p>c <math><mi>x</mi></math></p></article>').text() == "a b c x"
    assert sitetree.Page('<p>a</p><div id="left-sidebar">b</div><div class="comments"><article>c</article></div>').text() == "a"
