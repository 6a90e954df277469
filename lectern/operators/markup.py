"""Markup as rows: the elements of pages with their attributes, texts and places, and what pages say in them."""

from __future__ import annotations

import html as references
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.entities import html5

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window as W

from lectern.functions import text as t
from lectern.operators import nested
from lectern.sources.shared import keep

# Fixed values of HTML: elements without content, elements whose content is text alone, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "a": {"a"}, "button": {"button"}, "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot"}}
#: What an implied end does not reach across.
FENCES = {"li": {"ul", "ol"}, "a": {"td", "th", "table"}, "button": {"form"}} | {n: {"table"} for n in ("tr", "td", "th", "tbody")} | {n: {"dl"} for n in ("dt", "dd")} | {"option": {"select"}}
#: Elements that have the whole text inside them; none of them is open twice at once, so texts are told once a kind.
WHOLE = HEADINGS | {"a", "title", "script", "button", "option", "td", "th", "textarea"}
#: Bytes of text in a batch of rows.
BATCH = 1 << 22

ELEMENT = T.StructType([
    T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("depth", T.IntegerType()),
    T.StructField("attributes", T.MapType(T.StringType(), T.StringType())), T.StructField("classes", T.ArrayType(T.StringType())), T.StructField("own", T.StringType()), T.StructField("whole", T.StringType()),
    T.StructField("regions", T.ArrayType(T.StringType())), T.StructField("row", T.IntegerType()), T.StructField("cell", T.ArrayType(T.StringType())), T.StructField("visible", T.BooleanType()),
])

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"'=]|=\s*"[^"]*"|=\s*'[^']*'|[="'])*?)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+)|[a-zA-Z][a-zA-Z0-9]*);")


def decoded(written: str) -> str:
    """A text with its character references decoded. One without its semicolon, as where a text was cut off, stays as written."""
    if "&" not in written:
        return written
    return _REFERENCE.sub(lambda m: references.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), written)


@dataclass
class Element:
    node: int
    parent: int
    name: str
    depth: int
    attributes: dict[str, str]
    regions: tuple[str, ...]
    row: int | None
    cell: tuple[str, ...] | None
    visible: bool
    own: list[str] = field(default_factory=list)
    inside: list[str] | None = None

    @property
    def classes(self) -> list[str]:
        return self.attributes.get("class", "").split()

    def values(self) -> tuple:
        squeezed = lambda parts: " ".join("".join(parts).split())
        whole = "".join(self.inside) if self.name == "script" else None if self.inside is None else squeezed(self.inside)
        return (self.node, self.parent, self.name, self.depth, list(self.attributes.items()), self.classes, squeezed(self.own), whole, list(self.regions), self.row, None if self.cell is None else list(self.cell), self.visible)


def tags(page: str) -> Iterator[tuple[str, str, str]]:
    """('text', '', characters as written), ('start', name, attributes as written) and ('end', name, '') of a page in order. Comments,
    declarations and instructions give nothing; a tag that is not closed, and an open comment, end the page."""
    at, n = 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            begin = n
        if begin > at:
            yield "text", "", page[at:begin]
        if begin == n:
            return
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = n if end < 0 else end + 1
        elif (m := _TAG.match(page, begin)) is None:
            after = page[begin + 1 : begin + 2]
            if after.isalpha() or (after == "/" and page[begin + 2 : begin + 3].isalpha()):
                return
            yield "text", "", "<"
            at = begin + 1
        else:
            at, name = m.end(), m[2].lower()
            yield ("end", name, "") if m[1] else ("start", name, m[3])
            if not m[1] and name in RAW:
                close = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(page, at)
                stop = close.start() if close else n
                if stop > at:
                    yield "raw", name, page[at:stop]
                at = stop


def attributes_of(written: str) -> dict[str, str]:
    """Attributes by lower-case name, values with references decoded; of a name that is there twice the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(written):
        out.setdefault(m[1].lower(), decoded(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def parse(page: str, regions: dict[str, dict[str, set[str]]] | None = None) -> list[Element]:
    """The elements of a page in the order of their start tags.

    regions: name -> {"class": names, "id": names, "tag": names}; an element of one of them, and all in it, is in the region. A row is
    the number of the next tr (or, outside of tables, li) around an element, a cell the classes of the next td or th."""
    wanted = regions or {}
    found: list[Element] = []
    stack: list[Element] = [Element(-1, -1, "", 0, {}, (), None, None, True)]
    texts: dict[str, list[Element]] = {}  # open elements of each kind that has the whole text in it

    def close(down_to: int) -> None:
        for e in stack[down_to:]:
            if e.inside is not None:
                texts[e.name].pop()
        del stack[down_to:]

    for kind, name, rest in tags(page):
        top = stack[-1]
        if kind in ("text", "raw"):
            said = rest if kind == "raw" and name in ("script", "style") else decoded(rest)
            top.own.append(said)
            for kind_, open_ in texts.items():
                # A script is no text of what is around it; a cell of a table inside a cell is not the outer one's text.
                if open_ and (name not in ("script", "style") or kind_ == name) and (kind == "raw" or top.visible or kind_ != "td"):
                    open_[-1].inside.append(said)
        elif kind == "end":
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    close(k)
                    break
                if stack[k].name in FENCES.get(name, ()):
                    break
        else:
            ended = HEADINGS if name in HEADINGS else ENDS.get(name, ())
            if ended:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in FENCES.get(name, ()):
                        break
                    if stack[k].name in ended:
                        close(k)
                        if name not in ("tr", "tbody"):  # these may end a cell, then its row
                            break
                top = stack[-1]
            attributes = attributes_of(rest)
            classes = set(attributes.get("class", "").split())
            inner = tuple(r for r, by in wanted.items() if r in top.regions or classes & by.get("class", set()) or attributes.get("id") in by.get("id", ()) or name in by.get("tag", ()))
            visible = top.visible and "hidden" not in attributes and not _UNSEEN.search(attributes.get("style", "")) and name not in ("script", "style", "template", "noscript")
            in_table = name == "table" or (top.row is not None and found[top.row].name == "tr")
            row = len(found) if name == "tr" or (name == "li" and not in_table) else top.row
            cell = tuple(attributes.get("class", "").split()) if name in ("td", "th") else None if name == "tr" else top.cell
            e = Element(len(found), top.node, name, top.depth + 1, attributes, inner, row, cell, visible)
            found.append(e)
            if name not in VOID:
                stack.append(e)
                if name in WHOLE:
                    e.inside = []
                    texts.setdefault(name, []).append(e)
    return found


def elements(pages: DataFrame, regions: dict[str, dict[str, set[str]]] | None = None, only: set[str] | None = None, key: str = "page_id") -> DataFrame:
    """key, node, parent, name, depth, attributes, classes, own, whole, regions, row, cell, visible: a row for each element of each page's html.

    own is the element's text outside of inner elements, whole all text in it (links, headings, cells, buttons, options, titles and scripts
    only); both have character references decoded and white space squeezed, but for scripts. `only` keeps elements of some names, once
    the page is read. A null html has no elements. One page is held at a time; a batch of rows is passed on by its size."""
    names = set(only) if only else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        rows: list[tuple] = []
        held = 0

        def out(kind: pa.DataType) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(ELEMENT.fields)
            arrays = [pa.array(c, k) for c, k in zip(columns, _ARROW, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *arrays], [key, *ELEMENT.fieldNames()])

        kind = pa.null()
        for b in batches:
            kind = b.schema.field(key).type
            for k, page in zip(b.column(key).to_pylist(), b.column("html"), strict=True):
                for e in parse(page.as_py() or "", regions):
                    if names is None or e.name in names:
                        row = e.values()
                        rows.append(row)
                        keys.append(k)
                        held += 100 + len(row[6]) + len(row[7] or "")
                if held >= BATCH:
                    yield out(kind)
                    rows.clear()
                    keys.clear()
                    held = 0
        if rows:
            yield out(kind)

    schema = T.StructType([pages.schema[key], *ELEMENT.fields])
    return pages.select(key, F.col("html").cast("string").alias("html")).mapInArrow(run, schema)


_ARROW = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.string()), pa.bool_())


@udtf(returnType=ELEMENT)
class HtmlElements:
    """html_elements(html): the elements of one page, for SQL."""

    def eval(self, html: str) -> Iterator[tuple]:
        for e in parse(html or ""):
            *head, items, classes, own, whole, regions, row, cell, visible = e.values()
            yield (*head, dict(items), classes, own, whole, regions, row, cell, visible)


def attribute(name: str) -> Column:
    return F.try_element_at("attributes", F.lit(name))


def anchors(found: DataFrame, region: str | None = None) -> DataFrame:
    """page_id, position, href, label, listed of the links among elements(): every a with an href, in order; listed: inside the region."""
    links = found.where((F.col("name") == "a") & attribute("href").isNotNull())
    place = F.row_number().over(W.partitionBy("page_id").orderBy("node")) - 1
    listed = F.array_contains("regions", region) if region else F.lit(False)
    return links.select("page_id", place.alias("position"), attribute("href").alias("href"), F.col("whole").alias("label"), listed.alias("listed"))


def meta(found: DataFrame) -> DataFrame:
    """page_id, name, contents: what meta elements say under each lower-case name (name, property or http-equiv), in order, without empty ones."""
    name = F.lower(F.coalesce(F.nullif(attribute("name"), F.lit("")), F.nullif(attribute("property"), F.lit("")), attribute("http-equiv")))
    said = found.where("name = 'meta'").select("page_id", "node", name.alias("name"), F.trim(attribute("content")).alias("content")).where("name <> '' AND content <> ''")
    in_order = F.array_sort(F.collect_list(F.struct("node", "content")))
    return said.groupBy("page_id", "name").agg(F.transform(in_order, lambda x: x["content"]).alias("contents"))


def json_ld(found: DataFrame) -> DataFrame:
    """page_id, node, json of each JSON-LD script."""
    typed = F.lower(F.coalesce(attribute("type"), F.lit(""))).contains("ld+json")
    return found.where((F.col("name") == "script") & typed).select("page_id", "node", F.trim("whole").alias("json"))


def language(found: DataFrame) -> DataFrame:
    """page_id, language: what the html element says."""
    return found.where("name = 'html'").groupBy("page_id").agg(F.min_by(F.nullif(attribute("lang"), F.lit("")), "node").alias("language"))


#: Where older article pages name their authors, as pairs of spans.
BYLINE = {"byline": {"id": {"author-group"}}}
ARTICLE_ELEMENTS = {"html", "meta", "script", "h1", "span"}


def _described(found: DataFrame) -> DataFrame:
    """page_id, headline, people, listed, described of the first object of an article in a page's JSON-LD, at any depth."""
    held = nested.nodes(json_ld(found).select(F.struct("page_id", "node").alias("at"), "json"), "at")
    is_type = (F.lower("name") == "@type") | ((F.try_element_at(F.split("path", "/"), F.lit(-2)) == "@type") & (F.col("kind") == "string"))
    typed = is_type & F.lower("value").isin("scholarlyarticle", "article")
    # A type stands in the object, or in a list in it.
    owner = F.when(F.lower("name") == "@type", F.col("parent")).otherwise(F.regexp_replace("parent", "/@type$", ""))
    first = F.min_by(F.when(typed, F.struct("at", owner.alias("owner"))), F.when(typed, F.struct("at.node", "place"))).over(W.partitionBy("at.page_id"))
    inside = held.withColumn("f", first).where((F.col("at") == F.col("f.at")) & F.col("path").startswith(F.concat("f.owner", F.lit("/")))).withColumn("owner", F.col("f.owner"))
    below = F.expr("substring(path, length(owner) + 2)")
    says = lambda *paths: F.min_by("value", F.when(below.isin(*paths) & (F.col("kind") == "string"), F.col("place")))
    # An author is a name, an object with one, or a list of these.
    person = below.rlike(r"^author(/[0-9]+)?(/name)?$") & (F.col("kind") == "string") & (F.trim("value") != "")
    keyword = below.rlike(r"^keywords(/[0-9]+)?$") & (F.col("kind") == "string")
    in_order = lambda fits: F.transform(F.array_sort(F.collect_list(F.when(fits, F.struct("place", F.trim("value").alias("v"))))), lambda x: x["v"])
    return inside.groupBy("at.page_id").agg(F.coalesce(says("headline"), says("name")).alias("headline"), in_order(person).alias("people"), in_order(keyword).alias("listed"), F.lit(True).alias("described"))


def _byline(found: DataFrame) -> DataFrame:
    """page_id, names: given name and surname of each pair of spans in the byline; a surname alone is a name."""
    spans = found.where((F.col("name") == "span") & F.array_contains("regions", "byline"))
    part = F.when(F.array_contains("classes", "given-name"), "given").when(F.array_contains("classes", "surname"), "surname")
    spans = spans.select("page_id", "node", part.alias("part"), "own").where("part IS NOT NULL")
    w = W.partitionBy("page_id").orderBy("node")
    spans = spans.withColumns({"before": F.lag("part").over(w), "given": F.lag("own").over(w)}).where("part = 'surname' AND own <> ''")
    name = F.trim(F.concat(F.when(F.col("before") == "given", F.concat("given", F.lit(" "))).otherwise(""), "own"))
    in_order = F.array_sort(F.collect_list(F.struct("node", name.alias("n"))))
    return spans.groupBy("page_id").agg(F.transform(in_order, lambda x: x["n"]).alias("names"))


def article(pages: DataFrame, url: Column | None = None) -> DataFrame:
    """page_id, title, authors, journal, doi, keywords, status, language of article pages (page_id, html).

    Title: citation_title, dc.title or og:title, else the JSON-LD headline or name, else the first h1. Authors: citation_author, else those of
    JSON-LD, else the byline's. DOI: citation_doi, dc.identifier or prism.doi, else the one in the page's url. Keywords are split at
    , and ;. A journal with a DOI, or with an article in JSON-LD, makes it a peer-reviewed article."""
    held = keep(elements(pages, BYLINE, only=ARTICLE_ELEMENTS), "article-elements")  # pages are read once
    said = meta(held)
    names = ["citation_title", "dc.title", "og:title", "citation_author", "citation_journal_title", "citation_doi", "dc.identifier", "prism.doi", "citation_keywords"]
    wide = said.where(F.col("name").isin(names)).groupBy("page_id").pivot("name", names).agg(F.first("contents"))
    heading = held.where("name = 'h1'").groupBy("page_id").agg(F.min_by("whole", "node").alias("h1"))
    # Facts meet by one aggregation: what Spark takes for small sides of joins, as pages are larger than the rows they are made of, would go through the driver.
    out = pages.select("page_id", (url if url is not None else F.lit(None).cast("string")).alias("_url"), F.lit(True).alias("_page"))
    for part in (wide, heading, _described(held), _byline(held), language(held)):
        out = out.unionByName(part, allowMissingColumns=True)
    out = out.groupBy("page_id").agg(*[F.first(f"`{c}`", ignorenulls=True).alias(c) for c in out.columns if c != "page_id"]).where("_page")
    one = lambda name: F.get(F.col(f"`{name}`"), F.lit(0))
    title = F.coalesce(one("citation_title"), one("dc.title"), one("og:title"), F.nullif(F.trim("headline"), F.lit("")), F.nullif(F.col("h1"), F.lit("")))
    some = lambda x: F.when(F.size(x) > 0, x)
    authors = F.array_distinct(F.coalesce(some(F.col("citation_author")), some(F.col("people")), some(F.col("names")), F.array().cast("array<string>")))
    doi = F.coalesce(*[t.normalize_doi(x) for x in (one("citation_doi"), one("dc.identifier"), one("prism.doi"), F.col("_url"))])
    listed = F.coalesce(one("citation_keywords"), F.array_join("listed", ";"), F.lit(""))
    keywords = F.filter(F.transform(F.split(listed, "[;,；，]"), lambda k: F.trim(k)), lambda k: k != "")
    journal = one("citation_journal_title")
    status = F.when(journal.isNotNull() & (doi.isNotNull() | F.coalesce("described", F.lit(False))), "PeerReviewedJournalArticle").otherwise("Unknown")
    return out.select("page_id", title.alias("title"), authors.alias("authors"), journal.alias("journal"), doi.alias("doi"), keywords.alias("keywords"), status.alias("status"), "language")


# Fixed values of one catalogue's result tables: what its cells, codes and marks of journal articles are.
CELLS = ("name", "author", "source", "date", "data")
JOURNAL_LABELS, JOURNAL_PRODUCTS, JOURNAL_RESOURCE = ("期刊",), ("CJFQ", "CAPJ", "ZHYX", "CJTL", "WWJD"), "JOURNAL"
ONLINE_FIRST, FIRST_PRODUCT = "网络首发", "CAPJ"


#: What an element of a row of a page says.
IN_ROW = T.StructType([f for f in ELEMENT.fields if f.name in ("node", "name", "attributes", "classes", "own", "whole", "cell")])
ROWS = T.ArrayType(T.StructType([T.StructField("row", T.IntegerType()), T.StructField("elements", T.ArrayType(IN_ROW))]))


def element_rows(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """key, rows: one row for each page, with the visible elements() inside of each of its rows (tr or li), in order. A page is read in one place, so
    that what its rows say needs no grouping, and no element is shuffled. One page is held at a time; pages are passed on by their size."""
    picked = [k for k, f in enumerate(ELEMENT.fieldNames()) if f in IN_ROW.fieldNames()]
    inside = pa.struct([(f, _ARROW[k]) for f, k in zip(IN_ROW.fieldNames(), picked, strict=True)])
    nested_rows = pa.list_(pa.struct([("row", pa.int32()), ("elements", pa.list_(inside))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        made: list[list[tuple]] = []
        held = 0
        for b in batches:
            kind = b.schema.field(key).type
            for at, page in enumerate(b.column("html")):
                rows: dict[int, list[tuple]] = {}
                for e in parse(page.as_py() or ""):
                    if e.row is not None and e.visible:
                        said = e.values()
                        rows.setdefault(e.row, []).append(tuple(said[k] for k in picked))
                        held += 100 + len(said[6]) + len(said[7] or "")
                keys.append(b.column(key)[at].as_py())
                made.append(list(rows.items()))
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(made, nested_rows)], [key, "rows"])
                    keys, made, held = [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(made, nested_rows)], [key, "rows"])
                keys, made, held = [], [], 0

    return pages.select(key, F.col("html").cast("string").alias("html")).mapInArrow(run, T.StructType([pages.schema[key], T.StructField("rows", ROWS)]))


def listing_rows(pages: DataFrame, is_detail: Callable[[Column], Column], main_class: str = "fz14") -> DataFrame:
    """page_id, position, title, href, source, date, year, label, products, resources, online_first, authors, journal_article of the rows of
    result tables: each tr with a link in its name cell whose href is_detail() holds for.

    Cells are known by class, never by place. Of several links one of `main_class` comes first. journal_article is null where the row says
    nothing of its type, false where its label, products or resources are of anything else."""
    has = lambda e, name: F.try_element_at(e["attributes"], F.lit(name))
    in_name = lambda e: F.array_contains(e["cell"], "name")
    is_link = lambda e: (e["name"] == "a") & in_name(e) & F.coalesce(is_detail(has(e, "href")), F.lit(False))
    link = lambda e: F.struct((~F.array_contains(e["classes"], main_class)).alias("other"), e["node"].alias("node"), e["whole"].alias("title"), has(e, "href").alias("href"))
    kind = lambda e: F.get(F.filter(F.array(*map(F.lit, CELLS)), lambda c: F.array_contains(e["cell"], c)), F.lit(0))
    cell = lambda name: F.array_join(F.transform(F.filter("elements", lambda e: (e["name"] == "td") & (kind(e) == name) & (e["whole"] != "")), lambda e: e["whole"]), " ")
    codes = lambda name: F.array_distinct(F.filter(F.transform("elements", lambda e: F.upper(F.trim(has(e, name)))), lambda v: v != ""))
    linked = F.transform("rows", lambda r: F.struct(F.array_min(F.transform(F.filter(r["elements"], is_link), link)).alias("link"), r["elements"].alias("elements")))
    linked = F.filter(linked, lambda r: r["link"].isNotNull() & (t.squeeze_title(r["link"]["title"]) != ""))
    rows = element_rows(pages).select("page_id", F.posexplode(linked).alias("position", "r")).select("page_id", "position", "r.link", "r.elements")
    marked = F.exists("elements", lambda e: in_name(e) & F.array_contains(e["classes"], "marktip") & e["own"].contains(ONLINE_FIRST))
    rows = rows.select("page_id", "position", "link", t.squeeze_title(F.col("link.title")).alias("title"), *[cell(c).alias(c) for c in CELLS[1:]], codes("data-dbname").alias("products"), codes("data-resource").alias("resources"), marked.alias("marked"))
    label = F.regexp_replace("data", r"\s+", "")
    known = (label != "") | (F.size("products") > 0) | (F.size("resources") > 0)
    journal = F.when(known, ((label == "") | label.isin(*JOURNAL_LABELS)) & (F.size(F.array_except("products", F.array(*map(F.lit, JOURNAL_PRODUCTS)))) == 0) & (F.size(F.array_except("resources", F.array(F.lit(JOURNAL_RESOURCE)))) == 0))
    names = F.array_distinct(F.filter(F.transform(F.split("author", "[;；,，]"), lambda x: F.trim(x)), lambda x: x != ""))
    return rows.select(
        "page_id", "position", "title", F.col("link.href").alias("href"), F.nullif("source", F.lit("")).alias("source"), F.nullif("date", F.lit("")).alias("date"), F.nullif(F.regexp_extract("date", r"(?:18|19|20|21)\d{2}", 0), F.lit("")).alias("year"),
        label.alias("label"), "products", "resources", (F.coalesce("marked", F.lit(False)) | F.array_contains("products", FIRST_PRODUCT)).alias("online_first"), names.alias("authors"), journal.alias("journal_article"),
    )


def restricted(rows: DataFrame, scopes: DataFrame, asked: DataFrame) -> DataFrame:
    """page_id, position, verdict of every row of result pages (listing_rows()) for a search of journals alone: KEPT, or why not.

    scopes: page_id, journals (access.executed(): whether the page says that it searched journals alone; null, or no row, where it does not
    say). asked: page_id, journal, first, last, most. A page that did not search journals alone is REFUSED_SCOPE with all its rows; one with a
    row of no stated type REFUSED_UNCONFIRMED, of another type REFUSED_TYPE. Then OTHER_SOURCE (another journal's title), YEAR_UNREADABLE and
    OUTSIDE_YEARS (only where years are asked for), DUPLICATE (a work that a row before it is, by link or title), BEYOND_LIMIT."""
    w = W.partitionBy("page_id")
    ask = asked.select(F.col("page_id").alias("_page"), t.normalize_title(F.col("journal")).alias("_journal"), "first", "last", "most")
    out = rows.join(ask, F.col("page_id") == F.col("_page")).join(scopes.select(F.col("page_id").alias("_scope"), "journals"), F.col("page_id") == F.col("_scope"), "left")
    unsure, other = F.max(F.col("journal_article").isNull().cast("int")).over(w), F.max((~F.coalesce("journal_article", F.lit(True))).cast("int")).over(w)
    page = F.when(~F.coalesce("journals", F.lit(False)), "REFUSED_SCOPE").when(other == 1, "REFUSED_TYPE").when(unsure == 1, "REFUSED_UNCONFIRMED")
    bounded, year = F.col("first").isNotNull() | F.col("last").isNotNull(), F.col("year").cast("int")
    row = (
        F.when(F.col("_journal").isNotNull() & ~F.coalesce(t.normalize_title(F.col("source")) == F.col("_journal"), F.lit(False)), "OTHER_SOURCE").when(bounded & year.isNull(), "YEAR_UNREADABLE")
        .when(bounded & ((year < F.coalesce("first", F.lit(0))) | (year > F.coalesce("last", F.lit(9999)))), "OUTSIDE_YEARS")
    )
    out = out.withColumn("_why", F.coalesce(page, row)).withColumn("_identity", F.coalesce(F.nullif("href", F.lit("")), t.normalize_title(F.col("title"))))
    nth = F.row_number().over(W.partitionBy("page_id", "_identity", F.col("_why").isNull()).orderBy("position"))
    out = out.withColumn("_why", F.coalesce("_why", F.when(nth > 1, "DUPLICATE")))
    place = F.sum(F.col("_why").isNull().cast("int")).over(w.orderBy("position"))
    verdict = F.coalesce("_why", F.when(place > F.col("most"), "BEYOND_LIMIT"), F.lit("KEPT"))
    return out.select("page_id", "position", verdict.alias("verdict"))
