"""Main text of web pages by site style trees."""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import materialise
from lectern.llm.hostrep import host_and_path

#: Fixed values of HTML: elements without content, with raw text, that flow inside a line, and those whose start ends an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp noembed noframes noscript template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var".split())
#: What names a part of a page that is not its article, as an element, a role or a word of a class or id.
NOISE_TAGS = frozenset("nav footer aside form dialog menu svg object select button canvas audio video".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead footer sidebar aside cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "search share sharing social related recommended recommendations comment comments commentlist disqus respond reply replies pagination pager toolbar copyright".split()
)
#: What begins a class that tells of something beside the element ("with-sidebar").
BESIDE = frozenset("has with without no is not".split())
LANDMARKS = frozenset(("article", "main"))
#: Headings, whose class or id is a slug of what they say, and what else an id says of a part that is noise ("left-sidebar").
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PLACES = frozenset("left right top bottom main site page global primary secondary".split())
ROOTS = frozenset(("html", "body"))

#: A branch whose importance is less is removed: what says the same on nearly all pages of its site.
THRESHOLD = 0.2
#: Pages of a site that have to share a branch before it is compared. A site's text is the same from two pages on.
LEAST_PAGES = 2
#: Share of a page's text, parts that are noise by element or name aside, that its article or main elements need to be its article.
MARKED_SHARE = 0.25
GAMMA = 0.9
#: Elements around a piece of text that are told apart; what is deeper counts as part of the last of them.
DEPTH = 256
#: Hosts and nodes up to which their table, some 20 bytes a node, is broadcast; beyond, the join shuffles.
BROADCAST_HOSTS, BROADCAST_NODES = 20_000, 200_000
#: Pages that a host repeats up to which their table is broadcast.
BROADCAST_COPIES = 200_000
#: Counts that a task holds before it passes them on.
HELD_COUNTS = 200_000

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): 'text' and its characters as written, 'start' and its attributes, 'end'. Comments, declarations and
    raw elements with their content give nothing; an unclosed one reaches to the end."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            yield "text", "", page[at:]
            return
        if lt > at:
            yield "text", "", page[at:lt]
        after = page[lt + 1 : lt + 2]
        if after in ("!", "?") and after:
            if page.startswith("<!--", lt):
                end = lt + 5 if page.startswith(("<!-->",), lt) else page.find("-->", lt + 4)
                at = n if end < 0 else end + (0 if end == lt + 5 else 3)
            else:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if not m:
            if after == "/" or after.isalpha():  # a tag that never ends
                if after == "/" and not page[lt + 2 : lt + 3].isalpha():
                    end = page.find(">", lt)
                    at = n if end < 0 else end + 1
                    continue
                return
            yield "text", "", "<"
            at = lt + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            yield "end", name, ""
        elif name in RAW and not m[3].endswith("/"):
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else n
            yield "break", "", ""
        else:
            yield "start", name, m[3]


class Node:
    """An open element: whether it is no part of an article by its tag or role (hard), and the key of what around it a class or id names so."""

    __slots__ = ("name", "key", "hard", "form", "named", "landmark")

    def __init__(self, name: str, key: int, hard: bool = False, form: bool = False, named: int = 0, landmark: bool = False):
        self.name, self.key, self.hard, self.form, self.named, self.landmark = name, key, hard, form, named, landmark


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest else {}


def tag_noise(name: str, attributes: dict[str, str], in_landmark: bool) -> bool:
    """Whether an element is no part of an article by its tag or role. The header of an article is part of it, that of a page is not."""
    if name in ROOTS or name in LANDMARKS:
        return False
    return name in NOISE_TAGS or (name == "header" and not in_landmark) or "hidden" in attributes or attributes.get("role", "").lower() in NOISE_ROLES


def names_noise(name: str, attributes: dict[str, str], in_landmark: bool) -> bool:
    """Whether a class or id says that an element is no part of an article: a class that begins or ends with such a word
    ("left-sidebar", not "content-sidebar-wrap"), an id of nothing but such words and places (not the slug "related-work")."""
    if not attributes or name in ROOTS or name in LANDMARKS or name in HEADINGS:
        return False
    noise = NOISE_WORDS - {"header"} if in_landmark else NOISE_WORDS
    for label in attributes.get("class", "").lower().split():
        words = _WORDS.findall(label)
        if words and words[0] not in BESIDE and (words[0] in noise or words[-1] in noise):
            return True
    words = _WORDS.findall(attributes.get("id", "").lower())
    return any(w in noise for w in words) and all(w in noise or w in PLACES for w in words)


class Page:
    """A page as its branches: text pieces in order, each with the keys of the elements around it.

    An element's key stands for the path of names and classes to it, so that the same part of two pages of a site has one key.
    A piece also says whether it is noise by an element's tag or role, the key of the element named noise around it
    (0: none), and whether it lies in an article or main element."""

    def __init__(self, page: str):
        stack = [Node("", 0)]
        self.pieces: list[tuple[str, tuple[int, ...], bool, int, bool]] = []
        self.presentation: dict[int, list[int]] = defaultdict(list)
        self.parents: dict[int, int] = {}
        path: tuple[int, ...] = ()
        space = (" ", (), True, 0, False)

        def pop_to(depth: int) -> None:
            nonlocal path
            if any(x.name not in INLINE for x in stack[depth:]):
                self.pieces.append(space)
            del stack[depth:]
            path = path[: depth - 1]

        for kind, name, rest in tokens(page):
            top = stack[-1]
            if kind == "text":
                self.pieces.append((entities.unescape(rest), path, top.hard, top.named, top.landmark))
            elif kind == "break":
                self.pieces.append(space)
            elif kind == "end":
                inline = name in INLINE
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        pop_to(depth)
                        break
                    if inline and stack[depth].name not in INLINE:
                        break
                if name in ("p", "br"):
                    self.pieces.append(space)
            else:
                if name not in INLINE and name not in VOID:
                    # An open paragraph ends where another block begins; so do items, cells and rows of a list or table.
                    for depth in range(len(stack) - 1, 0, -1):
                        open_ = stack[depth].name
                        if open_ == "p" or (open_ == name and name in ("li", "td", "th", "tr", "dt", "dd", "option")):
                            pop_to(depth)
                            top = stack[-1]
                            break
                        if open_ not in INLINE:
                            break
                    self.pieces.append(space)
                elif name in VOID:
                    self.pieces.append(space) if name in ("br", "hr") else None
                    continue
                if rest.endswith("/") and name not in INLINE and name not in LANDMARKS:
                    rest = rest[:-1]
                attributes = _attributes(rest)
                key = xxhash.xxh64_intdigest(f"{name} {attributes.get('class', '')}", top.key) >> 1
                # Some sites put the whole page into a form: an article in nothing but a form is one.
                # So is the main element of a page in wrappers that are noise by their class or id alone.
                around = top.hard and not (top.form and name in LANDMARKS)
                tag = tag_noise(name, attributes, top.landmark)
                named = 0 if name == "main" else top.named
                if not tag and not named and names_noise(name, attributes, top.landmark):
                    named = key
                form = (tag and name == "form" and not around) or (top.form and around and not tag)
                landmark = top.landmark or name in LANDMARKS or attributes.get("role", "").lower() == "main"
                self.presentation[top.key].append(key)
                if name not in ROOTS:
                    self.parents[key] = top.key
                stack.append(Node(name, key, around or tag, form, named, landmark))
                path = (*path, key) if len(path) < DEPTH else path

    def text(self, low: frozenset[int] = frozenset()) -> str:
        """The text of the branches that matter: not those that the page says are something else, by element, role, class or id, or by a
        place outside of the article that it marks, whatever they say; nor those that the site's tree finds of low importance (`low`)."""
        sizes = [0 if hard or named else len(piece) - piece.count(" ") for piece, _, hard, named, _ in self.pieces]
        total = sum(sizes)
        # A branch with most of the page's text stays, with all in it: an article may be on many pages of its site.
        inside: Counter = Counter()
        if low:
            for (_, path, *_), size in zip(self.pieces, sizes, strict=True):
                if size:
                    for key in low.intersection(path):
                        inside[key] += size
        most = {key for key, size in inside.items() if 2 * size > total}
        in_landmarks = sum(size for (*_, landmark), size in zip(self.pieces, sizes, strict=True) if landmark)
        marked = in_landmarks > 0 and in_landmarks >= MARKED_SHARE * total
        kept, soft = [], []
        for piece, path, hard, named, landmark in self.pieces:
            if piece == " ":
                kept.append(piece)
                soft.append(piece)
            elif hard:
                continue
            elif named:
                soft.append(piece)
            elif (landmark or not marked) and (low.isdisjoint(path) or not most.isdisjoint(path)):
                kept.append(piece)
        # Where nothing else has text, the names of classes and ids were wrong about it.
        return " ".join("".join(kept).split()) or " ".join("".join(soft).split())

    def observations(self) -> Iterator[tuple[int, int, int, int]]:
        """(node, parent, style, content) of each node of the page's style tree: equal siblings are one node; a style is the sequence
        of children without repeats in a row, the content the text inside."""
        content: dict[int, xxhash.xxh64] = {}
        for piece, path, *_ in self.pieces:
            if piece.strip():
                data = " ".join(piece.split()).encode("utf-8", "surrogatepass")
                for key in dict.fromkeys(path):
                    content.setdefault(key, xxhash.xxh64()).update(data)
        for key, parent in self.parents.items():
            children = self.presentation.get(key, ())
            style = xxhash.xxh64()
            last = None
            for c in children:
                if c != last:
                    style.update(c.to_bytes(8, "little"))
                last = c
            yield key, parent, style.intdigest() >> 1, content[key].intdigest() >> 1 if key in content else 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, html, copies) to counts (host, node, parent, kind, value, n) of styles (kind 0) and contents (kind 1); one of k copies counts 1/k."""
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        rows = list(counts.items())
        counts.clear()
        columns = list(zip(*(k for k, _ in rows), strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), pa.array([n for _, n in rows], pa.float64())], ["host", "node", "parent", "kind", "value", "n"])

    for b in batches:
        for host, page, copies in zip(b.column("host"), b.column("html"), b.column("copies"), strict=True):
            name, weight = host.as_py(), 1 / copies.as_py()
            seen = Page(page.as_py() or "")
            for node, parent, style, content in seen.observations():
                counts[name, node, parent, 0, style] += weight
                counts[name, node, parent, 1, content] += weight
            if len(counts) >= HELD_COUNTS:
                yield out()
    yield out()


def _nodes(pages: DataFrame, least_pages: int) -> DataFrame:
    """host, node, parent, m, style, styles, content: what each node's styles and contents say over the pages that have it."""
    pages = pages.select("host", "html", F.xxhash64("html").alias("page"))
    repeated = materialise(pages.groupBy("host", "page").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
    repeated = repeated.select(F.col("host").alias("_host"), F.col("page").alias("_page"), "copies")
    if repeated.count() <= BROADCAST_COPIES:
        repeated = F.broadcast(repeated)
    pages = pages.join(repeated, (F.col("host") == F.col("_host")) & (F.col("page") == F.col("_page")), "left")
    pages = pages.select("host", "html", F.coalesce("copies", F.lit(1)).alias("copies"))
    counts = pages.mapInArrow(_count, "host string, node long, parent long, kind int, value long, n double")
    # The parts of a page's copies make up 1, so the sum is a whole number but for rounding.
    counts = counts.groupBy("host", "node", "parent", "kind", "value").agg(F.round(F.sum("n")).cast("long").alias("n"))
    n = F.col("n").cast("double")
    per = counts.groupBy("host", "node", "parent", "kind").agg(F.sum("n").alias("m"), F.count("*").alias("values"), F.sum(n * F.log(n)).alias("nlogn"), F.sum(F.log(n)).alias("logs"))
    logm = F.log(F.col("m"))
    own = F.when(F.col("kind") == 0, (logm - F.col("nlogn") / F.col("m")) / logm).otherwise(1 - F.col("logs") / F.col("values") / logm)
    nodes = per.where(F.col("m") >= least_pages).withColumn("importance", own)
    return nodes.groupBy("host", "node", "parent").agg(
        F.max("m").alias("m"), F.max(F.when(F.col("kind") == 0, F.col("importance"))).alias("style"), F.max(F.when(F.col("kind") == 0, F.col("values"))).alias("styles"), F.max(F.when(F.col("kind") == 1, F.col("importance"))).alias("content")
    )


def _importance(rows: dict[int, tuple]) -> dict[int, float]:
    """The importance of each node of one site, of rows (parent, m, style, styles, content) by node."""
    children = defaultdict(list)
    for key, (parent, *_) in rows.items():
        children[parent].append(key)
    value: dict[int, float] = {}
    for top in [k for k, r in rows.items() if r[0] not in rows]:
        todo = [(top, False)]
        while todo:
            key, ready = todo.pop()
            if not ready:
                todo += [(key, True), *((c, False) for c in children[key])]
                continue
            _, _, style, styles, content = rows[key]
            kids = children[key]
            if kids:
                share = GAMMA ** int(styles)
                below = sum(value[c] * rows[c][1] for c in kids) / sum(rows[c][1] for c in kids)
                value[key] = max((1 - share) * style + share * below, content)
            else:
                value[key] = content
    return {k: min(1.0, max(0.0, v)) for k, v in value.items() if math.isfinite(v)}


def _site(pdf: pd.DataFrame) -> dict[int, tuple]:
    return {r.node: (r.parent, r.m, r.style, r.styles, r.content) for r in pdf.itertuples()}


def node_importance(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, nodes (array of keys), importance (array of numbers from 0 to 1): each site's style tree, from `pages` (host, html).

    A node's presentation matters by the entropy of its styles over the m pages that have it, to the base m: one style everywhere
    is 0, one for each page 1. Copies of a page on its host count as one page. Its content matters by one less the mean entropy of what it says: a text on one
    page only counts 1, one on all pages 0. A node with children combines its own styles and its children's importance.
    A host's nodes meet in one task: there are as many as it has different paths of names and classes that `least_pages` of its pages
    share, however many pages it has."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        found = sorted(_importance(_site(pdf)).items())
        keys, numbers = np.array([k for k, _ in found], dtype=np.int64), np.array([v for _, v in found])
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "nodes": [keys], "importance": [numbers]})

    return _nodes(pages, least_pages).groupBy("host").applyInPandas(combine, "host string, nodes array<long>, importance array<double>")


def low_nodes(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, nodes: the nodes of each site's tree of an importance under THRESHOLD that are in no other such node; sites without any are left out.
    That is all that a page's row has to meet, however large the tree."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = _site(pdf)
        low = {k for k, v in _importance(rows).items() if v < THRESHOLD}
        top = []
        for key in sorted(low):
            parent = rows[key][0]
            while parent in rows and parent not in low:
                parent = rows[parent][0]
            if parent not in low:
                top.append(key)
        rows = [(pdf["host"].iloc[0], np.array(top, dtype=np.int64))] if top else []
        return pd.DataFrame(rows, columns=["host", "nodes"], dtype=object)

    return _nodes(pages, least_pages).groupBy("host").applyInPandas(combine, "host string, nodes array<long>")


@F.arrow_udf(T.StringType())
def main_text(html: pa.Array, nodes: pa.Array) -> pa.Array:
    """The text of a page's branches that matter, by the page and by its site's nodes of low importance."""
    return pa.array([Page(page.as_py() or "").text(frozenset(keys.as_py() or ())) for page, keys in zip(html, nodes, strict=True)], pa.string())


def code_points(text: Column) -> Column:
    return F.char_length(text).cast("long")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars: the main text of each row of `pages` (page_id, url, html and any more).

    Pages of one host are merged into a style tree, whose entropies give each branch its importance; branches of low importance, which say
    the same on nearly all pages, are removed from each page. So are parts that the page says are no article: by their elements and
    roles, by names in classes and ids, and by their place outside of the article or main elements, where these hold a quarter of its text.
    What is removed for one of these reasons does not come back because its text differs from page to page.

    - A null or empty html has an empty text. A null url has the empty host. Repeated rows are extracted each.
    - Branches that one page of a site alone has are judged by that page. From two on a page's text does not depend on how many there are, as long
      as a branch says the same on all of them, or something else on each. An empty table gives no rows.
    - A very long page is read whole, in one task; elements nested deeper than 256 count as parts of the 256th.
    - Columns beside the three play no part."""
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host_and_path(F.col("url"))[0].alias("host"))
    tree = materialise(low_nodes(rows, least_pages), "low-nodes").withColumnRenamed("host", "_host")
    size = tree.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(F.size("nodes")), F.lit(0)).alias("nodes")).first()
    if size["hosts"] <= BROADCAST_HOSTS and size["nodes"] <= BROADCAST_NODES:
        tree = F.broadcast(tree)
    joined = rows.join(tree, F.col("host") == F.col("_host"), "left")  # of two stored tables: AQE may split a large host
    out = joined.select("page_id", "url", main_text("html", "nodes").alias("text"))
    return out.withColumn("n_chars", code_points(F.col("text")))
