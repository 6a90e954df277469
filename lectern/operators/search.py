"""Fielded BM25 search over stored postings, with per-term contributions, passages and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as t
from lectern.operators import matcher
from lectern.operators.index import Index, field_counts
from lectern.sources import commits
from lectern.sources.shared import keep, small

# Saturation, length normalisation, and the weights of fields and of kinds of terms.
K1, B = 1.2, 0.75
FIELD_WEIGHTS = {"title": 3.0, "topics": 2.5, "keywords": 2.0, "authors": 1.6, "journal": 1.0, "human_name": 0.8, "text": 1.0}
LITERAL, LITERAL_PHENOMENON, EXPANDED, EXPANDED_PHENOMENON, TOPIC = 1.0, 1.5, 0.6, 0.9, 0.8
DEPTH, SHARE, PASSAGES = 40, 0.45, 3
ROLE_SHARE = 0.40
ROLE_WEIGHTS = {"title": 3, "topics": 2, "keywords": 2, "journal": 1, "body": 1}

#: Rows of terms, candidates, filters and the like of a query set up to which they are broadcast; beyond, joins with them shuffle.
BROADCAST_TERMS = 100_000
MOST_FILTERS = 1000


def query_terms(text: Column) -> Column:
    """Distinct tokens of a query, in order."""
    return F.array_distinct(t.tokens(text))


def plain_terms(queries: DataFrame) -> DataFrame:
    """query, token, weight of each row of `queries` (query, text): its tokens, of weight 1."""
    return queries.select("query", F.explode(query_terms(F.col("text"))).alias("token"), F.lit(LITERAL).alias("weight"))


def _hits(posted: DataFrame, terms: DataFrame, on: list[str]) -> DataFrame:
    """Postings that a query asks for. A token that stands in a query several times counts as often: its weights are added."""
    asked = terms.groupBy("query", "token").agg(F.sum("weight").alias("weight"))
    if "query" not in posted.columns:
        tokens = [r["token"] for r in asked.select("token").distinct().limit(1001).collect()]
        posted = posted.where(F.col("token").isin(tokens)) if len(tokens) <= 1000 else posted  # a filter that reaches the files
    return posted.join(small(asked, BROADCAST_TERMS), on)


def contributions(hits: DataFrame, stats: DataFrame, df: DataFrame, fields: dict[str, float], key: str = "doc_id") -> DataFrame:
    """query, key, token, field, contribution: what each field of a document adds to its score for each token of a query.

    stats: n and avg_len by field (and query), df: by token (and query). Saturation comes after the fields are summed, per token."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in fields.items() for x in kv]), F.col("field"))
    hits = hits.where(F.col("field").isin(*fields)).join(small(stats, BROADCAST_TERMS), [c for c in ("query", "field") if c in stats.columns])
    hits = hits.join(df, [c for c in ("query", "token") if c in df.columns])  # a row for each token of a query: Spark broadcasts it by its size
    x = weight * F.col("tf") / (1 - B + B * F.col("len") / F.col("avg_len"))
    hits = hits.withColumn("x", x).withColumn("total", F.sum("x").over(W.partitionBy("query", key, "token")))
    idf = F.greatest(F.lit(0.05), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    score = idf * F.col("total") / (K1 + F.col("total")) * (K1 + 1) * F.col("weight")
    return hits.select("query", key, "token", "field", (score * F.col("x") / F.col("total")).alias("contribution"))


def term_scores(index: Index, terms: DataFrame, fields: dict[str, float], indexed: list[str] | None = None) -> DataFrame:
    """contributions() of terms (query, token, weight) over an index. df counts documents that have a token in any field, or any of `indexed`."""
    posted = index.postings.where(F.col("field").isin(*indexed)) if indexed else index.postings
    hits = _hits(posted, terms, ["token"])
    df = hits.groupBy("token").agg(F.count_distinct("doc_id").alias("df"))
    return contributions(hits, index.stats, df, fields)


def contribution_totals(docs: DataFrame, terms: DataFrame, fields: dict[str, float]) -> DataFrame:
    """query, token, field, works, total: how many works of the whole catalog `docs` (a column for each field) have a token of a query in a field,
    and what contributions() sum to over them.

    What a work adds for a token is the same for all queries but for the token's weight, so works are summed by token before any query meets them: rows
    grow with the catalog or with the query set, not with both. A work's fields are read side by side; no posting is shuffled."""
    asked = terms.groupBy("query", "token").agg(F.sum("weight").alias("weight"))
    tokens = [r["token"] for r in asked.select("token").distinct().limit(BROADCAST_TERMS + 1).collect()]
    counts = keep(field_counts(docs, list(fields), frozenset(tokens) if len(tokens) <= BROADCAST_TERMS else None), "field-counts")
    average = [F.coalesce(F.nullif(F.sum(F.get("lens", F.lit(i))) / F.greatest(F.count("*"), F.lit(1)), F.lit(0.0)), F.lit(1.0)) for i in range(len(fields))]
    stats = F.broadcast(keep(counts.agg(F.count("*").alias("n"), F.array(*average).alias("average")), "field-stats"))  # one row
    rows = counts.select("lens", F.inline(F.arrays_zip("token", *(f"tf{i}" for i in range(len(fields)))))).crossJoin(stats)
    x = [F.lit(w) * F.col(f"tf{i}") / (1 - B + B * F.get("lens", F.lit(i)) / F.get("average", F.lit(i))) for i, w in enumerate(fields.values())]
    rows = rows.select("token", *(f"tf{i}" for i in range(len(fields))), *(c.alias(f"x{i}") for i, c in enumerate(x)))
    share = [F.col(f"x{i}") / (K1 + sum((F.col(f"x{k}") for k in range(1, len(fields))), F.col("x0"))) for i in range(len(fields))]
    totals = rows.groupBy("token").agg(F.count("*").alias("df"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"works{i}") for i in range(len(fields))), *(F.sum(c).alias(f"sum{i}") for i, c in enumerate(share)))
    out = totals.join(small(asked, BROADCAST_TERMS), "token").crossJoin(stats)
    idf = F.greatest(F.lit(0.05), F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    told = [F.struct(F.lit(f).alias("field"), F.col(f"works{i}").alias("works"), (idf * (K1 + 1) * F.col("weight") * F.col(f"sum{i}")).alias("total")) for i, f in enumerate(fields)]
    return out.select("query", "token", F.inline(F.array(*told))).where("works > 0")


def ranked(parts: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """query, key, score, rank: the n best of each query, ties by key; scores are rounded to 6 places so that ties are ties."""
    scored = parts.groupBy("query", key).agg(F.round(F.sum("contribution"), 6).alias("score")).where("score > 0")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), F.col(key).asc())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def passage_scores(index: Index, candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """query, doc_id, ordinal, score of every stored passage of the candidates (query, doc_id; a stored frame) that has a term.

    idf and average length are those of a query's candidates' passages alone. The index has passages sorted by work: with up to a
    thousand candidates a filter on works reaches the files."""
    ids = [r["doc_id"] for r in candidates.select("doc_id").distinct().limit(1001).collect()]
    near = lambda df: df.where(F.col("doc_id").isin(ids)) if len(ids) <= 1000 else df
    mine = small(candidates.select("query", "doc_id"), BROADCAST_TERMS)
    sizes = near(index.chunks).select("doc_id", "ordinal", "len").join(mine, "doc_id")
    stats = sizes.groupBy("query").agg(F.count("*").alias("n"), (F.sum("len") / F.count("*")).alias("avg_len")).where("avg_len > 0").select("query", F.lit("text").alias("field"), "n", "avg_len")
    posted = near(index.chunk_postings).join(mine, "doc_id").withColumns({"field": F.lit("text"), "chunk": F.struct("doc_id", "ordinal")})
    hits = _hits(posted, terms, ["query", "token"])
    df = hits.groupBy("query", "token").agg(F.count_distinct("chunk").alias("df"))
    parts = contributions(hits, stats, df, {"text": 1.0}, "chunk")
    scored = parts.groupBy("query", "chunk").agg(F.round(F.sum("contribution"), 6).alias("score")).where("score > 0")
    return scored.select("query", "chunk.doc_id", "chunk.ordinal", "score")


def two_stage(first: DataFrame, found: DataFrame, share: float = SHARE) -> DataFrame:
    """query, doc_id, stage1, passage, score: candidates (query, doc_id, score) ranked again with their best passage (passage_scores()).

    score = stage1 + share * best stage1 * passage, where passage is the document's best over the best of all."""
    best = found.groupBy("query", "doc_id").agg(F.max("score").alias("best"))
    lead = F.max("best").over(W.partitionBy("query"))
    best = best.select("query", "doc_id", F.least(F.lit(1.0), F.col("best") / lead).alias("passage"))
    out = first.select("query", "doc_id", F.col("score").alias("stage1")).join(best, ["query", "doc_id"], "left")
    score = F.col("stage1") + F.lit(share) * F.max("stage1").over(W.partitionBy("query")) * F.coalesce("passage", F.lit(0.0))
    return out.select("query", "doc_id", "stage1", F.round("passage", 6).alias("passage"), F.round(score, 6).alias("score"))


def best_passages(found: DataFrame, n: int = PASSAGES) -> DataFrame:
    """The n best passages of each document for each query, ties by ordinal."""
    order = W.partitionBy("query", "doc_id").orderBy(F.col("score").desc(), "ordinal")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


PREFIXES = {"doi": "doi", "paper_id": "id", "paperid": "id", "id": "id", "title": "title", "author": "author", "authors": "author", "journal": "journal", "year": "year", "topic": "topic", "keyword": "keyword"}


def field_filters(text: Column) -> Column:
    """Map of filters in a query like "words author:Li Ming year:2019": a field's value reaches to the next field; repeats are joined.

    Words before the first field are under "text"; other names before a colon are words."""
    names = "|".join(sorted(PREFIXES, key=len, reverse=True))
    marked = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), rf"(?i)\s({names}):", "\u0001$1\u0002")
    parts = F.transform(F.split(marked, "\u0001"), lambda p: F.when(p.contains("\u0002"), F.struct(F.lower(F.substring_index(p, "\u0002", 1)).alias("k"), F.trim(F.regexp_replace(p, "^[^\u0002]*\u0002", "")).alias("v"))).otherwise(F.struct(F.lit("text").alias("k"), F.trim(p).alias("v"))))
    named = F.create_map(*[F.lit(x) for kv in (PREFIXES | {"text": "text"}).items() for x in kv])
    parts = F.filter(F.transform(parts, lambda p: F.struct(F.element_at(named, p["k"]).alias("k"), p["v"].alias("v"))), lambda p: p["v"] != "")
    keys = F.array_distinct(F.transform(parts, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.array_join(F.transform(F.filter(parts, lambda p: p["k"] == k), lambda p: p["v"]), " ")))


def parse(queries: DataFrame) -> DataFrame:
    """query, filters, tokens, doi, id, years, authors, exact of each row of `queries` (query, text).

    exact: the query names one work (a DOI, an id, or a title filter), so that nothing but that work may be given."""
    filters = field_filters(F.col("text"))
    out = queries.select("query", filters.alias("filters"), "text")
    words = F.coalesce(F.try_element_at("filters", F.lit("text")), F.lit(""))
    doi = t.normalize_doi(F.coalesce(F.try_element_at("filters", F.lit("doi")), F.nullif(F.regexp_extract("text", r"10\.\d{4,9}/\S+", 0), F.lit(""))))
    work = F.coalesce(F.try_element_at("filters", F.lit("id")), F.nullif(F.regexp_extract("text", r"(?:^|\s)(P[0-9A-F]{12})(?:\s|$)", 1), F.lit("")))
    years = t.years(F.coalesce(F.try_element_at("filters", F.lit("year")), words))
    authors = F.coalesce(t.names(F.try_element_at("filters", F.lit("author"))), F.array().cast("array<string>"))
    exact = doi.isNotNull() | work.isNotNull() | F.map_contains_key("filters", "title")
    return out.select("query", "filters", query_terms(words).alias("tokens"), doi.alias("doi"), work.alias("id"), years.alias("years"), authors.alias("authors"), exact.alias("exact"))


def passes(works: DataFrame, filters: DataFrame) -> DataFrame:
    """query, doc_id of the works (doc_id, year, journal, topics: array) that pass a query's filters (query, years: array, journal, topic).

    A year is in the list, a journal and a topic contain the folded words; an empty list and null ask for nothing. Queries that ask alike are
    held against the works once: the filters that differ are MOST_FILTERS at most."""
    w = works.select("doc_id", "year", t.fold(F.col("journal")).alias("_journal"), F.transform("topics", t.fold).alias("_topics"))
    f = filters.select("query", "years", t.fold(F.col("journal")).alias("journal"), t.fold(F.col("topic")).alias("topic"))
    f = f.withColumn("years", F.array_sort(F.array_distinct(F.coalesce("years", F.array().cast("array<string>")))))
    kinds = f.select("years", "journal", "topic").distinct()
    if kinds.limit(MOST_FILTERS + 1).count() > MOST_FILTERS:
        raise ValueError(f"a query set has {MOST_FILTERS} different filters at most")
    fits = (F.size("years") == 0) | F.array_contains("years", F.col("year").cast("string"))
    fits &= (F.col("journal") == "") | F.col("_journal").contains(F.col("journal"))
    fits &= (F.col("topic") == "") | F.exists("_topics", lambda x: x.contains(F.col("topic")))
    return w.join(F.broadcast(kinds), fits).select("doc_id", "years", "journal", "topic").join(f, ["years", "journal", "topic"]).select("query", "doc_id")


def filtered(parts: DataFrame, works: DataFrame, filters: DataFrame) -> DataFrame:
    """The contributions() (query, doc_id, ...) of works that pass their query's filters, as passes() has them; a query without a row in `filters`, or
    with one that asks for nothing, keeps all. df and average lengths stay those of all works."""
    asks = (F.size("years") > 0) | (F.coalesce("journal", F.lit("")) != "") | (F.coalesce("topic", F.lit("")) != "")
    bound = filters.where(asks)
    free = parts.join(bound.select("query").distinct(), "query", "left_anti")
    rest = parts.join(passes(works, bound), ["query", "doc_id"], "left_semi")
    return free.unionByName(rest)


def expanded_terms(queries: DataFrame, lexicon: DataFrame) -> DataFrame:
    """query, token, weight: a query's tokens, those of other words for its concepts, and those of its concepts' topics.

    lexicon: concept, facet, term, topic. A literal token weighs 1, 1.5 if it is of a phenomenon's term in the query; a token of another
    term of a concept 0.6, 0.9 for a phenomenon, unless the query has it; a token of a topic's name 0.8, beside what is there already. Of each
    concept the last term found, in order, is the one that is not expanded."""
    terms = lexicon.select("concept", "facet", t.fold(F.col("term")).alias("term"), "topic").distinct()
    found = matcher.find(queries, terms.drop("topic").distinct(), ["text"], "query").select("query", "concept", "facet", "term").distinct()
    literal = queries.select("query", F.posexplode(query_terms(F.col("text"))).alias("position", "token"))
    strong = found.where("facet = 'PHENOMENON'").select("query", F.explode(query_terms(F.col("term"))).alias("token")).distinct().withColumn("strong", F.lit(True))
    first = literal.join(strong, ["query", "token"], "left").select("query", "token", F.when(F.col("strong"), LITERAL_PHENOMENON).otherwise(LITERAL).alias("weight"))
    shown = found.groupBy("query", "concept", "facet").agg(F.max(F.struct((-F.length("term")).alias("n"), "term")).alias("last"))
    others = shown.join(terms.select("concept", F.col("term").alias("other")).distinct(), "concept").where(F.col("other") != F.col("last.term"))
    others = others.select("query", "facet", F.explode(query_terms(F.col("other"))).alias("token"))
    others = others.groupBy("query", "token").agg(F.max(F.when(F.col("facet") == "PHENOMENON", EXPANDED_PHENOMENON).otherwise(EXPANDED)).alias("weight"))
    others = others.join(literal.select("query", "token"), ["query", "token"], "left_anti")
    topics = shown.join(terms.where("topic IS NOT NULL").select("concept", "topic").distinct(), "concept").select("query", "topic").distinct()
    topics = topics.select("query", F.explode(query_terms(F.col("topic"))).alias("token"), F.lit(TOPIC).alias("weight"))
    return first.unionByName(others).unionByName(topics)


def lexicon_hits(docs: DataFrame, lexicon: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """key, concept, term: the terms of `lexicon` (concept, term), folded, that a text has: as whole words, or anywhere for terms with CJK characters. One
    automaton of all terms passes over each text once, however many terms there are."""
    return matcher.find(docs, _terms(lexicon), [column], key).select(key, "concept", "term").distinct()


def _terms(lexicon: DataFrame) -> DataFrame:
    return lexicon.select("concept", t.fold(F.col("term")).alias("term")).where("term <> ''").distinct()


def evidence(docs: DataFrame, lexicon: DataFrame, fields: list[str]) -> DataFrame:
    """doc_id, concept, field, term: for each concept and field of a work the first term found, in the order of terms. All fields are read in one pass."""
    found = matcher.find(docs, _terms(lexicon), fields)
    return found.groupBy("doc_id", "concept", "field").agg(F.min("term").alias("term"))


def roles(works: DataFrame, found: DataFrame, facets: DataFrame, title_share: Column | None = None, names_phenomenon: bool = True) -> DataFrame:
    """doc_id, role of each work from its evidence() (doc_id, concept, field) and the facets of concepts (concept, facet).

    CORE with evidence of a phenomenon; else, where the query names none and the share of its tokens in the title is 0.40 or more, CORE; else
    the facet of the most weighted evidence among MECHANISM, OUTCOME and METHOD, in this order on ties; else BACKGROUND."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in ROLE_WEIGHTS.items() for x in kv]), F.col("field"))
    per = found.join(small(facets, BROADCAST_TERMS), "concept").groupBy("doc_id").pivot("facet", ["PHENOMENON", "MECHANISM", "OUTCOME", "METHOD"]).agg(F.sum(F.coalesce(weight, F.lit(1))))
    out = works.join(per, "doc_id", "left")
    of = lambda f: F.coalesce(F.col(f), F.lit(0))
    most = F.greatest(of("MECHANISM"), of("OUTCOME"), of("METHOD"))
    by_title = F.coalesce(title_share >= ROLE_SHARE, F.lit(False)) if title_share is not None and not names_phenomenon else F.lit(False)
    role_of = F.when(of("PHENOMENON") > 0, "CORE").when(by_title, "CORE")
    for f in ("MECHANISM", "OUTCOME", "METHOD"):
        role_of = role_of.when((most > 0) & (of(f) == most), f)
    return out.select("doc_id", role_of.otherwise("BACKGROUND").alias("role"))


FIELD_LABELS = {"title": "title", "topics": "topic", "keywords": "keyword", "journal": "journal"}
REASON_EVIDENCE, REASON_FIELDS, REASON_TOKENS = 3, 3, 3


def reasons(results: DataFrame, roles_of: DataFrame, found: DataFrame, facets: DataFrame, parts: DataFrame, passages_of: DataFrame) -> DataFrame:
    """query, doc_id, reason of each result (query, doc_id): its role and what speaks for it, made of its own evidence.

    That is the first three of evidence() (doc_id, concept, field, term), by field and term; where there is none, the three longest tokens of three
    fields of contributions() (query, doc_id, field, token); and the places of its best_passages() (query, doc_id, ordinal)."""
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FIELD_LABELS.items() for x in kv]), F.col("field")), F.col("field"))
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, FIELD_LABELS)), F.col("field")), F.lit(0)), F.lit(9))
    mine = found.join(results.select("doc_id").distinct(), "doc_id", "left_semi").join(facets.select("concept", "facet").distinct(), "concept")
    item = F.struct(rank.alias("rank"), "term", "concept", F.concat(label, F.lit("「"), "term", F.lit("」→ "), "concept", F.lit(" ("), F.lower("facet"), F.lit(")")).alias("text"))
    said = mine.groupBy("doc_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_set(item)), 1, REASON_EVIDENCE), lambda x: x["text"]), "; ").alias("evidence"))
    longest = F.array_sort(F.filter(F.collect_set("token"), lambda w: F.length(w) > 1), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    fields = parts.join(results.select("query", "doc_id"), ["query", "doc_id"], "left_semi").groupBy("query", "doc_id", "field").agg(F.slice(longest, 1, REASON_TOKENS).alias("tokens"), F.sum("contribution").alias("weight")).where(F.size("tokens") > 0)
    shown = F.array_sort(F.collect_list(F.struct((-F.round("weight", 6)).alias("minus"), "field", F.concat("field", F.lit("「"), F.array_join("tokens", "/"), F.lit("」")).alias("text"))))
    lexical = fields.groupBy("query", "doc_id").agg(F.concat(F.lit("lexical match on "), F.array_join(F.transform(F.slice(shown, 1, REASON_FIELDS), lambda x: x["text"]), ", ")).alias("lexical"))
    places = passages_of.groupBy("query", "doc_id").agg(F.concat(F.lit("full text p."), F.array_join(F.transform(F.array_sort(F.collect_set(F.col("ordinal") + 1)), lambda x: x.cast("string")), ", ")).alias("places"))
    out = results.select("query", "doc_id").join(roles_of, "doc_id").join(said, "doc_id", "left").join(lexical, ["query", "doc_id"], "left").join(places, ["query", "doc_id"], "left")
    detail = F.nullif(F.concat_ws("; ", F.coalesce(F.nullif("evidence", F.lit("")), "lexical"), "places"), F.lit(""))
    return out.select("query", "doc_id", F.concat("role", F.lit(": "), F.coalesce(detail, F.lit("topic overlap only"))).alias("reason"))


ROLE_ORDER = ("CORE", "MECHANISM", "OUTCOME", "METHOD", "BACKGROUND")


def reading_pack(results: DataFrame, roles_of: DataFrame, hashes: DataFrame, n: int = 20) -> DataFrame:
    """query, place, role, doc_id, score, sha256: the n best results (query, doc_id, score, rank), by role and then rank."""
    best = results.where(F.col("rank") <= n).join(roles_of, "doc_id").join(hashes, "doc_id")
    order = F.array_position(F.array(*map(F.lit, ROLE_ORDER)), F.col("role"))
    return best.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(order, "rank"))).select("query", "place", "role", "doc_id", "score", "sha256")


def reranked(results: DataFrame, vectors: DataFrame, wanted: DataFrame, share: float = 0.5) -> DataFrame:
    """The results (query, doc_id, score) with a semantic part: score + share * best score * cosine of the vectors of query (query, vector) and
    document (doc_id, vector). Without vectors the lexical order stays."""
    both = results.join(wanted.withColumnRenamed("vector", "q"), "query", "left").join(vectors.withColumnRenamed("vector", "v"), "doc_id", "left")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cosine = dot("q", "v") / F.sqrt(dot("q", "q") * dot("v", "v"))
    lead = F.max("score").over(W.partitionBy("query"))
    return both.select("query", "doc_id", F.round(F.col("score") + share * lead * F.coalesce(cosine, F.lit(0.0)), 6).alias("score"))


# What a reader looks for in a work of each role.
GUIDANCE = {"CORE": "definitions, claims and main results", "MECHANISM": "channel and how it is tested", "OUTCOME": "measure of the outcome and effect size", "METHOD": "design, assumptions and data", "BACKGROUND": "context"}


def write_pack(pack: DataFrame, texts: DataFrame, queries: DataFrame, path: str, batch: str) -> bool:
    """Store reading packs (reading_pack(): query, place, role, doc_id, score, sha256) below `path` in one commit: their manifests, rankings, evidence plans and a text
    to read, all or none. False if the batch is there already. Packs refer to works; no text is copied.

    texts: doc_id, title, readable. queries: query, text."""
    named = F.concat(F.lit("pack-"), F.substring(F.sha2("text", 256), 1, 12))
    q = queries.select("query", "text", named.alias("pack"))
    rows = pack.join(texts, "doc_id", "left").join(q, "query")
    manifest = rows.groupBy("pack", "query", "text").agg(F.count("*").alias("entries"), F.count_distinct("doc_id").alias("works"), F.lit(0).alias("copies"), F.array_sort(F.collect_list(F.struct("place", "doc_id", "sha256"))).alias("contents"))
    ranking = rows.select("pack", "doc_id", "role", "score", F.row_number().over(W.partitionBy("pack").orderBy(F.col("score").desc(), "doc_id")).alias("rank"))
    guide = F.element_at(F.create_map(*[F.lit(x) for kv in GUIDANCE.items() for x in kv]), F.col("role"))
    plan = rows.select("pack", "place", "role", "doc_id", "title", guide.alias("extract"), F.coalesce("readable", F.lit(False)).alias("readable"), "sha256")
    line = F.concat(F.col("place").cast("string"), F.lit(". ["), "role", F.lit("] "), F.coalesce("title", F.lit("unknown")), F.when(F.coalesce("readable", F.lit(False)), "").otherwise(" (no readable text here)"))
    readme = rows.groupBy("pack", "text").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda x: x["line"]), "\n").alias("lines"))
    readme = readme.select("pack", F.concat(F.lit("# Reading pack: "), "text", F.lit("\n\n"), "lines", F.lit("\n")).alias("readme"))
    return commits.commit(path, "packs", batch, adds={"manifest": manifest, "ranking": ranking, "evidence_plan": plan, "readme": readme})
