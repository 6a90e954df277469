"""Taxonomy classification: signals by field, confidence, decisions, backtest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as t
from lectern.operators import matcher

# What a field's evidence weighs, and when a label is assigned.
FIELD_WEIGHTS = {"title": 3.0, "keywords": 2.0, "abstract": 1.5, "journal": 0.5, "fulltext": 1.0}
HALF = 3.0  # the score of confidence one half
ASSIGN, SPLIT, SHARE, MOST = 0.75, 0.30, 0.70, 3
FULLTEXT_TERMS = 3
# Titles that are about a method itself, what such a title counts, and the phrase that is no evidence beside it.
METHOD_TITLE = (
    r"(?i)^(?:double(?:\s*[/\-]\s*debiased)?|debiased)\s+machine\s+learning\s+for\s+"
    r"(?:treatment\s+and\s+structural\s+parameters|treatment\s+parameters|structural\s+parameters|treatment\s+effects|causal\s+parameters|"
    r"causal\s+inference|semiparametric\s+(?:estimation|inference)|difference[\s-]+in[\s-]+differences(?:\s+models)?)\s*[.?!]?$"
)
METHOD_WEIGHT = 9.0
METHOD_PHRASE = r"(?i)\bmachine\s+learning\b|机器学习"


def name_terms(taxonomy: DataFrame) -> DataFrame:
    """label, term: the parts of each label's name (label, name) of two characters or more, else the whole name."""
    parts = F.filter(F.transform(F.split("name", "[与和、及/]+"), t.fold), lambda p: F.length(p) >= 2)
    return taxonomy.select("label", F.explode(F.when(F.size(parts) > 0, parts).otherwise(F.array(t.fold(F.col("name"))))).alias("term"))


def signals(works: DataFrame, concepts: DataFrame, names: DataFrame, fields: list[str], aliases: DataFrame | None = None, method_label: str | None = None) -> DataFrame:
    """doc_id, label, score, named: the evidence of each label in the fields of each work.

    concepts: concept, label, term; each term counts its field's weight for each label of its concept, in full texts the three longest of a
    concept. names: label, term; each counts weight * min(1.5 * length, 6) / 3. aliases: label, term; of a label's one alias of a field counts, that of most
    words, then the longest: weight * min(3 * words, 6) / 3. A title about a method counts 9 for `method_label`, and its phrase is no evidence then.
    All terms of all kinds are one automaton, which passes over each field of a work once; the terms' table is joined to what it finds."""
    one = lambda df, kind, times: df.select(F.lit(kind).alias("kind"), (F.col("concept") if kind == "concept" else F.lit("")).alias("concept"), "label", "term", times.alias("times")).distinct()
    words = F.size(F.split("term", " "))
    terms = one(concepts, "concept", F.lit(1.0)).unionByName(one(names, "name", F.least(1.5 * F.length("term"), F.lit(6.0)) / 3))
    if aliases is not None:
        terms = terms.unionByName(one(aliases, "alias", F.least(3.0 * words, F.lit(6.0)) / 3))
    method = F.trim(F.regexp_replace("title", r"\s+", " ")).rlike(METHOD_TITLE) if method_label else F.lit(False)
    said = lambda f: F.when(method, F.regexp_replace(f, METHOD_PHRASE, " ")).otherwise(F.col(f)) if method_label else F.col(f)
    texts = works.select("doc_id", method.alias("method"), *[said(f).alias(f) for f in fields])
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in FIELD_WEIGHTS.items() for x in kv]), F.col("field"))
    hits = matcher.find(texts, terms, fields).select("doc_id", "kind", "concept", "label", "field", "term", (weight * F.col("times")).alias("weight"))
    place = F.dense_rank().over(W.partitionBy("doc_id", "kind", "concept", "field").orderBy(F.length("term").desc(), "term"))
    best = F.row_number().over(W.partitionBy("doc_id", "kind", "label", "field").orderBy(F.size(F.split("term", " ")).desc(), F.length("term").desc(), "term"))
    hits = hits.withColumns({"place": place, "best": best})
    hits = hits.where(F.when(F.col("kind") == "alias", F.col("best") == 1).when((F.col("kind") == "concept") & (F.col("field") == "fulltext"), F.col("place") <= FULLTEXT_TERMS).otherwise(True))
    hits = hits.select("doc_id", "label", "weight", F.col("kind").isin("name", "alias").alias("named"))
    if method_label:
        hits = hits.unionByName(texts.where("method").select("doc_id", F.lit(method_label).alias("label"), F.lit(METHOD_WEIGHT).alias("weight"), F.lit(False).alias("named")))
    return hits.groupBy("doc_id", "label").agg(F.round(F.sum("weight"), 6).alias("score"), F.bool_or("named").alias("named"))


def decide(scored: DataFrame, works: DataFrame | None = None) -> DataFrame:
    """doc_id, label, score, confidence, decision, reason, status of each signal, and one row for each of `works` (doc_id) without any.

    The leader, by score and then label, is assigned from confidence 0.75 on. Others of at least 0.70 of its score are assigned if their
    name was found, three in all, else suggested. A weak leader leaves all for review; so does a work without a signal."""
    order = W.partitionBy("doc_id").orderBy(F.col("score").desc(), "label")
    s = scored.withColumn("rank", F.row_number().over(order)).withColumn("lead", F.max("score").over(W.partitionBy("doc_id")))
    s = s.withColumn("confidence", F.round(F.col("score") / (F.col("score") + HALF), 6)).withColumn("lead_confidence", F.col("lead") / (F.col("lead") + HALF))
    close = (F.col("rank") > 1) & F.col("named") & (F.col("score") >= SHARE * F.col("lead"))
    s = s.withColumn("place", F.when(close, F.sum(close.cast("int")).over(order)))
    if works is not None:
        s = works.select("doc_id").join(s, "doc_id", "left")
    weak = F.col("lead").isNull() | (F.col("lead_confidence") < ASSIGN)
    decision = F.when(weak, "REVIEW_REQUIRED").when((F.col("rank") == 1) | (F.col("place") < MOST), "ASSIGNED").when(F.col("score") >= SHARE * F.col("lead"), "SUGGESTED").otherwise("IGNORED")
    reason = (
        F.when(F.col("lead").isNull(), "NO_TAXONOMY_CONCEPT_MATCHED").when(F.col("lead_confidence") < SPLIT, "BELOW_REVIEW_THRESHOLD").when(weak, "BELOW_AUTO_ASSIGN_THRESHOLD").otherwise("AUTO_ASSIGNED_FROM_FROZEN_TAXONOMY")
    )
    s = s.withColumn("decision", decision).withColumn("reason", reason)
    suggested = F.max((F.col("decision") == "SUGGESTED").cast("int")).over(W.partitionBy("doc_id")) == 1
    status = F.when(F.col("decision") == "REVIEW_REQUIRED", "REVIEW_REQUIRED").when(suggested, "CLASSIFIED_WITH_REVIEW_SUGGESTIONS").otherwise("CLASSIFIED")
    return s.select("doc_id", "label", "score", "confidence", "decision", "reason", status.alias("status"))


def confirm(topics: DataFrame, proposals: DataFrame, chosen: DataFrame, preview: str, shown: str) -> DataFrame:
    """doc_id, labels, status of each work of `topics` (doc_id, labels: array): what a person's choice (doc_id, label) makes of it.

    Topics that are there stay. Else the chosen labels that were proposed (doc_id, label) are confirmed; a label that was not proposed refuses
    the work's choice, and so does every choice if the fingerprint of the preview is not the one that was shown."""
    pick = chosen.distinct().join(proposals.select("doc_id", "label").distinct().withColumn("raised", F.lit(True)), ["doc_id", "label"], "left")
    pick = pick.groupBy("doc_id").agg(F.sort_array(F.collect_set("label")).alias("picked"), F.bool_and(F.coalesce("raised", F.lit(False))).alias("raised"))
    out = topics.join(pick, "doc_id", "left")
    there = F.size(F.coalesce("labels", F.array().cast("array<string>"))) > 0
    status = F.when(there, "SKIPPED_EXISTING").when(F.col("picked").isNull(), "REVIEW_REQUIRED").when(F.lit(preview != shown), "FAILED_SAFE").when(~F.col("raised"), "FAILED_SAFE").otherwise("HUMAN_CONFIRMED")
    labels = F.when(status == "HUMAN_CONFIRMED", F.col("picked")).otherwise(F.coalesce("labels", F.array().cast("array<string>")))
    return out.select("doc_id", labels.alias("labels"), status.alias("status"))


def reclassify(asked: DataFrame, current: DataFrame, proposals: DataFrame) -> DataFrame:
    """doc_id, status, labels of each request to classify a work anew (doc_id, reason, expected: array or null, fingerprint, authorised, dry): the labels after it.

    current: doc_id, labels (array, in order), source (AUTOMATIC or HUMAN_CONFIRMED, null where unknown), fingerprint of the work as it is. proposals:
    decide(). No labels are taken from the request: they are what the classifier assigns, by score. To apply, the labels or the
    fingerprint that the request expects have to be those that are there; labels that a person has confirmed need an authorisation of just this
    fingerprint; where it is not known who gave the labels nothing is changed."""
    assigned = proposals.where("decision = 'ASSIGNED'").groupBy(F.col("doc_id").alias("_new")).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "label"))).alias("made"))
    here = current.select(F.col("doc_id").alias("_doc"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"), "source", F.col("fingerprint").alias("now"))
    out = asked.join(here, F.col("doc_id") == F.col("_doc"), "left").join(assigned, F.col("doc_id") == F.col("_new"), "left")
    new = F.transform(F.coalesce("made", F.array().cast("array<struct<minus:double,label:string>>")), lambda x: x["label"])
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    status = (
        F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", "REASON_REQUIRED").when(~F.col("dry") & F.col("expected").isNull() & F.col("fingerprint").isNull(), "PRECONDITION_REQUIRED").when(F.col("_doc").isNull(), "WORK_NOT_FOUND")
        .when(F.size("labels") == 0, "WORK_UNFILED").when(differs("expected", "labels") | differs("fingerprint", "now"), "PRECONDITION_CONFLICT").when(F.size(new) == 0, "REVIEW_REQUIRED").when(F.col("dry"), "DRY_RUN")
        .when(F.col("source").isNull(), "UNKNOWN_PROVENANCE").when((F.col("source") == "HUMAN_CONFIRMED") & ~F.coalesce(F.col("authorised") == F.col("now"), F.lit(False)), "HUMAN_AUTHORIZATION_REQUIRED")
        .when(F.col("labels") == new, "ALREADY_CURRENT").otherwise("APPLIED")
    )
    out = out.withColumn("status", status)
    return out.select("doc_id", "status", F.when(F.col("status").isin("APPLIED", "DRY_RUN"), new).otherwise(F.coalesce("labels", F.array().cast("array<string>"))).alias("labels"))


def topic_links(works: DataFrame, root: str) -> DataFrame:
    """doc_id, domain, topic, view_path, link_type, sha256, version_role: a row for each topic of each work (doc_id, name, topics: array of struct (domain, subtopic),
    sha256, version_role), which says where its view is to stand."""
    label = works.select("doc_id", "name", "sha256", "version_role", F.posexplode("topics").alias("place", "x"))
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")))
    return label.select("doc_id", F.col("x.domain").alias("domain"), F.col("x.subtopic").alias("topic"), F.concat_ws("/", F.lit(root), "x.domain", "x.subtopic", name).alias("view_path"), F.lit("HARDLINK").alias("link_type"), "sha256", F.coalesce("version_role", F.lit("PRIMARY_CANONICAL")).alias("version_role"))


def outside(labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Labels that the taxonomy does not have."""
    return labels.select("label").distinct().join(taxonomy.select("label").distinct(), "label", "left_anti")


def backtest(predicted: DataFrame, settled: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """works, precision, recall, top1, coverage, review of predicted (doc_id, label, score) against settled (doc_id, label): top1 is the share of
    leaders that are right, review the share of settled works that `review` (doc_id) holds."""
    p = predicted.groupBy("doc_id", "label").agg(F.max("score").alias("score"))
    p = p.withColumn("p", F.lit(1)).withColumn("lead", (F.row_number().over(W.partitionBy("doc_id").orderBy(F.col("score").desc(), "label")) == 1).cast("int"))
    s = settled.select("doc_id", "label").distinct().withColumn("s", F.lit(1))
    both = s.join(p, ["doc_id", "label"], "full").join(settled.select("doc_id").distinct(), "doc_id", "left_semi")
    per = both.groupBy("doc_id").agg(F.sum(F.col("p") * F.col("s")).alias("hits"), F.sum("p").alias("p"), F.sum("s").alias("s"), F.sum(F.col("lead") * F.col("s")).alias("first"))
    if review is not None:
        per = per.join(review.select("doc_id").distinct().withColumn("r", F.lit(1)), "doc_id", "left")
    else:
        per = per.withColumn("r", F.lit(0))
    return per.agg(
        F.count("*").alias("works"), F.round(F.sum("hits") / F.sum("p"), 6).alias("precision"), F.round(F.coalesce(F.sum("hits"), F.lit(0)) / F.sum("s"), 6).alias("recall"),
        F.round(F.coalesce(F.sum("first"), F.lit(0)) / F.count_if(F.col("p") > 0), 6).alias("top1"), F.round(F.count_if(F.col("p") > 0) / F.count("*"), 6).alias("coverage"), F.round(F.coalesce(F.sum("r"), F.lit(0)) / F.count("*"), 6).alias("review"),
    )
