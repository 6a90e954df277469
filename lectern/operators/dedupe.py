"""Work deduplication by several keys, in the order of the records."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lectern.functions import text as t
from lectern.sources.shared import keep

# How good a publication status is.
STATUS_RANK = {
    "PeerReviewedJournalArticle": 80, "OnlineFirst": 70, "AcceptedManuscript": 60, "ConferencePaper": 50, "WorkingPaper": 40, "Preprint": 30, "ProfessionalArticle": 20, "Other": 10, "Unknown": 0,
}
KINDS = ("doi", "title_year", "title_author", "sha256")


def keys(records: DataFrame) -> DataFrame:
    """position, kind, key: up to four keys of each record (position, doi, title, year, first_author, sha256)."""
    title, author = t.normalize_title(F.col("title")), t.normalize_title(F.col("first_author"))
    values = (t.normalize_doi(F.col("doi")), F.concat_ws("|", title, "year"), F.concat_ws("|", title, author), F.lower("sha256"))
    known = (values[0].isNotNull(), title.isNotNull() & F.col("year").isNotNull(), title.isNotNull() & author.isNotNull(), F.col("sha256").isNotNull() & (F.col("sha256") != ""))
    items = F.array(*[F.struct(F.lit(n).alias("kind"), F.when(ok, v).alias("key")) for n, (v, ok) in enumerate(zip(values, known, strict=True))])
    return records.select("position", F.explode(F.filter(items, lambda i: i["key"].isNotNull())).alias("i")).select("position", "i.kind", "i.key")


def components(keyed: DataFrame, rounds: int = 50) -> DataFrame:
    """position, component: the smallest position that a record reaches over shared keys.

    Each key links its records to its smallest, so that a key of any number of records gives one link each; labels then fall along
    links and jump along labels until none changes. Each round is written to the shared folder."""
    keyed = keep(keyed.select("position", "kind", "key"), "keys")
    first = keep(keyed.groupBy("kind", "key").agg(F.min("position").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared-keys")
    links = keyed.join(first, ["kind", "key"]).where("position <> low").select(F.col("position").alias("a"), F.col("low").alias("b")).distinct()
    links = keep(links.union(links.select("b", "a")))
    label = keep(links.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("l")))
    for _ in range(rounds):
        seen = links.join(label, F.col("b") == F.col("n")).groupBy("a").agg(F.min("l").alias("m"))
        hooked = label.join(seen, F.col("n") == F.col("a")).select("n", "l", F.least("l", "m").alias("x"))
        up = label.select(F.col("n").alias("un"), F.col("l").alias("ul"))
        moved = keep(hooked.join(up, F.col("x") == F.col("un")).select("n", F.least("x", "ul").alias("l"), (F.least("x", "ul") != F.col("l")).alias("moved")))
        label = moved.select("n", "l")
        if not moved.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    alone = keyed.select("position").distinct().join(label, F.col("position") == F.col("n"), "left")
    return alone.select("position", F.coalesce("l", "position").alias("component"))


class _Group:
    """Records that are one work so far, and the publication statuses under which it has DOIs."""

    def __init__(self, position: int, status: str, doi: str | None):
        self.members = [position]
        self.known = {status} if doi else set()

    def clashes(self, other: _Group) -> bool:
        """Whether both know DOIs under one status. A DOI's key is a record's first and always joins: no DOI is in two groups, so these are others."""
        return not self.known.isdisjoint(other.known)

    def absorb(self, other: _Group) -> None:
        self.members += other.members
        self.known |= other.known


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    """The groups of one component, its records taken in order: a title key does not join groups whose known DOIs under one status
    are disjoint; other keys always join. A record's group is told by its smallest position."""
    group: dict[int, _Group] = {}
    owner: dict[tuple, int] = {}
    for position, status, doi, own in pdf.sort_values("position")[["position", "status", "doi", "keys"]].itertuples(index=False, name=None):
        group[position] = _Group(position, status, doi if isinstance(doi, str) else None)
        for kind, key in ((k["kind"], k["key"]) for k in own):
            first = owner.setdefault((kind, key), position)
            mine, theirs = group[position], group[first]
            if mine is theirs or (KINDS[kind].startswith("title") and mine.clashes(theirs)):
                continue
            large, small = (mine, theirs) if len(mine.members) > len(theirs.members) else (theirs, mine)
            large.absorb(small)
            group.update(dict.fromkeys(small.members, large))
    lowest = {id(g): min(g.members) for g in group.values()}
    return pd.DataFrame([(p, lowest[id(g)]) for p, g in group.items()], columns=["position", "grp"])


def deduplicate(records: DataFrame) -> DataFrame:
    """position, canonical, duplicate, versions, reason of each record (position, doi, title, year, first_author, sha256, status, downloaded).

    Records interact only through shared keys, so the rule that depends on their order runs inside components, and only in those that
    hold different DOIs under one status: such a component, records without their texts, is folded in one task. The canonical record
    of a group is the best by status, known DOI, download and year, the first of equals."""
    keyed = keep(keys(records), "record-keys")
    base = records.select("position", t.normalize_doi(F.col("doi")).alias("doi"), t.normalize_title(F.col("title")).alias("title"), "year", t.normalize_title(F.col("first_author")).alias("author"), F.lower("sha256").alias("sha256"), "status", "downloaded")
    base = keep(base.join(components(keyed), "position", "left").withColumn("component", F.coalesce("component", "position")), "records")
    # Only where records of one status have different DOIs can a title key fail to join: elsewhere the component is the group.
    dois = base.where("doi IS NOT NULL").groupBy("component", "status").agg(F.min("doi").alias("low"), F.max("doi").alias("high"))
    disputed = keep(dois.where("low <> high").select("component").distinct(), "disputed")
    several = base.join(disputed, "component", "left_semi")
    own = keyed.join(several.select("position"), "position", "left_semi").groupBy("position").agg(F.sort_array(F.collect_list(F.struct("kind", "key"))).alias("keys"))
    members = several.select("position", "component", "status", "doi").join(own, "position")
    folded = members.groupBy("component").applyInPandas(lambda pdf: _ordered(pdf), "position long, grp long")
    grouped = folded.unionByName(base.join(disputed, "component", "left_anti").select("position", F.col("component").cast("long").alias("grp")))
    rows = base.join(grouped, "position", "left").withColumn("grp", F.coalesce("grp", "position"))
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv]), F.col("status")), F.lit(0))
    quality = F.struct(rank.alias("a"), F.col("doi").isNotNull().alias("b"), "downloaded", F.coalesce(F.col("year").cast("int"), F.lit(0)).alias("c"), (-F.col("position")).alias("d"))
    best = rows.groupBy("grp").agg(
        F.max_by(F.struct("position", "doi", "title", "year", "author", "sha256"), quality).alias("best"), (F.count_distinct("status") > 1).alias("s"), (F.count_distinct(F.coalesce("title", F.lit(""))) == 1).alias("t")
    )
    out = rows.join(best, "grp")
    b = F.col("best")
    reason = (
        F.when(F.col("doi") == b["doi"], "DOI exact match")
        .when((F.col("title") == b["title"]) & (F.col("year") == b["year"]), "normalized title + year")
        .when((F.col("title") == b["title"]) & (F.col("author") == b["author"]), "title + first author")
        .when(F.col("sha256") == b["sha256"], "SHA256 identical file")
        .otherwise("same-work evidence")
    )
    duplicate = F.col("position") != b["position"]
    return out.select("position", b["position"].alias("canonical"), duplicate.alias("duplicate"), (F.col("s") & F.col("t")).alias("versions"), F.when(duplicate, reason).alias("reason"))
