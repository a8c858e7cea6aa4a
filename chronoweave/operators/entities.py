"""Entities: resolution, views, merges, variants, and what is left over."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import temporal
from chronoweave.session import numbered


def resolve(names: DataFrame, entities: DataFrame, aliases: DataFrame, prefix: bool = False) -> DataFrame:
    """(name, entity_id, how) for each distinct name: exact, else live alias, else (if asked) the most seen name that begins with it.

    Names without a match are absent. Of several aliases the most confident, then the smallest entity id wins.
    """
    asked = names.select("name", S.canonical_name(F.col("name")).alias("c")).where("c <> ''").distinct()
    ent = entities.select(F.col("id").alias("entity_id"), S.canonical_name(F.col("name")).alias("c"), "seen_count")
    exact = asked.join(ent, "c").select("name", "entity_id", F.lit("exact").alias("how"), F.lit(0).alias("pri"), F.col("seen_count").cast("double").alias("w"))
    live = aliases.where("valid_to IS NULL").join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")
    al = live.select("entity_id", S.canonical_name(F.col("alias")).alias("c"), "confidence").distinct()
    by_alias = asked.join(al, "c").select("name", "entity_id", F.lit("alias").alias("how"), F.lit(1).alias("pri"), F.col("confidence").alias("w"))
    found = exact.unionByName(by_alias)
    if prefix:
        # Each entity under all its beginnings: an equi-join instead of a comparison of all pairs.
        starts = ent.select("entity_id", "seen_count", F.explode(F.transform(F.sequence(F.lit(1), F.length("c")), lambda i: F.substr(F.col("c"), F.lit(1), i))).alias("c"))
        found = found.unionByName(asked.join(starts, "c").select("name", "entity_id", F.lit("prefix").alias("how"), F.lit(2).alias("pri"), F.col("seen_count").cast("double").alias("w")))
    w = Window.partitionBy("name").orderBy("pri", F.desc("w"), "entity_id")
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("name", "entity_id", "how")


def entity_facts(links: DataFrame, facts: DataFrame, now: float, k: int) -> DataFrame:
    """(entity_id, fact_id, rank, mass): the k live facts of greatest rounded decayed mass of each entity."""
    mass = F.round(S.decayed_mass(F.col("kind"), F.col("mass"), F.col("valid_from"), now), 3)
    w = Window.partitionBy("entity_id").orderBy(F.desc("m"), "fact_id")
    rows = links.join(temporal.live(facts).select(F.col("id").alias("fact_id"), mass.alias("m")), "fact_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("entity_id", "fact_id", "rank", F.col("m").alias("mass"))


def neighbours(edges: DataFrame) -> DataFrame:
    """(id, other, count): undirected edges from both ends."""
    return edges.select(F.col("a").alias("id"), F.col("b").alias("other"), "count").unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("other"), "count"))


def co_mentions(edges: DataFrame, k: int = 15) -> DataFrame:
    """(id, other, count, rank): the k entities most often mentioned with each."""
    w = Window.partitionBy("id").orderBy(F.desc("count"), "other")
    return neighbours(edges).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def link(new_links: DataFrame, seen_at: DataFrame, entities: DataFrame, links: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The tables after linking facts(fact_id, entity_id), seen at seen_at(fact_id, t): each new link adds one to the entity's
    seen_count, each pair of entities of a fact one to their edge; last_seen only grows. Links that exist change nothing."""
    fresh = new_links.distinct().join(links, ["fact_id", "entity_id"], "left_anti").join(seen_at, "fact_id")
    more = fresh.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("__n"), F.max("t").alias("__t"))
    ent = entities.join(more, "id", "left").withColumns({"seen_count": F.col("seen_count") + F.coalesce("__n", F.lit(0)), "last_seen": F.greatest("last_seen", "__t")}).drop("__n", "__t")
    per = fresh.groupBy("fact_id").agg(F.sort_array(F.collect_set("entity_id")).alias("es"), F.max("t").alias("t"))
    pairs = per.select(F.explode(F.expr("flatten(transform(es, (x, i) -> transform(slice(es, i + 2, size(es)), y -> struct(x AS a, y AS b))))")).alias("p"), "t").select("p.a", "p.b", F.lit(1).cast("bigint").alias("count"), F.col("t").alias("last_seen"))
    both = edges.select("a", "b", "count", "last_seen").unionByName(pairs).groupBy("a", "b").agg(F.sum("count").alias("count"), F.max("last_seen").alias("last_seen"))
    return {"entities": ent.select(*entities.columns), "links": links.unionByName(fresh.select("fact_id", "entity_id")), "edges": both}


def variant_groups(entities: DataFrame) -> DataFrame:
    """(key, winner, losers, seen): names that differ only in case, dashes, dots, blanks; the most seen wins, the smallest id of equals."""
    e = entities.select("id", S.variant_key(F.col("name")).alias("key"), "seen_count").where("key <> ''")
    best = F.max_by("id", F.struct("seen_count", -F.col("id")))
    g = e.groupBy("key").agg(best.alias("winner"), F.sort_array(F.collect_set("id")).alias("ids"), F.sum("seen_count").alias("seen")).where(F.size("ids") > 1)
    return g.select("key", "winner", F.array_except("ids", F.array("winner")).alias("losers"), "seen")


def merge_map(groups: DataFrame) -> DataFrame:
    """(old, new) of variant_groups."""
    return groups.select(F.explode("losers").alias("old"), F.col("winner").alias("new"))


def remap(df: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """df with ids replaced by mapping(old, new)."""
    order = df.columns
    for c in columns:
        m = mapping.select(F.col("old").alias(c), F.col("new").alias("__new"))
        df = df.join(m, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return df.select(*order)


def merge(
    mapping: DataFrame, entities: DataFrame, links: DataFrame, edges: DataFrame, aliases: DataFrame, triples: DataFrame | None = None, observations: DataFrame | None = None, now: float | None = None
) -> dict[str, DataFrame]:
    """The tables after a merge: links repointed and distinct, edges folded (self-edges dropped, an existing edge's last_seen kept),
    triples (both ends) and metric observations repointed, aliases repointed and, if ``now`` is given, each loser's name made a live alias of its
    winner; losers' seen counts added to the winner and their rows removed."""
    moved = remap(edges.withColumn("old_pair", F.struct("a", "b")), mapping, "a", "b").where("a <> b")
    own = (F.least("a", "b") == F.col("old_pair.a")) & (F.greatest("a", "b") == F.col("old_pair.b"))
    folded = moved.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("count").alias("count"), F.coalesce(F.max(F.when(own, F.col("last_seen"))), F.max("last_seen")).alias("last_seen"))
    gained = entities.join(mapping.withColumnRenamed("old", "id"), "id").groupBy(F.col("new").alias("id")).agg(F.sum("seen_count").alias("more"))
    kept = entities.join(mapping.select(F.col("old").alias("id")), "id", "left_anti").join(gained, "id", "left")
    more = {}
    if triples is not None:
        more["triples"] = remap(triples, mapping, "subject_id", "object_id")
    if observations is not None:
        more["observations"] = remap(observations, mapping, "entity_id")
    if now is not None:
        known = aliases.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        names = entities.join(mapping.withColumnRenamed("old", "id"), "id").select(F.col("new").alias("entity_id"), F.col("name").alias("alias"), F.col("id").alias("old"))
        stamp = {"valid_from": F.lit(now), "valid_to": F.lit(None).cast("double"), "recorded_at": F.lit(now), "confidence": F.lit(1.0)}
        said = numbered(names, ["old"], "id", known + 1).withColumns(stamp).select("id", "entity_id", "alias", *stamp)
        aliases = aliases.select("id", "entity_id", "alias", *stamp).unionByName(said)
    return {
        **more,
        "entities": kept.withColumn("seen_count", F.col("seen_count") + F.coalesce("more", F.lit(0))).drop("more"),
        "links": remap(links, mapping, "entity_id").distinct(),
        "edges": folded,
        "aliases": remap(aliases, mapping, "entity_id").dropDuplicates(["id"]),
    }


def unused(entities: DataFrame, links: DataFrame, edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Ids of entities that no fact, edge or live alias refers to."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"))
    used = links.select(F.col("entity_id").alias("id")).unionByName(ends).unionByName(aliases.where("valid_to IS NULL").select(F.col("entity_id").alias("id")))
    return entities.select("id").join(used, "id", "left_anti")


def resolve_or_create(names: DataFrame, entities: DataFrame, aliases: DataFrame, next_id: int) -> tuple[DataFrame, DataFrame]:
    """(assignments, new entities) for names(pos, name) in order of pos: exact, alias, then a unique variant key; else a new entity.

    assignments: (pos, name, entity_id, how). Names that agree by variant key within the batch share the entity the first of them makes;
    names that aren't valid and unknown get none. New entities (id, name, display) are numbered from next_id in order of their first mention.
    """
    known = resolve(names, entities, aliases)
    keys = entities.groupBy(S.variant_key(F.col("name")).alias("key")).agg(F.count("*").alias("n"), F.min("id").alias("entity_id")).where("n = 1 AND key <> ''")
    by_key = names.join(known, "name", "left_anti").where(S.entity_name_ok(F.trim("name"))).select("pos", "name", S.variant_key(F.col("name")).alias("key"))
    folded = by_key.join(keys.select("key", "entity_id"), "key")
    rest = by_key.join(folded.select("pos"), "pos", "left_anti")
    first = numbered(rest.groupBy("key").agg(F.min(F.struct("pos", "name")).alias("f")).select("key", "f.pos", F.col("f.name").alias("display")), ["pos"], "entity_id", next_id)
    made = rest.join(first.select("key", "entity_id"), "key")
    done = names.join(known, "name").select("pos", "name", "entity_id", "how").unionByName(folded.select("pos", "name", "entity_id", F.lit("variant").alias("how"))).unionByName(made.select("pos", "name", "entity_id", F.lit("new").alias("how")))
    return done, first.select(F.col("entity_id").alias("id"), S.canonical_name(F.col("display")).alias("name"), "display")
