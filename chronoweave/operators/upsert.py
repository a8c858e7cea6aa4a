"""One batch of facts into the graph: insertion, restatement, links, co-mention edges, closures and their edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import entities as E
from chronoweave.operators import ingest, truth
from chronoweave.session import materialize

NEW_FACT = {"superseded_at": "double", "superseded_by": "bigint", "corroborations": "int"}


def facts(store: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, inserted) of the store after batch(pos, ... the store's columns but id).

    The first of the batch to say something new becomes a fact with its pos as id. What a live fact or an earlier one of the batch
    says already is no new fact; from another session it corroborates that one, moves its valid_from to the latest time it was said to be true,
    and makes it verified if it was said as verified.
    """
    insert, again = ingest.deduplicate(batch, store)
    empty = {c: F.lit(None if c != "corroborations" else 0).cast(t) for c, t in NEW_FACT.items() if c in store.columns}
    fresh = materialize(insert.withColumn("id", F.col("pos")).withColumns(empty).select(*store.columns), "inserted")
    said = again.select(F.coalesce("id", "pos").alias("id"), "times", "last", "verified").groupBy("id").agg(F.sum("times").alias("times"), F.max("last").alias("last"), F.bool_or("verified").alias("verified"))
    return ingest.corroborate(store.unionByName(fresh), said), fresh


def links(inserted: DataFrame, entities: DataFrame, aliases: DataFrame, known: DataFrame, edges: DataFrame, now: float) -> dict[str, DataFrame]:
    """entities, links and edges (co-mentions) after the inserted facts' entity names were resolved, or made new entities.

    Each new link counts one for its entity and each pair of a fact's entities one for their edge, seen at ``now``.
    """
    said = inserted.select(F.col("id").alias("fact_id"), F.posexplode("entities").alias("no", "name")).where(S.entity_name_ok(S.canonical_name(F.col("name"))))
    # Names in order of fact and mention; each once, for whoever says it first.
    names = said.groupBy("name").agg(F.min(F.struct("fact_id", "no")).alias("pos")).select("pos", "name")
    next_id = entities.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0] + 1
    done, made = E.resolve_or_create(names, entities, aliases, next_id)
    done = materialize(done.select("name", "entity_id"), "resolved")
    fields = {"etype": F.lit(None).cast("string"), "vkey": S.variant_key(F.col("name")), "seen_count": F.lit(0).cast("bigint"), "last_seen": F.lit(float(now))}
    everyone = entities.unionByName(made.withColumns({c: v for c, v in fields.items() if c in entities.columns}).select(*entities.columns))
    fresh = said.join(done, "name").select("fact_id", "entity_id").distinct()
    return E.link(fresh, fresh.select("fact_id").distinct().withColumn("t", F.lit(float(now))), everyone, known, edges)


def closures(facts_: DataFrame, relations: DataFrame, verdicts: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """(facts, edges) after verdicts(old, new, verdict): 'supersedes' closes the old fact, if it is still open, and both kinds leave an edge new -> old; an edge that exists stays as it is."""
    judged = verdicts.where("verdict IN ('supersedes', 'contradicts') AND old <> new")
    closed = truth.close(facts_, judged.where("verdict = 'supersedes'").select("old", "new"), now)
    said = judged.select(F.col("new").alias("src"), F.col("old").alias("dst"), F.col("verdict").alias("edge_type"), F.lit(float(now)).alias("recorded_at")).distinct()
    kept = relations.groupBy("src", "dst", "edge_type").agg(F.min("recorded_at").alias("recorded_at"))
    return closed, ingest.keyed_merge(kept, said, ["src", "dst", "edge_type"], new_wins=False)


def trace_prune(traces: DataFrame, keep_from: float) -> DataFrame:
    """Traces since a moment."""
    return traces.where(F.col("ts") >= keep_from)
