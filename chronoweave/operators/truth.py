"""Truth maintenance: missed supersessions, re-audits, conflicts, verdict statistics, predicate folding.

Candidates are plans; verdicts come as a table; applying them is a function from tables to tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import temporal
from chronoweave.session import materialize

DAY = 86_400.0


def _best_pairs(gap: float, min_cos: float):
    """Rows sorted by (entity, kind, cell): the best ``keep`` pairs of each cell, older before newer, by one matrix product."""

    def best(rows: list[tuple]) -> list[tuple]:
        entity, i, j, keep = rows[0][0], rows[0][2], rows[0][3], rows[0][8]
        left = [r for r in rows if r[4] == i]
        right = [r for r in rows if r[4] == j]
        if not left or not right:
            return []
        ids, t, v = (np.array([r[k] for r in left]) for k in (5, 6, 7))
        ids2, t2, v2 = (np.array([r[k] for r in right]) for k in (5, 6, 7))
        sim = np.round(v @ v2.T, 9)
        ok = (np.abs(t2[None, :] - t[:, None]) > gap) & (sim > min_cos)
        if i == j:
            ok &= np.triu(np.ones_like(ok), 1).astype(bool)
        x, y = np.nonzero(ok)
        older = np.where(t[x] < t2[y], ids[x], ids2[y])
        newer = np.where(t[x] < t2[y], ids2[y], ids[x])
        order = np.lexsort((newer, older, -sim[x, y]))[:keep]
        return [(entity, int(older[k]), int(newer[k]), float(sim[x[k], y[k]])) for k in order]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        names = ["entity_id", "older", "newer", "sim"]
        for b in batches:
            out = []
            for r in b.itertuples(index=False, name=None):
                if held and r[:4] != held[0][:4]:
                    out += best(held)
                    held = []
                held.append(r)
            if out:
                yield pd.DataFrame(out, columns=names)
        if held and (out := best(held)):
            yield pd.DataFrame(out, columns=names)

    return run


def sweep_candidates(facts: DataFrame, links: DataFrame, vectors: DataFrame, done: DataFrame, per_entity: int = 20, max_pairs: int = 500, gap_days: float = 3.0, min_cos: float = 0.60, block: int = 2_000) -> DataFrame:
    """(older, newer, sim): live facts of one entity and kind, more than gap_days apart and more similar than min_cos.

    The best per_entity pairs of each entity count, then each pair once, then the best
    max_pairs of all. Pairs in ``done`` (either way round) are out. A group of facts is split into blocks of about ``block``;
    each pair of blocks is one cell, which emits no more than an entity can keep, so neither a group nor its pairs are ever gathered.
    """
    v = vectors.select(F.col("id").alias("fact_id"), S.l2_normalize(F.col("vec")).alias("v"))
    f = temporal.live(facts).select(F.col("id").alias("fact_id"), "kind", "valid_from")
    rows = links.join(f, "fact_id").join(v, "fact_id")
    either = materialize(done.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "done")
    # What is done already may fill the best places of a cell: that many more are kept.
    spare = either.join(links.select(F.col("fact_id").alias("lo"), "entity_id"), "lo").join(links.select(F.col("fact_id").alias("hi"), "entity_id"), ["hi", "entity_id"], "left_semi").groupBy("entity_id").agg(F.count("*").alias("spare"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    size = rows.groupBy("entity_id", "kind").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", blocks).drop("n").join(spare, "entity_id", "left")
    placed = rows.join(size, ["entity_id", "kind"]).withColumn("own", F.pmod(F.xxhash64("fact_id"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select(
        "entity_id", "kind", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fact_id", "valid_from", "v", (F.lit(per_entity) + F.coalesce("spare", F.lit(0))).cast("int").alias("keep")
    )
    streamed = cells.repartition("entity_id", "kind", "i", "j").sortWithinPartitions("entity_id", "kind", "i", "j", "fact_id")
    pairs = streamed.mapInPandas(_best_pairs(gap_days * DAY, min_cos), "entity_id bigint, older bigint, newer bigint, sim double").distinct()
    open_ = pairs.join(either, (F.least("older", "newer") == F.col("lo")) & (F.greatest("older", "newer") == F.col("hi")), "left_anti")
    w = Window.partitionBy("entity_id").orderBy(F.desc("sim"), "older", "newer")
    best = open_.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_entity)
    return best.groupBy("older", "newer").agg(F.max("sim").alias("sim")).orderBy(F.desc("sim"), "older", "newer").limit(max_pairs)


def close(facts: DataFrame, verdicts: DataFrame, at: float) -> DataFrame:
    """facts with each ``old`` of verdicts(old, new) closed by new, if it is still live and not the newer one; of several the smallest new. Of two that would close each other the later id stays."""
    back = verdicts.select(F.col("new").alias("old"), F.col("old").alias("new")).where("old > new")
    v = verdicts.where("old <> new").join(back, ["old", "new"], "left_anti").groupBy(F.col("old").alias("id")).agg(F.min("new").alias("__new"))
    t = facts.select(F.col("id").alias("__new"), F.col("valid_from").alias("__t"))
    ok = F.col("superseded_at").isNull() & F.col("__t").isNotNull() & (F.col("__t") >= F.col("valid_from"))
    j = facts.join(v.join(t, "__new"), "id", "left")
    return j.withColumns({"superseded_by": F.when(ok, F.col("__new")).otherwise(F.col("superseded_by")), "superseded_at": F.when(ok, F.lit(at)).otherwise(F.col("superseded_at"))}).drop("__new", "__t").select(*facts.columns)


def decided(log: DataFrame, mode: str) -> DataFrame:
    """log(llm_verdict, local_verdict, ...) with the verdict that counts: with the local judge 'off' or in 'shadow', where it is only logged, the other's; when 'active' its own."""
    if mode not in ("off", "shadow", "active"):
        raise ValueError(mode)
    return log.withColumn("verdict", F.col("local_verdict" if mode == "active" else "llm_verdict"))


def repair_pairs(facts: DataFrame, done: DataFrame) -> DataFrame:
    """(old_id, new_id): closed facts whose superseder exists and that were never re-audited (done(old_id))."""
    return temporal.supersession_pairs(temporal.dead(facts).select("id", "superseded_by", "valid_from").unionByName(facts.where("superseded_at IS NULL").select("id", F.lit(None).cast("bigint").alias("superseded_by"), "valid_from"))).select("old_id", "new_id").join(done, "old_id", "left_anti")


def apply_repair(facts: DataFrame, edges: DataFrame, verdicts: DataFrame, at: float) -> dict[str, DataFrame]:
    """verdicts(old_id, new_id, verdict): UPHOLD changes nothing; REOPEN opens the fact and drops its supersedes edge;
    REOPEN_CONTRADICT opens it and turns the edge into a contradiction. Every verdict goes to the ledger."""
    opened = verdicts.where("verdict IN ('REOPEN', 'REOPEN_CONTRADICT')")
    ids = opened.select(F.col("old_id").alias("id"), F.lit(True).alias("__open")).distinct()
    j = facts.join(ids, "id", "left")
    out = j.withColumns({c: F.when(F.col("__open").isNull(), F.col(c)) for c in ("superseded_at", "superseded_by")}).drop("__open").select(*facts.columns)
    gone = opened.select(F.col("new_id").alias("src"), F.col("old_id").alias("dst")).distinct().withColumn("edge_type", F.lit("supersedes"))
    kept = edges.join(gone, ["src", "dst", "edge_type"], "left_anti").select(*edges.columns)
    fresh = opened.where("verdict = 'REOPEN_CONTRADICT'").select(F.col("new_id").alias("src"), F.col("old_id").alias("dst"), F.lit("contradicts").alias("edge_type"), F.lit(at).alias("recorded_at"))
    merged = kept.unionByName(fresh).groupBy("src", "dst", "edge_type").agg(F.min("recorded_at").alias("recorded_at"))
    return {"facts": out, "edges": merged, "ledger": verdicts.select("old_id").distinct()}


def conflicts(facts: DataFrame, edges: DataFrame, refereed: DataFrame) -> DataFrame:
    """(src, dst): contradictions between two live facts that no referee has seen, either way round."""
    alive = temporal.live(facts).select("id")
    c = edges.where("edge_type = 'contradicts' AND src <> dst").select("src", "dst").distinct()
    c = c.join(alive.select(F.col("id").alias("src")), "src", "left_semi").join(alive.select(F.col("id").alias("dst")), "dst", "left_semi")
    seen = refereed.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    return c.withColumns({"lo": F.least("src", "dst"), "hi": F.greatest("src", "dst")}).join(seen, ["lo", "hi"], "left_anti").select("src", "dst")


def newer_side(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(src, dst, winner, loser): the side valid later, then recorded later; src if equal."""
    s = facts.select(F.col("id").alias("src"), F.struct("valid_from", "recorded_at").alias("s"))
    d = facts.select(F.col("id").alias("dst"), F.struct("valid_from", "recorded_at").alias("d"))
    j = pairs.join(s, "src").join(d, "dst")
    src_wins = F.col("s") >= F.col("d")
    return j.select("src", "dst", F.when(src_wins, F.col("src")).otherwise(F.col("dst")).alias("winner"), F.when(src_wins, F.col("dst")).otherwise(F.col("src")).alias("loser"))


def apply_referee(facts: DataFrame, verdicts: DataFrame, at: float) -> tuple[DataFrame, DataFrame]:
    """(facts, ledger) after verdicts(src, dst, verdict): SUPERSEDE_NEWER closes the older side, others only go to the ledger."""
    sides = newer_side(facts, verdicts.where("verdict = 'SUPERSEDE_NEWER'").select("src", "dst"))
    return close(facts, sides.select(F.col("loser").alias("old"), F.col("winner").alias("new")), at), verdicts.select(F.col("src").alias("a"), F.col("dst").alias("b"), "verdict").distinct()


def audit_sample(facts: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n supersession pairs in seeded order, rendered for a judge."""
    side = lambda p: S.prompt_side(F.col(f"{p}.valid_from"), F.col(f"{p}.evidence"), F.col(f"{p}.kind"), F.col(f"{p}.statement"))
    cols = ["id", "valid_from", "evidence", "kind", "statement"]
    old = facts.where("superseded_by IS NOT NULL").select(F.struct(*cols).alias("o"), F.col("superseded_by").alias("nid"))
    new = facts.select(F.col("id").alias("nid"), F.struct(*cols).alias("n"))
    pairs = old.join(new, "nid").orderBy(F.md5(F.concat_ws("-", F.col("o.id").cast("string"), F.lit(str(seed)))), "o.id").limit(n)
    return pairs.select(F.col("o.id").alias("old_id"), F.col("n.id").alias("new_id"), side("o").alias("old_side"), side("n").alias("new_side"))


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("verdict").agg(F.count("*").alias("n"))


def canonical_predicates(proposals: DataFrame, hops: int = 10) -> DataFrame:
    """(name, canon): where proposals(name, canon) lead within so many steps; a loop ends at its smallest name."""
    p = proposals.where("name <> canon").groupBy("name").agg(F.min("canon").alias("canon"))
    at = materialize(p.select("name", F.col("canon").alias("to"), F.array("name").alias("path")), "pred0")
    for i in range(hops):
        nxt = at.join(p.select(F.col("name").alias("to"), F.col("canon").alias("then")), "to", "left")
        looped = F.array_contains("path", F.col("to"))
        at = materialize(nxt.select("name", F.when(F.col("then").isNull() | looped, F.col("to")).otherwise(F.col("then")).alias("to"), F.when(F.col("then").isNull() | looped, F.col("path")).otherwise(F.concat("path", F.array("to"))).alias("path")), f"pred{i + 1}")
    inside = F.array_contains("path", F.col("to"))
    ring = F.slice("path", F.array_position("path", F.col("to")).cast("int"), F.size("path"))
    return at.select("name", F.when(inside, F.array_min(ring)).otherwise(F.col("to")).alias("canon"))


def fold_predicates(triples: DataFrame, mapping: DataFrame) -> DataFrame:
    """triples with canonical predicates, distinct by subject, predicate and object (the smallest id stays)."""
    m = mapping.select(F.col("name").alias("predicate"), F.col("canon").alias("__c"))
    j = triples.join(m, "predicate", "left").withColumn("predicate", F.coalesce("__c", "predicate"))
    return j.groupBy("subject_id", "predicate", "object_id").agg(F.min("id").alias("id"))
