"""Hybrid retrieval over the fact graph: lexical and vector arms, chain continuity, rank fusion, truth and freshness nudges.

Any number of queries is answered by one plan: every arm yields (qid, id, rank or similarity), and the fusion is one grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import lexical, temporal, vector
from chronoweave.session import materialize

ARM, DEAD_ARM = 60, 10
LIVE, DEAD = 0, 1
REINFORCEMENT, MOST_MASS = 0.15, 3.0


def live_contradictions(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n): by how many live facts each fact is contradicted; a repeated edge counts once."""
    c = edges.where("edge_type = 'contradicts'").select("src", "dst").distinct()
    return c.join(temporal.live(facts).select(F.col("id").alias("src")), "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))


def fact_out(rows: DataFrame, now: float) -> DataFrame:
    """What a hit shows of a fact, with mass and age as of now."""
    return rows.select(
        *[c for c in ("qid", "rank", "score", "via_history") if c in rows.columns], "id", "statement", "kind", "repo",
        F.round("confidence", 3).alias("confidence"), F.round(S.decayed_mass(F.col("kind"), F.col("mass"), F.col("valid_from"), now), 3).alias("mass"),
        S.age_days(F.col("valid_from"), now).alias("age_days"), S.is_stale(F.col("kind"), F.col("valid_from"), now).alias("stale"), S.epoch_date(F.col("valid_from")).alias("as_of_date"),
    )


def _score(ref: float, with_para: bool) -> Column:
    perishable = F.col("kind").isin("status", "todo") & (F.col("intent") == "current")
    mass = S.decayed_mass(F.col("kind"), F.col("mass"), F.col("valid_from"), ref)
    return (
        S.rrf(F.col("lex_rank")) + S.rrf(F.col("cos_rank"), 1.2) + F.coalesce(0.004 * F.when(F.col("cos_rank").isNotNull(), F.col("sim")), F.lit(0.0))
        + (S.rrf(F.col("para_rank"), 0.8) if with_para else F.lit(0.0))
        + F.when(perishable, 0.012).otherwise(0.004) * F.log(mass) - F.when(perishable & S.is_rotten(F.col("kind"), F.col("valid_from"), ref), 1.0).otherwise(0.0)
        + 0.003 * F.col("confidence") + F.when(F.col("want_repo") == F.col("repo"), 0.008).otherwise(0.0)
        + 0.003 * F.log1p(F.col("corroborations").cast("double")) - 0.006 * F.coalesce("n", F.lit(0))
        - F.when((F.col("evidence") == "asserted") & (F.col("corroborations") == 0), 0.002).otherwise(0.0) + 0.008 * F.coalesce("dead_sim", F.lit(0.0))
    )


def hybrid_search(
    queries: DataFrame, facts: DataFrame, edges: DataFrame, index: lexical.LexicalIndex, vectors: DataFrame, now: float, k: int = 5,
    as_of: float | None = None, paraphrases: DataFrame | None = None, para_vectors: DataFrame | None = None, features: bool = False,
) -> DataFrame:
    """Ranked facts for queries(qid, q, repo, vec): qid, rank (from 1), score, via_history and the fact's fields.

    Live facts answer, or those visible at ``as_of``, which makes every query historical and leaves out
    dead facts and paraphrases (texts in ``paraphrases``, their vectors in ``para_vectors``). A query without vector has no vector arm. Ties go to the smaller id.
    With ``features`` the result is (qid, rank, id, feat) of all candidates instead, see trace_log.
    """
    pool = temporal.live(facts) if as_of is None else temporal.as_of(facts, as_of)
    pools = pool.select("id", F.lit(LIVE).alias("pool"))
    if as_of is None:
        pools = pools.unionByName(temporal.dead(facts).select("id", F.lit(DEAD).alias("pool")))
    pools = materialize(pools, "pools")
    keep = {LIVE: ARM} if as_of is not None else {LIVE: ARM, DEAD: DEAD_ARM}
    alive = pools.where(F.col("pool") == LIVE).select("id")
    asked = queries.select("qid", "q")
    with_vec = queries.where("vec IS NOT NULL").select("qid", "vec")
    matches = materialize(lexical.best(index, asked, pools, keep), "matches")
    lex = matches.where(F.col("pool") == LIVE).select("qid", "id", F.col("rank").alias("lex_rank"))
    nearest = materialize(vector.cosine_best(with_vec, vectors.join(pools, "id"), keep), "nearest")
    cos = nearest.where(F.col("pool") == LIVE).select("qid", "id", "sim")
    if para_vectors is not None and as_of is None:
        # A fact counts by its nearest wording; several vectors (fact_id, vec) a fact are allowed.
        numbered = para_vectors.select(F.col("fact_id").alias("id"), "vec").where("vec IS NOT NULL").join(alive, "id", "left_semi")
        near = vector.cosine_top(with_vec, numbered, ARM).where("sim > 0").select("qid", "id", "sim")
        cos = lexical.top(cos.unionByName(near).groupBy("qid", "id").agg(F.max("sim").alias("sim")), ARM, "sim").select("qid", "id", "sim")
    via = None
    dead_sims = None
    if as_of is None:
        gone = materialize(temporal.dead(facts).where("superseded_by IS NOT NULL").select("id", F.col("superseded_by").alias("next")), "dead")
        heads = temporal.chain_heads(facts).select(F.col("id").alias("next"), "head")
        ends = materialize(gone.join(heads, "next", "left").select("id", F.coalesce("head", "next").alias("head")), "ends")
        # A dead hit stands for the head of its chain; each further head is appended behind the direct hits.
        dead_lex = matches.where(F.col("pool") == DEAD).join(ends, "id").groupBy("qid", "head").agg(F.min("rank").alias("dead_rank"))
        size = lex.groupBy("qid").agg(F.count("*").alias("l0"))
        fresh = dead_lex.withColumnRenamed("head", "id").join(lex.select("qid", "id"), ["qid", "id"], "left_anti").join(size, "qid", "left")
        order = Window.partitionBy("qid").orderBy("dead_rank", "id")
        fresh = fresh.select("qid", "id", (F.coalesce("l0", F.lit(0)) + F.row_number().over(order) - 1 + F.col("dead_rank") + 2).alias("lex_rank"))
        lex_all = lex.unionByName(fresh)
        dead_cos = nearest.where(F.col("pool") == DEAD).join(ends, "id").where("sim > 0")
        dead_sims = dead_cos.groupBy("qid", F.col("head").alias("id")).agg(F.max("sim").alias("dead_sim"))
        both = cos.withColumn("own", F.lit(True)).unionByName(dead_sims.select("qid", "id", F.round(F.col("dead_sim") * 0.9, 9).alias("sim"), F.lit(False).alias("own")))
        best = both.groupBy("qid", "id").agg(F.max("sim").alias("sim"), F.max_by("own", F.struct("sim", "own")).alias("own"))
        via = fresh.select("qid", "id").unionByName(best.where("NOT own").select("qid", "id")).distinct().withColumn("via_history", F.lit(True))
        cos = best.select("qid", "id", "sim")
    else:
        lex_all = lex
    cos = lexical.top(cos, ARM, "sim").select("qid", "id", "sim", F.col("rank").alias("cos_rank"))
    joined = lex_all.join(cos, ["qid", "id"], "full")
    if paraphrases is not None and as_of is None:
        pidx = lexical.build(paraphrases.groupBy("fact_id").agg(F.concat_ws(" ", F.collect_list("text")).alias("text")), "fact_id", {"text": 1.0})
        para = lexical.best(pidx, asked, alive.withColumn("pool", F.lit(LIVE)), {LIVE: ARM}).select("qid", "id", F.col("rank").alias("para_rank"))
        joined = joined.join(para, ["qid", "id"], "full")
    if dead_sims is not None:
        joined = joined.join(dead_sims, ["qid", "id"], "left").join(via, ["qid", "id"], "left")
    else:
        joined = joined.withColumn("dead_sim", F.lit(None).cast("double")).withColumn("via_history", F.lit(None).cast("boolean"))
    intent = F.lit("historical") if as_of is not None else S.temporal_intent(F.col("q"))
    rows = (
        joined.join(facts.select("id", "statement", "kind", "repo", "confidence", "mass", "valid_from", "corroborations", "evidence"), "id")
        .join(live_contradictions(facts, edges), "id", "left")
        .join(queries.select("qid", intent.alias("intent"), F.col("repo").alias("want_repo")), "qid")
    )
    ref = as_of if as_of is not None else now
    scored = rows.withColumn("score", F.round(_score(ref, paraphrases is not None and as_of is None), 9)).withColumn("via_history", F.coalesce("via_history", F.lit(False)))
    rank = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(rank))
    if features:
        none, double = F.lit(-1.0), lambda c: F.col(c).cast("double")
        same = F.when(F.col("want_repo") == F.col("repo"), 1.0).otherwise(0.0)
        mass = F.round(S.decayed_mass(F.col("kind"), F.col("mass"), F.col("valid_from"), ref), 3)
        feat = F.array(F.coalesce(double("lex_rank"), none), F.coalesce(double("cos_rank"), none), F.round(F.coalesce("sim", F.lit(0.0)), 3), mass, F.col("confidence"), same)
        return ranked.select("qid", "rank", "id", feat.alias("feat"))
    return fact_out(ranked.where(F.col("rank") <= k), now)


def reinforce(facts: DataFrame, hits: DataFrame, now: float, top: int = 3) -> DataFrame:
    """facts after searches whose hits(qid, rank, id) people saw: each of the first ``top`` gains mass (up to a limit) and counts one use a search."""
    n = hits.where(F.col("rank") <= top).groupBy("id").agg(F.count("*").alias("__n"))
    used = F.col("__n").isNotNull()
    new = {
        "mass": F.when(used, F.least(F.col("mass") + REINFORCEMENT * F.col("__n"), F.lit(MOST_MASS))).otherwise(F.col("mass")),
        "use_count": (F.col("use_count") + F.coalesce("__n", F.lit(0))).cast("int"), "last_used_at": F.when(used, F.lit(now)).otherwise(F.col("last_used_at")),
    }
    return facts.join(n, "id", "left").withColumns(new).select(*facts.columns)


def trace_log(found: DataFrame, queries: DataFrame, ts: float, k: int = 5) -> DataFrame:
    """(qid, ts, kind, q, results): one trace a query from hybrid_search(..., features=True) with every candidate.

    results is JSON: ids, the first k hits in order, and feat, by id the evidence they were ranked by:
    [lexical rank, cosine rank, cosine, decayed mass, confidence, same repository], ranks -1 where there is none.
    """
    hits = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") <= k, F.struct("rank", "id")))), lambda x: x["id"])
    feats = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("id").cast("string"), "feat"))))
    rows = found.groupBy("qid").agg(F.to_json(F.struct(hits.alias("ids"), feats.alias("feat"))).alias("results"))
    return queries.select("qid", "q").join(rows, "qid", "left").select("qid", F.lit(ts).alias("ts"), F.lit("query").alias("kind"), "q", F.coalesce("results", F.lit('{"ids":[],"feat":{}}')).alias("results"))


def brief(facts: DataFrame, now: float, k: int = 10, repo: str | None = None, per: tuple[str, ...] = ()) -> DataFrame:
    """The standing brief: the k facts of greatest decayed mass x (0.5 + confidence), over all or for each value of ``per``."""
    f = facts if repo is None else facts.where(F.col("repo") == repo)
    weight = F.round(S.decayed_mass(F.col("kind"), F.col("mass"), F.col("valid_from"), now) * (0.5 + F.col("confidence")), 9)
    w = Window.partitionBy(*(per or (F.lit(0),))).orderBy(F.desc("weight"), "id")
    return f.withColumn("weight", weight).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def by_kind(rows: DataFrame) -> DataFrame:
    """(kind, ids): a brief as one row a kind."""
    return rows.groupBy("kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("ids"))


def supersede_candidates(new: DataFrame, facts: DataFrame, links: DataFrame, index: lexical.LexicalIndex, k: int = 3) -> DataFrame:
    """(qid, id, rank): the k best lexical matches of each new fact(qid, q, repo, kind, entity_ids) among live facts of its kind
    that share its repository or one of its entities. Entities must be resolved exactly: a prefix never opens the scope."""
    scored = lexical.scores(index, new.select("qid", "q")).where("qid <> id")
    mine = temporal.live(facts).select("id", "kind", F.col("repo").alias("own_repo"))
    pairs = scored.join(mine, "id").join(new.select("qid", "kind", "repo"), ["qid", "kind"])
    asked = new.select("qid", F.explode("entity_ids").alias("entity_id"))
    shared = pairs.select("qid", "id").join(asked, "qid").join(links.select(F.col("fact_id").alias("id"), "entity_id"), ["id", "entity_id"], "left_semi").select("qid", "id").distinct().withColumn("shared", F.lit(True))
    inside = pairs.join(shared, ["qid", "id"], "left").where(F.coalesce(F.col("own_repo") == F.col("repo"), F.lit(False)) | F.coalesce("shared", F.lit(False)))
    return lexical.top(inside.select("qid", "id", "bm25"), k).select("qid", "id", "rank")
