"""Queries of the composite operators: retrieval, entities, traversal, truth maintenance, mining, topics, ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.functions.porter import stems_sql
from chronoweave.operators import entities as E
from chronoweave.operators import graph, ingest, lexical, metrics, mining, search, temporal, topics, truth, vector
from chronoweave.plans.core_queries import _TRACE, AS_OF_SQL, DATE, EDGES, FACTS, LINKS, NOW_SQL, VISIBLE, _edges, _facts, _links, mass_sql
from chronoweave.session import materialize
from chronoweave.sources import adapters as A
from chronoweave.sources.adapters import AS_OF, NOW, table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- Retrieval. The stated query set: every fact whose id is divisible by 50 asks with its statement.


def _asked(spark: SparkSession, d: str) -> DataFrame:
    v = vector.usable(table(spark, d, "fact_vecs")).select(F.col("id").alias("qid"), "vec")
    q = _facts(spark, d).where("id % 50 = 0").select(F.col("id").alias("qid"), F.array_join(S.query_tokens(F.col("statement")), " ").alias("q"), "repo")
    return materialize(q.join(v, "qid", "left"), "asked")


def _index(spark: SparkSession, d: str) -> lexical.LexicalIndex:
    f = _facts(spark, d).select("id", "statement", F.array_join("entities", " ").alias("names"))
    return lexical.build(f, "id", {"statement": 2.0, "names": 1.0})


_TOKENS = "regexp_extract_all(statement, '[A-Za-z0-9_.-]{2,}')[1:64]"
_STOPS = ", ".join(f"'{w}'" for w in S.STOPWORDS)
_ASK = f"""qt AS (SELECT id AS qid, repo, {_TOKENS} AS r FROM f WHERE id % 50 = 0),
qc AS (SELECT qid, repo, r, list_filter(r, lambda t, i: lower(t) NOT IN ({_STOPS}) AND list_position(list_transform(r, lambda y: lower(y)), lower(t)) = i) AS c FROM qt),
q AS (SELECT qid, repo, array_to_string(CASE WHEN len(c) > 0 THEN c[1:12] ELSE r[1:12] END, ' ') AS q FROM qc)"""
_DFREQ = "dq AS (SELECT token, count(*) AS df FROM (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(statement, '[A-Za-z0-9_.-]{2,}')[1:200], lambda t: lower(t)))) AS token FROM f WHERE superseded_at IS NULL) GROUP BY 1)"
_RARE = f"""{_DFREQ}, ps AS (SELECT id, t, i, lower(t) AS token FROM (SELECT id, unnest(r) AS t, generate_subscripts(r, 1) AS i FROM (SELECT id, regexp_extract_all(statement, '[A-Za-z0-9_.-]{{2,}}') AS r FROM f)) WHERE octet_length(encode(t)) >= 4 AND lower(t) NOT IN ({_STOPS})),
pu AS (SELECT id, token, min(i) AS i, arg_min(t, i) AS t FROM ps GROUP BY 1, 2), pr AS (SELECT pu.*, df, row_number() OVER (PARTITION BY id ORDER BY df, i) AS rn FROM pu JOIN dq USING (token)),
rp AS (SELECT id, string_agg(replace(t, '.', '\\.'), '.*' ORDER BY i) AS pattern FROM pr WHERE rn <= 3 GROUP BY 1 HAVING min(df) <= 40 AND count(*) >= 2)"""
def _bm25_sql(statement: float = 2, names: bool = True, pre: str = "", text: str = "statement", out: str = "bm", asked: bool = True) -> str:
    """CTEs that end in {out}(qid, id, bm25): a query's tokens are stems, or phrases of stems, each counted by text and weight."""
    other = " UNION ALL SELECT id, 2, 1e0, regexp_extract_all(lower(array_to_string(entities, ' ')), '[\\p{L}\\p{N}]+') FROM f" if names else ""
    rows = "" if text == "statement" else f" WHERE {text} IS NOT NULL"
    question = """qtok AS (SELECT DISTINCT qid, unnest(string_split(q, ' ')) AS token FROM q), qwl AS (SELECT qid, token, regexp_extract_all(lower(token), '[\\p{L}\\p{N}]+') AS ws FROM qtok),
qws AS (SELECT DISTINCT token, unnest(ws) AS term, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM qwl),
""" if asked else ""
    phrase = """qst AS (SELECT token, n, i, stem FROM qws JOIN st USING (term)), qit AS (SELECT token, n, string_agg(stem, ' ' ORDER BY i) AS item FROM qst GROUP BY 1, 2), qitem AS (SELECT DISTINCT qid, item FROM qtok JOIN qit USING (token)), ii AS (SELECT DISTINCT item, string_split(item, ' ') AS ss FROM qit), iw AS (SELECT item, unnest(ss) AS stem, generate_subscripts(ss, 1) AS i, len(ss) AS n FROM ii),
""" if asked else ""
    words = f"SELECT id, 1 AS c, {statement}e0 AS w, regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+') AS ws FROM f{rows}{other}"
    vocabulary = f"{pre}vo AS (SELECT DISTINCT term FROM {pre}po" + (" UNION SELECT term FROM qws" if asked else "") + ")"
    stems = stems_sql(f"{pre}vo", f"{pre}st")
    return question + f"""{pre}tl AS ({words}), {pre}po AS (SELECT id, c, w, unnest(ws) AS term, generate_subscripts(ws, 1) AS pos FROM {pre}tl), {vocabulary}, {stems},
{phrase}{pre}sq AS (SELECT id, c, w, pos, stem FROM {pre}po JOIN {pre}st USING (term)), {pre}dl AS (SELECT id, sum(len(ws)) AS dl FROM {pre}tl GROUP BY 1), {pre}sn AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM {pre}dl),
{pre}oc AS (SELECT iw.item, sq.id, sq.c, sq.w, sq.pos - iw.i AS start FROM iw JOIN {pre}sq sq ON sq.stem = iw.stem GROUP BY 1, 2, 3, 4, 5, iw.n HAVING count(*) = iw.n),
{pre}tf AS (SELECT id, item, sum(w) AS tf FROM {pre}oc GROUP BY 1, 2), {pre}df AS (SELECT item, count(*) AS df FROM {pre}tf GROUP BY 1),
{out} AS (SELECT qid, tf.id, round(sum(greatest(ln((sn.n - df.df + 0.5e0) / (df.df + 0.5e0)), 1e-6) * tf.tf * 2.2e0 / (tf.tf + 1.2e0 * (0.25e0 + 0.75e0 * dl.dl / sn.avgdl))), 9) AS bm25
  FROM qitem JOIN {pre}tf tf USING (item) JOIN {pre}df df USING (item) JOIN {pre}dl dl ON dl.id = tf.id, {pre}sn sn GROUP BY 1, 2)"""


_BM25 = _bm25_sql()
_VECS = """vd AS (SELECT len(vec) AS d FROM (SELECT DISTINCT ON (fact_id) vec FROM fact_vecs WHERE vec IS NOT NULL) GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1),
vx AS (SELECT DISTINCT ON (fact_id) fact_id AS id, CAST(vec AS DOUBLE[]) AS vec FROM fact_vecs WHERE len(vec) = (SELECT d FROM vd) AND list_max(list_transform(vec, lambda x: abs(x))) > 0)"""
_SCORE = """1e0 * coalesce(1e0 / (60 + lex_rank), 0e0) + coalesce(1.2e0 / (60 + cos_rank), 0e0) + coalesce(CASE WHEN cos_rank IS NOT NULL THEN 0.004e0 * sim END, 0e0)
 + CASE WHEN {per} THEN 0.012e0 ELSE 0.004e0 END * ln({mass}) - CASE WHEN {per} AND {rotten} THEN 1e0 ELSE 0e0 END + 0.003e0 * f.confidence + CASE WHEN q.repo = f.repo THEN 0.008e0 ELSE 0e0 END
 + 0.003e0 * ln(1 + f.corroborations) - 0.006e0 * coalesce(k.n, 0) - CASE WHEN f.evidence = 'asserted' AND f.corroborations = 0 THEN 0.002e0 ELSE 0e0 END + 0.008e0 * coalesce(dead_sim, 0e0)"""
_CONTRA = "k AS (SELECT dst AS id, count(*) AS n FROM (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'contradicts') c JOIN f ON f.id = c.src AND f.superseded_at IS NULL GROUP BY 1)"


@query(f"WITH {FACTS}, {_ASK}, {_BM25} SELECT qid, id, rank, round(bm25, 6) AS bm25 FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) - 1 AS rank FROM bm) WHERE rank < 10")
def bm25_top(spark, d):
    """The ten best lexical matches of each question."""
    t = lexical.best(_index(spark, d), _asked(spark, d).select("qid", "q"), _facts(spark, d).select("id", F.lit(0).alias("pool")), {0: 10})
    return t.select("qid", "id", F.col("rank").cast("bigint").alias("rank"), F.round("bm25", 6).alias("bm25"))


@query(f"""WITH {FACTS}, {_VECS} SELECT qid, id, rank, round(sim, 6) AS sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) - 1 AS rank FROM
(SELECT a.id AS qid, b.id, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim FROM vx a, vx b JOIN f ON f.id = b.id AND f.superseded_at IS NULL WHERE a.id % 50 = 0)) WHERE rank < 10""")
def cosine_top(spark, d):
    """The ten live facts nearest to each question's vector."""
    v = vector.usable(table(spark, d, "fact_vecs"))
    mine = v.join(temporal.live(_facts(spark, d)).select("id"), "id", "left_semi")
    t = vector.cosine_top(v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), mine, 10)
    return t.select("qid", "id", F.col("rank").cast("bigint").alias("rank"), F.round("sim", 6).alias("sim"))


_OUT = f"""SELECT qid, rank, id, round(s, 6) AS score, via_history, round(mass, 3) AS mass, age_days, day AS as_of_date"""


@query(f"""WITH {FACTS}, {VISIBLE}, {_ASK}, {_BM25}, {_VECS}, {_CONTRA},
lex AS (SELECT * FROM (SELECT qid, bm.id, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, bm.id) - 1 AS lex_rank FROM bm JOIN v ON v.id = bm.id) WHERE lex_rank < 60),
cs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) - 1 AS cos_rank FROM (SELECT q.qid, b.id, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim FROM q JOIN vx a ON a.id = q.qid, vx b JOIN v ON v.id = b.id)) WHERE cos_rank < 60),
j AS (SELECT coalesce(lex.qid, cs.qid) AS qid, coalesce(lex.id, cs.id) AS id, lex_rank, cos_rank, sim, NULL AS dead_sim FROM lex FULL JOIN cs ON lex.qid = cs.qid AND lex.id = cs.id),
s AS (SELECT j.qid, j.id, round({_SCORE.format(per='false', rotten='false', mass=mass_sql(AS_OF_SQL, 'f.'))}, 9) AS s, false AS via_history, {mass_sql(NOW_SQL, 'f.')} AS mass, round(({NOW_SQL} - f.valid_from) / 8640) / 10 AS age_days, {DATE.format(x='f.valid_from')} AS day
  FROM j JOIN f ON f.id = j.id JOIN q ON q.qid = j.qid LEFT JOIN k ON k.id = j.id)
{_OUT} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s) WHERE rank <= 5""")
def search_as_of(spark, d):
    """Hybrid search over what was visible at a past moment."""
    return _hits(spark, d, AS_OF)


def _hits(spark, d, as_of):
    r = search.hybrid_search(_asked(spark, d), materialize(_facts(spark, d), "facts"), table(spark, d, "edges"), _index(spark, d), vector.usable(table(spark, d, "fact_vecs")), NOW, 5, as_of)
    return r.select("qid", F.col("rank").cast("bigint").alias("rank"), "id", F.round("score", 6).alias("score"), "via_history", "mass", "age_days", "as_of_date")


_HIST, _CURR = S.HISTORICAL, S.CURRENT


_PARA = _bm25_sql(1, False, "p", "quote", "pb", False) + """,
pa AS (SELECT * FROM (SELECT qid, pb.id, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, pb.id) - 1 AS para_rank FROM pb JOIN f ON f.id = pb.id AND f.superseded_at IS NULL) WHERE para_rank < 60),
j0 AS (SELECT coalesce(ja.qid, pa.qid) AS qid, coalesce(ja.id, pa.id) AS id, lex_rank, cos_rank, sim, para_rank FROM ja FULL JOIN pa ON ja.qid = pa.qid AND ja.id = pa.id),"""


def _live_sql(para: bool = False, out: str = _OUT) -> str:
    """Search over live facts, with the quotes as paraphrases if asked."""
    arm = _PARA if para else "j0 AS (SELECT *, NULL AS para_rank FROM ja),"
    more = "coalesce(0.8e0 / (60 + para_rank), 0e0) + " if para else ""
    if para:
        out = "SELECT qid, rank, id, round(s, 6) AS score"
    return f"""WITH RECURSIVE {FACTS}, {_ASK}, {_BM25}, {_VECS}, {_CONTRA}, g AS (SELECT * FROM f WHERE superseded_at IS NOT NULL),
ch AS (SELECT id, id AS node, 0 AS n FROM f UNION ALL SELECT ch.id, f.superseded_by, n + 1 FROM ch JOIN f ON f.id = ch.node AND f.superseded_at IS NOT NULL AND f.superseded_by IS NOT NULL WHERE n < 20),
hd AS (SELECT id, arg_max(node, n) AS head FROM ch GROUP BY 1),
ends AS (SELECT g.id, coalesce(hd.head, g.superseded_by) AS head FROM g LEFT JOIN hd ON hd.id = g.superseded_by WHERE g.superseded_by IS NOT NULL),
lex0 AS (SELECT * FROM (SELECT qid, bm.id, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, bm.id) - 1 AS lex_rank FROM bm JOIN f ON f.id = bm.id AND f.superseded_at IS NULL) WHERE lex_rank < 60),
dl10 AS (SELECT qid, head AS id, min(r) AS dead_rank FROM (SELECT qid, bm.id, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, bm.id) - 1 AS r FROM bm JOIN g ON g.id = bm.id) x JOIN ends ON ends.id = x.id WHERE r < 10 GROUP BY 1, 2),
fresh AS (SELECT y.qid, y.id, coalesce(l0, 0) + row_number() OVER (PARTITION BY y.qid ORDER BY dead_rank, y.id) - 1 + dead_rank + 2 AS lex_rank FROM (SELECT * FROM dl10 WHERE (qid, id) NOT IN (SELECT (qid, id) FROM lex0)) y LEFT JOIN (SELECT qid, count(*) AS l0 FROM lex0 GROUP BY 1) z ON z.qid = y.qid),
lex AS (SELECT * FROM lex0 UNION ALL SELECT * FROM fresh),
sims AS (SELECT q.qid, b.id, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim, f.superseded_at IS NULL AS alive FROM q JOIN vx a ON a.id = q.qid, vx b JOIN f ON f.id = b.id),
c0 AS (SELECT qid, id, sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS r FROM sims WHERE alive) WHERE r <= 60),
ds AS (SELECT qid, head AS id, max(sim) AS dead_sim FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS r FROM sims WHERE NOT alive) x JOIN ends ON ends.id = x.id WHERE r <= 10 AND sim > 0 GROUP BY 1, 2),
c1 AS (SELECT qid, id, max(sim) AS sim, arg_max(own, struct_pack(s := sim, o := own)) AS own FROM (SELECT qid, id, sim, true AS own FROM c0 UNION ALL SELECT qid, id, round(dead_sim * 0.9e0, 9), false FROM ds) GROUP BY 1, 2),
cs AS (SELECT * FROM (SELECT qid, id, sim, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) - 1 AS cos_rank FROM c1) WHERE cos_rank < 60),
via AS (SELECT qid, id FROM fresh UNION SELECT qid, id FROM c1 WHERE NOT own),
ja AS (SELECT coalesce(lex.qid, cs.qid) AS qid, coalesce(lex.id, cs.id) AS id, lex_rank, cos_rank, sim FROM lex FULL JOIN cs ON lex.qid = cs.qid AND lex.id = cs.id),
{arm}
j AS (SELECT j0.*, ds.dead_sim, via.id IS NOT NULL AS via_history FROM j0 LEFT JOIN ds ON ds.qid = j0.qid AND ds.id = j0.id LEFT JOIN via ON via.qid = j0.qid AND via.id = j0.id),
qi AS (SELECT *, CASE WHEN regexp_matches(q, '{_HIST}') THEN 'historical' WHEN regexp_matches(q, '{_CURR}') THEN 'current' ELSE 'neutral' END AS intent FROM q),
s AS (SELECT j.qid, j.id, round({more}{_SCORE.format(per="(q.intent = 'current' AND f.kind IN ('status', 'todo'))", rotten=f"({NOW_SQL} - f.valid_from > 3 * (CASE f.kind WHEN 'status' THEN 7e0 ELSE 14e0 END) * 86400)", mass=mass_sql(NOW_SQL, 'f.'))}, 9) AS s, via_history, {mass_sql(NOW_SQL, 'f.')} AS mass, round(({NOW_SQL} - f.valid_from) / 8640) / 10 AS age_days, {DATE.format(x='f.valid_from')} AS day
  FROM j JOIN f ON f.id = j.id JOIN qi q ON q.qid = j.qid LEFT JOIN k ON k.id = j.id)
{out} FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) AS rank FROM s) WHERE rank <= 5"""


def _self_eval_sql() -> str:
    found = _live_sql(out="SELECT qid, id")
    return f"""WITH hits AS ({found}), {FACTS}, rk AS (SELECT * FROM (WITH {FACTS}, {_RARE} SELECT id, pattern FROM rp)),
hd AS (SELECT id, head FROM (WITH RECURSIVE {FACTS}, ch AS (SELECT id, id AS node, 0 AS n FROM f UNION ALL SELECT ch.id, f.superseded_by, n + 1 FROM ch JOIN f ON f.id = ch.node AND f.superseded_at IS NOT NULL AND f.superseded_by IS NOT NULL WHERE n < 20) SELECT id, arg_max(node, n) AS head FROM ch GROUP BY 1)),
pr AS (SELECT hd.id AS qid, rk.pattern, CASE WHEN hd.id = hd.head THEN 'own' ELSE 'continuity' END AS miner FROM hd JOIN rk ON rk.id = hd.head WHERE hd.id % 50 = 0),
hi AS (SELECT pr.qid, pr.miner, coalesce(bool_or(regexp_matches(f.statement, '(?i)' || pr.pattern)), false) AS hit FROM pr LEFT JOIN hits ON hits.qid = pr.qid LEFT JOIN f ON f.id = hits.id GROUP BY 1, 2)
SELECT miner, count(*) AS probes, count(*) FILTER (WHERE hit) AS hits FROM hi GROUP BY 1"""


@query(_live_sql())
def search_live(spark, d):
    """Hybrid search over live facts, with chain continuity."""
    return _hits(spark, d, None)


@query(_live_sql(para=True))
def search_with_quotes(spark, d):
    """Hybrid search with the facts' quotes as paraphrases."""
    f = materialize(_facts(spark, d), "facts")
    para = f.where("quote IS NOT NULL").select(F.col("id").alias("fact_id"), F.col("quote").alias("text"))
    return search.hybrid_search(_asked(spark, d), f, table(spark, d, "edges"), _index(spark, d), vector.usable(table(spark, d, "fact_vecs")), NOW, 5, None, para).select("qid", "rank", "id", F.round("score", 6).alias("score"))


@query(f"""WITH {FACTS}, {_TRACE}, past AS (SELECT * FROM t ORDER BY ts DESC, id DESC LIMIT 400), a AS (SELECT DISTINCT id AS qid, lower(unnest(CASE WHEN len(c) > 0 THEN c[1:12] ELSE r[1:12] END)) AS token FROM (SELECT id, r, list_filter(r, lambda x, i: lower(x) NOT IN ({_STOPS}) AND list_position(list_transform(r, lambda y: lower(y)), lower(x)) = i) AS c FROM (SELECT id, regexp_extract_all(q, '[A-Za-z0-9_.-]{{2,}}')[1:64] AS r FROM t))),
b AS (SELECT id AS past_id, lower(unnest(regexp_extract_all(q, '[A-Za-z0-9_.-]{{2,}}')[1:16])) AS token FROM past), n AS (SELECT qid, past_id, count(*) AS shared FROM a JOIN b USING (token) GROUP BY 1, 2 HAVING count(*) > 2)
SELECT qid, past_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY shared DESC, past_id DESC) AS rn FROM n) WHERE rn = 1""")
def similar_questions(spark, d):
    """The past question most like each question."""
    t = A.traces(spark, d)
    return mining.similar_questions(t.select(F.col("id").alias("qid"), "q"), t)


@query(f"""WITH {FACTS}, {LINKS}, {_ASK}, {_bm25_sql(1)}, s AS (SELECT bm.qid, bm.id, bm25 FROM bm JOIN f a ON a.id = bm.qid JOIN f b ON b.id = bm.id AND b.superseded_at IS NULL AND b.kind = a.kind WHERE bm.qid <> bm.id
AND (coalesce(a.repo = b.repo, false) OR EXISTS (SELECT 1 FROM fe x JOIN fe y ON x.entity_id = y.entity_id WHERE x.fact_id = bm.qid AND y.fact_id = bm.id)))
SELECT qid, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25 DESC, id) - 1 AS rank FROM s) WHERE rank < 3""")
def supersede_candidates(spark, d):
    """The live facts that each new fact may replace."""
    f = materialize(_facts(spark, d), "facts")
    fe = materialize(_links(spark, d), "links")
    ix = lexical.build(f.select("id", "statement", F.array_join("entities", " ").alias("names")), "id", {"statement": 1.0, "names": 1.0})
    own = fe.groupBy(F.col("fact_id").alias("qid")).agg(F.collect_set("entity_id").alias("entity_ids"))
    new = _asked(spark, d).select("qid", "q", "repo").join(f.select(F.col("id").alias("qid"), "kind"), "qid").join(own, "qid", "left")
    return search.supersede_candidates(new, f, fe, ix).withColumn("rank", F.col("rank").cast("bigint"))


# --- Entities and graph.


@query("""WITH al AS (SELECT DISTINCT entity_id, lower(trim(alias)) AS c, confidence FROM entity_aliases WHERE valid_to IS NULL AND entity_id IN (SELECT id FROM entities)), n AS (SELECT DISTINCT alias AS name, lower(trim(alias)) AS c FROM entity_aliases WHERE trim(alias) <> '' UNION SELECT DISTINCT entity, lower(trim(entity)) FROM lookups WHERE trim(entity) <> ''),
x AS (SELECT n.name, e.id AS entity_id, 'exact' AS how, 0 AS pri, CAST(e.seen_count AS DOUBLE) AS w FROM n JOIN entities e ON lower(trim(e.name)) = n.c UNION ALL SELECT n.name, al.entity_id, 'alias', 1, al.confidence FROM n JOIN al ON al.c = n.c
 UNION ALL SELECT n.name, e.id, 'prefix', 2, CAST(e.seen_count AS DOUBLE) FROM n JOIN entities e ON starts_with(lower(trim(e.name)), n.c))
SELECT name, entity_id, how FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pri, w DESC, entity_id) AS rn FROM x) WHERE rn = 1""")
def resolved_names(spark, d):
    """Aliases and looked-up names as entities."""
    n = table(spark, d, "entity_aliases").select(F.col("alias").alias("name")).unionByName(table(spark, d, "lookups").select(F.col("entity").alias("name")))
    return E.resolve(n, table(spark, d, "entities"), table(spark, d, "entity_aliases"), prefix=True)


@query(f"WITH {FACTS}, {EDGES} SELECT id FROM entities WHERE id NOT IN (SELECT entity_id FROM fe) AND id NOT IN (SELECT a FROM ee UNION SELECT b FROM ee) AND id NOT IN (SELECT entity_id FROM entity_aliases WHERE valid_to IS NULL AND entity_id IS NOT NULL)")
def unused_entities(spark, d):
    """Entities that nothing refers to."""
    return E.unused(table(spark, d, "entities"), _links(spark, d), _edges(spark, d), table(spark, d, "entity_aliases"))


_MAP = "mp AS (SELECT DISTINCT ON (old) entity_id AS old, new FROM (SELECT a.entity_id, min(b.entity_id) AS new FROM (SELECT DISTINCT entity_id, lower(trim(alias)) AS c FROM entity_aliases WHERE entity_id IN (SELECT id FROM entities)) a JOIN (SELECT DISTINCT entity_id, lower(trim(alias)) AS c FROM entity_aliases WHERE entity_id IN (SELECT id FROM entities)) b ON a.c = b.c AND b.entity_id < a.entity_id GROUP BY 1) x(entity_id, new)), m AS (SELECT old, new FROM mp WHERE new NOT IN (SELECT old FROM mp))"


def _merged(spark, d, now=None):
    ent = table(spark, d, "entities")
    al = table(spark, d, "entity_aliases").join(ent.select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("entity_id", S.canonical_name(F.col("alias")).alias("c")).distinct()
    low = al.groupBy("c").agg(F.min("entity_id").alias("new"))
    mp = al.join(low, "c").where("new < entity_id").groupBy(F.col("entity_id").alias("old")).agg(F.min("new").alias("new"))
    m = mp.join(mp.select(F.col("old").alias("new")), "new", "left_anti").select("old", "new")
    return E.merge(materialize(m, "merge"), ent, _links(spark, d), _edges(spark, d), table(spark, d, "entity_aliases"), A.triples(spark, d), A.observations(spark, d), now)


@query(f"""WITH {FACTS}, {EDGES}, {_MAP}, r AS (SELECT coalesce(x.new, a) AS p, coalesce(y.new, b) AS q, count, last_seen, a AS oa, b AS ob FROM ee LEFT JOIN m x ON x.old = a LEFT JOIN m y ON y.old = b)
SELECT least(p, q) AS a, greatest(p, q) AS b, CAST(sum(count) AS BIGINT) AS count, coalesce(max(last_seen) FILTER (WHERE least(p, q) = oa AND greatest(p, q) = ob), max(last_seen)) AS last_seen FROM r WHERE p <> q GROUP BY 1, 2""")
def merged_edges(spark, d):
    """Co-mention edges after merging entities that share an alias."""
    return _merged(spark, d)["edges"]


@query(f"WITH {FACTS}, {_MAP} SELECT e.id, e.name, CAST(e.seen_count + coalesce((SELECT sum(l.seen_count) FROM m JOIN entities l ON l.id = m.old WHERE m.new = e.id), 0) AS BIGINT) AS seen_count FROM entities e WHERE e.id NOT IN (SELECT old FROM m)")
def merged_entities(spark, d):
    """Entities after the merge, with the losers' counts."""
    return _merged(spark, d)["entities"].select("id", "name", "seen_count")


@query()
def traversal(spark, d):
    """What a bounded breadth-first search meets around the most supplied part."""
    t = A.triples(spark, d)
    start = t.groupBy("subject_id").count().orderBy(F.desc("count"), "subject_id").first()["subject_id"]
    return graph.traverse(start, graph.link_stream(t, E.neighbours(_edges(spark, d))), 2, 20, 200)


@query(f"""WITH {FACTS}, {EDGES}, t AS (SELECT DISTINCT l_partkey AS s, l_returnflag || l_linestatus AS p, l_suppkey AS o FROM lineitem) SELECT id, pri, count(*) AS links FROM (SELECT s AS id, 0 AS pri FROM t UNION ALL SELECT o, 1 FROM t UNION ALL SELECT a, 2 FROM ee UNION ALL SELECT b, 2 FROM ee) GROUP BY 1, 2""")
def link_counts(spark, d):
    """Typed links out of and into each node, and co-mentions."""
    s = graph.link_stream(A.triples(spark, d), E.neighbours(_edges(spark, d)))
    return s.groupBy("id", "pri").agg(F.count("*").alias("links"))


@query(f"WITH {FACTS}, {EDGES}, t AS (SELECT id FROM entities ORDER BY seen_count DESC, id LIMIT 150), i AS (SELECT a, b FROM ee WHERE a IN (SELECT id FROM t) AND b IN (SELECT id FROM t)), n AS (SELECT a AS id FROM i UNION ALL SELECT b FROM i) SELECT t.id, count(n.id) AS degree FROM t LEFT JOIN n ON n.id = t.id GROUP BY 1")
def graph_picture(spark, d):
    """The most seen entities and their degree among themselves."""
    return graph.picture(table(spark, d, "entities"), _edges(spark, d))[0].select("id", "degree")


@query(f"WITH {FACTS}, {EDGES}, u AS (SELECT a AS x, b AS y FROM ee UNION SELECT b, a FROM ee), h1 AS (SELECT id AS root, y AS id FROM entities JOIN u ON u.x = id WHERE id % 50 = 0), h2 AS (SELECT root, y AS id FROM h1 JOIN u ON u.x = h1.id), a AS (SELECT id AS root, id, 0 AS hop FROM entities WHERE id % 50 = 0 UNION ALL SELECT root, id, 1 FROM h1 UNION ALL SELECT root, id, 2 FROM h2) SELECT root, id, min(hop) AS hop FROM a GROUP BY 1, 2")
def neighbourhoods(spark, d):
    """Everything within two hops of the entities asked for."""
    return graph.reachable(_edges(spark, d), table(spark, d, "entities").where("id % 50 = 0"), 2)


# --- Truth maintenance.


@query(f"""WITH {FACTS}, {LINKS}, {_VECS}, n AS (SELECT id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS vec FROM vx),
fr AS (SELECT * FROM fe UNION ALL SELECT id, 1000000 + CAST('0x' || md5(repo)[1:8] AS BIGINT) FROM f WHERE repo IS NOT NULL),
l AS (SELECT fr.entity_id, fr.fact_id, f.kind, f.valid_from, n.vec FROM fr JOIN f ON f.id = fr.fact_id AND f.superseded_at IS NULL JOIN n ON n.id = fr.fact_id),
p AS (SELECT a.entity_id, a.fact_id AS older, b.fact_id AS newer, round(list_dot_product(a.vec, b.vec), 9) AS sim FROM l a JOIN l b ON a.entity_id = b.entity_id AND a.kind = b.kind AND b.valid_from - a.valid_from > 3 * 86400),
o AS (SELECT * FROM p WHERE sim > 0.05 AND NOT EXISTS (SELECT 1 FROM edges e WHERE least(e.src, e.dst) = least(older, newer) AND greatest(e.src, e.dst) = greatest(older, newer))),
w AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY sim DESC, older, newer) AS rn FROM o)
SELECT older, newer, round(max(sim), 6) AS sim FROM w WHERE rn <= 20 GROUP BY 1, 2 ORDER BY max(sim) DESC, 1, 2 LIMIT 500""")
def sweep_candidates(spark, d):
    """Likely supersessions that were missed, among facts that share an entity or the repository. The invented vectors are nearly orthogonal, so the least cosine is low."""
    of_repo = _facts(spark, d).where("repo IS NOT NULL").select(F.col("id").alias("fact_id"), (F.conv(F.substring(F.md5("repo"), 1, 8), 16, 10).cast("bigint") + 1_000_000).alias("entity_id"))
    done = table(spark, d, "edges").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return truth.sweep_candidates(_facts(spark, d), _links(spark, d).unionByName(of_repo), vector.usable(table(spark, d, "fact_vecs")), done, 20, 500, 3.0, 0.05).withColumn("sim", F.round("sim", 6))


@query(f"WITH {FACTS} SELECT f.id AS old_id, s.id AS new_id FROM f JOIN f s ON s.id = f.superseded_by WHERE f.superseded_at IS NOT NULL")
def repair_pairs(spark, d):
    """Closures to be audited again, none of which was."""
    f = _facts(spark, d)
    return truth.repair_pairs(f, f.limit(0).select(F.col("id").alias("old_id")))


def _verdicts(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("verdict", F.when(F.col("old_id") % 4 == 0, "REOPEN").when(F.col("old_id") % 4 == 1, "REOPEN_CONTRADICT").otherwise("UPHOLD"))


_REPAIR = f"""WITH {FACTS}, v AS (SELECT f.id AS old_id, s.id AS new_id, CASE f.id % 4 WHEN 0 THEN 'REOPEN' WHEN 1 THEN 'REOPEN_CONTRADICT' ELSE 'UPHOLD' END AS verdict FROM f JOIN f s ON s.id = f.superseded_by WHERE f.superseded_at IS NOT NULL)"""


def _repaired(spark, d):
    f = _facts(spark, d)
    return truth.apply_repair(f, table(spark, d, "edges"), _verdicts(repair_pairs(spark, d)), NOW)


@query(_REPAIR + " SELECT id, CASE WHEN id IN (SELECT old_id FROM v WHERE verdict <> 'UPHOLD') THEN NULL ELSE superseded_at END AS superseded_at, CASE WHEN id IN (SELECT old_id FROM v WHERE verdict <> 'UPHOLD') THEN NULL ELSE superseded_by END AS superseded_by FROM f")
def repaired_facts(spark, d):
    """Facts after the audit's verdicts."""
    return _repaired(spark, d)["facts"].select("id", "superseded_at", "superseded_by")


@query(_REPAIR + f""", o AS (SELECT new_id AS src, old_id AS dst, verdict FROM v WHERE verdict <> 'UPHOLD'), e AS (SELECT src, dst, edge_type, recorded_at FROM edges WHERE NOT (edge_type = 'supersedes' AND (src, dst) IN (SELECT (src, dst) FROM o)) UNION ALL SELECT src, dst, 'contradicts', {NOW_SQL} FROM o WHERE verdict = 'REOPEN_CONTRADICT')
SELECT src, dst, edge_type, min(recorded_at) AS recorded_at FROM e GROUP BY 1, 2, 3""")
def repaired_edges(spark, d):
    """Edges after the audit's verdicts."""
    return _repaired(spark, d)["edges"]


_CONFLICT = f"""{FACTS}, c AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'contradicts' AND src <> dst AND src IN (SELECT id FROM f WHERE superseded_at IS NULL) AND dst IN (SELECT id FROM f WHERE superseded_at IS NULL))"""


def _conflicts(spark, d):
    e = table(spark, d, "edges")
    return truth.conflicts(_facts(spark, d), e, e.limit(0).select(F.col("dst").alias("a"), F.col("src").alias("b")))


@query(f"WITH {_CONFLICT} SELECT c.src, c.dst, CASE WHEN (s.valid_from, s.recorded_at) >= (t.valid_from, t.recorded_at) THEN c.src ELSE c.dst END AS winner, CASE WHEN (s.valid_from, s.recorded_at) >= (t.valid_from, t.recorded_at) THEN c.dst ELSE c.src END AS loser FROM c JOIN f s ON s.id = c.src JOIN f t ON t.id = c.dst")
def live_conflicts(spark, d):
    """Contradictions between live facts, and the newer side of each."""
    return truth.newer_side(_facts(spark, d), _conflicts(spark, d))


@query(f"""WITH {_CONFLICT}, s AS (SELECT CASE WHEN (a.valid_from, a.recorded_at) >= (b.valid_from, b.recorded_at) THEN c.dst ELSE c.src END AS old, CASE WHEN (a.valid_from, a.recorded_at) >= (b.valid_from, b.recorded_at) THEN c.src ELSE c.dst END AS new FROM c JOIN f a ON a.id = c.src JOIN f b ON b.id = c.dst WHERE c.src % 2 = 0),
n AS (SELECT old, min(new) AS new FROM s GROUP BY 1) SELECT f.id, coalesce(n.new, f.superseded_by) AS superseded_by FROM f LEFT JOIN n ON n.old = f.id""")
def refereed_facts(spark, d):
    """Facts after a referee closed the older side of some conflicts."""
    v = _conflicts(spark, d).withColumn("verdict", F.when(F.col("src") % 2 == 0, "SUPERSEDE_NEWER").otherwise("DIFFERENT_SCOPE"))
    return truth.apply_referee(_facts(spark, d), v, NOW)[0].select("id", "superseded_by")


@query("""WITH RECURSIVE p AS (SELECT n_name AS name, lead(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS canon, n_nationkey FROM nation), q AS (SELECT name, canon FROM p WHERE canon IS NOT NULL AND n_nationkey % 4 <> 0),
w AS (SELECT name, canon, 1 AS n FROM q UNION ALL SELECT w.name, q.canon, n + 1 FROM w JOIN q ON q.name = w.canon WHERE n < 10) SELECT name, arg_max(canon, n) AS canon FROM w GROUP BY 1""")
def canonical_predicates(spark, d):
    """Where chains of proposed names lead."""
    from pyspark.sql import Window

    n = table(spark, d, "nation")
    p = n.withColumn("canon", F.lead("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))).where("canon IS NOT NULL AND n_nationkey % 4 <> 0")
    return truth.canonical_predicates(p.select(F.col("n_name").alias("name"), "canon"))


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS subject_id, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'RF' ELSE l_returnflag || l_linestatus END AS predicate, l_suppkey AS object_id FROM lineitem) SELECT subject_id, predicate, object_id, min(id) AS id FROM t GROUP BY 1, 2, 3""")
def folded_triples(spark, d):
    """Triples under canonical predicates."""
    return truth.fold_predicates(A.triples(spark, d), spark.createDataFrame([("AF", "RF")], "name string, canon string"))


# --- Metrics.


@query("SELECT event_id AS id, user_id AS entity_id, round(epoch(ts), 6) AS occurred_at, value FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def metric_series(spark, d):
    """One metric over time."""
    o = A.observations(spark, d)
    return metrics.series(o, o.agg(F.min("metric")).first()[0]).withColumn("occurred_at", F.round("occurred_at", 6))


@query("SELECT m.metric, count(e.event_id) AS observations, round(max(epoch(ts)), 6) AS last FROM (SELECT DISTINCT event_type AS metric FROM events UNION SELECT DISTINCT kind FROM facts) m LEFT JOIN events e ON e.event_type = m.metric GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40")
def metric_list(spark, d):
    """Metrics by their number of observations, those never observed included."""
    o = A.observations(spark, d)
    return metrics.metric_list(o.select("metric").unionByName(_facts(spark, d).select(F.col("kind").alias("metric"))), o).withColumn("last", F.round("last", 6))


# --- Mining and topics.


def _patterns(spark, d, f=None):
    f = _facts(spark, d) if f is None else f
    return mining.rare_patterns(f, mining.document_frequency(f))


@query(f"WITH {FACTS}, {_RARE} SELECT id, pattern FROM rp")
def rare_patterns(spark, d):
    """The pattern of rare tokens that finds each fact again."""
    return _patterns(spark, d)


@query(f"""WITH {FACTS}, {_RARE}, p AS (SELECT id, pattern, lower(replace(list_sort(list_transform(string_split(pattern, '.*'), lambda x: lpad(CAST(length(x) AS VARCHAR), 6, '0') || x), 'DESC')[1][7:], '\\.', '.')) AS piece FROM rp), l AS (SELECT id, statement, lower(statement) AS low FROM f WHERE superseded_at IS NULL),
h AS (SELECT p.id, count(*) AS n FROM p JOIN l ON contains(l.low, p.piece) WHERE regexp_matches(l.statement, '(?i)' || p.pattern) GROUP BY 1) SELECT p.id, p.pattern, coalesce(n, 0) AS matches FROM p LEFT JOIN h USING (id) WHERE coalesce(n, 0) <= 20""")
def narrow_patterns(spark, d):
    """Patterns that match few facts."""
    f = materialize(_facts(spark, d).select("id", "statement", "superseded_at"), "facts")
    return mining.narrow(materialize(_patterns(spark, d, f), "patterns"), f)


@query(f"""WITH RECURSIVE {FACTS}, {_RARE}, ch AS (SELECT id, id AS node, 0 AS n FROM f UNION ALL SELECT ch.id, f.superseded_by, n + 1 FROM ch JOIN f ON f.id = ch.node AND f.superseded_at IS NOT NULL AND f.superseded_by IS NOT NULL WHERE n < 20), hd AS (SELECT id, arg_max(node, n) AS head FROM ch GROUP BY 1)
SELECT f.statement AS q, rp.pattern, 'chain' AS miner, CAST(NULL AS VARCHAR) AS as_of FROM f JOIN hd ON hd.id = f.id AND hd.head <> f.id JOIN f h ON h.id = hd.head AND h.superseded_at IS NULL JOIN rp ON rp.id = h.id WHERE f.superseded_at IS NOT NULL""")
def chain_probes(spark, d):
    """Old statements that should find the head of their chain."""
    f = _facts(spark, d)
    return mining.chain_probes(f, temporal.chain_heads(f), _patterns(spark, d))


@query(f"""WITH {FACTS}, {_RARE} SELECT f.statement AS q, rp.pattern, 'time' AS miner, {DATE.format(x='(floor(f.valid_from / 86400) + 1) * 86400')} AS as_of FROM f JOIN f s ON s.id = f.superseded_by JOIN rp ON rp.id = f.id WHERE (floor(f.valid_from / 86400) + 1) * 86400 < s.valid_from""")
def time_probes(spark, d):
    """Questions as of the midnight after a fact became true."""
    return mining.time_probes(_facts(spark, d), _patterns(spark, d))


@query(_self_eval_sql())
def self_eval(spark, d):
    """How often search finds a question's own fact, or the head of its chain, among the first five."""
    f = materialize(_facts(spark, d), "facts")
    asked = _asked(spark, d)
    found = search.hybrid_search(asked, f, table(spark, d, "edges"), _index(spark, d), vector.usable(table(spark, d, "fact_vecs")), NOW, 5)
    goal = temporal.chain_heads(f).select(F.col("id").alias("qid"), "head").join(asked.select("qid"), "qid")
    pats = materialize(_patterns(spark, d), "patterns").select(F.col("id").alias("head"), "pattern")
    probes = goal.join(pats, "head").select("qid", "pattern", F.when(F.col("qid") == F.col("head"), "own").otherwise("continuity").alias("miner"))
    return mining.hit_rates(found, probes)


@query(f"""WITH {FACTS}, {_VECS}, sims AS (SELECT a.id AS qid, b.id, round(list_cosine_similarity(a.vec, b.vec), 9) AS sim FROM vx a, vx b JOIN f ON f.id = b.id AND f.superseded_at IS NULL WHERE a.id % 50 = 0),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, id) AS rank FROM sims) WHERE rank <= 10), g AS (SELECT a.id AS qid, b.id FROM f a JOIN f b ON b.repo = a.repo AND b.kind = a.kind AND b.superseded_at IS NULL WHERE a.id % 50 = 0),
r AS (SELECT g.qid, avg(CASE WHEN t.id IS NULL THEN 0e0 ELSE 1e0 END) AS r FROM g LEFT JOIN t ON t.qid = g.qid AND t.id = g.id GROUP BY 1) SELECT count(*) AS queries, round(avg(r), 6) AS recall, round(avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM r""")
def retrieval_recall(spark, d):
    """How many facts of the same repository and kind are among a fact's ten nearest."""
    f = _facts(spark, d)
    v = vector.usable(table(spark, d, "fact_vecs"))
    top = vector.cosine_top(v.where("id % 50 = 0").select(F.col("id").alias("qid"), "vec"), v.join(temporal.live(f).select("id"), "id", "left_semi"), 10).withColumn("rank", F.col("rank") + 1)
    mine = temporal.live(f).select("id", "repo", "kind").where("repo IS NOT NULL")
    sizes = f.where("id % 50 = 0").select(F.col("id").alias("qid"), "repo", "kind").join(mine.groupBy("repo", "kind").agg(F.count("*").alias("n")), ["repo", "kind"])
    near = top.select("qid", "id").join(mine.withColumnsRenamed({"repo": "r", "kind": "k"}), "id").join(sizes, "qid").where("r = repo AND k = kind").select("qid", "id")
    return metrics.recall_of(near, sizes.select("qid", "n"))


@query(f"""WITH {FACTS} SELECT kind AS split, count(*) AS n, count(*) FILTER (WHERE a AND h) AS hits, count(*) FILTER (WHERE a AND NOT h AND NOT b) AS wrong, count(*) FILTER (WHERE NOT a AND NOT b) AS confidently_wrong, count(*) FILTER (WHERE NOT a AND b) AS rightly_abstained, count(*) FILTER (WHERE a AND b) AS needlessly_abstained
FROM (SELECT kind, superseded_at IS NULL AS a, corroborations > 0 AS h, confidence < 0.7 AS b FROM f) GROUP BY 1""")
def answer_summary(spark, d):
    """Right, wrong and abstained, by kind of fact."""
    return metrics.answer_summary(_facts(spark, d).select(F.col("kind").alias("split"), F.col("superseded_at").isNull().alias("answerable"), (F.col("corroborations") > 0).alias("hit"), (F.col("confidence") < 0.7).alias("abstained")))


@query("""WITH p AS (SELECT l_partkey AS s, lower(l_returnflag || l_linestatus) AS p, l_suppkey AS o FROM lineitem) SELECT CASE p WHEN 'af' THEN 'rf' ELSE p END AS predicate, count(*) AS seen_count FROM p GROUP BY 1""")
def predicate_counts(spark, d):
    """Predicates after alias routing, with how often each was said, before (the even order lines) and now (the odd ones)."""
    t = A.triples(spark, d).select("id", "subject_id", "predicate", "object_id", F.lit(None).cast("string").alias("object_literal"))
    known = t.where("id % 2 = 0").withColumn("predicate", F.when(F.lower("predicate") == "af", "rf").otherwise(F.lower("predicate")))
    return graph.store_triples(known, t.where("id % 2 = 1"), spark.createDataFrame([("af", "rf")], "alias string, predicate string"))[1]


@query()
def topics_of_facts(spark, d):
    """Topics by k-means over live facts' vectors."""
    f = _facts(spark, d)
    v = vector.usable(table(spark, d, "fact_vecs")).join(temporal.live(f).select("id"), "id", "left_semi")
    return topics.topic_table(topics.kmeans(v, 12), f).withColumn("samples", F.array_join("samples", " | "))


# --- Ingest.


@query()
def rendered_lines(spark, d):
    """Transcript lines as rendered turns."""
    return ingest.decode_items(table(spark, d, "session_lines")).where("piece IS NOT NULL").select("line_id", "src_session", "line_offset", "piece")


@query()
def session_chunks(spark, d):
    """Sessions as chunks of at least 4,000 bytes with overlap."""
    lines = ingest.decode_items(table(spark, d, "session_lines").dropDuplicates(["src_session", "line_offset"]))
    return ingest.chunks(lines, 4_000, 500)


@query(f"""WITH {FACTS}, b AS (SELECT id AS pos, coalesce(repo, '') AS r, sha1(regexp_replace(lower(statement), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS h FROM f WHERE recorded_at >= {AS_OF_SQL}),
s AS (SELECT coalesce(repo, '') AS r, sha1(regexp_replace(lower(statement), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS h FROM f WHERE recorded_at < {AS_OF_SQL} AND superseded_at IS NULL),
w AS (SELECT *, first_value(pos) OVER x AS first_pos FROM b WINDOW x AS (PARTITION BY h, r ORDER BY pos)) SELECT pos FROM w WHERE pos = first_pos AND (h, r) NOT IN (SELECT (h, r) FROM s)""")
def batch_inserts(spark, d):
    """Of a batch of facts, those that say something new beside the live facts known before."""
    batch, store = _batch(spark, d)
    return ingest.deduplicate(batch, store)[0].select("pos")


def _batch(spark, d):
    """Facts recorded from AS_OF on, and those recorded before."""
    f = _facts(spark, d)
    return f.where(F.col("recorded_at") >= AS_OF).withColumnRenamed("id", "pos"), f.where(F.col("recorded_at") < AS_OF)


@query(f"""WITH {FACTS}, b AS (SELECT id AS pos, src_session, coalesce(repo, '') AS r, sha1(regexp_replace(lower(statement), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS h FROM f),
w AS (SELECT *, first_value(pos) OVER x AS first_pos, first_value(src_session) OVER x AS first_session FROM b WINDOW x AS (PARTITION BY h, r ORDER BY pos)) SELECT first_pos AS pos, count(*) AS times FROM w WHERE pos <> first_pos AND src_session IS DISTINCT FROM first_session GROUP BY 1""")
def batch_corroborations(spark, d):
    """Of all facts as one batch, how often the first is said again in other sessions."""
    batch = _facts(spark, d).withColumnRenamed("id", "pos")
    return ingest.deduplicate(batch, _facts(spark, d).limit(0))[1].select("pos", "times")


@query(f"""WITH {FACTS} SELECT src_path AS file, repo, bool_or(contains(lower(statement), lower(repo))) AS met FROM f WHERE repo IS NOT NULL AND src_path IS NOT NULL GROUP BY src_path, repo""")
def canaries(spark, d):
    """Whether each transcript has a statement that names its repository."""
    f = _facts(spark, d).where("repo IS NOT NULL AND src_path IS NOT NULL").select(F.struct("src_path", "repo").alias("file"), "repo", "statement")
    want = f.select("file", F.array(F.lower("repo")).alias("keywords")).distinct()
    return ingest.canary(f.select("file", "statement"), want).select("file.src_path", "file.repo", "met").withColumnRenamed("src_path", "file")


@query("""SELECT src, dst, edge_type, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, edge_type ORDER BY pri, recorded_at) AS rn FROM (SELECT src, dst, edge_type, recorded_at, 0 AS pri FROM edges UNION ALL SELECT dst, src, edge_type, recorded_at + 1, 1 FROM edges)) WHERE rn = 1""")
def edge_union(spark, d):
    """Edges and their reverses as a set; an existing edge wins."""
    e = table(spark, d, "edges").groupBy("src", "dst", "edge_type").agg(F.min("recorded_at").alias("recorded_at"))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "edge_type", (F.col("recorded_at") + 1).alias("recorded_at"))
    return ingest.keyed_merge(e, back, ["src", "dst", "edge_type"], new_wins=False)
