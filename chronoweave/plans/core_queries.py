"""Queries of the fact graph's own operators: scalars, filters, joins, aggregates, windows, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import entities as E
from chronoweave.operators import hierarchy, metrics, mining, search, temporal, truth
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


FACTS = "f AS (SELECT DISTINCT ON (id) * FROM facts)"
HL = "(CASE kind WHEN 'status' THEN 7e0 WHEN 'todo' THEN 14e0 WHEN 'fact' THEN 60e0 WHEN 'decision' THEN 120e0 WHEN 'gotcha' THEN 120e0 WHEN 'preference' THEN 365e0 ELSE 60e0 END)"


def mass_sql(now: str, p: str = "") -> str:
    hl = HL.replace("kind", f"{p}kind")
    return f"(0.05e0 + {p}mass * exp(-0.693e0 * greatest(0e0, {now} - {p}valid_from) / ({hl} * 86400e0)))"


NOW_SQL, AS_OF_SQL = f"{NOW:.0f}e0", f"{AS_OF:.0f}e0"
DATE = "strftime(make_timestamp(CAST(floor({x}) AS BIGINT) * 1000000), '%Y-%m-%d')"
VISIBLE = f"v AS (SELECT f.* FROM f LEFT JOIN f s ON s.id = f.superseded_by WHERE f.valid_from <= {AS_OF_SQL} AND (f.superseded_by IS NULL OR s.valid_from > {AS_OF_SQL}))"
LINKS = """fe AS (
  SELECT DISTINCT x.fact_id, e.id AS entity_id FROM (SELECT id AS fact_id, unnest(entities) AS name FROM f) x JOIN entities e ON lower(trim(e.name)) = lower(trim(x.name))
)"""
EDGES = f"""{LINKS}, ee AS (
  SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS count, max(f.valid_from) AS last_seen
  FROM fe x JOIN fe y ON x.fact_id = y.fact_id AND x.entity_id < y.entity_id JOIN f ON f.id = x.fact_id GROUP BY 1, 2
)"""


def _facts(spark, d):
    return A.facts(spark, d)


def _links(spark, d):
    return A.fact_entities(_facts(spark, d), table(spark, d, "entities"))


def _edges(spark, d):
    return A.entity_edges(_links(spark, d), _facts(spark, d))


# --- The flagship: what was known then, by kind.


@query(f"""WITH {FACTS}, {VISIBLE}, w AS (SELECT *, round({mass_sql(AS_OF_SQL)} * (0.5e0 + confidence), 9) AS weight FROM v)
SELECT kind, id, statement, rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY weight DESC, id) AS rank FROM w) WHERE rank <= 10""")
def asof_brief(spark: SparkSession, d: str) -> DataFrame:
    """The brief as of a past moment: ten facts a kind."""
    rows = search.brief(temporal.as_of(_facts(spark, d), AS_OF), AS_OF, 10, per=("kind",))
    return rows.select("kind", "id", "statement", F.col("rank").cast("bigint").alias("rank"))


# --- Scalars.


@query(f"""WITH {FACTS} SELECT id, round({mass_sql(NOW_SQL)}, 6) AS mass, round({mass_sql(NOW_SQL)} - 0.05e0, 6) AS order_mass,
{NOW_SQL} - valid_from > 2 * {HL} * 86400 AS stale, {NOW_SQL} - valid_from > 3 * {HL} * 86400 AS rotten, round(({NOW_SQL} - valid_from) / 8640) / 10 AS age_days, {DATE.format(x='valid_from')} AS day FROM f""")
def mass_and_age(spark, d):
    """Decayed mass, staleness and age of every fact."""
    k, v = F.col("kind"), F.col("valid_from")
    return _facts(spark, d).select("id", F.round(S.decayed_mass(k, F.col("mass"), v, NOW), 6).alias("mass"), F.round(S.order_mass(k, F.col("mass"), v, NOW), 6).alias("order_mass"), S.is_stale(k, v, NOW).alias("stale"), S.is_rotten(k, v, NOW).alias("rotten"), S.age_days(v, NOW).alias("age_days"), S.epoch_date(v).alias("day"))


@query(f"""WITH {FACTS} SELECT id, round(CASE WHEN corroborations > 0 THEN least(0.98e0, 1 - (1 - confidence) * pow(0.7e0, corroborations)) ELSE confidence END, 6) AS corroborated,
round(least(mass + 0.15e0, 3e0), 6) AS reinforced, CASE evidence WHEN 'verified' THEN 1e0 WHEN 'reported' THEN 0.8e0 ELSE 0.6e0 END AS tier,
round(1e0 / (60 + id % 60) + 1.2e0 / (60 + id % 7), 9) AS rrf, least(1800 * pow(2e0, least(use_count, 6)), 86400e0) AS backoff FROM f""")
def evidence_scores(spark, d):
    """Corroboration, reinforcement, evidence tier, rank fusion terms, error backoff."""
    return _facts(spark, d).select(
        "id", F.round(S.corroborated(F.col("confidence"), F.col("corroborations")), 6).alias("corroborated"), F.round(S.reinforced(F.col("mass")), 6).alias("reinforced"),
        S.evidence_tier(F.col("evidence")).alias("tier"), F.round(S.rrf(F.col("id") % 60) + S.rrf(F.col("id") % 7, 1.2), 9).alias("rrf"), S.backoff_seconds(F.col("use_count")).alias("backoff"),
    )


@query("""WITH v AS (SELECT DISTINCT ON (fact_id) * FROM fact_vecs WHERE vec IS NOT NULL), w AS (SELECT DISTINCT ON (fact_id) * FROM fact_vecs_local WHERE vec IS NOT NULL)
SELECT v.fact_id, round(sqrt(list_dot_product(CAST(v.vec AS DOUBLE[]), CAST(v.vec AS DOUBLE[]))), 6) AS norm,
round(list_dot_product(CAST(v.vec[1:least(len(v.vec), len(w.vec))] AS DOUBLE[]), CAST(w.vec[1:least(len(v.vec), len(w.vec))] AS DOUBLE[])), 6) AS across
FROM v JOIN w USING (fact_id)""")
def vector_products(spark, d):
    """Norms, and dot products over the shorter length."""
    a, b = (table(spark, d, t).where("vec IS NOT NULL").dropDuplicates(["fact_id"]) for t in ("fact_vecs", "fact_vecs_local"))
    return a.join(b.withColumnRenamed("vec", "other"), "fact_id").select("fact_id", F.round(S.norm(F.col("vec")), 6).alias("norm"), F.round(S.dot(F.col("vec"), F.col("other")), 6).alias("across"))


@query(f"""WITH {FACTS}, p AS (SELECT id, [confidence, mass, CAST(id % 3 AS DOUBLE)] AS l FROM f), e AS (SELECT id, l, list_transform(l, lambda x: exp(x - list_max(l))) AS x FROM p)
SELECT id, list_position(l, list_max(l)) - 1 AS best, round(list_max(x) / list_sum(x), 6) AS p_best, round(list_sort(l, 'DESC')[1] - list_sort(l, 'DESC')[2], 6) AS margin FROM e""")
def judge_softmax(spark, d):
    """Softmax, argmax and margin of three logits."""
    row = _facts(spark, d).select("id", F.array("confidence", "mass", (F.col("id") % 3).cast("double")).alias("l"))
    return row.select("id", S.argmax(F.col("l")).alias("best"), F.round(F.array_max(S.softmax(F.col("l"))), 6).alias("p_best"), F.round(S.margin(F.col("l")), 6).alias("margin"))


@query(f"WITH {FACTS} SELECT id, sha1(regexp_replace(lower(statement), '[^\\p{{L}}\\p{{Nd}}]', '', 'g')) AS hash FROM f")
def statement_hashes(spark, d):
    """Hash of the letters and digits of each statement."""
    return _facts(spark, d).select("id", S.statement_hash(F.col("statement")).alias("hash"))


@query(r"""SELECT id, lower(trim(display)) AS canon, translate(lower(display), '-_. ', '') AS variant, replace(trim(lower(display)), ' ', '_') AS snake,
length(display) > 0 AND octet_length(encode(display)) <= 48 AND NOT regexp_matches(display, '[/\\`«»]') AND len(regexp_extract_all(display, ' ')) <= 3 AS valid FROM entities""")
def entity_names(spark, d):
    """Canonical, variant and snake-case forms of entity names, and their validity."""
    c = F.col("display")
    return table(spark, d, "entities").select("id", S.canonical_name(c).alias("canon"), S.variant_key(c).alias("variant"), S.snake_name(c).alias("snake"), S.entity_name_ok(c).alias("valid"))


@query(r"""WITH b AS (SELECT line_id, cwd, regexp_extract(cwd, '([^/]+)/*$', 1) AS base FROM session_lines)
SELECT coalesce(CASE WHEN base NOT IN ('', '.', '/') AND octet_length(encode(base)) <= 40 THEN base END, 'unknown') AS repo, count(*) AS lines FROM b GROUP BY 1""")
def repo_labels(spark, d):
    """Lines by the repository that their folder names."""
    return table(spark, d, "session_lines").groupBy(S.repo_of_cwd(F.col("cwd")).alias("repo")).agg(F.count("*").alias("lines"))


_STOP = ", ".join(f"'{w}'" for w in S.STOPWORDS)
QUERY_TOKENS = (
    "(SELECT {id} AS id, CASE WHEN len(c) > 0 THEN c[1:12] ELSE r[1:12] END AS toks FROM (SELECT *, list_filter(r, lambda t, i: lower(t) NOT IN (" + _STOP + ") AND list_position(list_transform(r, lambda y: lower(y)), lower(t)) = i) AS c "
    "FROM (SELECT {id}, regexp_extract_all({text}, '[A-Za-z0-9_.-]{{2,}}')[1:64] AS r FROM {table})))"
)


@query(f"WITH {FACTS} SELECT id, CASE WHEN len(toks) > 0 THEN array_to_string(list_transform(toks, lambda x: '\"' || x || '\"'), ' OR ') ELSE '\"\"' END AS match FROM {QUERY_TOKENS.format(id='id', text='statement', table='f')}")
def match_queries(spark, d):
    """The disjunction of content tokens that each statement would search with."""
    return _facts(spark, d).select("id", S.match_query(F.col("statement")).alias("match"))


@query(r"""SELECT line_id, regexp_replace(message, '""" + S.SECRET.replace("'", "''") + r"""', '[REDACTED]', 'g') AS message FROM session_lines WHERE message IS NOT NULL""")
def redacted_lines(spark, d):
    """Messages after the pattern redaction of the ingest."""
    return table(spark, d, "session_lines").where("message IS NOT NULL").select("line_id", S.redacted(F.col("message")).alias("message"))


_TRACE = "t AS (SELECT DISTINCT ON (lookup_id) lookup_id AS id, asked_at AS ts, CASE WHEN lookup_id % 4 = 0 THEN 'ask' ELSE 'query' END AS kind, concat_ws(' ', 'what is the', kind, 'of', entity, 'in', repo) AS q, [1000 + lookup_id, 1001 + lookup_id * 3] AS cited FROM lookups)"


@query(f"""WITH {FACTS}, {_TRACE}, a AS (SELECT statement AS q FROM f UNION ALL SELECT q FROM t)
SELECT CASE WHEN regexp_matches(q, '{S.HISTORICAL}') THEN 'historical' WHEN regexp_matches(q, '{S.CURRENT}') THEN 'current' ELSE 'neutral' END AS intent, count(*) AS n FROM a GROUP BY 1""")
def temporal_intents(spark, d):
    """Which time a question is about, counted over statements and questions."""
    q = _facts(spark, d).select(F.col("statement").alias("q")).unionByName(A.traces(spark, d).select("q"))
    return q.groupBy(S.temporal_intent(F.col("q")).alias("intent")).agg(F.count("*").alias("n"))


_MARKS = "[" + ", ".join("'" + m.replace("'", "''") + "'" for m in S.DOUBT_MARKERS) + "]"


@query(f"""WITH {FACTS}, l AS (SELECT id, statement, lower(replace(statement, '’', '''')) AS low FROM f)
SELECT id, len(list_filter({_MARKS}, lambda m: contains(low[1:160], m))) > 0 AS leads, len(list_filter({_MARKS}, lambda m: contains(low, m))) > 0 AS denies,
CASE WHEN len(list_filter({_MARKS}, lambda m: contains(low[1:160], m))) > 0 THEN '{S.ABSTAIN_PREFIX} ' || trim(statement) ELSE statement END AS answer FROM l""")
def doubt(spark, d):
    """Whether a text leads with doubt or denies coverage, and its marked form."""
    c = F.col("statement")
    lead = S.leads_with_doubt(c)
    return _facts(spark, d).select("id", lead.alias("leads"), S.denies_coverage(c).alias("denies"), S.with_abstain(c, lead).alias("answer"))


@query(f"WITH {_TRACE} SELECT id, CASE WHEN cited[1] = cited[2] THEN CAST(cited[1] AS VARCHAR) ELSE concat_ws(',', cited[1], cited[2]) END AS cited FROM t")
def cited_ids(spark, d):
    """Ids cited by an answer, in order of appearance."""
    t = A.traces(spark, d).select("id", F.from_json("results", "cited array<bigint>")["cited"].alias("c"))
    text = F.concat(F.lit("See ["), F.get("c", 0), F.lit("] and ["), F.get("c", 1), F.lit("], again ["), F.get("c", 0), F.lit("]."))
    return t.select("id", F.array_join(S.citations(text).cast("array<string>"), ",").alias("cited"))


@query(f"""WITH l AS (SELECT line_id, CASE WHEN regexp_matches(rec_timestamp, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[Tt ]\\d{{2}}:\\d{{2}}:\\d{{2}}(\\.\\d+)?([Zz]|[+-]\\d{{2}}:\\d{{2}})$') THEN coalesce(floor(epoch(TRY_CAST(rec_timestamp AS TIMESTAMPTZ))), 0e0) ELSE 0e0 END AS t FROM session_lines)
SELECT line_id, t, {DATE.format(x='t')} AS day, (floor(t / 86400) + 1) * 86400 AS midnight, (t + {NOW_SQL}) / 2 AS era FROM l""")
def line_times(spark, d):
    """RFC 3339 times as whole epoch seconds (0 where the text is no such time), their date, the midnight after, and a midpoint."""
    t = S.rfc3339_epoch(F.col("rec_timestamp"))
    rows = table(spark, d, "session_lines").select("line_id", t.alias("t"))
    return rows.select("line_id", "t", S.epoch_date(F.col("t")).alias("day"), S.next_midnight(F.col("t")).alias("midnight"), S.era_midpoint(F.col("t"), F.lit(NOW)).alias("era"))


@query(f"""WITH {FACTS}, r AS (SELECT *, CASE WHEN id % 13 = 0 THEN 'note' ELSE kind END AS k, CASE WHEN id % 17 = 0 THEN 1.5e0 ELSE confidence END AS c, CASE WHEN id % 19 = 0 THEN 'heard' ELSE evidence END AS e FROM f),
x AS (SELECT *, CASE WHEN c > 0 AND c <= 1 THEN c ELSE 0.7e0 END AS c2, CASE WHEN e IN ('verified', 'reported') THEN e ELSE 'asserted' END AS e2 FROM r)
SELECT id, CASE WHEN k IN ('status', 'todo', 'fact', 'decision', 'gotcha', 'preference') THEN k ELSE 'fact' END AS kind, CASE e2 WHEN 'reported' THEN least(c2, 0.6e0) WHEN 'asserted' THEN least(c2, 0.8e0) ELSE c2 END AS confidence,
e2 AS evidence, len(entities[1:12]) AS n_entities FROM x WHERE trim(statement) <> ''""")
def cleaned_facts(spark, d):
    """Extracted facts after the cleaning rules."""
    raw = _facts(spark, d).withColumns({
        "kind": F.when(F.col("id") % 13 == 0, "note").otherwise(F.col("kind")), "confidence": F.when(F.col("id") % 17 == 0, 1.5).otherwise(F.col("confidence")),
        "evidence": F.when(F.col("id") % 19 == 0, "heard").otherwise(F.col("evidence")),
    })
    return S.clean_fact(raw).select("id", "kind", "confidence", "evidence", F.size("entities").alias("n_entities"))


@query(f"""WITH {FACTS} SELECT id, format('[{{}}] ({{}}, {{}}, {{}}, {{:.2f}}) {{}}', id, kind, coalesce(repo, 'null'), {DATE.format(x='valid_from')}, confidence, statement) AS line,
format('[valid_from {{}}][evidence {{}}][kind {{}}] {{}}', {DATE.format(x='valid_from')}, evidence, kind, statement) AS side FROM f""")
def fact_lines(spark, d):
    """Facts as a reader and a judge see them."""
    c = F.col
    return _facts(spark, d).select("id", S.fact_line(c("id"), c("kind"), c("repo"), c("valid_from"), c("confidence"), c("statement")).alias("line"), S.prompt_side(c("valid_from"), c("evidence"), c("kind"), c("statement")).alias("side"))


# --- Filters and joins.


@query(f"WITH {FACTS} SELECT count(*) AS total, count(*) FILTER (WHERE superseded_at IS NULL) AS live, count(*) FILTER (WHERE superseded_at IS NOT NULL) AS dead, count(DISTINCT coalesce(repo, '')) AS repos, max(id) AS last_id FROM f")
def fact_counts(spark, d):
    """Live, dead and all facts, repositories, and the last id, in one pass."""
    return _facts(spark, d).agg(F.count("*").alias("total"), F.count_if(F.col("superseded_at").isNull()).alias("live"), F.count_if(F.col("superseded_at").isNotNull()).alias("dead"), F.countDistinct(F.coalesce("repo", F.lit(""))).alias("repos"), F.max("id").alias("last_id"))


@query(f"WITH {FACTS}, {VISIBLE} SELECT id FROM v")
def as_of_facts(spark, d):
    """Facts visible at a past moment."""
    return temporal.as_of(_facts(spark, d), AS_OF).select("id")


@query(f"WITH {FACTS} SELECT f.id AS old_id, s.id AS new_id, f.valid_from AS old_valid_from, s.valid_from AS new_valid_from FROM f JOIN f s ON s.id = f.superseded_by WHERE s.valid_from > f.valid_from + 3600")
def supersession_pairs(spark, d):
    """Facts and their superseders, an hour apart at least."""
    return temporal.supersession_pairs(_facts(spark, d), 3600)


@query(f"""WITH RECURSIVE {FACTS}, w AS (SELECT id, id AS node, 0 AS n FROM f UNION ALL SELECT w.id, f.superseded_by, n + 1 FROM w JOIN f ON f.id = w.node AND f.superseded_at IS NOT NULL AND f.superseded_by IS NOT NULL WHERE n < 20)
SELECT id, arg_max(node, n) AS head FROM w GROUP BY id""")
def chain_heads(spark, d):
    """Where twenty links lead from each fact."""
    return temporal.chain_heads(_facts(spark, d), 20)


#: (id, path): where parents lead from each fact, until a fact without one or the first that was met before.
WALKS = """n AS (SELECT f.id, p.id AS p FROM (SELECT DISTINCT ON (id) id, superseded_by FROM facts) f LEFT JOIN (SELECT DISTINCT id FROM facts) p ON p.id = f.superseded_by),
w AS (SELECT id, id AS node, [id] AS path FROM n UNION ALL SELECT w.id, n.p, list_append(w.path, n.p) FROM w JOIN n ON n.id = w.node WHERE n.p IS NOT NULL AND NOT list_contains(w.path, n.p)),
e AS (SELECT id, arg_max(path, len(path)) AS path FROM w GROUP BY 1),
c AS (SELECT e.id, e.path, n.p AS back, CASE WHEN n.p IS NOT NULL THEN list_slice(e.path, list_position(e.path, n.p), len(e.path)) END AS ring FROM e JOIN n ON n.id = e.path[len(e.path)]),
tr AS (SELECT id, CASE WHEN ring IS NULL THEN path[len(path)] ELSE list_min(ring) END AS root, path, ring FROM c), td AS (SELECT *, list_position(path, root) - 1 AS depth FROM tr)"""


@query(f"WITH RECURSIVE {WALKS} SELECT root, count(*) AS members, CAST(max(depth) AS INT) AS depth FROM td GROUP BY 1")
def chain_members(spark, d):
    """Members of each supersession chain, in both directions."""
    t = hierarchy.hierarchy(table(spark, d, "facts"), "id", "superseded_by")
    return t.groupBy("root").agg(F.count("*").alias("members"), F.max("depth").alias("depth"))


@query(f"WITH {FACTS}, c AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'contradicts') SELECT c.dst AS id, count(*) AS n FROM c JOIN f ON f.id = c.src AND f.superseded_at IS NULL GROUP BY 1")
def contradiction_counts(spark, d):
    """How many live facts contradict each fact."""
    return search.live_contradictions(_facts(spark, d), table(spark, d, "edges"))


@query(f"WITH {FACTS} SELECT f.id FROM f LEFT JOIN fact_vecs v ON v.fact_id = f.id WHERE v.fact_id IS NULL AND f.superseded_at IS NULL")
def unembedded_facts(spark, d):
    """Live facts without a vector."""
    return temporal.live(_facts(spark, d)).select("id").join(table(spark, d, "fact_vecs").select(F.col("fact_id").alias("id")), "id", "left_anti")


@query(f"WITH {FACTS}, {_TRACE}, c AS (SELECT id, unnest(cited) AS fact_id FROM t) SELECT c.id, c.fact_id FROM c WHERE fact_id IN (SELECT id FROM f)")
def cited_facts(spark, d):
    """Cited ids that exist as facts."""
    c = A.traces(spark, d).where(F.contains("results", F.lit('"cited"'))).select("id", F.explode(F.from_json("results", "cited array<bigint>")["cited"]).alias("fact_id"))
    return c.join(_facts(spark, d).select(F.col("id").alias("fact_id")), "fact_id", "left_semi").select("id", "fact_id")


@query(f"WITH {FACTS} SELECT id % 8 AS part, count(*) AS n, count(*) FILTER (WHERE evidence = 'verified' OR corroborations >= 1 OR confidence >= 0.9) AS eligible FROM f GROUP BY 1")
def partitioned_work(spark, d):
    """Facts by modulo partition, and those eligible for probes."""
    return _facts(spark, d).groupBy((F.col("id") % 8).alias("part")).agg(F.count("*").alias("n"), F.count_if(F.expr(mining.ELIGIBLE)).alias("eligible"))


@query(f"""WITH {FACTS}, {LINKS}, l AS (SELECT * FROM f WHERE superseded_at IS NULL),
q AS (SELECT id AS qid, repo, kind FROM l WHERE id % 50 = 0),
s AS (SELECT q.qid, l.id FROM q JOIN l ON l.repo = q.repo AND l.kind = q.kind WHERE l.id <> q.qid
  UNION SELECT q.qid, l.id FROM q JOIN fe a ON a.fact_id = q.qid JOIN fe b ON b.entity_id = a.entity_id JOIN l ON l.id = b.fact_id AND l.kind = q.kind WHERE l.id <> q.qid)
SELECT qid, count(*) AS candidates FROM s GROUP BY 1""")
def scope_candidates(spark, d):
    """Live facts of the same kind in the same repository or with a shared entity."""
    f, fe = temporal.live(_facts(spark, d)), _links(spark, d)
    q = f.where("id % 50 = 0").select(F.col("id").alias("qid"), "repo", "kind")
    mine = f.select("id", "repo", "kind")
    # Those of the same repository are counted by group; only what shares an entity elsewhere is paired.
    of_repo = q.join(mine.where("repo IS NOT NULL").groupBy("repo", "kind").agg((F.count("*") - 1).alias("n")), ["repo", "kind"]).select("qid", "n")
    shared = q.join(fe.select(F.col("fact_id").alias("qid"), "entity_id"), "qid").select("qid", "kind", "entity_id").join(fe, "entity_id").select("qid", "kind", F.col("fact_id").alias("id")).distinct().join(mine.withColumnRenamed("repo", "own"), ["id", "kind"])
    elsewhere = shared.join(q.select("qid", "repo"), "qid").where("qid <> id AND NOT coalesce(own = repo, false)").groupBy("qid").agg(F.count("*").alias("n"))
    return of_repo.unionByName(elsewhere).groupBy("qid").agg(F.sum("n").alias("candidates")).where("candidates > 0")


@query(f"""WITH {FACTS}, {LINKS} SELECT fact_id, id, name FROM (SELECT fe.fact_id, e.id, e.name, row_number() OVER (PARTITION BY fe.fact_id ORDER BY e.seen_count DESC, e.id) AS rn FROM fe JOIN f ON f.id = fe.fact_id AND f.superseded_at IS NULL JOIN entities e ON e.id = fe.entity_id) WHERE rn = 1""")
def top_entity(spark, d):
    """The most seen entity of each live fact."""
    e = table(spark, d, "entities").select(F.col("id").alias("entity_id"), "name", "seen_count")
    rows = _links(spark, d).join(temporal.live(_facts(spark, d)).select(F.col("id").alias("fact_id")), "fact_id", "left_semi").join(e, "entity_id")
    best = rows.groupBy("fact_id").agg(F.min(F.struct(-F.col("seen_count"), F.col("entity_id").alias("id"), "name")).alias("b"))
    return best.select("fact_id", "b.id", "b.name")


# --- Aggregates.


@query(f"WITH {FACTS} SELECT coalesce(repo, '') AS repo, count(*) AS n, count(*) FILTER (WHERE superseded_at IS NULL) AS live FROM f GROUP BY 1 ORDER BY n DESC, repo LIMIT 20")
def facts_by_repo(spark, d):
    """The repositories with most facts."""
    return _facts(spark, d).groupBy(F.coalesce("repo", F.lit("")).alias("repo")).agg(F.count("*").alias("n"), F.count_if(F.col("superseded_at").isNull()).alias("live")).orderBy(F.desc("n"), "repo").limit(20)


@query("SELECT coalesce(etype, '') AS etype, count(*) AS n, sum(seen_count) AS seen FROM entities GROUP BY 1")
def entities_by_type(spark, d):
    return table(spark, d, "entities").groupBy(F.coalesce("etype", F.lit("")).alias("etype")).agg(F.count("*").alias("n"), F.sum("seen_count").alias("seen"))


_JUDGE = f"""{FACTS}, j AS (SELECT id AS old_id, superseded_by AS new_id, CASE WHEN id % 11 = 0 THEN '' ELSE (['supersedes', 'contradicts', 'unrelated'])[id % 3 + 1] END AS llm_verdict,
(['supersedes', 'contradicts', 'unrelated'])[(id + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END) % 3 + 1] AS local_verdict, (id % 100) / 100e0 AS local_margin FROM f WHERE superseded_by IS NOT NULL)"""


@query(f"WITH {_JUDGE} SELECT local_verdict AS verdict, count(*) AS n FROM j GROUP BY 1")
def verdict_histogram(spark, d):
    return truth.verdict_counts(A.judge_log(_facts(spark, d)).withColumnRenamed("local_verdict", "verdict"))


@query(f"""WITH {_JUDGE} SELECT CASE WHEN local_margin < 0.25 THEN '0.00-0.25' WHEN local_margin < 0.5 THEN '0.25-0.50' WHEN local_margin < 0.75 THEN '0.50-0.75' ELSE '0.75-1.00' END AS bucket,
count(*) FILTER (WHERE llm_verdict <> '') AS n, count(*) FILTER (WHERE llm_verdict <> '' AND llm_verdict = local_verdict) AS agree, count(*) FILTER (WHERE llm_verdict = '') AS active,
round(count(*) FILTER (WHERE llm_verdict <> '' AND llm_verdict = local_verdict) / greatest(count(*) FILTER (WHERE llm_verdict <> ''), 1), 6) AS rate FROM j GROUP BY 1""")
def judge_agreement(spark, d):
    """Agreement of two judges by margin."""
    return metrics.agreement_by_margin(A.judge_log(_facts(spark, d)))


@query(f"""WITH {_JUDGE}, p AS (SELECT llm_verdict AS verdict, 1 AS t, 0 AS s, CAST(llm_verdict = local_verdict AS INT) AS h FROM j WHERE llm_verdict <> '' UNION ALL SELECT local_verdict, 0, 1, 0 FROM j WHERE llm_verdict <> '')
SELECT verdict, sum(t) AS truth, sum(s) AS said, round(sum(h) / greatest(sum(s), 1), 6) AS precision, round(sum(h) / greatest(sum(t), 1), 6) AS recall FROM p GROUP BY 1""")
def judge_quality(spark, d):
    """Precision and recall by verdict."""
    return metrics.class_quality(A.judge_log(_facts(spark, d)))


@query(f"WITH {_JUDGE} SELECT count(*) AS pairs, round(avg(CASE WHEN llm_verdict NOT IN ('supersedes', '') THEN 1e0 ELSE 0e0 END), 6) AS false_rate FROM j")
def false_supersessions(spark, d):
    """The share of closures that a judge rejects."""
    return A.judge_log(_facts(spark, d)).agg(F.count("*").alias("pairs"), F.round(F.avg(F.when(~F.col("llm_verdict").isin("supersedes", ""), 1.0).otherwise(0.0)), 6).alias("false_rate"))


@query(f"WITH {FACTS} SELECT token, count(*) AS df FROM (SELECT id, unnest(list_distinct(list_transform(regexp_extract_all(statement, '[A-Za-z0-9_.-]{{2,}}')[1:200], lambda t: lower(t)))) AS token FROM f WHERE superseded_at IS NULL) GROUP BY 1")
def document_frequency(spark, d):
    return mining.document_frequency(_facts(spark, d))


@query(f"WITH {FACTS}, {_TRACE}, c AS (SELECT t.id, unnest(cited) AS fid FROM t), r AS (SELECT c.id, avg(CASE WHEN f.id IS NULL THEN 0e0 ELSE 1e0 END) AS r FROM c LEFT JOIN f ON f.id = c.fid GROUP BY 1) SELECT count(*) AS traces, round(avg(r), 3) AS recall FROM r")
def citation_recall(spark, d):
    """Mean share of cited ids that exist."""
    return mining.citation_recall(A.traces(spark, d), _facts(spark, d))


@query("""WITH r AS (SELECT event_type AS route, event_id AS id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS rn FROM events), s AS (SELECT route, list_sort(list(value)) AS v FROM r WHERE rn <= 2048 GROUP BY 1)
SELECT route, len(v) AS n, v[CAST(floor(0.5e0 * (len(v) - 1)) AS INT) + 1] AS p50, v[CAST(floor(0.95e0 * (len(v) - 1)) AS INT) + 1] AS p95, list_max(v) AS max FROM s""")
def latencies(spark, d):
    """Percentiles of the newest 2,048 values of each route."""
    return metrics.latency(table(spark, d, "events").select(F.col("event_type").alias("route"), F.col("event_id").alias("id"), "value"))


@query("SELECT event_type, value AS upper_median FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE rn = n // 2")
def upper_medians(spark, d):
    return metrics.upper_median(table(spark, d, "events"), "event_type", "value")


_HITS = f"{FACTS}, h AS (SELECT confidence, superseded_at IS NULL AS hit FROM f)"


@query(f"WITH {_HITS} SELECT CAST(least(floor(confidence * 5), 4) AS INT) AS bucket, count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate FROM h GROUP BY 1")
def calibration(spark, d):
    """Hit rate by fifths of confidence."""
    return metrics.calibration(_facts(spark, d).select("confidence", F.col("superseded_at").isNull().alias("hit")))


@query(f"""WITH {_HITS}, s AS (SELECT unnest(range(10, 91, 5)) / 100e0 AS threshold)
SELECT threshold, count(*) FILTER (WHERE confidence >= threshold) AS answered, count(*) FILTER (WHERE confidence >= threshold AND hit) AS right, count(*) FILTER (WHERE confidence >= threshold AND NOT hit) AS wrong FROM s, h GROUP BY 1""")
def threshold_sweep(spark, d):
    """Answers above each threshold, right and wrong."""
    return metrics.threshold_sweep(_facts(spark, d).select("confidence", F.col("superseded_at").isNull().alias("hit")))


@query("""WITH e AS (SELECT id, translate(lower(name), '-_. ', '') AS key, seen_count FROM (SELECT id, name, seen_count FROM entities UNION ALL SELECT DISTINCT a.id + 10000000, upper(alias), CAST(round(a.confidence * 100) AS BIGINT) FROM entity_aliases a)), g AS (SELECT key, first(id ORDER BY seen_count DESC, id) AS winner, list_sort(list(DISTINCT id)) AS ids, sum(seen_count) AS seen FROM e WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT id) > 1)
SELECT key, winner, array_to_string(list_filter(ids, lambda x: x <> winner), ',') AS losers, seen FROM g""")
def variant_groups(spark, d):
    """Names, of entities and their aliases, that differ in form alone."""
    said = table(spark, d, "entity_aliases").select((F.col("id") + 10_000_000).alias("id"), F.upper("alias").alias("name"), F.round(F.col("confidence") * 100).cast("bigint").alias("seen_count")).distinct()
    return E.variant_groups(table(spark, d, "entities").select("id", "name", "seen_count").unionByName(said)).withColumn("losers", F.array_join(F.col("losers").cast("array<string>"), ","))


@query(f"WITH {FACTS} SELECT coalesce(repo, '') AS old, CASE WHEN repo IS NULL OR repo = 'unknown' THEN coalesce(nullif(split_part(files[1], '/', 1), ''), 'unknown') ELSE repo END AS new, count(*) AS n FROM f GROUP BY 1, 2")
def relabel_plan(spark, d):
    """How repositories would be relabelled."""
    first = F.nullif(F.split_part(F.get("files", 0), F.lit("/"), F.lit(1)), F.lit(""))
    new = F.when(F.col("repo").isNull() | (F.col("repo") == "unknown"), F.coalesce(first, F.lit("unknown"))).otherwise(F.col("repo"))
    return _facts(spark, d).groupBy(F.coalesce("repo", F.lit("")).alias("old"), new.alias("new")).agg(F.count("*").alias("n"))


@query(f"WITH {FACTS} SELECT count(*) FILTER (WHERE quote IS NOT NULL) AS quoted, count(*) FILTER (WHERE len(entities) > 0) AS linked, count(*) FILTER (WHERE id IN (SELECT fact_id FROM fact_vecs)) AS embedded, count(*) AS live FROM f WHERE superseded_at IS NULL")
def coverage(spark, d):
    """How far live facts are quoted, linked and embedded."""
    v = table(spark, d, "fact_vecs").select(F.col("fact_id").alias("id"), F.lit(1).alias("has")).distinct()
    j = temporal.live(_facts(spark, d)).join(v, "id", "left")
    return j.agg(F.count("quote").alias("quoted"), F.count_if(F.size("entities") > 0).alias("linked"), F.count("has").alias("embedded"), F.count("*").alias("live"))


@query(f"WITH {FACTS}, w AS (SELECT *, round({mass_sql(NOW_SQL)} * (0.5e0 + confidence), 9) AS weight FROM f WHERE superseded_at IS NULL AND repo = 'brindlecore'), t AS (SELECT * FROM w ORDER BY weight DESC, id LIMIT 40) SELECT kind, string_agg(CAST(id AS VARCHAR), ',' ORDER BY weight DESC, id) AS ids FROM t GROUP BY 1")
def standing_brief(spark, d):
    """The brief of a repository, by kind."""
    return search.by_kind(search.brief(temporal.live(_facts(spark, d)), NOW, 40, "brindlecore")).select("kind", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


# --- Windows and top-k.


@query(f"WITH {FACTS} SELECT repo, id, rn FROM (SELECT coalesce(repo, '') AS repo, id, row_number() OVER (PARTITION BY coalesce(repo, '') ORDER BY corroborations DESC, recorded_at DESC, id DESC) AS rn FROM f) WHERE rn <= 20")
def fixture_top(spark, d):
    """The best-supported facts of each repository."""
    w = Window.partitionBy("repo").orderBy(F.desc("corroborations"), F.desc("recorded_at"), F.desc("id"))
    f = _facts(spark, d).withColumn("repo", F.coalesce("repo", F.lit("")))
    return f.withColumn("rn", F.row_number().over(w)).where("rn <= 20").select("repo", "id", F.col("rn").cast("bigint").alias("rn"))


@query(f"""WITH {FACTS}, w AS (SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY md5(concat_ws('-', id, '7')), id) AS rn, count(*) OVER (PARTITION BY kind) AS n, count(*) OVER () AS total FROM f)
SELECT id, kind FROM w WHERE rn <= ceil(100 * n / total) ORDER BY kind, rn LIMIT 100""")
def quota_sample(spark, d):
    """A hundred facts, each kind in proportion, in seeded order."""
    return mining.quota_sample(_facts(spark, d), "kind", 100).select("id", "kind")


@query(f"WITH {FACTS}, {LINKS} SELECT entity_id, fact_id, rank, mass FROM (SELECT fe.entity_id, fe.fact_id, round({mass_sql(NOW_SQL, 'f.')}, 3) AS mass, row_number() OVER (PARTITION BY fe.entity_id ORDER BY round({mass_sql(NOW_SQL, 'f.')}, 3) DESC, fe.fact_id) AS rank FROM fe JOIN f ON f.id = fe.fact_id WHERE f.superseded_at IS NULL) WHERE rank <= 5")
def entity_top_facts(spark, d):
    """The heaviest facts of each entity."""
    return E.entity_facts(_links(spark, d), _facts(spark, d), NOW, 5).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {FACTS}, {EDGES}, n AS (SELECT a AS id, b AS other, count FROM ee UNION ALL SELECT b, a, count FROM ee) SELECT id, other, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, other) AS rank FROM n) WHERE rank <= 15")
def co_mentions(spark, d):
    """The entities most often mentioned with each."""
    return E.co_mentions(_edges(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"WITH {FACTS}, {EDGES} SELECT a, b, count, last_seen FROM ee")
def entity_edges(spark, d):
    """Co-mention edges."""
    return _edges(spark, d)


@query(f"WITH {FACTS} SELECT id, valid_from, statement, superseded_at IS NOT NULL AS closed FROM f WHERE repo = 'brindlecore' ORDER BY valid_from, id LIMIT 250")
def narrative_evidence(spark, d):
    """What the story of a repository is told from."""
    from chronoweave.operators.topics import evidence

    return evidence(_facts(spark, d).where("repo = 'brindlecore'"))


@query(f"""WITH {FACTS}, p AS (SELECT f.id AS o, s.id AS n, f.valid_from AS v1, f.evidence AS e1, f.kind AS k1, f.statement AS s1, s.valid_from AS v2, s.evidence AS e2, s.kind AS k2, s.statement AS s2 FROM f JOIN f s ON s.id = f.superseded_by ORDER BY md5(concat_ws('-', f.id, '42')), f.id LIMIT 100)
SELECT o AS old_id, n AS new_id, format('[valid_from {{}}][evidence {{}}][kind {{}}] {{}}', {DATE.format(x='v1')}, e1, k1, s1) AS old_side, format('[valid_from {{}}][evidence {{}}][kind {{}}] {{}}', {DATE.format(x='v2')}, e2, k2, s2) AS new_side FROM p""")
def audit_sample(spark, d):
    """A seeded sample of closures for a judge."""
    return truth.audit_sample(_facts(spark, d), 100)
