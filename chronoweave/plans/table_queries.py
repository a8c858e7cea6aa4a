"""Queries of what changes the tables (ingest, links, merges, reinforcement, traces) and of scalars on single rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import entities as E
from chronoweave.operators import ingest, metrics, search, temporal, truth, upsert, vector
from chronoweave.plans.core_queries import _TRACE, AS_OF_SQL, DATE, EDGES, FACTS, LINKS, NOW_SQL, _edges, _facts, _links, mass_sql
from chronoweave.plans.graph_queries import _MAP, _asked, _index, _live_sql, _merged
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


# --- A batch into the store: the store is what was recorded before AS_OF, the batch what was recorded from then on, with every decision said once more in another session.

_HASH = "sha1(regexp_replace(lower(statement), '[^\\p{L}\\p{Nd}]', '', 'g'))"
_UP = f"""{FACTS}, st AS (SELECT * REPLACE (CASE WHEN superseded_at < {AS_OF_SQL} THEN superseded_at END AS superseded_at, CASE WHEN superseded_at < {AS_OF_SQL} THEN superseded_by END AS superseded_by) FROM f WHERE recorded_at < {AS_OF_SQL}),
ba AS (SELECT *, coalesce(repo, '') AS r, {_HASH} AS h FROM (SELECT * FROM f WHERE recorded_at >= {AS_OF_SQL} UNION ALL SELECT * REPLACE (id + 10000000 AS id, statement || ' !' AS statement, coalesce(src_session, '') || '-later' AS src_session, valid_from + 1000 AS valid_from, 'verified' AS evidence) FROM f WHERE kind = 'decision')),
kn AS (SELECT h, r, id AS kid, src_session AS own FROM (SELECT *, row_number() OVER (PARTITION BY h, r ORDER BY id) AS rn FROM (SELECT id, src_session, coalesce(repo, '') AS r, {_HASH} AS h FROM st WHERE superseded_at IS NULL)) WHERE rn = 1),
jo AS (SELECT ba.*, kn.kid, kn.own, first_value(ba.id) OVER w AS first_pos, first_value(ba.src_session) OVER w AS first_session FROM ba LEFT JOIN kn USING (h, r) WINDOW w AS (PARTITION BY h, r ORDER BY ba.id)),
ins AS (SELECT * FROM jo WHERE kid IS NULL AND id = first_pos),
ag AS (SELECT coalesce(kid, first_pos) AS id, count(*) AS times, max(valid_from) AS last, bool_or(evidence = 'verified') AS verified FROM jo WHERE (kid IS NOT NULL OR id <> first_pos) AND src_session IS DISTINCT FROM coalesce(own, first_session) GROUP BY 1),
fa AS (SELECT x.id, CASE WHEN times > 0 THEN least(0.98e0, 1 - (1 - confidence) * pow(0.7e0, times)) ELSE confidence END AS confidence, CAST(corroborations + coalesce(times, 0) AS INT) AS corroborations, greatest(valid_from, coalesce(last, valid_from)) AS valid_from, CASE WHEN verified THEN 'verified' ELSE evidence END AS evidence, superseded_at
  FROM (SELECT id, confidence, corroborations, valid_from, evidence, superseded_at FROM st UNION ALL SELECT id, confidence, 0, valid_from, evidence, NULL FROM ins) x LEFT JOIN ag USING (id))"""


def _store(spark: SparkSession, d: str) -> DataFrame:
    then = F.col("superseded_at") < AS_OF
    return _facts(spark, d).where(F.col("recorded_at") < AS_OF).withColumns({"superseded_by": F.when(then, F.col("superseded_by")), "superseded_at": F.when(then, F.col("superseded_at"))})


def _new(spark: SparkSession, d: str) -> DataFrame:
    f = _facts(spark, d)
    again = f.where("kind = 'decision'").withColumns({
        "id": F.col("id") + 10_000_000, "statement": F.concat("statement", F.lit(" !")), "src_session": F.concat(F.coalesce("src_session", F.lit("")), F.lit("-later")), "valid_from": F.col("valid_from") + 1000, "evidence": F.lit("verified"),
    })
    return f.where(F.col("recorded_at") >= AS_OF).unionByName(again).withColumnRenamed("id", "pos")


def _upserted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    store = materialize(_store(spark, d), "store")
    return store, *upsert.facts(store, _new(spark, d))


@query(f"WITH {_UP} SELECT id, round(confidence, 9) AS confidence, corroborations, valid_from, evidence FROM fa")
def upserted_facts(spark, d):
    """The facts after a batch: new ones, and old ones said again."""
    return _upserted(spark, d)[1].select("id", F.round("confidence", 9).alias("confidence"), "corroborations", "valid_from", "evidence")


@query(f"WITH {_UP} SELECT id, times, last, verified FROM ag")
def restatements(spark, d):
    """What a batch says again, how often, until when, and whether as verified."""
    return ingest.deduplicate(_new(spark, d), _store(spark, d))[1].select(F.coalesce("id", "pos").alias("id"), "times", "last", "verified")


_LINKED = f"""{_UP}, old AS (SELECT DISTINCT x.fact_id, e.id AS entity_id FROM (SELECT id AS fact_id, unnest(entities) AS name FROM st) x JOIN entities e ON lower(trim(e.name)) = lower(trim(x.name))),
av AS (SELECT DISTINCT entity_id, lower(trim(alias)) AS c, confidence FROM entity_aliases WHERE valid_to IS NULL AND entity_id IN (SELECT id FROM entities)),
sa AS (SELECT ins.id AS fact_id, unnest(entities) AS name FROM ins),
nm AS (SELECT DISTINCT name, lower(trim(name)) AS c FROM sa WHERE length(lower(trim(name))) > 0 AND octet_length(encode(lower(trim(name)))) <= 48 AND NOT regexp_matches(lower(trim(name)), '[/\\\\`«»]') AND len(regexp_extract_all(lower(trim(name)), ' ')) <= 3),
ra AS (SELECT nm.name, e.id AS entity_id, 0 AS pri, CAST(e.seen_count AS DOUBLE) AS w FROM nm JOIN entities e ON lower(trim(e.name)) = nm.c UNION ALL SELECT nm.name, av.entity_id, 1, av.confidence FROM nm JOIN av ON av.c = nm.c),
rb AS (SELECT name, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY pri, w DESC, entity_id) AS rn FROM ra) WHERE rn = 1),
ke AS (SELECT translate(lower(name), '-_. ', '') AS key, min(id) AS entity_id FROM entities GROUP BY 1 HAVING count(*) = 1),
rc AS (SELECT nm.name, ke.entity_id FROM nm JOIN ke ON ke.key = translate(lower(nm.name), '-_. ', '') AND ke.key <> '' WHERE nm.name NOT IN (SELECT name FROM rb)),
kno AS (SELECT * FROM rb UNION ALL SELECT * FROM rc),
fresh AS (SELECT DISTINCT sa.fact_id, kno.entity_id FROM sa JOIN kno USING (name))"""


def _linked(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    store, _, inserted = _upserted(spark, d)
    old = A.fact_entities(store, table(spark, d, "entities"))
    return upsert.links(inserted, table(spark, d, "entities"), table(spark, d, "entity_aliases"), old, A.entity_edges(old, store), AS_OF) | {"inserted": inserted}


def _top(spark: SparkSession, d: str) -> int:
    return table(spark, d, "entities").agg(F.max("id")).first()[0]


@query(f"WITH {_LINKED}, n AS (SELECT entity_id, count(*) AS n FROM fresh GROUP BY 1) SELECT e.id, CAST(e.seen_count + coalesce(n.n, 0) AS BIGINT) AS seen_count, CASE WHEN n.n > 0 THEN greatest(e.last_seen, {AS_OF_SQL}) ELSE e.last_seen END AS last_seen FROM entities e LEFT JOIN n ON n.entity_id = e.id")
def linked_entities(spark, d):
    """How often known entities were seen after a batch, and when last."""
    return _linked(spark, d)["entities"].where(F.col("id") <= _top(spark, d)).select("id", "seen_count", "last_seen")


@query(f"WITH {_LINKED} SELECT fact_id, entity_id FROM old UNION SELECT fact_id, entity_id FROM fresh")
def linked_facts(spark, d):
    """Links of facts to known entities after a batch."""
    return _linked(spark, d)["links"].where(F.col("entity_id") <= _top(spark, d))


@query(f"""WITH {_LINKED}, oe AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS count, max(st.valid_from) AS last_seen FROM old x JOIN old y ON x.fact_id = y.fact_id AND x.entity_id < y.entity_id JOIN st ON st.id = x.fact_id GROUP BY 1, 2),
ne AS (SELECT x.entity_id AS a, y.entity_id AS b, count(*) AS count, {AS_OF_SQL} AS last_seen FROM fresh x JOIN fresh y ON x.fact_id = y.fact_id AND x.entity_id < y.entity_id GROUP BY 1, 2)
SELECT a, b, CAST(sum(count) AS BIGINT) AS count, max(last_seen) AS last_seen FROM (SELECT * FROM oe UNION ALL SELECT * FROM ne) GROUP BY 1, 2""")
def linked_edges(spark, d):
    """Co-mention edges between known entities after a batch."""
    top = _top(spark, d)
    return _linked(spark, d)["edges"].where((F.col("a") <= top) & (F.col("b") <= top))


@query(f"WITH {_LINKED} SELECT DISTINCT translate(lower(name), '-_. ', '') AS vkey FROM nm WHERE name NOT IN (SELECT name FROM kno)")
def made_entities(spark, d):
    """The entities a batch makes, by variant key."""
    return _linked(spark, d)["entities"].where(F.col("id") > _top(spark, d)).select("vkey")


_CLOSE = f"""{FACTS}, st AS (SELECT id, valid_from, CASE WHEN superseded_at < {AS_OF_SQL} THEN superseded_at END AS superseded_at, CASE WHEN superseded_at < {AS_OF_SQL} THEN superseded_by END AS superseded_by FROM f),
vd AS (SELECT f.id AS old, f.superseded_by AS new, 'supersedes' AS verdict FROM f WHERE f.superseded_by IS NOT NULL AND (superseded_at IS NULL OR superseded_at >= {AS_OF_SQL}) UNION SELECT dst, src, 'contradicts' FROM edges WHERE edge_type = 'contradicts' AND recorded_at >= {AS_OF_SQL} AND src <> dst)"""


def _closed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f, e = _facts(spark, d), table(spark, d, "edges")
    then = F.col("superseded_at") < AS_OF
    store = f.withColumns({"superseded_by": F.when(then, F.col("superseded_by")), "superseded_at": F.when(then, F.col("superseded_at"))})
    later = f.where(F.col("superseded_by").isNotNull() & ~F.coalesce(then, F.lit(False))).select(F.col("id").alias("old"), F.col("superseded_by").alias("new"), F.lit("supersedes").alias("verdict"))
    against = e.where((F.col("edge_type") == "contradicts") & (F.col("recorded_at") >= AS_OF)).select(F.col("dst").alias("old"), F.col("src").alias("new"), F.lit("contradicts").alias("verdict")).distinct()
    return upsert.closures(store, e.where(F.col("recorded_at") < AS_OF), later.unionByName(against), NOW)


@query(f"""WITH {_CLOSE}, ok AS (SELECT old, min(new) AS new FROM vd WHERE verdict = 'supersedes' AND old <> new AND NOT (old < new AND EXISTS (SELECT 1 FROM vd z WHERE z.verdict = 'supersedes' AND z.old = vd.new AND z.new = vd.old)) GROUP BY 1),
cl AS (SELECT st.id, ok.new FROM st JOIN ok ON ok.old = st.id JOIN st n ON n.id = ok.new WHERE st.superseded_at IS NULL AND n.valid_from >= st.valid_from)
SELECT st.id, coalesce(cl.new, st.superseded_by) AS superseded_by, CASE WHEN cl.id IS NULL THEN st.superseded_at ELSE {NOW_SQL} END AS superseded_at FROM st LEFT JOIN cl ON cl.id = st.id""")
def closed_facts(spark, d):
    """Facts after the verdicts on what a batch replaces."""
    return _closed(spark, d)[0].select("id", "superseded_by", "superseded_at")


@query(f"""WITH {_CLOSE}, o AS (SELECT src, dst, edge_type, min(recorded_at) AS recorded_at FROM edges WHERE recorded_at < {AS_OF_SQL} GROUP BY 1, 2, 3), n AS (SELECT DISTINCT new AS src, old AS dst, verdict AS edge_type FROM vd WHERE old <> new)
SELECT * FROM o UNION ALL SELECT src, dst, edge_type, {NOW_SQL} FROM n WHERE (src, dst, edge_type) NOT IN (SELECT (src, dst, edge_type) FROM o)""")
def judged_edges(spark, d):
    """The supersedes and contradicts edges that those verdicts leave."""
    return _closed(spark, d)[1]


@query(f"WITH {FACTS}, b AS (SELECT src_session AS k, max(recorded_at) AS t FROM f WHERE src_session IS NOT NULL AND recorded_at < {AS_OF_SQL} GROUP BY 1), n AS (SELECT src_session AS k, max(recorded_at) AS t FROM f WHERE src_session IS NOT NULL AND recorded_at >= {AS_OF_SQL} GROUP BY 1) SELECT coalesce(n.k, b.k) AS k, coalesce(n.t, b.t) AS t FROM b FULL JOIN n ON n.k = b.k")
def upserted_offsets(spark, d):
    """An upsert in which the new row wins: the last time of each session."""
    last = lambda c: _facts(spark, d).where(F.col("src_session").isNotNull() & c).groupBy(F.col("src_session").alias("k")).agg(F.max("recorded_at").alias("t"))
    return ingest.keyed_merge(last(F.col("recorded_at") < AS_OF), last(F.col("recorded_at") >= AS_OF), ["k"], new_wins=True)


# --- Searches leave traces and strengthen what they found.


def _found(spark: SparkSession, d: str, **more) -> DataFrame:
    return search.hybrid_search(_asked(spark, d), materialize(_facts(spark, d), "facts"), table(spark, d, "edges"), _index(spark, d), vector.usable(table(spark, d, "fact_vecs")), NOW, 5, **more)


@query(f"""WITH {FACTS}, h AS (SELECT unnest(f2.files) AS file, id FROM f f2), r AS (SELECT id, row_number() OVER (PARTITION BY file ORDER BY id) AS rank FROM h), n AS (SELECT id, count(*) AS n FROM r WHERE rank <= 3 GROUP BY 1)
SELECT f.id, round(CASE WHEN n.n > 0 THEN least(mass + 0.15e0 * n.n, 3e0) ELSE mass END, 9) AS mass, CAST(use_count + coalesce(n.n, 0) AS INT) AS use_count, CASE WHEN n.n > 0 THEN {NOW_SQL} ELSE last_used_at END AS last_used_at FROM f LEFT JOIN n ON n.id = f.id""")
def reinforced_facts(spark, d):
    """Facts after searches by file of which each met its first facts in order of id."""
    from pyspark.sql import Window

    hits = _facts(spark, d).select(F.explode("files").alias("qid"), "id").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    return search.reinforce(_facts(spark, d), hits, NOW).select("id", F.round("mass", 9).alias("mass"), "use_count", "last_used_at")


def _features_sql() -> str:
    whole = _live_sql(out="@@")
    return whole[: whole.index("@@")] + f"""SELECT j.qid, j.id, coalesce(lex_rank, -1e0) AS lex, coalesce(cos_rank, -1e0) AS cos, round(coalesce(sim, 0e0), 3) AS sim, round({mass_sql(NOW_SQL, 'f.')}, 3) AS mass, f.confidence, CASE WHEN q.repo = f.repo THEN 1e0 ELSE 0e0 END AS same
FROM j JOIN f ON f.id = j.id JOIN q ON q.qid = j.qid"""


@query(_features_sql())
def trace_features(spark, d):
    """The evidence behind every candidate of each search."""
    f = _found(spark, d, features=True)
    names = ["lex", "cos", "sim", "mass", "confidence", "same"]
    return f.select("qid", "id", *[F.get("feat", i).alias(n) for i, n in enumerate(names)])


@query()
def search_traces(spark, d):
    """The trace of each search: its hits and the evidence behind every candidate."""
    return search.trace_log(_found(spark, d, features=True), _asked(spark, d), NOW)


@query(f"WITH {_TRACE} SELECT id FROM t WHERE ts >= {AS_OF_SQL}")
def pruned_traces(spark, d):
    """Traces since a moment."""
    return upsert.trace_prune(A.traces(spark, d), AS_OF).select("id")


@query("""WITH s AS (SELECT DISTINCT lookup_id, asked_at, repo, entity FROM lookups), p AS (SELECT repo AS qid, lookup_id AS id, row_number() OVER (PARTITION BY repo ORDER BY asked_at, lookup_id) AS pos, (lookup_id % 97) / 97e0 AS score FROM s WHERE repo IS NOT NULL)
SELECT qid, id, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pos) AS rn FROM p) WHERE rn <= 15""")
def first_met(spark, d):
    """What the searches of each repository met, the best first, equals by first appearance, fifteen at most."""
    from pyspark.sql import Window

    s = table(spark, d, "lookups").select("lookup_id", "asked_at", "repo").distinct().where("repo IS NOT NULL")
    seen = s.select(F.col("repo").alias("qid"), F.row_number().over(Window.partitionBy("repo").orderBy("asked_at", "lookup_id")).cast("bigint").alias("pos"), F.col("lookup_id").alias("id"), (F.col("lookup_id") % 97 / 97.0).alias("score"))
    return metrics.first_appearance(seen.unionByName(seen.withColumns({"pos": F.col("pos") + 1_000_000, "score": F.col("score") / 2})))


@query(f"WITH {FACTS} SELECT id, rank FROM (SELECT id, row_number() OVER (ORDER BY round({mass_sql(NOW_SQL)} - 0.05e0, 9) DESC, id) AS rank FROM f WHERE superseded_at IS NULL AND quote IS NULL) WHERE rank <= 200")
def paraphrase_work(spark, d):
    """The heaviest live facts without a paraphrase: what a budget is spent on first."""
    from pyspark.sql import Window

    live = temporal.live(_facts(spark, d)).where("quote IS NULL")
    first = live.withColumn("w", F.round(S.order_mass(F.col("kind"), F.col("mass"), F.col("valid_from"), NOW), 9)).orderBy(F.desc("w"), "id").limit(200)
    return first.select("id", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("w"), "id")).cast("bigint").alias("rank"))  # over 200 rows


# --- Merges.


@query(f"WITH {FACTS}, {LINKS}, {_MAP} SELECT DISTINCT fact_id, coalesce(m.new, entity_id) AS entity_id FROM fe LEFT JOIN m ON m.old = fe.entity_id")
def merged_links(spark, d):
    """Links after entities that share an alias were merged."""
    return _merged(spark, d)["links"]


@query(f"""WITH {FACTS}, {_MAP}, a AS (SELECT DISTINCT ON (id) * FROM entity_aliases)
SELECT coalesce(m.new, a.entity_id) AS entity_id, a.alias, count(*) AS n FROM a LEFT JOIN m ON m.old = a.entity_id GROUP BY 1, 2
UNION ALL SELECT m.new, e.name, -count(*) FROM m JOIN entities e ON e.id = m.old GROUP BY 1, 2""")
def merged_aliases(spark, d):
    """Aliases after the merge; the losers' names, which become aliases of the winners, count negatively."""
    al = _merged(spark, d, NOW)["aliases"]
    new = F.col("recorded_at") == NOW
    return al.groupBy("entity_id", "alias", new.alias("new")).agg(F.count("*").alias("n")).select("entity_id", "alias", F.when(F.col("new"), -F.col("n")).otherwise(F.col("n")).alias("n"))


@query(f"WITH {FACTS}, {_MAP} SELECT coalesce(x.new, l_partkey) AS subject_id, coalesce(y.new, l_suppkey) AS object_id, count(*) AS n FROM lineitem LEFT JOIN m x ON x.old = l_partkey LEFT JOIN m y ON y.old = l_suppkey GROUP BY 1, 2")
def merged_triples(spark, d):
    """Triples by their ends after the merge, which repoints both."""
    return _merged(spark, d)["triples"].groupBy("subject_id", "object_id").agg(F.count("*").alias("n"))


@query(f"WITH {FACTS}, {_MAP} SELECT coalesce(m.new, user_id) AS entity_id, count(*) AS n FROM events LEFT JOIN m ON m.old = user_id GROUP BY 1")
def merged_observations(spark, d):
    """Observations by entity after the merge."""
    return _merged(spark, d)["observations"].groupBy("entity_id").agg(F.count("*").alias("n"))


# --- Metrics.


@query("SELECT e.event_id AS id, e.user_id AS entity_id, coalesce(n.display, '') AS display, e.value FROM events e LEFT JOIN entities n ON n.id = e.user_id WHERE e.event_type = (SELECT max(event_type) FROM events)")
def named_series(spark, d):
    """One metric over time with the entities' names, where there are any."""
    o = A.observations(spark, d)
    return metrics.series(o, o.agg(F.max("metric")).first()[0], entities=table(spark, d, "entities")).select("id", "entity_id", "display", "value")


@query("""WITH n AS (SELECT CASE WHEN event_id % 3 = 0 THEN ' ' || upper(event_type) || ' ' ELSE event_type END AS metric, user_id AS entity_id, value, CASE event_id % 4 WHEN 0 THEN '2026-03-01' WHEN 1 THEN 'soon' END AS day, 1000e0 + event_id % 5 AS valid_from FROM events)
SELECT replace(trim(lower(metric)), ' ', '_') AS metric, entity_id, round(value, 6) AS value, CASE WHEN day = '2026-03-01' THEN 1772323200e0 ELSE valid_from END AS occurred_at FROM n WHERE value IS NOT NULL GROUP BY ALL""")
def stored_observations(spark, d):
    """Observations as extraction gives them, under snake-case names and with the day they tell, or else their fact's time."""
    o = table(spark, d, "events")
    day = F.when(F.col("event_id") % 4 == 0, "2026-03-01").when(F.col("event_id") % 4 == 1, "soon")
    new = o.select(F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.upper("event_type"), F.lit(" "))).otherwise(F.col("event_type")).alias("metric"), F.col("user_id").alias("entity_id"), F.round("value", 6).alias("value"), day.alias("day"), (1000.0 + F.col("event_id") % 5).alias("valid_from"))
    return metrics.store_observations(A.observations(spark, d).limit(0), new)


@query("SELECT event_type AS metric, CAST(count(*) + 1 AS BIGINT) AS seen_count FROM events GROUP BY 1 UNION ALL SELECT 'never seen', 1")
def metric_mentions(spark, d):
    """How often each metric was mentioned, with those known before."""
    o = table(spark, d, "events").select(F.col("event_type").alias("metric"))
    known = o.distinct().withColumn("seen_count", F.lit(1).cast("bigint")).unionByName(spark.createDataFrame([("never seen", 1)], "metric string, seen_count bigint"))
    return metrics.metric_counts(known, o)


# --- Scalars on rows.


@query(f"""WITH {FACTS}, x AS (SELECT id, confidence AS c, CASE evidence WHEN 'verified' THEN 1e0 WHEN 'reported' THEN 0.8e0 ELSE 0.6e0 END AS tier, [confidence / 20, mass / 40, 0.01e0] AS tops FROM f)
SELECT id, round((least(tops[1] / 0.03e0, 1e0) + least(tops[2] / 0.03e0, 1e0) + least(tops[3] / 0.03e0, 1e0)) / 3, 9) AS strength,
round((0.30e0 * c + 0.25e0 * (id % 5) / 4e0 + 0.20e0 * tier + 0.15e0 * (id % 3) / 2e0 + 0.10e0 * (least(tops[1] / 0.03e0, 1e0) + least(tops[2] / 0.03e0, 1e0) + least(tops[3] / 0.03e0, 1e0)) / 3) * CASE WHEN id % 7 = 0 THEN 0.4e0 ELSE 1e0 END, 9) AS confidence FROM x""")
def answer_confidence(spark, d):
    """The confidence of an answer from coverage, validity, evidence, agreement and retrieval, less where it doubts."""
    c = F.col
    tops = F.array(c("confidence") / 20, c("mass") / 40, F.lit(0.01))
    strength = S.retrieval_strength(tops)
    score = S.answer_confidence(c("confidence"), c("id") % 5 / 4.0, S.evidence_tier(c("evidence")), c("id") % 3 / 2.0, strength, c("id") % 7 == 0)
    return _facts(spark, d).select("id", F.round(strength, 9).alias("strength"), F.round(score, 9).alias("confidence"))


@query(f"WITH {FACTS} SELECT a.id, levenshtein(a.statement, b.statement) AS distance FROM f a JOIN f b ON b.id = a.superseded_by")
def edit_distances(spark, d):
    """How far each statement is from the one that replaced it."""
    f = _facts(spark, d)
    pairs = f.join(f.select(F.col("id").alias("superseded_by"), F.col("statement").alias("later")), "superseded_by")
    return pairs.select("id", F.levenshtein("statement", "later").cast("bigint").alias("distance"))


@query("""SELECT line_id, CASE WHEN path IS NULL THEN NULL ELSE regexp_extract(regexp_replace('git@host.invalid:' || path || '.git', '\\.git$', ''), '([^/:]+)$', 1) END AS origin, length(left(coalesce(message, ''), 400)) AS kept FROM session_lines""")
def origins(spark, d):
    """Repository names from origin addresses, and lengths after truncation."""
    url = F.concat(F.lit("git@host.invalid:"), F.col("path"), F.lit(".git"))
    return table(spark, d, "session_lines").select("line_id", S.repo_of_origin(url).alias("origin"), F.length(F.left(F.coalesce("message", F.lit("")), F.lit(400))).cast("bigint").alias("kept"))


@query(f"""WITH {FACTS}, x AS (SELECT id, CASE id % 4 WHEN 0 THEN {DATE.format(x='valid_from')} WHEN 1 THEN 'not a day' WHEN 2 THEN NULL ELSE '2026-02-30' END AS day, valid_from FROM f)
SELECT id, epoch(TRY_CAST(day AS DATE)) AS told, coalesce(epoch(TRY_CAST(day AS DATE)), valid_from) AS occurred_at FROM x""")
def observation_days(spark, d):
    """ISO dates as epoch seconds, and the fact's own time where there is none."""
    day = F.when(F.col("id") % 4 == 0, S.epoch_date(F.col("valid_from"))).when(F.col("id") % 4 == 1, "not a day").when(F.col("id") % 4 == 3, "2026-02-30")
    return _facts(spark, d).select("id", S.iso_epoch(day).alias("told"), S.observation_time(day, F.col("valid_from")).alias("occurred_at"))


@query("""WITH l AS (SELECT line_id, rec_timestamp, rec_type, cwd, message FROM session_lines WHERE message IS NOT NULL AND json_valid(message) AND json_type(CAST(message AS JSON), '$.content') = 'VARCHAR')
SELECT line_id, CASE WHEN regexp_matches(CAST(message AS JSON)->>'$.content', '\\S') THEN true END AS says, rec_type = 'system' AS meta FROM l""")
def payload_lines(spark, d):
    """Lines written in the second format and read again: whether they say something, and whether they tell the folder."""
    v = F.expr("try_parse_json(message)")
    said = F.expr("CASE WHEN schema_of_variant(try_variant_get(try_parse_json(message), '$.content', 'variant')) = 'STRING' THEN try_variant_get(try_parse_json(message), '$.content', 'string') END")
    src = table(spark, d, "session_lines").where(v.isNotNull()).withColumn("said", said).where("said IS NOT NULL")
    item = F.struct(F.lit("message").alias("type"), F.col("cwd"), F.lit("user").alias("role"), F.array(F.struct(F.col("said").alias("text"))).alias("content"))
    as_item = F.to_json(F.struct(F.col("rec_timestamp").alias("timestamp"), F.lit("response_item").alias("type"), item.alias("payload")))
    piece = ingest.decode_payloads(src.select("line_id", "rec_type", as_item.alias("value")), keep=("line_id", "rec_type"))
    return piece.select("line_id", F.when(F.col("piece").isNotNull(), F.lit(True)).alias("says"), (F.col("rec_type") == "system").alias("meta"))


# --- Views of one thing, for many at once.


@query(f"WITH {FACTS}, {EDGES}, n AS (SELECT entity_id, count(*) AS facts FROM fe JOIN f ON f.id = fe.fact_id AND f.superseded_at IS NULL GROUP BY 1), m AS (SELECT id, count(*) AS others FROM (SELECT a AS id FROM ee UNION ALL SELECT b FROM ee) GROUP BY 1) SELECT e.id, e.display, e.seen_count, coalesce(n.facts, 0) AS facts, coalesce(m.others, 0) AS others FROM entities e LEFT JOIN n ON n.entity_id = e.id LEFT JOIN m ON m.id = e.id")
def entity_cards(spark, d):
    """Each entity with its live facts and the entities mentioned with it, counted."""
    facts_of = _links(spark, d).join(temporal.live(_facts(spark, d)).select(F.col("id").alias("fact_id")), "fact_id", "left_semi").groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("facts"))
    others = E.neighbours(_edges(spark, d)).groupBy("id").agg(F.count("*").alias("others"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return table(spark, d, "entities").join(facts_of, "id", "left").join(others, "id", "left").select("id", "display", "seen_count", zero("facts"), zero("others"))


@query(f"""WITH {FACTS}, o AS (SELECT f.id, count(p.id) AS replaces FROM f LEFT JOIN f p ON p.superseded_by = f.id GROUP BY 1), c AS (SELECT DISTINCT src, dst FROM edges WHERE edge_type = 'contradicts'), k AS (SELECT dst AS id, count(*) AS against FROM c JOIN f ON f.id = c.src AND f.superseded_at IS NULL GROUP BY 1)
SELECT f.id, f.superseded_by, s.statement AS later, o.replaces, coalesce(k.against, 0) AS against FROM f JOIN o USING (id) LEFT JOIN f s ON s.id = f.superseded_by LEFT JOIN k ON k.id = f.id""")
def fact_details(spark, d):
    """Each fact with what replaced it, how many it replaced, and how many live facts contradict it."""
    f = _facts(spark, d)
    later = f.select(F.col("id").alias("superseded_by"), F.col("statement").alias("later"))
    replaces = f.where("superseded_by IS NOT NULL").groupBy(F.col("superseded_by").alias("id")).agg(F.count("*").alias("replaces"))
    against = search.live_contradictions(f, table(spark, d, "edges")).withColumnRenamed("n", "against")
    j = f.join(later, "superseded_by", "left").join(replaces, "id", "left").join(against, "id", "left")
    return j.select("id", "superseded_by", "later", F.coalesce("replaces", F.lit(0)).alias("replaces"), F.coalesce("against", F.lit(0)).alias("against"))


@query(f"""WITH {FACTS}, v AS (SELECT id, superseded_by, id % 3 AS m FROM f WHERE superseded_by IS NOT NULL) SELECT mode, count(*) AS closes FROM (SELECT unnest(['off', 'shadow', 'active']) AS mode, m, id FROM v) WHERE (mode = 'off' AND m = 0) OR (mode = 'shadow' AND m = 0) OR (mode = 'active' AND (CASE WHEN id % 5 = 0 THEN (m + 1) % 3 ELSE m END) = 0) GROUP BY 1""")
def judge_modes(spark, d):
    """How many closures stand when a local judge is off, only watches, or decides."""
    log = A.judge_log(_facts(spark, d)).withColumn("llm_verdict", F.get(F.array(F.lit("supersedes"), F.lit("contradicts"), F.lit("unrelated")), (F.col("old_id") % 3).cast("int")))
    out = None
    for mode in ("off", "shadow", "active"):
        n = truth.decided(log, mode).where("verdict = 'supersedes'").agg(F.count("*").alias("closes")).select(F.lit(mode).alias("mode"), "closes")
        out = n if out is None else out.unionByName(n)
    return out
