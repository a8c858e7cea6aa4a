"""What changes the tables: upserts, links, closures, traces; search by stems and phrases; numbering, clean-up; the tool loop."""

import json
import random

import pytest
from pyspark.sql import functions as F

from chronoweave import protocols as P
from chronoweave.functions.porter import stem
from chronoweave.operators import asof_lookup, entities, lexical, metrics, search, upsert, vector
from chronoweave.session import clear, drop, materialize, numbered
from chronoweave.streaming import cycle


def facts(spark, rows):
    base = dict(statement="s", kind="fact", repo="r", entities=[], files=[], confidence=0.5, mass=1.0, recorded_at=0.0, valid_from=0.0, superseded_at=None, superseded_by=None, src_session="x", corroborations=0, evidence="verified", stmt_hash=None)
    names = [c.split()[0] for c in cycle.FACT.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], cycle.FACT)


@pytest.mark.parametrize(
    "word, want",
    [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("hopping", "hop"), ("filing", "file"), ("sky", "sky"), ("relational", "relat"), ("generalizations", "gener"), ("controll", "control"), ("ab", "ab"), ("adoption", "adopt"), ("v3", "v3")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_search_by_stems_and_phrases(spark):
    texts = ["deploys failing on host-12 today", "the failed deployment of 12 hosts", "host 12 is fine", "nothing to see", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, t string")
    ix = lexical.build(df, "id", {"t": 1.0})
    pools = df.select("id", (F.col("id") % 2).cast("int").alias("pool"))
    q = spark.createDataFrame([(1, "failing"), (2, "host-12"), (3, "12-host"), (4, "zebra"), (5, None), (6, "Deploy failure")], "qid bigint, q string")
    got = {}
    for r in lexical.best(ix, q, pools, {0: 5, 1: 5}).collect():
        got.setdefault(r.qid, set()).add(r.id)
    assert got == {1: {0, 1}, 2: {0, 2}, 3: {1}, 6: {0}}
    pairs = {(r.qid, r.id): r.bm25 for r in lexical.scores(ix, q).collect()}
    assert {(r.qid, r.id): r.bm25 for r in lexical.best(ix, q, pools, {0: 5, 1: 5}).collect()} == pairs
    assert lexical.best(ix, q.limit(0), pools, {0: 1}).count() == 0 and lexical.best(lexical.build(df.limit(0), "id", {"t": 1.0}), q, pools, {0: 1}).count() == 0


def test_best_matches_by_blocks(spark, monkeypatch):
    rnd = random.Random(1)
    words = [f"w{i}x" for i in range(30)]
    df = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(8))) for i in range(200)], "id bigint, t string").repartition(5)
    q = spark.createDataFrame([(i, " ".join(rnd.sample(words, 3))) for i in range(40)], "qid bigint, q string")
    ix = lexical.build(df, "id", {"t": 1.0})
    want = {tuple(r) for r in lexical.top(lexical.scores(ix, q), 4).collect()}
    monkeypatch.setattr(lexical, "BLOCK_QUERIES", 7)
    got = lexical.best(ix, q, df.select("id", F.lit(3).alias("pool")), {3: 4})
    assert {(r.qid, r.id, r.bm25, r["rank"]) for r in got.collect()} == want and len(want) > 100


def test_nearest_of_two_pools(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.gauss(0, 1) for _ in range(4)] if i % 9 else [1.0, 0.0, 0.0, 0.0], i % 2) for i in range(120)]
    v = spark.createDataFrame(rows, "id bigint, vec array<float>, pool int").repartition(4)
    q = v.where("id < 7").select(F.col("id").alias("qid"), "vec")
    norm = lambda x: [a / sum(b * b for b in x) ** 0.5 for a in x]
    vecs = {r.id: norm(r.vec) for r in v.collect()}
    for r in vector.cosine_best(q, v, {0: 3, 1: 5}).groupBy("qid", "pool").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("x")).collect():
        k = 3 if r.pool == 0 else 5
        sims = sorted((-round(sum(a * b for a, b in zip(vecs[r.qid], vecs[i])), 6), i) for i in vecs if i % 2 == r.pool)
        assert len(r.x) == k and [-round(sum(a * b for a, b in zip(vecs[r.qid], vecs[x.id])), 6) for x in r.x] == [s for s, _ in sims[:k]]
        assert [x.id for x in r.x] == [i for _, i in sims[:k]] or len({s for s, _ in sims[: k + 1]}) < k + 1


def test_numbers_and_clean_up(spark):
    df = spark.createDataFrame([(i * 7 % 100, "x") for i in range(100)], "a int, b string").repartition(7)
    got = numbered(df, ["a"], "n", 5).collect()
    assert sorted((r.a, r.n) for r in got) == [(i, i + 5) for i in range(100)] and numbered(df.limit(0), ["a"]).count() == 0
    a, b = materialize(df), materialize(df)
    drop(a)
    assert b.count() == 100 and clear(spark) >= 1 and clear(spark) == 0
    with pytest.raises(Exception, match="does not exist|DOES_NOT_EXIST|FILE_NOT_EXIST|not exist"):
        b.count()


def test_upsert_links_and_closures(spark):
    store = facts(spark, [dict(id=1, statement="Alpha is slow", valid_from=10.0, src_session="s1", confidence=0.5, evidence="asserted"), dict(id=2, statement="beta is red", valid_from=11.0)])
    say = dict(kind="fact", mass=1.0, recorded_at=50.0, entities=["Alpha", "New-Thing", "alpha"])
    new = facts(spark, [dict(id=10, statement="alpha IS slow!", valid_from=40.0, src_session="s2", evidence="verified", **say), dict(id=11, statement="beta is blue", valid_from=41.0, src_session="s2", **say), dict(id=12, statement="Beta is blue", valid_from=45.0, src_session="s3", **say)])
    after, fresh = upsert.facts(store, new.withColumnRenamed("id", "pos"))
    got = {r.id: r for r in after.collect()}
    assert set(got) == {1, 2, 11} and got[1].corroborations == 1 and got[1].valid_from == 40.0 and got[1].evidence == "verified"
    assert got[11].corroborations == 1 and got[11].valid_from == 45.0 and [r.id for r in fresh.collect()] == [11]
    ent = spark.createDataFrame([(5, "alpha", "Alpha", None, "alpha", 3, 1.0)], cycle.TABLES["entities"])
    al, links, co = (spark.createDataFrame([], cycle.TABLES[t]) for t in ("aliases", "links", "co_mentions"))
    out = upsert.links(fresh, ent, al, links, co, 99.0)
    assert {(r.id, r.name, r.seen_count, r.last_seen) for r in out["entities"].collect()} == {(5, "alpha", 4, 99.0), (6, "new-thing", 1, 99.0)}
    assert {tuple(r) for r in out["links"].collect()} == {(11, 5), (11, 6)} and [tuple(r) for r in out["edges"].collect()] == [(5, 6, 1, 99.0)]
    again = upsert.links(fresh, out["entities"], al, out["links"], out["edges"], 100.0)
    assert {(r.id, r.seen_count) for r in again["entities"].collect()} == {(5, 4), (6, 1)}
    verdicts = spark.createDataFrame([(2, 11, "supersedes"), (1, 11, "contradicts"), (1, 11, "unrelated")], "old bigint, new bigint, verdict string")
    closed, edges = upsert.closures(after, spark.createDataFrame([(11, 1, "contradicts", 7.0)], cycle.TABLES["edges"]), verdicts, 60.0)
    assert {r.id: r.superseded_by for r in closed.collect()} == {1: None, 2: 11, 11: None}
    assert {tuple(r) for r in edges.select("src", "dst", "edge_type", "recorded_at").collect()} == {(11, 2, "supersedes", 60.0), (11, 1, "contradicts", 7.0)}


def test_cycle_publishes_all_tables(spark, tmp_path):
    c = cycle.Cycle(spark, str(tmp_path / "state"), P.LineExtractor(), P.OverlapJudge(), least_margin=0.0)
    schema = "src_session string, line_offset bigint, piece string, repo string, t double"
    one = [("s1", 0, "USER: The cache of pool seven is small.", "alpha", 10.0), ("s1", 9, "ASSISTANT: Noted.", "alpha", 11.0)]
    c.apply(spark.createDataFrame(one, schema), 0)
    c.apply(spark.createDataFrame([("s2", 4, "USER: The cache of pool seven is small.\nThe cache of pool seven is large.", "alpha", 500.0)], schema), 1)
    c.apply(spark.createDataFrame(one, schema), 1)  # done already
    f = {r.statement: r for r in c.facts().collect()}
    assert f["The cache of pool seven is small."].corroborations == 1 and len({r.id for r in f.values()}) == len(f)
    assert c.table("entities").where("name = 'alpha'").first().seen_count == len(f) and c.table("links").count() == len(f)
    assert {r.src_session: r.end_offset for r in c.table("offsets").collect()} == {"s1": 9, "s2": 4}
    edges = {(r.src, r.dst, r.edge_type) for r in c.table("edges").collect()}
    closed = {(r.superseded_by, r.id) for r in f.values() if r.superseded_by is not None}
    assert closed <= {(s, d) for s, d, k in edges if k == "supersedes"} and edges


def test_reinforcement_and_traces(spark):
    f = facts(spark, [dict(id=i, statement=f"alpha number{i}", mass=2.95 if i == 1 else 1.0, valid_from=5.0) for i in range(1, 6)])
    f = f.withColumns({"use_count": F.lit(0), "last_used_at": F.lit(None).cast("double")})
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (2, 1, 2)], "qid bigint, rank int, id bigint")
    got = {r.id: r for r in search.reinforce(f, hits, 77.0).collect()}
    assert got[1].mass == 3.0 and abs(got[2].mass - 1.3) < 1e-9 and got[2].use_count == 2 and got[4].mass == 1.0 and got[4].last_used_at is None and got[3].last_used_at == 77.0
    q = spark.createDataFrame([(7, "alpha number2", "r", None), (8, "nothing", None, None)], "qid bigint, q string, repo string, vec array<float>")
    edges = spark.createDataFrame([], "src bigint, dst bigint, edge_type string, recorded_at double")
    found = search.hybrid_search(q, f, edges, lexical.build(f, "id", {"statement": 1.0}), spark.createDataFrame([], "id bigint, vec array<float>"), 10.0, features=True)
    log = {r.qid: json.loads(r.results) for r in search.trace_log(found, q, 10.0, k=2).collect()}
    assert set(log[7]["ids"]) == {1, 2} and len(log[7]["feat"]) == 5 and log[7]["feat"]["2"][0] == 0.0 and log[7]["feat"]["2"][1] == -1.0 and log[8] == {"ids": [], "feat": {}}


def test_merge_of_all_tables(spark):
    ent = spark.createDataFrame([(1, "foo", 5), (2, "foo-", 2)], "id bigint, name string, seen_count bigint")
    m = spark.createDataFrame([(2, 1)], "old bigint, new bigint")
    none = lambda s: spark.createDataFrame([], s)
    al = spark.createDataFrame([(4, 2, "fu", 1.0, None, 1.0, 0.5)], cycle.TABLES["aliases"])
    tr = spark.createDataFrame([(1, 2, "p", 2), (2, 3, "p", 1)], "id bigint, subject_id bigint, predicate string, object_id bigint")
    ob = spark.createDataFrame([(1, 2, 0.5)], "id bigint, entity_id bigint, value double")
    out = entities.merge(m, ent, none("fact_id bigint, entity_id bigint"), none("a bigint, b bigint, count bigint, last_seen double"), al, tr, ob, 9.0)
    assert {tuple(r) for r in out["triples"].collect()} == {(1, 1, "p", 1), (2, 3, "p", 1)} and out["observations"].first().entity_id == 1
    assert {(r.id, r.entity_id, r.alias, r.valid_from) for r in out["aliases"].collect()} == {(4, 1, "fu", 1.0), (5, 1, "foo-", 9.0)}


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0, 5.0, 5.0, 9.0], list(range(5000, 0, -1)), [1e9] + [0.1 * i for i in range(999)]])
def test_upper_median(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 1.0), ("h", None)], "g string, v double")
    assert {r.g: r.upper_median for r in metrics.upper_median(df, "g", "v").collect()} == {"g": sorted(map(float, values))[len(values) // 2], "h": 1.0}


def test_dyadic_intervals_cover_once(spark):
    rows = [(a, b) for a in range(0, 40, 3) for b in range(a, 41, 2)]
    df = spark.createDataFrame(rows, "a int, b int").withColumn("n", F.explode_outer(F.expr(asof_lookup._dyadic("a", "b", 64))))
    got = {}
    for r in df.collect():
        if r.n is not None:
            got.setdefault((r.a, r.b), []).extend(range(r.n["at"] << r.n["level"], (r.n["at"] + 1) << r.n["level"]))
    assert all(sorted(got.get((a, b), [])) == list(range(a, b)) for a, b in rows)


class Scripted:
    def __init__(self, steps, answers):
        self.steps, self.answers = list(steps), list(answers)

    def next_step(self, question, notes):
        return self.steps.pop(0) if self.steps else "STOP"

    def answer(self, question, notes):
        return self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]


def test_the_tool_loop():
    tools = {"search": lambda t: [f"[1] {t}"], "entity": lambda t: (_ for _ in ()).throw(LookupError("unknown"))}
    out = P.ask("q", Scripted(["entity(x)", "STOP", "STOP"], ["no idea", "it is so [1]"]), tools)
    assert out["steps"] == [("search", "q"), ("entity", "x")] and out["answer"] == "it is so [1]" and out["nudged"] and P.NUDGE in out["notes"] and "(entity: unknown)" in out["notes"]
    out = P.ask("q", Scripted([f"search(a{i})" for i in range(20)], ["done [1]"]), tools, rounds=3)
    assert len(out["steps"]) == 4 and out["notes"][-1] == P.FINISH and out["answer"] == "done [1]"
    local = P.ask_local("q", Scripted([], ["a"]), tools, lambda: 0.2, lambda q: ["[2] wider", "[1] q"])
    assert local["widened"] and local["notes"] == ["[1] q", "[2] wider"] and not P.ask_local("q", Scripted(["search(z)"], ["a"]), tools, lambda: 0.9, lambda q: ["x"])["widened"]
