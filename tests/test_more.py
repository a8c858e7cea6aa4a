"""The ingest cycle, candidates, links, stores, summaries and WordPiece."""

from pyspark.sql import functions as F

from chronoweave.functions.wordpiece import basic_tokens, with_wordpieces, wordpieces
from chronoweave.operators import entities as E
from chronoweave.operators import graph, lexical, metrics, search
from chronoweave.protocols import LineExtractor, OverlapJudge
from chronoweave.streaming.cycle import Cycle
from tests.test_core import facts


def test_cycle_is_idempotent_and_closes(spark, tmp_path):
    c = Cycle(spark, str(tmp_path / "g"), LineExtractor(), OverlapJudge(), least_margin=0.1, chunk_bytes=20, overlap_bytes=0)
    schema = "src_session string, line_offset bigint, piece string, repo string, t double"
    first = spark.createDataFrame([("a", 0, "USER: The host is alpha now.", "r", 10.0), ("a", 1, "USER: Lunch is at noon.", "r", 10.0)], schema)
    second = spark.createDataFrame([("b", 0, "USER: The host is alpha2 now.", "r", 20.0), ("b", 1, "USER: lunch is at NOON.", "r", 20.0)], schema)
    for batch, i in ((first, 0), (first, 0), (second, 1), (second, 1)):
        c.apply(batch, i)
    got = {r.statement: r for r in c.facts().collect()}
    assert len(got) == 3 and got["The host is alpha now."].superseded_by == got["The host is alpha2 now."].id
    assert got["Lunch is at noon."].corroborations == 1 and got["Lunch is at noon."].superseded_at is None


def test_cycle_keeps_the_chunks_beyond_its_budget(spark, tmp_path):
    schema = "src_session string, line_offset bigint, piece string, repo string, t double"
    said = [("a", "Alpha host is up."), ("a", "Beta port is open."), ("b", "Gamma disk is full."), ("b", "Delta lamp is red."), ("c", "Omega door is shut.")]
    first = spark.createDataFrame([(s, i, f"USER: {x}", "r", 10.0) for i, (s, x) in enumerate(said[:4])], schema)
    second = spark.createDataFrame([("a", 9, f"USER: {said[4][1]}", "r", 20.0)], schema)
    c = Cycle(spark, str(tmp_path / "g"), LineExtractor(), OverlapJudge(), least_margin=0.1, chunk_bytes=10, overlap_bytes=0, max_chunks=2)
    counts = []
    for batch, i in ((first, 0), (first, 0), (second, 1), (second.limit(0), 2)):
        c.apply(batch, i)
        counts.append((c.facts().count(), c.waiting().count()))
    assert counts == [(2, 2), (2, 2), (4, 1), (5, 0)]
    assert {r.statement for r in c.facts().collect()} == {x for _, x in said} and c.facts().select("id").distinct().count() == 5


def test_supersede_candidates_scope(spark):
    f = facts(spark, [dict(id=1, statement="deploy host alpha"), dict(id=2, statement="deploy host beta", repo="other"), dict(id=3, statement="deploy host gamma", repo="other"), dict(id=4, statement="deploy host", kind="todo"), dict(id=5, statement="deploy host old", superseded_at=1.0)])
    links = spark.createDataFrame([(2, 7), (1, 8)], "fact_id bigint, entity_id bigint")
    new = spark.createDataFrame([(100, "deploy host moved", "r", "fact", [7]), (101, "deploy", None, "fact", None)], "qid bigint, q string, repo string, kind string, entity_ids array<bigint>")
    got = search.supersede_candidates(new, f, links, lexical.build(f, "id", {"statement": 1.0}))
    assert {(r.qid, r.id) for r in got.collect()} == {(100, 1), (100, 2)}


def test_paraphrase_arms(spark):
    f = facts(spark, [dict(id=1, statement="alpha"), dict(id=2, statement="beta"), dict(id=3, statement="gamma", superseded_at=1.0)])
    edges = spark.createDataFrame([], "src bigint, dst bigint, edge_type string, recorded_at double")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "id bigint, vec array<float>")
    q = spark.createDataFrame([(1, "wording", None, [0.0, 1.0])], "qid bigint, q string, repo string, vec array<float>")
    para = spark.createDataFrame([(1, "another wording"), (3, "wording")], "fact_id bigint, text string")
    pv = spark.createDataFrame([(1, [0.0, 1.0]), (1, [1.0, 0.0]), (3, [0.0, 1.0]), (2, None)], "fact_id bigint, vec array<float>")
    args = (q, f, edges, lexical.build(f, "id", {"statement": 1.0}), vecs)
    ranks = lambda **k: [r.id for r in search.hybrid_search(*args, now=1.0, k=3, **k).orderBy("rank").collect()]
    assert ranks() == [2, 1] and ranks(para_vectors=pv) == [1, 2] and ranks(paraphrases=para) == [1, 2]
    assert ranks(paraphrases=para, para_vectors=pv, as_of=0.5) == ranks(as_of=0.5)


def test_links_and_stores(spark):
    ent = spark.createDataFrame([(1, 5, 1.0), (2, 0, None)], "id bigint, seen_count bigint, last_seen double")
    links = spark.createDataFrame([(10, 1)], "fact_id bigint, entity_id bigint")
    edges = spark.createDataFrame([(1, 2, 3, 2.0)], "a bigint, b bigint, count bigint, last_seen double")
    new = spark.createDataFrame([(10, 1), (11, 1), (11, 2), (11, 2)], "fact_id bigint, entity_id bigint")
    out = E.link(new, spark.createDataFrame([(10, 9.0), (11, 0.5)], "fact_id bigint, t double"), ent, links, edges)
    assert {tuple(r) for r in out["entities"].collect()} == {(1, 6, 1.0), (2, 1, 0.5)} and out["links"].count() == 3
    assert [tuple(r) for r in out["edges"].collect()] == [(1, 2, 4, 2.0)]
    t = spark.createDataFrame([], "subject_id bigint, predicate string, object_id bigint, object_literal string")
    add = spark.createDataFrame([(1, " Runs On ", 2, None), (1, "runs on", 2, None), (1, "hosted by", None, "x"), (None, "p", 1, None)], t.schema)
    stored, counts = graph.store_triples(t, add, spark.createDataFrame([("hosted_by", "runs_on")], "alias string, predicate string"))
    assert stored.count() == 2 and [tuple(r) for r in counts.collect()] == [("runs_on", 3)]
    o = spark.createDataFrame([], "metric string, entity_id bigint, value double, occurred_at double")
    rows = spark.createDataFrame([("Disk Use", 1, 2.0, "1970-01-02", 5.0), ("disk use", 1, 2.0, "1970-01-02", 6.0), ("x", 1, 1.0, "soon", 7.0), ("", 1, 1.0, None, 1.0)], "metric string, entity_id bigint, value double, day string, valid_from double")
    assert {tuple(r) for r in metrics.store_observations(o, rows).collect()} == {("disk_use", 1, 2.0, 86400.0), ("x", 1, 1.0, 7.0)}


def test_summaries(spark):
    rows = spark.createDataFrame([("b", True, True, False), ("b", True, False, False), ("b", False, False, False), ("b", False, False, True), ("b", True, False, True)], "split string, answerable boolean, hit boolean, abstained boolean")
    assert tuple(metrics.answer_summary(rows).first()) == ("b", 5, 1, 1, 1, 1, 1)
    res = spark.createDataFrame([(1, 5, 1), (1, 6, 11), (2, 5, 1)], "qid bigint, id bigint, rank int")
    rel = spark.createDataFrame([(1, 5), (1, 6), (3, 9)], "qid bigint, id bigint")
    assert tuple(metrics.recall_at(res, rel).first()) == (2, 0.25, 0.5)
    seen = spark.createDataFrame([(1, 0, 7, 0.1), (1, 1, 8, 0.5), (1, 2, 7, 0.5), (1, 3, 9, 0.5)], "qid bigint, pos int, id bigint, score double")
    assert [r.id for r in metrics.first_appearance(seen, 2).orderBy(F.desc("score"), "pos").collect()] == [7, 8]


def test_wordpiece(spark):
    v = {"[UNK]": 0, "play": 1, "##ing": 2, "!": 3, "cafe": 4}
    assert basic_tokens("Café_x!") == ["cafe", "_", "x", "!"] and wordpieces("Playing café! zzz", v) == [1, 2, 4, 3, 0]
    got = with_wordpieces(spark.createDataFrame([("play",), (None,), ("",)], "t string"), "t", v).collect()
    assert [r.ids for r in got] == [[1], None, []]
