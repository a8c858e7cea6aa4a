"""Files, snapshots, streams, seams and the object API."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from chronoweave import __main__ as cli
from chronoweave import protocols as P
from chronoweave.operators.ingest import chunks
from chronoweave.sources import snapshot, transcripts
from chronoweave.streaming import sessions


def test_discover_and_tail(spark, tmp_path):
    for name, text in (("p/a.jsonl", "one\ntwo\npart"), ("p/b.jsonl", ""), ("-tmp-x/c.jsonl", "skip\n"), ("p/d.txt", "no\n")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    files = transcripts.discover(spark, str(tmp_path))
    assert {os.path.basename(r.path) for r in files.collect()} == {"a.jsonl"}
    assert {os.path.basename(r.path) for r in transcripts.discover(spark, str(tmp_path), recursive=True).collect()} == {"a.jsonl"}
    state = spark.createDataFrame([], "path string, offset bigint, error_count int, last_error_ts double")
    got = transcripts.read_new(transcripts.due(files, state, 0.0)).orderBy("line_offset").collect()
    assert [(r.line_offset, r.next_offset, r.value) for r in got] == [(0, 4, "one"), (4, 8, "two")]
    state = transcripts.advance(state, spark.createDataFrame(got))
    (tmp_path / "p/a.jsonl").write_text("one\ntwo\npart three\n")
    again = transcripts.read_new(transcripts.due(transcripts.discover(spark, str(tmp_path)), spark.createDataFrame(state.collect(), state.schema), 0.0)).collect()
    assert [r.value for r in again] == ["part three"]
    failing = spark.createDataFrame([(got[0].path, 0, 1, 1000.0)], state.schema)
    due = lambda now: {os.path.basename(r.path) for r in transcripts.due(transcripts.discover(spark, str(tmp_path)), failing, now).collect()}
    assert due(1000.0 + 3599) == set() and due(1000.0 + 3601) == {"a.jsonl"}


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    df = spark.range(3)
    day = dt.datetime(2025, 1, 1)
    made = [snapshot.backup_if_due({"t": df}, root, day + dt.timedelta(hours=h), keep=2) for h in (0, 5, 25, 50)]
    assert made[1] is None and snapshot.versions(spark, root) == ["20250102T010000", "20250103T020000"] and snapshot.latest(spark, root, "t").count() == 3
    with pytest.raises(FileExistsError):
        snapshot.publish({"t": df}, root, "20250103T020000")
    snapshot.write_probes(spark.createDataFrame([("q\t1", "a.*b", "chain", None)], "q string, pattern string, miner string, as_of string"), str(tmp_path / "probes"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "probes")).first()[1] == "a.*b"
    c = spark.createDataFrame([(f"p{i}", i, "x" * (3000 if i % 2 else 10)) for i in range(10)], "path string, end_offset bigint, text string")
    snapshot.dump_chunks(c, str(tmp_path / "dump"), 3)
    assert spark.read.json(str(tmp_path / "dump")).count() == 3


def test_fixture_is_closed(spark):
    f = spark.createDataFrame([(i, "r" if i % 2 else None, 0, 1.0, i + 1 if i < 9 else None) for i in range(10)], "id bigint, repo string, corroborations int, recorded_at double, superseded_by bigint")
    e = spark.createDataFrame([(9, 8, "supersedes"), (0, 5, "contradicts")], "src bigint, dst bigint, edge_type string")
    t = spark.createDataFrame([(1, '{"cited":[3,77]}'), (2, "{}")], "id bigint, results string")
    links = spark.createDataFrame([(3, 70), (0, 71), (9, 70)], "fact_id bigint, entity_id bigint")
    who = spark.createDataFrame([(70, "a"), (71, "b")], "id bigint, name string")
    out = snapshot.fixture(f, e, t, 1, chains=1)
    assert {r.id for r in out["facts"].collect()} == set(range(10)) and out["edges"].count() == 2
    out = snapshot.fixture(f, e, t, 1, chains=0, links=links, entities=who)
    assert {r.entity_id for r in out["links"].collect()} == {70} and {r.name for r in out["entities"].collect()} == {"a"}
    assert {r.id for r in out["facts"].collect()} == {3, 4, 5, 6, 7, 8, 9} and out["edges"].count() == 1 and out["traces"].count() == 1


def drain(query):
    query.processAllAvailable()
    query.stop()


def test_stream_chunks_equal_batch_chunks_over_restarts(spark, tmp_path):
    rows = [(s, i * 10, f"{s}{i} " * 5 if i % 4 else None) for s in "ab" for i in range(12)]
    schema = "src_session string, line_offset bigint, piece string"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in (rows[:7] + rows[12:15], rows[5:12] + rows[15:]):  # some lines come twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = sessions.run_cycle(sessions.stream_chunks(spark.readStream.schema(schema).parquet(src), 60, 20), sessions.once(spark, out), ck)
        q.awaitTermination()
    got = {(r.src_session, r.chunk_no): (r.text, r.end_offset) for r in spark.read.parquet(out).collect()}
    want = {(r.src_session, r.chunk_no): (r.text, r.end_offset) for r in chunks(spark.createDataFrame(rows, schema), 60, 20).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(want) - len(got) <= 2  # the last of a session is open


PIECE = "src_session string, line_offset bigint, piece string"


def test_stream_chunks_emit_the_rest_of_an_idle_session(spark, tmp_path):
    import time

    rows = [(s, i * 10, f"{s}{i} " * 5) for s, n in (("a", 11), ("b", 1)) for i in range(n)]
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    spark.createDataFrame(rows, PIECE).coalesce(1).write.parquet(src)
    want = {tuple(r) for r in chunks(spark.createDataFrame(rows, PIECE), 60, 20).drop("n_pieces").collect()}
    q = sessions.run_cycle(sessions.stream_chunks(spark.readStream.schema(PIECE).parquet(src), 60, 20, idle_ms=1_000), sessions.once(spark, out), ck, seconds=1)
    got, end = set(), time.time() + 30
    while got != want and time.time() < end:
        time.sleep(1)
        got = {tuple(r) for r in spark.read.schema(sessions.CHUNK).parquet(out).drop("batch").collect()} if os.path.exists(f"{out}/batch=0") else set()
    q.stop()
    assert got == want and {r[0] for r in got} == {"a", "b"}


def test_stream_chunks_by_read_lose_nothing_that_comes_out_of_order(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in ([("a", 0, "p0"), ("a", 20, "p20")], [("a", 10, "p10"), ("a", 20, "p20"), ("a", 30, "p30")], [("a", 10, "p10")]):
        spark.createDataFrame(part, PIECE).coalesce(1).write.mode("append").parquet(src)
        sessions.run_cycle(sessions.stream_chunks(spark.readStream.schema(PIECE).parquet(src), 1_000, 0, idle_ms=0), sessions.once(spark, out), ck).awaitTermination(60)
    got = [(r.chunk_no, r.text, r.end_offset) for r in spark.read.parquet(out).orderBy("chunk_no").collect()]
    assert got == [(0, "p0\n\np20", 20), (1, "p10\n\np30", 30)]


def test_stream_new_facts(spark, tmp_path):
    schema = "statement string, repo string, src_session string"
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for part in ([("A b", "r", "s1"), ("c", None, "s1")], [("a-B!", "r", "s1"), ("a b", "r", "s2"), ("c", None, "s3")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        sessions.run_cycle(sessions.stream_new_facts(spark.readStream.schema(schema).parquet(src)), sessions.once(spark, out), ck).awaitTermination()
    rows = {(r.statement.lower()[0], r.times) for r in spark.read.parquet(out).collect()}
    assert rows == {("a", 0), ("c", 0), ("a", 1), ("c", 1)}


def test_seams(spark):
    e = P.HashEmbedder(8)
    facts = spark.createDataFrame([(1, "a b"), (2, "c")], "id bigint, statement string")
    vecs = P.embed_missing(facts, spark.createDataFrame([(1,)], "fact_id bigint"), e).collect()
    assert [r.fact_id for r in vecs] == [2] and abs(sum(x * x for x in vecs[0].vec) - 1) < 1e-5
    pairs = spark.createDataFrame([(1, 2, "x is red", "x is red"), (3, 4, "apples", "zebras")], "old_id bigint, new_id bigint, old_side string, new_side string")
    v = {r.old_id: r for r in P.judge_pairs(pairs, P.OverlapJudge()).collect()}
    assert v[1].verdict == "supersedes" and v[3].verdict == "unrelated" and P.gate(spark.createDataFrame(list(v.values())), 0.99).count() == 0
    ch = spark.createDataFrame([("s", 0, "r", "USER: One.\nno stop\nTwo.")], "src_session string, chunk_no int, repo string, text string")
    assert [r.statement for r in P.extract_facts(ch, P.LineExtractor()).orderBy("fact_no").collect()] == ["One.", "Two."]
    assert P.plan_steps("1. search(a)\n- Search('a')\nentity(b)\nbad(c)\nSTOP\nsearch(z)", {"search", "entity"}) == [("search", "a"), ("entity", "b")]
    out = P.ask("q", P.EchoReasoner(), {"search": lambda t: [f"[1] {t}"]})
    assert out["answer"] == "[1] q" and out["steps"] == [("search", "q")]
    assert P.first_json_object('x {bad {"a": 1} y') == {"a": 1} and P.first_json_object("none") is None


def test_cli_suggestions(capsys):
    assert cli.edit_distance("qurey", "query") == 2 and cli.suggestion("breif") == "brief" and cli.suggestion("zzzzzzz") is None
    assert cli.main(["d", "qury"]) == 2 and "did you mean query" in capsys.readouterr().out


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001/facts.parquet"), reason="needs the test data")
def test_graph_object(spark):
    from chronoweave.api import FactGraph, as_json

    g = FactGraph(spark, "/root/testdata/sf0.001")
    first = g.facts.where("superseded_at IS NULL").orderBy("id").first()
    hits = g.query(first.statement).collect()
    assert hits and as_json(g.health()) and g.brief().count() > 0 and g.fact(first.id).count() == 1
    name = g.table("entities").orderBy(F.desc("seen_count"), "id").first()["name"]
    assert g.entity(name)["seen"].count() == 1 and g.metrics().count() > 0 and g.narrative(first.repo).count() > 0
    answer = g.ask(first.statement, P.EchoReasoner())
    assert answer["cited"] and 0 <= answer["confidence"] <= 1
