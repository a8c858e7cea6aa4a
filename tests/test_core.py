"""The fact graph's operators on small hand-made rows."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import entities as E
from chronoweave.operators import graph, ingest, lexical, mining, search, temporal, topics, truth, vector

FACT = "id bigint, statement string, kind string, repo string, confidence double, mass double, valid_from double, recorded_at double, superseded_at double, superseded_by bigint, corroborations int, evidence string, src_session string"


def facts(spark, rows):
    base = dict(statement="s", kind="fact", repo="r", confidence=0.5, mass=1.0, valid_from=0.0, recorded_at=0.0, superseded_at=None, superseded_by=None, corroborations=0, evidence="verified", src_session="x")
    names = [c.split()[0] for c in FACT.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], FACT)


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x"))).first()[0]


def test_mass(spark):
    f = facts(spark, [dict(id=1, kind="status", valid_from=0.0), dict(id=2, kind="odd", valid_from=9e9)])
    now = 14 * 86400.0
    got = {r[0]: r[1:] for r in f.select("id", S.decayed_mass(F.col("kind"), F.col("mass"), F.col("valid_from"), now), S.is_stale(F.col("kind"), F.col("valid_from"), now), S.is_rotten(F.col("kind"), F.col("valid_from"), now + 8 * 86400)).collect()}
    assert math.isclose(got[1][0], 0.05 + math.exp(-0.693 * 2)) and not got[1][1] and got[1][2]
    assert math.isclose(got[2][0], 1.05)


@pytest.mark.parametrize("q, want", [("why did it change", "historical"), ("as of today", "historical"), ("what is it now", "current"), ("what is the schema", "current"), ("list all hosts", "neutral"), ("", "neutral")])
def test_intent(spark, q, want):
    assert one(spark, S.temporal_intent, q) == want


@pytest.mark.parametrize("q, want", [
    ("What is the GPU-box of the gpu-box v1.2?", '"GPU-box" OR "v1.2"'), ("what is the", '"what" OR "is" OR "the"'), ("", '""'), ("a", '""'),
    (" ".join(f"tok{i}" for i in range(20)), " OR ".join(f'"tok{i}"' for i in range(12))),
])
def test_match_query(spark, q, want):
    assert one(spark, S.match_query, q) == want


def test_text_scalars(spark):
    assert one(spark, S.normalized_statement, "The Quick-Fox, v1.2!") == "thequickfoxv12"
    assert one(spark, S.statement_hash, "A b") == one(spark, S.statement_hash, "a-B.")
    assert one(spark, S.variant_key, "Foo-Bar_1.2 x") == "foobar12x"
    assert one(spark, S.redacted, "token = abcdefgh12 and sk-abcdefghijklmnop1 ok") == "[REDACTED] and [REDACTED] ok"
    assert one(spark, S.repo_of_origin, "git@host:team/app.git") == "app" and one(spark, S.repo_of_cwd, "/srv/work/app/") == "app" and one(spark, S.repo_of_cwd, "/") == "unknown"
    assert one(spark, S.citations, "[3] and [1], [3]") == [3, 1]
    assert one(spark, S.leads_with_doubt, "We don’t use it.") and not one(spark, S.leads_with_doubt, "x" * 170 + " unknown") and one(spark, S.denies_coverage, "x" * 170 + " unknown")
    marked = one(spark, lambda c: S.with_abstain(c, F.lit(True)), " maybe ")
    assert marked == S.ABSTAIN_PREFIX + " maybe" and one(spark, lambda c: S.with_abstain(c, F.lit(True)), marked) == marked
    assert [one(spark, S.entity_name_ok, s) for s in ("ok", "", "a/b", "a b c d e", "x" * 49, "é" * 24)] == [True, False, False, False, False, True]
    assert one(spark, S.rfc3339_epoch, "nope") == 0.0 and one(spark, S.rfc3339_epoch, "1970-01-02T00:00:00+02:00") == 79200.0
    assert [one(spark, S.backoff_seconds, n, "int") for n in (0, 1, 9)] == [1800.0, 3600.0, 86400.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0, 9.0]), ([0.0, 0.0], [1.0])], "a array<float>, b array<float>")
    rows = df.select(S.dot(F.col("a"), F.col("b")), S.l2_normalize(F.col("a")), S.norm(F.col("a"))).collect()
    assert rows[0][0] == 11.0 and rows[0][1] == [0.6, 0.8] and rows[1][1] == [0.0, 0.0]
    p = spark.createDataFrame([([1.0, 1.0, 0.0],)], "l array<double>").select(S.softmax(F.col("l")), S.argmax(F.col("l")), S.margin(F.col("l"))).first()
    assert math.isclose(sum(p[0]), 1) and p[1] == 0 and p[2] == 0.0


def test_as_of(spark):
    f = facts(spark, [dict(id=1, valid_from=10.0, superseded_by=2, superseded_at=90.0), dict(id=2, valid_from=20.0), dict(id=3, valid_from=5.0, superseded_by=77, superseded_at=9.0), dict(id=4, valid_from=1.0, superseded_at=2.0)])
    at = lambda t: {r.id for r in temporal.as_of(f, t).collect()}
    assert at(15) == {1, 4} and at(20) == {2, 4} and at(0) == set()
    assert {r.id for r in temporal.live(f).collect()} == {2}


def test_chain_heads_stop_after_the_hops(spark):
    f = facts(spark, [dict(id=i, superseded_by=i + 1, superseded_at=1.0) for i in range(1, 30)] + [dict(id=30)] + [dict(id=50, superseded_at=1.0), dict(id=60, superseded_by=61, superseded_at=1.0)])
    heads = {r.id: r.head for r in temporal.chain_heads(f, 20).collect()}
    assert heads[1] == 21 and heads[15] == 30 and heads[30] == 30 and heads[50] == 50 and heads[60] == 61


def test_bm25_prefers_rare_terms_and_weights(spark):
    df = spark.createDataFrame([(i, "common words here", "") for i in range(20)] + [(100, "rare common", ""), (101, "common", "rare"), (102, None, None)], "id bigint, a string, b string")
    ix = lexical.build(df, "id", {"a": 2.0, "b": 1.0})
    q = spark.createDataFrame([(1, "rare thing"), (2, "")], "qid bigint, q string")
    top = lexical.top(lexical.scores(ix, q), 5).orderBy("rank").collect()
    assert [r.id for r in top] == [100, 101] and top[0].bm25 > top[1].bm25


def test_cosine_top_orders_ties_by_id(spark):
    v = spark.createDataFrame([(3, [1.0, 0.0]), (2, [2.0, 0.0]), (1, [0.0, 1.0]), (9, None), (8, [0.0, 0.0]), (7, [1.0])], "fact_id bigint, vec array<float>")
    top = vector.cosine_top(spark.createDataFrame([(1, [1.0, 0.0])], "qid bigint, vec array<float>"), vector.usable(v), 2).orderBy("rank").collect()
    assert [(r.id, r.sim) for r in top] == [(2, 1.0), (3, 1.0)]


def search_fixture(spark):
    f = facts(spark, [
        dict(id=1, statement="the deploy host is alpha", valid_from=10.0, superseded_by=2, superseded_at=20.0),
        dict(id=2, statement="builds ship from beta", valid_from=20.0), dict(id=3, statement="lunch is at noon", valid_from=5.0),
        dict(id=4, statement="beta has a flaky disk", valid_from=15.0, evidence="asserted"),
    ])
    edges = spark.createDataFrame([(3, 4, "contradicts", 1.0), (3, 4, "contradicts", 1.0)], "src bigint, dst bigint, edge_type string, recorded_at double")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.2])], "id bigint, vec array<float>")
    ix = lexical.build(f, "id", {"statement": 2.0})
    q = spark.createDataFrame([(1, "deploy host alpha", None, [1.0, 0.0]), (2, "nothing matches", "r", None)], "qid bigint, q string, repo string, vec array<float>")
    return f, edges, vecs, ix, q


def test_search_follows_chains_to_the_live_head(spark):
    f, edges, vecs, ix, q = search_fixture(spark)
    hits = search.hybrid_search(q, f, edges, ix, vecs, now=100.0, k=3).orderBy("qid", "rank").collect()
    assert hits[0].id == 2 and hits[0].via_history and 1 not in {h.id for h in hits} and {h.qid for h in hits} == {1}


def test_search_as_of_shows_what_was_visible(spark):
    f, edges, vecs, ix, q = search_fixture(spark)
    hits = search.hybrid_search(q, f, edges, ix, vecs, now=100.0, k=3, as_of=16.0).orderBy("qid", "rank").collect()
    assert hits[0].id == 1 and not hits[0].via_history and 2 not in {h.id for h in hits}


def test_resolution_ladder(spark):
    ent = spark.createDataFrame([(1, "alpha", 5), (2, "alphabet", 9), (3, "beta", 1)], "id bigint, name string, seen_count bigint")
    al = spark.createDataFrame([(1, 3, "Bee", None, 0.5), (2, 1, "bee", None, 0.9), (3, 1, "old", 5.0, 0.9), (4, 99, "ghost", None, 0.9)], "id bigint, entity_id bigint, alias string, valid_to double, confidence double")
    n = spark.createDataFrame([(" ALPHA ",), ("BEE",), ("alphab",), ("old",), ("ghost",), ("zzz",), (None,)], "name string")
    assert {(r.name, r.entity_id, r.how) for r in E.resolve(n, ent, al, prefix=True).collect()} == {(" ALPHA ", 1, "exact"), ("BEE", 1, "alias"), ("alphab", 2, "prefix")}
    done, new = E.resolve_or_create(spark.createDataFrame(list(enumerate(["alpha", "be-ta", "New Thing", "new-thing"])), "pos int, name string"), ent, al, 50)
    assert [(r.name, r.entity_id, r.how) for r in done.orderBy("pos").collect()] == [("alpha", 1, "exact"), ("be-ta", 3, "variant"), ("New Thing", 50, "new"), ("new-thing", 50, "new")] and new.count() == 1


def test_merge_folds_edges(spark):
    ent = spark.createDataFrame([(1, "foo", 5), (2, "Foo-", 2), (3, "x", 1)], "id bigint, name string, seen_count bigint")
    groups = E.variant_groups(ent)
    assert [(r.winner, r.losers) for r in groups.collect()] == [(1, [2])]
    links = spark.createDataFrame([(10, 1), (10, 2), (11, 2)], "fact_id bigint, entity_id bigint")
    edges = spark.createDataFrame([(1, 2, 4, 1.0), (1, 3, 1, 5.0), (2, 3, 2, 9.0)], "a bigint, b bigint, count bigint, last_seen double")
    al = spark.createDataFrame([(1, 2, "f", None)], "id bigint, entity_id bigint, alias string, valid_to double")
    out = E.merge(E.merge_map(groups), ent, links, edges, al)
    assert {(r.id, r.seen_count) for r in out["entities"].collect()} == {(1, 7), (3, 1)} and {tuple(r) for r in out["links"].collect()} == {(10, 1), (11, 1)}
    assert [tuple(r) for r in out["edges"].collect()] == [(1, 3, 3, 5.0)] and out["aliases"].first().entity_id == 1


def test_traverse_star(spark):
    t = spark.createDataFrame([(1, "uses", 2), (1, "uses", 3), (2, "uses", 1), (4, "hosts", 1)], "subject_id bigint, predicate string, object_id bigint")
    co = spark.createDataFrame([(1, 5, 7), (5, 1, 7), (1, 2, 9), (2, 1, 9)], "id bigint, other bigint, count bigint")
    links = graph.traverse(1, graph.link_stream(t, co), hops=2).orderBy("link_no").collect()
    assert [(r.other, r.pri) for r in links if r.level == 1] == [(2, 0), (3, 0), (4, 1), (2, 1), (5, 2)]
    assert len(graph.traverse(1, graph.link_stream(t, co), hops=2, max_links=3).collect()) == 3
    near = graph.reachable(spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a bigint, b bigint"), spark.createDataFrame([(1,)], "id bigint"), 2)
    assert {(r.id, r.hop) for r in near.collect()} == {(1, 0), (2, 1), (3, 2)}


def test_truth_maintenance(spark):
    f = facts(spark, [dict(id=1, valid_from=1.0, superseded_by=2, superseded_at=5.0), dict(id=2, valid_from=3.0), dict(id=3, valid_from=9.0), dict(id=4, valid_from=9.0)])
    edges = spark.createDataFrame([(2, 1, "supersedes", 5.0), (3, 4, "contradicts", 6.0), (1, 3, "contradicts", 6.0)], "src bigint, dst bigint, edge_type string, recorded_at double")
    none = spark.createDataFrame([], "a bigint, b bigint")
    assert [tuple(r) for r in truth.conflicts(f, edges, none).collect()] == [(3, 4)]
    assert truth.conflicts(f, edges, spark.createDataFrame([(4, 3)], "a bigint, b bigint")).count() == 0
    side = truth.newer_side(f, truth.conflicts(f, edges, none)).first()
    assert (side.winner, side.loser) == (3, 4)
    done, ledger = truth.apply_referee(f, spark.createDataFrame([(3, 4, "SUPERSEDE_NEWER")], "src bigint, dst bigint, verdict string"), 50.0)
    assert done.where("id = 4").first().superseded_by == 3 and ledger.count() == 1
    v = spark.createDataFrame([(1, 2, "REOPEN_CONTRADICT")], "old_id bigint, new_id bigint, verdict string")
    out = truth.apply_repair(f, edges, v, 50.0)
    assert out["facts"].where("id = 1").first().superseded_at is None and {(r.src, r.dst, r.edge_type) for r in out["edges"].collect()} == {(2, 1, "contradicts"), (3, 4, "contradicts"), (1, 3, "contradicts")}
    assert truth.repair_pairs(f, spark.createDataFrame([], "old_id bigint")).count() == 1
    closed = truth.close(f, spark.createDataFrame([(3, 2)], "old bigint, new bigint"), 60.0)
    assert closed.where("id = 3").first().superseded_at is None  # an older fact never closes a newer one


def test_canonical_predicates_break_loops(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("q", "q"), ("z", "x")], "name string, canon string")
    assert {(r.name, r.canon) for r in truth.canonical_predicates(p).collect()} == {("a", "c"), ("b", "c"), ("x", "x"), ("y", "x"), ("z", "x")}


@pytest.mark.parametrize("block", [2_000, 1])
def test_sweep_candidates(spark, block):
    f = facts(spark, [dict(id=i, valid_from=86400.0 * d) for i, d in ((1, 0), (2, 4), (3, 3), (4, 9))])
    links = spark.createDataFrame([(i, 7) for i in (1, 2, 3, 4)] + [(1, 8), (2, 8)], "fact_id bigint, entity_id bigint")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "id bigint, vec array<float>")
    got = truth.sweep_candidates(f, links, vecs, spark.createDataFrame([], "a bigint, b bigint"), block=block).collect()
    assert [(r.older, r.newer) for r in got] == [(1, 2)]  # three days exactly isn't enough
    assert not truth.sweep_candidates(f, links, vecs, spark.createDataFrame([(2, 1)], "a bigint, b bigint"), block=block).collect()


def test_chunker_overlap_and_oversized_tail():
    c = ingest.Chunker(size=10, overlap=4)
    assert c.push("aaaa") is None and c.push("bbbb") is None and c.push("cc") == "aaaa\n\nbbbb\n\ncc" and c.pieces == ["cc"]
    assert c.flush() is None  # overlap alone is no chunk
    assert c.push("dddddddddd") == "cc\n\ndddddddddd" and c.pieces == []


def test_chunks_follow_sessions(spark):
    rows = [("s", i * 10, "x" * 30 if i % 2 else None) for i in range(8)] + [("t", 0, None), ("u", 5, "tail")]
    got = {(r.src_session, r.chunk_no): (r.end_offset, r.n_pieces) for r in ingest.chunks(spark.createDataFrame(rows, "src_session string, line_offset bigint, piece string"), 60, 0).collect()}
    assert got == {("s", 0): (30, 2), ("s", 1): (70, 2), ("u", 0): (5, 1)}


def test_decoders(spark):
    lines = spark.createDataFrame([
        (1, "user", None, '{"content": "hello token = abcdefgh12"}'), (2, "assistant", True, '{"content": [{"type": "text", "text": "hi"}, {"type": "tool_use", "name": "Bash", "input": {"a": 1}}]}'),
        (3, "summary", None, '{"content": "x"}'), (4, "user", None, "{broken"), (5, "user", None, '{"content": "  "}'), (6, "user", None, None),
    ], "line_id bigint, rec_type string, is_sidechain boolean, message string")
    got = {r.line_id: r.piece for r in ingest.decode_items(lines).collect()}
    assert got == {1: "USER: hello [REDACTED]", 2: 'SUBAGENT-ASSISTANT: hi\n[tool:Bash] {"a":1}', 3: None, 4: None, 5: None, 6: None}
    b = spark.createDataFrame([('{"timestamp":"1970-01-01T00:00:09Z","type":"session_meta","payload":{"cwd":"/w/app"}}',), ('{"timestamp":"x","type":"response_item","payload":{"type":"message","role":"user","content":[{"text":"hey"}]}}',),
                               ('{"type":"response_item","payload":{"type":"function_call","name":"sh","arguments":"{}"}}',), ("junk",)], "value string")
    got = ingest.decode_payloads(b).collect()
    assert (got[0].t, got[0].cwd) == (9.0, "/w/app") and [r.piece for r in got] == [None, "USER: hey", "ASSISTANT: [tool:sh] {}", None]


def test_deduplicate_and_corroborate(spark):
    live = facts(spark, [dict(id=1, statement="Known fact.", src_session="a")])
    batch = spark.createDataFrame([(1, "known FACT", "r", "a"), (2, "known-fact", "r", "b"), (3, "New", "r", "a"), (4, "new!", "r", "a"), (5, "new", "r", "c"), (6, "new", None, "c")], "pos bigint, statement string, repo string, src_session string")
    insert, again = ingest.deduplicate(batch, live)
    assert {r.pos for r in insert.collect()} == {3, 6} and {(r.id, r.pos, r.times) for r in again.collect()} == {(1, None, 1), (None, 3, 1)}
    up = ingest.corroborate(live, again.where("id IS NOT NULL")).first()
    assert math.isclose(up.confidence, 0.65) and up.corroborations == 1
    assert math.isclose(one(spark, lambda c: S.corroborated(F.lit(0.5), c), 2, "int"), 1 - 0.5 * 0.49)


def test_mining(spark):
    f = facts(spark, [dict(id=i, statement=f"the usual words number{i} with zebra.x" if i == 3 else "the usual words again here") for i in range(1, 60)])
    df = mining.document_frequency(f)
    pats = mining.rare_patterns(f, df)
    assert [(r.id, r.pattern) for r in pats.collect()] == [(3, "usual.*number3.*zebra\\.x")]
    assert [r.matches for r in mining.narrow(pats, f).collect()] == [1]
    odd = spark.createDataFrame([(1, "("), (2, None), (3, "again.*here"), (4, "sual w"), (5, ".*")], "id int, pattern string")
    assert {(r.id, r.matches) for r in mining.narrow(odd, f, 100).collect()} == {(3, 58), (4, 59)} and not mining.narrow(odd, f, 20).count()
    res = spark.createDataFrame([(1, 1, "Alpha beta"), (1, 6, "gamma"), (2, 1, "nope")], "qid bigint, rank int, statement string")
    probes = spark.createDataFrame([(1, "alpha.*beta", "m"), (2, "gamma", "m"), (3, "x", "n")], "qid bigint, pattern string, miner string")
    assert {tuple(r) for r in mining.hit_rates(res, probes).collect()} == {("m", 2, 1), ("n", 1, 0)}


def test_narrow_patterns_meet_statements_at_a_piece_and_pairs_do_not_move(spark):
    rnd = random.Random(5)
    names = ["kubernetes", "uber-v6.13", "netes", "v6.1", "abc", "Abcd", "a(b)c", "xy"]
    said = [" ".join(rnd.choice(names) for _ in range(4)) for _ in range(40)]
    pats = [(i, ".*".join(re.escape(rnd.choice(names)) for _ in range(2))) for i in range(60)] + [(90, r"c\ x"), (91, r"kub|["), (92, "6")]
    out = mining.narrow(spark.createDataFrame(pats, "id int, pattern string"), facts(spark, [dict(id=i, statement=s) for i, s in enumerate(said)]), 30)
    got = {(r.id, r.matches) for r in out.collect()}
    n = {i: sum(bool(re.search(p, s, re.I)) for s in said) for i, p in pats if i < 91 and p.lower() != "xy.*xy"}
    assert got == {(i, k) for i, k in n.items() if k <= 30} and n[90]
    tried = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RLIKE" in line]
    assert any("piece#" in line for line in tried) and not any("fid#" in line for line in tried)


def test_narrow_patterns_sends_no_table_through_the_driver(spark, monkeypatch):
    """Whatever the sizes on disk: words and pieces are few bytes there, and their grams hundreds of MB."""
    said = [" ".join(f"word{i * 7 % k}x{k}" for k in (11, 13, 17)) for i in range(40)]
    f = facts(spark, [dict(id=i, statement=s) for i, s in enumerate(said)])
    plans, write = [], mining.materialize

    def materialize(df, label):
        out = write(df, label)
        df.collect()
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(mining, "materialize", materialize)
    blank = spark.createDataFrame([(100, r"1\ w")], "id int, pattern string")
    out = mining.narrow(mining.rare_patterns(f, mining.document_frequency(f)).unionByName(blank), f, 40)
    got = {r.id: (r.pattern, r.matches) for r in out.collect()}
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert len(got) == 41 and got[100][1] == 40 and all(n == sum(bool(re.search(p, s, re.I)) for s in said) for p, n in got.values())
    assert "SortMergeJoin" in plans[-1] and "CartesianProduct" in plans[-1] and not any("Broadcast" in p for p in plans)


def test_kmeans_separates(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0] if i < 5 else [0.0, 1.0]) for i in range(10)], "id bigint, vec array<float>")
    got = {r.id: r.cluster for r in topics.kmeans(v, 2).collect()}
    assert len({got[i] for i in range(5)}) == 1 and got[0] != got[9]
    assert topics.kmeans(v.limit(0), 2).count() == 0
