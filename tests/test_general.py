"""Hierarchies, as-of attributes and orphans: against brute force, and on nulls, ties, repeats, clashes and nothing."""

import random

import pytest
from pyspark.sql import functions as F

from chronoweave.operators.asof_lookup import as_known_at
from chronoweave.operators.hierarchy import descendant_pairs, hierarchy, hierarchy_blocks, loops
from chronoweave.operators.orphans import orphan_report, orphans


def brute_tree(links):
    parent = {}
    for i, p in links:
        if i is not None and (i not in parent or (p is not None and (parent[i] is None or p < parent[i]))):
            parent[i] = p
    up = {i: p if p in parent else None for i, p in parent.items()}
    roots = {}
    for i in up:
        seen, at = [i], i
        while up[at] is not None and up[at] not in seen:
            at = up[at]
            seen.append(at)
        roots[i] = min(seen[seen.index(up[at]):]) if up[at] is not None else at
    below = {i: set() for i in up}
    for i in up:
        at, seen = i, set()
        while up[at] is not None and up[at] not in seen:
            at = up[at]
            seen.add(at)
        for a in seen - {i}:
            below[a].add(i)
    return roots, below


def random_links(n, seed):
    rnd = random.Random(seed)
    ids = rnd.sample(range(1, 10 * n), n)
    return [(i, rnd.choice([None, rnd.choice(ids), rnd.choice(ids), -7])) for i in ids] + [(ids[0], ids[0]), (None, 3)]


@pytest.mark.parametrize("limit", [200_000, 1])
def test_hierarchy_against_brute_force(spark, limit):
    links = random_links(300, limit)
    chain = [(20_000 + i, 20_000 + i + 1 if i < 70 else None) for i in range(71)]
    df = spark.createDataFrame(links + chain + chain, "id bigint, parent bigint").withColumn("path", F.lit("clash")).withColumn("root", F.lit(1))
    tree = hierarchy(df, "id", "parent", max_component=limit)
    rows = tree.collect()
    roots, below = brute_tree(links + chain)
    assert {r.node: r.root for r in rows} == roots and len(rows) == len(roots)
    assert {(r.ancestor, r.node) for r in descendant_pairs(tree).collect()} == {(a, n) for a in below for n in below[a]}
    assert all(set(r.descendants) == below[r.node] for r in rows if r.descendants is not None)
    for r in rows:
        assert r.path[0] == r.root and r.path[-1] == r.node and r.depth == len(r.path) - 1 and r.n_descendants == len(below[r.node])
    deep = next(r for r in rows if r.node == 20_000)
    assert deep.depth == 70 and deep.path == list(range(20_070, 19_999, -1))


def test_hierarchy_paths_agree_in_both_ways(spark):
    df = spark.createDataFrame(random_links(200, 5), "id bigint, parent bigint")
    cols = ["node", "parent", "root", "depth", "path", "n_descendants", "in_loop", "loop_reached", "dangling", "back_edge_to"]
    a, b = (sorted(map(str, hierarchy(df, max_component=m).select(*cols).collect())) for m in (100_000, 0))
    assert a == b


@pytest.mark.parametrize("limit", [200_000, 7, 0])
def test_descendants_are_whole_at_every_size(spark, limit):
    links = random_links(150, 11) + [(9_000 + i, 9_000 if i else None) for i in range(60)] + [(9_100 + i, 9_100 + (i + 1) % 40) for i in range(40)]
    below = brute_tree(links)[1]
    rows = hierarchy_blocks(spark.createDataFrame(links, "id bigint, parent bigint"), max_component=limit).collect()
    got = {}
    for r in rows:
        got.setdefault(r.node, []).extend(r.descendants)
        assert r.n_descendants == len(below[r.node])
    assert {n: sorted(ds) for n, ds in got.items()} == {n: sorted(ds) for n, ds in below.items()}
    assert len({(r.node, r.block) for r in rows}) == len(rows)
    assert limit != 7 or len([r for r in rows if r.node == 9_000]) > 1


def test_p2_tree_holds_the_descendants_of_a_large_component(spark, tmp_path):
    from chronoweave.plans.general_queries import p2_tree

    n = 5_200
    spark.range(n).selectExpr("id", "CASE WHEN id > 0 THEN 0L END AS superseded_by").write.parquet(str(tmp_path / "facts.parquet"))
    rows = p2_tree(spark, str(tmp_path)).where("node = 0").collect()
    assert sorted(int(x) for r in rows for x in r.descendants.split(",")) == list(range(1, n)) and all(r.n_descendants == n - 1 for r in rows)


def test_hierarchy_loops_and_nothing(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (6, None), (7, 99)], "id bigint, parent bigint")
    t = hierarchy(df)
    assert {(r.root, tuple(r.members)) for r in loops(t).collect()} == {(1, (1, 2, 3)), (5, (5,))}
    by = {r.node: r for r in t.collect()}
    assert by[4].root == 1 and not by[4].in_loop and by[4].loop_reached and by[7].dangling and by[7].root == 7
    assert sum(r.back_edge_to is not None for r in by.values()) == 2
    assert hierarchy(df.limit(0)).count() == 0


def brute_known(events, versions):
    out = {}
    for eid, t, k in events:
        best = None
        for vid, vk, vf, ra, e in versions:
            if None in (t, k, vid, vk, vf, ra):
                continue
            if vk == k and vf <= t and ra <= t and (e is None or e > t):
                best = max(best, (vf, ra, vid)) if best else (vf, ra, vid)
        if eid is not None:
            out[eid] = best[2] if best else None
    return out


@pytest.mark.parametrize("hot", [200_000, 20])
def test_as_known_at_against_brute_force(spark, hot):
    rnd = random.Random(hot)
    t = lambda: float(rnd.randint(0, 60))
    versions = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([t(), t(), None]) if i % 9 == 0 else t(), t(), rnd.choice([None, t(), t()])) for i in range(400)]
    events = [(i, t() if i % 11 else None, rnd.choice(["a", "a", "b", "c", "d", None])) for i in range(300)]
    ev = spark.createDataFrame(events + events[:5], "eid bigint, t double, k string").withColumn("bucket", F.lit("clash"))
    ve = spark.createDataFrame(versions + versions[:9], "vid bigint, k string, valid_from double, recorded_at double, superseded_at double").withColumn("slice", F.lit(3))
    got = {r.event_id: r.version_id for r in as_known_at(ev, ve, "eid", "t", ["k"], "vid", ["k"], hot_rows=hot, slices=7, bucket_rows=100).collect()}
    assert got == brute_known(events, versions)


def test_as_known_at_nothing(spark):
    ev = spark.createDataFrame([], "eid bigint, t double, k string")
    ve = spark.createDataFrame([], "vid bigint, k string, valid_from double, recorded_at double, superseded_at double")
    assert as_known_at(ev, ve, "eid", "t", ["k"], "vid", ["k"]).count() == 0
    one = spark.createDataFrame([(1, 5.0, "a")], "eid bigint, t double, k string")
    assert [r.version_id for r in as_known_at(one, ve, "eid", "t", ["k"], "vid", ["k"]).collect()] == [None]


@pytest.mark.parametrize("hot", [100_000, 10])
def test_orphans_against_brute_force(spark, hot):
    rnd = random.Random(hot)
    parents = [("p", i, float(rnd.randint(0, 9))) for i in range(0, 100, 2)] + [("q", i, None) for i in range(0, 50, 3)] + [("p", None, 1.0), ("p", 0, 9.0)]
    refs = [("r", i, rnd.choice(["p", "q", "z"]), rnd.choice([0, 0, 0, rnd.randint(-3, 110), None]), rnd.choice([None, float(rnd.randint(0, 9))]), "2025-01") for i in range(500)]
    at = {}
    for target, k, a in parents:
        if k is not None:
            at[(target, k)] = min(x for x in (at.get((target, k)), a) if x is not None) if a is not None else at.get((target, k))
    want = set()
    for table, row, target, ref, t, period in refs:
        if ref is None:
            continue
        if (target, ref) not in at:
            want.add((table, row, ref, period, "missing"))
        elif at[(target, ref)] is not None and t is not None and at[(target, ref)] > t:
            want.add((table, row, ref, period, "later"))
    r = spark.createDataFrame(refs + refs[:7], "ref_table string, row_id bigint, target string, ref_id bigint, ref_time double, period string").withColumn("salt", F.lit("clash"))
    p = spark.createDataFrame(parents, "target string, key bigint, available_at double").withColumn("kind", F.lit("clash"))
    found = orphans(r, p, hot_refs=hot, salts=4)
    assert {tuple(x) for x in found.collect()} == want and found.count() == len(want)
    assert orphan_report(found).agg(F.sum("orphans")).first()[0] == len(want)
    assert orphans(r.limit(0), p).count() == 0 and orphans(r, p.limit(0)).count() == len({x[:5] for x in map(tuple, r.where("ref_id IS NOT NULL").select("ref_table", "row_id", "ref_id", "period").collect())})
