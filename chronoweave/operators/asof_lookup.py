"""Attributes as known at event time: each event with the version valid and known then, and none later.

Versions of an entity overlap: one is available from the later of its two
starts until it is superseded. Per entity they become current-state versions in order of
availability (ties resolved before), so that one DuckDB ``ASOF LEFT JOIN`` per
hash bucket answers all events of that bucket.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import duckdb
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEP = "\x1f"


def _key(columns: Sequence[Column]) -> Column:
    """One string for several key columns; null if any of them is null."""
    parts = [F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")) for c in columns]
    return F.concat(*[p for i, c in enumerate(parts) for p in ([F.lit(SEP)] if i else []) + [c]])


def current_states(versions: pd.DataFrame) -> pd.DataFrame:
    """(k, from_t, vid): the best version (greatest valid_from, recorded_at, id) of each key from each moment of change on.

    vid is missing from the moment on at which no version is left.
    """
    v = versions.sort_values(["k", "s"], kind="stable")
    ks, ss, es = v["k"].tolist(), v["s"].tolist(), v["e"].tolist()
    rank = list(zip((-v["vf"]).tolist(), (-v["ra"]).tolist(), (-v["vid"]).tolist()))
    ids = v["vid"].tolist()
    out_k: list[str] = []
    out_t: list[float] = []
    out_v: list[int | None] = []
    n, i = len(ks), 0
    while i < n:
        j = i
        while j < n and ks[j] == ks[i]:
            j += 1
        ends = sorted(e for e in es[i:j] if e != np.inf)
        heap: list[tuple] = []
        a, b, last = i, 0, object()
        while a < j or b < len(ends):
            t = ss[a] if a < j and (b >= len(ends) or ss[a] <= ends[b]) else ends[b]
            while a < j and ss[a] == t:
                heapq.heappush(heap, (rank[a], a))
                a += 1
            while b < len(ends) and ends[b] == t:
                b += 1
            while heap and es[heap[0][1]] <= t:
                heapq.heappop(heap)
            best = ids[heap[0][1]] if heap else None
            if best != last:
                out_k.append(ks[i])
                out_t.append(t)
                out_v.append(best)
                last = best
        i = j
    return pd.DataFrame({"k": pd.Series(out_k, dtype="object"), "from_t": np.array(out_t, "float64"), "vid": pd.array(out_v, "Int64")})


def _bucket(versions: pd.DataFrame, events: pd.DataFrame) -> pd.DataFrame:
    if events.empty:
        return pd.DataFrame({"event_id": pd.Series([], dtype="int64"), "version_id": pd.Series([], dtype="Int64")})
    for side in (versions, events):
        side["k"] = side["k"] + SEP + side["slice"].astype(str)
    states = current_states(versions[versions["k"].isin(set(events["k"]))])
    if states.empty:
        return pd.DataFrame({"event_id": events["event_id"], "version_id": pd.array([None] * len(events), "Int64")})
    with duckdb.connect(config={"threads": 1, "memory_limit": "1GB"}) as con:
        con.register("ev", events[["event_id", "k", "t"]])
        con.register("st", states)
        joined = con.execute("SELECT ev.event_id, st.vid AS version_id FROM ev ASOF LEFT JOIN st ON ev.k = st.k AND ev.t >= st.from_t").df()
    return pd.DataFrame({"event_id": joined["event_id"].astype("int64"), "version_id": joined["version_id"].astype("Int64")})


def _dyadic(low: str, end: str, slices: int) -> str:
    """SQL for the disjoint intervals [at * 2^level, (at + 1) * 2^level) that make up [low, end), two a level at most."""
    lo, hi = f"shiftright({low} + shiftleft(1, j) - 1, j)", f"shiftright({end}, j)"
    left = f"CASE WHEN {lo} % 2 = 1 AND {lo} < {hi} THEN struct(j AS level, {lo} AS at) END"
    right = f"CASE WHEN {hi} % 2 = 1 AND {lo} < {hi} THEN struct(j AS level, {hi} - 1 AS at) END"
    return f"filter(flatten(transform(sequence(0, {slices.bit_length()}), j -> array({left}, {right}))), x -> x IS NOT NULL)"


def as_known_at(
    events: DataFrame,
    versions: DataFrame,
    event_id: str,
    event_time: str,
    event_keys: Sequence[str],
    version_id: str,
    version_keys: Sequence[str],
    valid_from: str = "valid_from",
    recorded_at: str = "recorded_at",
    superseded_at: str = "superseded_at",
    hot_rows: int = 200_000,
    slices: int = 256,
    bucket_rows: int = 50_000,
) -> DataFrame:
    """(event_id, version_id): the version that was valid and known at each event; null if there was none.

    A version counts at t if valid_from <= t, recorded_at <= t and
    superseded_at is null or > t; of several the one with the greatest
    (valid_from, recorded_at, id). Versions lacking a time, an id or a key never
    count; an event lacking its time or a key gets null. A repeated event id or version counts
    once. Keys with more than ``hot_rows`` rows are split into ``slices`` of
    time, so no bucket holds a whole hot entity: a version goes to the slices
    it begins and ends in, and of those that fill a slice only the best goes there.
    """
    t = F.col(event_time).cast("double")
    ev = events.select(F.col(event_id).cast("bigint").alias("event_id"), t.alias("t"), _key([F.col(c) for c in event_keys]).alias("k"))
    ver = versions.select(
        F.col(version_id).cast("bigint").alias("vid"), _key([F.col(c) for c in version_keys]).alias("k"),
        F.col(valid_from).cast("double").alias("vf"), F.col(recorded_at).cast("double").alias("ra"), F.col(superseded_at).cast("double").alias("e"),
    ).withColumn("s", F.greatest("vf", "ra")).withColumn("e", F.coalesce("e", F.lit(float("inf"))))
    ver = ver.where("vid IS NOT NULL AND k IS NOT NULL AND vf IS NOT NULL AND ra IS NOT NULL AND NOT isnan(s) AND s < e")
    open_ = ev.where("event_id IS NOT NULL AND (k IS NULL OR t IS NULL OR isnan(t))").select("event_id", F.lit(None).cast("bigint").alias("version_id"))
    ev = ev.where("event_id IS NOT NULL AND k IS NOT NULL AND t IS NOT NULL AND NOT isnan(t)")

    # Rows by hash of the key: a few thousand counts tell whether any key can be hot, and how many buckets are needed.
    both = ver.select("k", F.col("s").alias("at")).unionByName(ev.select("k", F.col("t").alias("at")))
    groups = both.groupBy(F.pmod(F.xxhash64("k"), F.lit(4096)).alias("g")).agg(F.count("*").alias("n"))
    counts = {r["g"]: r["n"] for r in groups.collect()}  # at most 4,096 rows
    buckets = max(1, -(-sum(counts.values()) // bucket_rows))
    suspects = [g for g, n in counts.items() if n > hot_rows]

    if suspects:
        fractions = [i / slices for i in range(1, slices)]
        hot = (
            both.where(F.pmod(F.xxhash64("k"), F.lit(4096)).isin(suspects))
            .groupBy("k")
            .agg(F.count("*").alias("n"), F.percentile_approx("at", fractions, 2 * slices).alias("bounds"))
            .where(F.col("n") > hot_rows)
            .select("k", F.array_distinct("bounds").alias("bounds"))
        )
        place = lambda at: F.coalesce(F.size(F.filter("bounds", lambda b: b <= at)), F.lit(0))
        # A hot key has over hot_rows rows, so this side has at most 1 / hot_rows of them all.
        ev = ev.join(hot, "k", "left").withColumn("slice", F.when(F.col("bounds").isNotNull(), place(F.col("t"))).otherwise(0)).drop("bounds")
        ver = ver.join(hot, "k", "left").withColumns({
            "a": F.when(F.col("bounds").isNotNull(), place(F.col("s"))).otherwise(0),
            "b": F.when(F.col("bounds").isNotNull(), place(F.col("e"))).otherwise(0),
        }).drop("bounds")
        ends = ver.withColumn("slice", F.explode(F.array_distinct(F.array("a", "b")))).drop("a", "b")
        # The slices between are covered by intervals of a power of two of slices, sixteen at most; the best of each interval, one row, then goes to its slices.
        filling = ver.where("b > a + 1").withColumn("n", F.explode(F.expr(_dyadic("a + 1", "b", slices))))
        inside = filling.groupBy("k", "n").agg(F.max(F.struct("vf", "ra", "vid")).alias("x")).withColumn("slice", F.explode(F.expr("sequence(shiftleft(n.at, n.level), shiftleft(n.at + 1, n.level) - 1)")))
        best = inside.groupBy("k", "slice").agg(F.max("x").alias("x"))
        best = best.select(F.col("x.vid").alias("vid"), "k", F.col("x.vf").alias("vf"), F.col("x.ra").alias("ra"), F.lit(float("inf")).alias("e"), F.lit(float("-inf")).alias("s"), "slice")
        ver = ends.unionByName(best)
    else:
        ev, ver = ev.withColumn("slice", F.lit(0)), ver.withColumn("slice", F.lit(0))

    bucket = F.pmod(F.xxhash64("k", "slice"), F.lit(buckets)).alias("bucket")
    grouped = ver.select("vid", "k", "slice", "vf", "ra", "s", "e", bucket).groupBy("bucket").cogroup(ev.select("event_id", "k", "t", "slice", bucket).groupBy("bucket"))
    found = grouped.applyInPandas(_bucket, "event_id bigint, version_id bigint")
    return found.unionByName(open_).groupBy("event_id").agg(F.max("version_id").alias("version_id"))
