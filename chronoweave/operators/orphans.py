"""References to records that do not exist, or came into being only after the reference.

Parents and references are range-partitioned by key together; in each range
the parents form one sorted array, which batches of references probe by
binary search. Keys that very many rows refer to are salted, with a copy of
the parent for each salt, so that a range never holds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARENT, REFERENCE = 0, 1


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind, target, key: first the parents of the range, then the references."""
    keys: dict[str, list[np.ndarray]] = {}
    times: dict[str, list[np.ndarray]] = {}
    arrays: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        kind = batch.column("kind").to_numpy(zero_copy_only=False)
        target = np.array(batch.column("target").to_pylist(), dtype=object)
        key = batch.column("key").to_numpy(zero_copy_only=False)
        at = batch.column("at").to_numpy(zero_copy_only=False).astype("float64")  # null becomes NaN
        for name in sorted(set(target[kind == PARENT])):
            own = (kind == PARENT) & (target == name)
            keys.setdefault(name, []).append(key[own])
            times.setdefault(name, []).append(at[own])
        refs = np.flatnonzero(kind == REFERENCE)
        if not len(refs):
            continue
        for name in [n for n in keys if n not in arrays]:
            k, a = np.concatenate(keys[name]), np.concatenate(times[name])
            order = np.argsort(k, kind="stable")
            arrays[name] = (k[order], a[order])
        miss = np.ones(len(refs), bool)
        late = np.zeros(len(refs), bool)
        for name in set(target[refs]):
            own = np.flatnonzero(target[refs] == name)
            if name not in arrays:
                continue
            k, a = arrays[name]
            place = np.searchsorted(k, key[refs][own])
            there = (place < len(k)) & (k[np.minimum(place, len(k) - 1)] == key[refs][own])
            miss[own] = ~there
            late[own] = there & (a[np.minimum(place, len(k) - 1)] > at[refs][own])
        bad = refs[miss | late]
        if len(bad):
            part = batch.take(pa.array(bad)).select(["ref_table", "row_id", "ref_id", "period"])
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(np.where(miss[miss | late], "missing", "later"))], names=["ref_table", "row_id", "ref_id", "period", "reason"]
            )


def orphans(references: DataFrame, parents: DataFrame, hot_refs: int = 100_000, salts: int = 64) -> DataFrame:
    """(ref_table, row_id, ref_id, period, reason) of each reference without a target, distinct.

    references: ref_table, row_id, target (the table referred to), ref_id, ref_time (double, may be null), period.
    parents: target, key, available_at (double, may be null; the earliest counts where a key is repeated).
    reason is ``missing`` if there is no parent, ``later`` if it is available only
    after ref_time; without either time the order isn't judged. A null ref_id
    refers to nothing and is no orphan; null row ids and periods are kept.
    Empty parents make every reference an orphan. Other columns are ignored.
    """
    refs = references.where(F.col("ref_id").isNotNull()).select(
        F.lit(REFERENCE).alias("kind"), "target", F.col("ref_id").cast("bigint").alias("key"), F.col("ref_time").cast("double").alias("at"),
        "ref_table", F.col("row_id").cast("bigint").alias("row_id"), F.col("ref_id").cast("bigint").alias("ref_id"), "period",
    )
    par = parents.where(F.col("key").isNotNull()).groupBy("target", F.col("key").cast("bigint").alias("key")).agg(F.min(F.col("available_at").cast("double")).alias("at"))
    # Counts by hash tell whether any key can be hot; only then keys are counted.
    g = F.pmod(F.xxhash64("target", "key"), F.lit(4096))
    suspects = [r["g"] for r in refs.groupBy(g.alias("g")).count().where(F.col("count") > hot_refs).collect()]  # at most 4,096 rows
    if suspects:
        hot = refs.where(g.isin(suspects)).groupBy("target", "key").count().where(F.col("count") > hot_refs).select("target", "key", F.lit(True).alias("hot"))
        refs = refs.join(hot, ["target", "key"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_id", "at", "period"), F.lit(salts))).otherwise(0).cast("int")).drop("hot")
        par = par.join(hot, ["target", "key"], "left").withColumn("salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("hot")
    else:
        refs, par = refs.withColumn("salt", F.lit(0)), par.withColumn("salt", F.lit(0))
    rows = par.withColumn("kind", F.lit(PARENT)).unionByName(refs, allowMissingColumns=True)
    ranged = rows.repartitionByRange("target", "key", "salt").sortWithinPartitions("kind", "target", "key")
    return ranged.mapInArrow(_probe, "ref_table string, row_id bigint, ref_id bigint, period string, reason string").distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, period and reason."""
    return found.groupBy("ref_table", "period", "reason").agg(F.count("*").alias("orphans"), F.countDistinct("ref_id").alias("keys"))
