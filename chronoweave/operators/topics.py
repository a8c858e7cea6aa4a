"""Topics: k-means over fact vectors with fixed seeds and rounds, and the evidence of a narrative."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import materialize


def rows_at(df: DataFrame, by: str, positions: list[int]) -> DataFrame:
    """The rows of df at 0-based positions in order of ``by``: sorted range partitions and their counts, no global window."""
    placed = materialize(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__at", 33)
    before, total = {}, 0
    for r in placed.groupBy(part.alias("p")).count().orderBy("p").collect():  # a row a partition
        before[r["p"]], total = total, total + r["count"]
    wanted = [(p << 33) + x - before[p] for x in positions for p in [max(q for q in before if before[q] <= x)] if x < total]
    return placed.where(F.col("__at").isin(wanted)).drop("__at")


def kmeans(vectors: DataFrame, k: int, rounds: int = 12) -> DataFrame:
    """(id, cluster): centroid c starts at row c * n / k in order of id; a row goes to the greatest dot product, the first of
    equals; empty clusters keep their centroid. Each round sends k sums per partition, never rows, to the driver."""
    v = materialize(vectors.select("id", "vec"), "kmeans")
    n = v.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "id bigint, cluster int")
    k = min(k, n)
    at = [c * n // k for c in range(k)]
    ids = rows_at(v.select("id"), "id", at)
    rows = v.join(F.broadcast(ids), "id").orderBy("id").collect()  # k rows
    c = np.array([r["vec"] for r in rows], "float64")
    for _ in range(rounds):
        fixed = c

        def sums(batches: Iterator[pd.DataFrame], c=fixed) -> Iterator[pd.DataFrame]:
            total, count = np.zeros_like(c), np.zeros(len(c), "int64")
            for b in batches:
                if len(b):
                    x = np.stack(b["vec"].to_numpy()).astype("float64")
                    near = (x @ c.T).argmax(1)
                    np.add.at(total, near, x)
                    count += np.bincount(near, minlength=len(c))
            yield pd.DataFrame({"cluster": np.arange(len(c), dtype="int32"), "n": count, "total": list(total)})

        parts = v.mapInPandas(sums, "cluster int, n bigint, total array<double>").where("n > 0").select("cluster", "n", F.posexplode("total").alias("place", "x"))
        # Summed in Spark in an order of their own, so that no sum depends on the partitions' order; k x dimensions rows come to the driver.
        whole = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.aggregate(F.sort_array(F.collect_list("x")), F.lit(0.0), lambda a, y: a + y).alias("x")).toPandas()
        c = c.copy()
        c[whole["cluster"], whole["place"]] = whole["x"] / whole["n"]

    def assign(batches: Iterator[pd.DataFrame], c=c) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "cluster": (np.stack(b["vec"].to_numpy()).astype("float64") @ c.T).argmax(1).astype("int32")})

    return v.mapInPandas(assign, "id bigint, cluster int")


def topic_table(clusters: DataFrame, facts: DataFrame, samples: int = 3) -> DataFrame:
    """(cluster, size, samples): statements of the first members stand for a topic's label."""
    w = Window.partitionBy("cluster").orderBy("id")
    first = clusters.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= samples).join(facts.select("id", "statement"), "id")  # the limit applies before the shuffle
    said = first.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", "statement"))), lambda x: x["statement"]).alias("samples"))
    return clusters.join(facts.select("id"), "id", "left_semi").groupBy("cluster").agg(F.count("*").alias("size")).join(said, "cluster")


def evidence(facts: DataFrame, limit: int = 250) -> DataFrame:
    """The first ``limit`` facts in order of world time: what a narrative is told from."""
    return facts.select("id", "valid_from", "statement", F.col("superseded_at").isNotNull().alias("closed")).orderBy("valid_from", "id").limit(limit)
