"""Exact vector ranking: a stated set of queries, in blocks, against all vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.lexical import query_blocks

BLOCK_VALUES = 4_000_000


def usable(vectors: DataFrame, id_col: str = "fact_id", vec_col: str = "vec") -> DataFrame:
    """(id, vec) of vectors with the most frequent length that aren't all zero; an id once."""
    v = vectors.where(F.col(vec_col).isNotNull()).dropDuplicates([id_col]).select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    most = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return v.where(F.size("vec") == (most[0]["d"] if most else -1)).where(F.exists("vec", lambda x: x != 0))


def cosine_top(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(qid, id, sim, rank) for queries(qid, vec) against vectors(id, vec): exact cosine in double, rounded to nine places, rank from 0."""
    return cosine_best(queries, vectors.select("id", "vec", F.lit(0).alias("pool")), {0: k}).drop("pool")


def cosine_best(queries: DataFrame, vectors: DataFrame, keep: dict[int, int]) -> DataFrame:
    """(qid, pool, id, sim, rank): the keep[pool] nearest vectors(id, vec, pool) of each pool.

    Each block of queries goes to all partitions, which pass on no more than each query can keep. An id with several vectors counts by the nearest, if asked for as one pool.
    """
    spark = vectors.sparkSession
    out = spark.createDataFrame([], "qid bigint, pool int, id bigint, sim double")
    dims = vectors.select(F.size("vec").alias("d")).limit(1).collect()
    for block in query_blocks(queries.select("qid", "vec"), BLOCK_VALUES // max(1, dims[0]["d"] if dims else 1)):
        q = block.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(block.num_rows, -1)
        handle = spark.sparkContext.broadcast((block.column("qid").to_numpy(), q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)))  # at most BLOCK_VALUES

        def run(batches: Iterator[pa.RecordBatch], handle=handle) -> Iterator[pa.RecordBatch]:
            qid, q = handle.value
            held = {p: (np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)) for p in keep}
            least = {p: np.full(len(qid), -np.inf) for p in keep}
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype("float64")
                ids, pool = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "pool"))
                x = (x / np.linalg.norm(x, axis=1, keepdims=True)).T
                for p, k in keep.items():
                    own = np.flatnonzero(pool == p)
                    for a in range(0, len(own), 4096):
                        part = own[a : a + 4096]
                        s = np.round(q @ x[:, part], 9)
                        floor = least[p] if s.shape[1] <= k else np.maximum(least[p], np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
                        r, c = np.nonzero(s >= floor[:, None])  # equals of the last are kept until ids decide
                        row, best_i, best_s = (np.concatenate(z) for z in zip(held[p], (r, ids[part[c]], s[r, c])))
                        order = np.lexsort((best_i, -best_s, row))
                        row, best_i, best_s = row[order], best_i[order], best_s[order]
                        first = np.searchsorted(row, np.arange(len(qid) + 1))
                        place = np.arange(len(row)) - first[row]
                        full = np.flatnonzero(np.diff(first) >= k)
                        least[p][full] = best_s[first[full] + k - 1]
                        held[p] = row[place < k], best_i[place < k], best_s[place < k]
            for p, (row, best_i, best_s) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(np.full(len(row), p, "int32")), pa.array(best_i), pa.array(best_s)], names=["qid", "pool", "id", "sim"])

        out = out.unionByName(vectors.select("id", "vec", "pool").mapInArrow(run, "qid bigint, pool int, id bigint, sim double"))
    w = Window.partitionBy("qid", "pool").orderBy(F.desc("sim"), "id")
    most = F.create_map(*[F.lit(x) for kv in keep.items() for x in kv])
    return out.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most[F.col("pool")])
