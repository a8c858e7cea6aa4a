"""Most similar vectors of every vector, by cosine: an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample. Every
vector is indexed. Where all vectors are queries, its code goes to the cells nearest to it, while as a query
it stays in its nearest cell, whole: a code of a few bytes is copied, never
a vector. Where queries are few, they are copied instead. In a cell, asymmetric distance tables give q.c + q.r~ for each query and
code; with the norm of what the code leaves out, that is a bound on the exact cosine.
What passes the bound (or is among the best, for top-k) is reranked exactly.

Cells grow in number with the square root of the rows, beyond some hundred thousand. How many a query of top_k searches is
measured on the sample, by the recall asked for. In a crowd of near copies a query keeps a bounded number of candidates a cell, with
a bound on those left out; where that bound doesn't settle the first k, they are found exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.vector import cosine_best
from chronoweave.session import materialize

CODE, QUERY = 0, 1
#: Candidates that a query keeps in a cell when pairs above a cosine are sought.
CROWD = 256


@dataclass
class Index:
    """What is fitted: its size depends on the parameters, not on the data."""

    centroids: np.ndarray  # cells x dim, unit length
    codebooks: np.ndarray  # parts x codes x dim / parts
    finer: np.ndarray  # likewise, for what the first code leaves out
    probes: int
    cell_salts: np.ndarray  # into how many parts the queries of a cell are spread

    @property
    def dim(self) -> int:
        return self.centroids.shape[1]


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator, spherical: bool = False) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        d = x @ c.T if spherical else x @ c.T - 0.5 * (c * c).sum(1)
        near = d.argmax(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        empty = n == 0
        c[~empty] = total[~empty] / n[~empty, None]
        if empty.any():
            c[empty] = x[rng.choice(len(x), int(empty.sum()))]
        if spherical:
            norm = np.linalg.norm(c, axis=1, keepdims=True)
            c = c / np.where(norm > 0, norm, 1)
    return c


def cells_for(rows: int, rows_per_cell: int = 400, max_cells: int = 32_768) -> int:
    """A cell for each rows_per_cell rows, and beyond twice the root of the rows that many, so that neither cells nor their rows grow in proportion."""
    return int(np.clip(min(rows / rows_per_cell, 2 * np.sqrt(rows)), 1, max_cells))


def fit(sample: np.ndarray, cells: int, probes: int = 12, part_dims: int = 4, codes: int = 256, seed: int = 11) -> Index:
    rng = np.random.default_rng(seed)
    x = sample.astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = _kmeans(x, min(cells, max(1, len(x) // 4)), 8, rng, spherical=True)
    near = (x @ c.T).argmax(1)
    residual = x - c[near]
    dim = x.shape[1]
    parts = max(1, dim // part_dims)
    width = -(-dim // parts)
    padded = np.zeros((len(x), parts * width), "float32")
    padded[:, :dim] = residual
    books = np.zeros((2, parts, codes, width), "float32")
    for level in range(2):
        for m in range(parts):
            own = padded[:, m * width : (m + 1) * width]
            c_m = _kmeans(own, codes, 8, rng)
            books[level, m, : len(c_m)] = c_m
            books[level, m, len(c_m) :] = c_m[0]
            own -= c_m[(own @ c_m.T - 0.5 * (c_m * c_m).sum(1)).argmax(1)]
    share = np.bincount(near, minlength=len(c)) / len(x)
    salts = np.maximum(1, np.ceil(share * len(c) / 8)).astype("int64")
    return Index(c, books[0], books[1], min(probes, len(c)), salts)


def probes_for(index: Index, sample: np.ndarray, k: int, recall: float) -> int:
    """The fewest cells a query has to search so that ``recall`` of the k nearest within the sample lie in them: measured on up to 400 rows of the sample as queries."""
    x = sample.astype("float32")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ index.centroids.T).argmax(1)
    q = np.arange(min(400, len(x)))
    sim = x[q] @ x.T
    sim[q, q] = -2
    k = min(k, len(x) - 1)
    if k < 1:
        return len(index.centroids)
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    order = np.argsort(np.argsort(-(x[q] @ index.centroids.T), axis=1), axis=1)  # the rank of each cell for each query
    return int(np.quantile(np.take_along_axis(order, near[best], axis=1), recall, method="higher")) + 1


def _matrix(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    lists = batch.column("vec")
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return ids, flat.reshape(len(ids), dim)


def _assign(index: Index, copy_codes: bool):
    """Each vector becomes a QUERY row in its nearest cell and CODE rows in the cells it is near to; or the other way round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = index.codebooks.shape
        levels = [(b, 0.5 * (b**2).sum(2)) for b in (index.codebooks, index.finer)]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, raw = _matrix(batch, index.dim)
            as_query = batch.column("as_query").to_numpy(zero_copy_only=False)
            x = raw.astype("float64")
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")
            near = x @ index.centroids.T
            probe = np.argpartition(-near, index.probes - 1, axis=1)[:, : index.probes] if index.probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(x), 1))
            home = near.argmax(1)
            padded = np.zeros((len(x), parts * width), "float32")
            padded[:, : index.dim] = x - index.centroids[home]
            head = np.empty((len(x), 12 + 2 * parts), "uint8")
            head[:, :4] = home.astype("int32").view("uint8").reshape(-1, 4)
            for level, (books, half) in enumerate(levels):
                for m in range(parts):
                    part = padded[:, m * width : (m + 1) * width]
                    near_m = (part @ books[m].T - half[m]).argmax(1)
                    head[:, 12 + level * parts + m] = near_m
                    part -= books[m][near_m]
                left = np.linalg.norm(padded, axis=1).astype("float32") + np.float32(1e-4)
                head[:, 4 + 4 * level : 8 + 4 * level] = left.view("uint8").reshape(-1, 4)
            salts = index.cell_salts
            q = np.flatnonzero(as_query)
            for kind, data, own in ((CODE, head, np.arange(len(x))), (QUERY, x.view("uint8").reshape(len(x), -1), q)):
                if not len(own):
                    continue
                if copy_codes == (kind == CODE):  # to all probed cells, and to all parts of each
                    flat = probe[own].ravel()
                    n = salts[flat]
                    rows = np.repeat(np.repeat(own, probe.shape[1]), n)
                    cells, salt = np.repeat(flat, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                else:
                    rows, cells, salt = own, home[own], ids[own] % salts[home[own]]
                payload = pa.Array.from_buffers(pa.binary(data.shape[1]), len(rows), [None, pa.py_buffer(np.ascontiguousarray(data[rows]).tobytes())]).cast(pa.binary())
                spot = (cells.astype("int64") << 32) + (salt.astype("int64") << 1) + kind
                yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(ids[rows]), payload], names=["spot", "id", "payload"])

    return run


def _scan(index: Index, min_cos: float | None, keep: int):
    """Rows sorted by spot (cell, salt, kind): the codes of a cell, then its queries, by asymmetric distance tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_codes, width = index.codebooks.shape
        at = None
        heads: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        ready: tuple | None = None

        def search(qid: np.ndarray, q: np.ndarray) -> Iterator[pa.RecordBatch]:
            nonlocal ready
            if ready is None:
                head, owner = np.concatenate(heads), np.concatenate(owners)
                home, left, left2 = (head[:, 4 * i : 4 * i + 4].copy().view(t).ravel() for i, t in enumerate(("int32", "float32", "float32")))
                cells, place = np.unique(home, return_inverse=True)
                ready = owner, left, left2, index.centroids[cells], place.ravel(), head[:, 12 : 12 + parts].astype("intp"), head[:, 12 + parts :]
            owner, left, left2, cents, place, code, code2 = ready
            for a in range(0, len(q), 512):
                block, ids = q[a : a + 512], qid[a : a + 512]
                padded = np.zeros((len(block), parts * width), "float32")
                padded[:, : index.dim] = block
                # table[m]: codes x queries, so that a lookup copies a row of queries
                table = [np.ascontiguousarray((padded[:, m * width : (m + 1) * width] @ index.codebooks[m].T).T) for m in range(parts)]
                coarse = np.ascontiguousarray((block @ cents.T).T)
                seen: list[tuple[np.ndarray, ...]] = []
                for b in range(0, len(owner), 8192):
                    part = slice(b, b + 8192)
                    score = coarse[place[part]]
                    for m in range(parts):
                        score += table[m][code[part, m]]
                    if min_cos is not None:
                        x, y = np.nonzero(score >= (min_cos - 1e-4 - left[part])[:, None])
                    else:
                        n = min(keep, score.shape[0])
                        x = np.argpartition(-score, n - 1, axis=0)[:n].ravel()
                        y = np.tile(np.arange(len(ids)), n)
                    value = score[x, y]
                    for m in range(parts):  # the finer code, for these alone
                        value += (index.finer[m][code2[part][x, m]] * padded[y, m * width : (m + 1) * width]).sum(1)
                    if min_cos is not None:
                        near = value >= min_cos - 1e-4 - left2[part][x]
                        x, y, value = x[near], y[near], value[near] + left2[part][x[near]]
                    other = owner[part][x]
                    ok = other != ids[y]
                    seen.append((y[ok], other[ok], value[ok]))
                y, other, value = (np.concatenate(z) for z in zip(*seen))
                if not len(y):
                    continue
                # A query keeps its best over the whole cell; what a crowd leaves out is told by its greatest bound, under id -1.
                order = np.lexsort((other, -value, y))
                y, other, value = y[order], other[order], value[order]
                first = np.searchsorted(y, np.arange(len(ids) + 1))
                rank = np.arange(len(y)) - first[y]
                most = keep if min_cos is None else CROWD
                own = rank < most if min_cos is None else rank <= most
                y, other, value = y[own], np.where(rank[own] < most, other[own], -1), value[own]
                columns = [pa.array(ids[y]), pa.array(other), pa.array(value.astype("float32"))]
                if min_cos is not None:
                    vec = np.ascontiguousarray(block[y])
                    columns.append(pa.Array.from_buffers(pa.binary(4 * index.dim), len(vec), [None, pa.py_buffer(vec.tobytes())]).cast(pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=["query", "id", "score", "q"][: len(columns)])

        for batch in batches:
            if not batch.num_rows:
                continue
            spot, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("spot", "id"))
            cuts = [0, *(np.flatnonzero(np.diff(spot)) + 1).tolist(), len(spot)]
            for a, b in zip(cuts, cuts[1:]):
                if spot[a] >> 1 != at:
                    at, heads, owners, ready = spot[a] >> 1, [], [], None
                part = batch.column("payload").slice(a, b - a)
                data = np.frombuffer(b"".join(part.to_pylist()), "uint8").reshape(b - a, -1)
                if spot[a] & 1 == CODE:
                    heads.append(data)
                    owners.append(ids[a:b])
                elif heads:
                    yield from search(ids[a:b], data.view("float32"))

    return run


def _clean(vectors: DataFrame, id_col: str, vec_col: str, copies: int | None) -> tuple[DataFrame, int]:
    """(id, vec) of usable vectors; of equal vectors only the ``copies`` smallest ids, where there are more.

    With ties going to the smaller id, no other copy can be among anyone's most similar.
    """
    v = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    lengths = v.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    usable = v.where(F.size("vec") == dim).where(F.expr("exists(vec, x -> x <> 0) AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < float('inf'))"))
    if copies is None:
        return usable, dim
    h = F.xxhash64("vec").alias("h")
    crowds = usable.select(h, "id").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > copies).select("h")
    if not crowds.limit(1).count():
        return usable, dim
    # Only crowds are ranked; the window's limit applies before its shuffle.
    crowded = usable.withColumn("h", h).join(crowds, "h", "left_semi")
    w = Window.partitionBy("h").orderBy("id")
    ranked = crowded.withColumn("place", F.dense_rank().over(w)).where(F.col("place") <= copies).select("id", "vec")
    return usable.withColumn("h", h).join(crowds, "h", "left_anti").select("id", "vec").unionByName(ranked.distinct()), dim


def _index_for(usable: DataFrame, dim: int, sample_rows: int, rows_per_cell: int = 400, max_cells: int = 32_768, **params) -> tuple[Index, np.ndarray] | None:
    """The index and its sample: the rows of smallest hash, sample_rows of them, or eight a cell where there are more cells (max_cells bounds it)."""
    rows = usable.count()
    if not rows or not dim:
        return None
    cells = cells_for(rows, rows_per_cell, max_cells)
    sample_rows = max(sample_rows, 8 * cells)
    # About twice as many pass by their hash, so that no task sends the driver a whole sample of its own.
    part = min(1.0, 2 * sample_rows / rows)
    likely = usable.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 20)) < int(np.ceil(part * (1 << 20))))
    sample = likely.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(sample_rows).select("vec").toArrow()
    x = sample.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    return fit(x, cells, **params), x


def _candidates(usable: DataFrame, index: Index, as_query, min_cos: float | None, keep: int) -> DataFrame:
    spark = usable.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    placed = usable.select("id", "vec", as_query.alias("as_query")).mapInArrow(_assign(index, min_cos is not None), "spot bigint, id bigint, payload binary")
    cells = placed.repartition(tasks, F.shiftright("spot", 1)).sortWithinPartitions("spot")
    return cells.mapInArrow(_scan(index, min_cos, keep), "query bigint, id bigint, score float" + (", q binary" if min_cos is not None else ""))


def _cosine(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype("float64")
            q = batch.column("q")
            q = q.flatten().to_numpy(zero_copy_only=False) if pa.types.is_list(q.type) else np.frombuffer(b"".join(q.to_pylist()), "float32")
            q = q.reshape(-1, dim).astype("float64")
            cos = (x * q).sum(1) / (np.linalg.norm(x, axis=1) * np.linalg.norm(q, axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("id"), pa.array(cos)], names=["query", "id", "cosine"])

    return run


def top_k(
    vectors: DataFrame, id_col: str = "fact_id", vec_col: str = "vec", k: int = 10, queries=None, sample_rows: int = 20_000, keep: int = 100, recall: float = 0.97, exact: bool = False, **params
) -> DataFrame:
    """(query, rank, id, cosine): the k most similar others of each query vector, exact cosine, ties to the smaller id.

    queries: a condition on the column ``id`` that says which rows are queries (all by
    default). As many cells are searched as give ``recall`` on the sample, all with ``exact``, when also no candidate is
    left to the tables; else the ``keep`` best by table
    distance are reranked. Vectors that are null, all zero, not finite or of another length than
    the most frequent one take no part; an id counts once. Fewer than k others give fewer rows.
    """
    usable, dim = _clean(vectors, id_col, vec_col, None)
    usable = usable.dropDuplicates(["id"])
    as_query = queries if queries is not None else F.lit(True)
    asked = usable.where(as_query).select(F.col("id").alias("query"), F.col("vec").alias("own"))
    rank = Window.partitionBy("query").orderBy(F.desc("cosine"), "id")
    if exact:
        near = cosine_best(asked.select(F.col("query").alias("qid"), F.col("own").alias("vec")), usable.select("id", "vec", F.lit(0).alias("pool")), {0: k + 1})
        others = near.where("id <> qid").select(F.col("qid").alias("query"), "id", F.col("sim").alias("cosine"))
        return others.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query", "rank", "id", "cosine")
    fitted = _index_for(usable, dim, sample_rows, **params)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], "query bigint, rank int, id bigint, cosine double")
    index, sample = fitted
    index.probes = min(len(index.centroids), max(index.probes, probes_for(index, sample, k, recall)))
    found = _candidates(usable, index, as_query, None, max(keep, k))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max(keep, k)).select("query", "id")
    q = F.transform("own", lambda x: x.cast("float")).alias("q")
    cosines = near.join(asked.select("query", q), "query").join(usable, "id").select("query", "id", "vec", "q").mapInArrow(_cosine(dim), "query bigint, id bigint, cosine double")
    return cosines.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select("query", "rank", "id", "cosine")


def mutual_pairs(vectors: DataFrame, id_col: str = "fact_id", vec_col: str = "vec", min_cos: float = 0.9, k: int = 10, sample_rows: int = 20_000, **params) -> DataFrame:
    """(a, b, cosine), a < b: pairs of at least min_cos that are among each other's k most similar.

    Whoever is that similar and not within the first k has k others at least as
    similar, so ranking the pairs above min_cos decides. Of equal vectors the k + 1
    smallest ids are kept, which loses no such pair (ties go to the smaller id).
    Vectors that take no part: see top_k.
    """
    usable, dim = _clean(vectors, id_col, vec_col, k + 1)
    fitted = _index_for(usable, dim, sample_rows, **params)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], "a bigint, b bigint, cosine double")
    found = materialize(_candidates(usable, fitted[0], F.lit(True), min_cos, 0), "candidates")
    exact = found.where("id >= 0").join(usable, "id").select("query", "id", "vec", "q").mapInArrow(_cosine(dim), "query bigint, id bigint, cosine double")
    exact = exact.where(F.col("cosine") >= min_cos)
    # Queries in a crowd, whose k-th best isn't above all that was left out, are searched exactly.
    left_out = found.where("id < 0").groupBy("query").agg(F.max("score").alias("bound"))
    if left_out.limit(1).count():
        place = Window.partitionBy("query").orderBy(F.desc("cosine"))
        exact = materialize(exact, "reranked")
        kth = exact.dropDuplicates(["query", "id"]).withColumn("n", F.row_number().over(place)).where(F.col("n") == k).select("query", F.col("cosine").alias("kth"))
        unsure = materialize(left_out.join(kth, "query", "left").where(F.coalesce(F.col("kth") <= F.col("bound") + 1e-6, F.lit(True))).select(F.col("query").alias("id")), "unsure")
        asked = usable.join(unsure, "id").select(F.col("id").alias("qid"), "vec")
        near = cosine_best(asked, usable.select("id", "vec", F.lit(0).alias("pool")), {0: k + 1}).where(F.col("sim") >= min_cos).where("qid <> id")
        exact = exact.unionByName(near.select(F.col("qid").alias("query"), "id", F.col("sim").alias("cosine")))
    # A pair may be found from either end, and in more than one cell.
    pairs = exact.groupBy(F.least("query", "id").alias("a"), F.greatest("query", "id").alias("b")).agg(F.max("cosine").alias("cosine"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y")))).alias("p"), "cosine").select("p.*", "cosine")
    rank = Window.partitionBy("x").orderBy(F.desc("cosine"), "y")
    top = both.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    return top.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"), F.max("cosine").alias("cosine")).where("n = 2").drop("n")
