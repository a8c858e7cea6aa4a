"""Lexical ranking by stems and phrases: postings once, BM25 for any number of queries."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions.porter import stem
from chronoweave.session import materialize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Queries that are scored in one pass over the documents, and documents whose postings are held at a time.
BLOCK_QUERIES, BLOCK_DOCUMENTS = 20_000, 20_000


def words(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _stemmed(c: Column) -> Column:
    """The stems of the words of a text, in order; equal words are stemmed once a task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([None if t is None else [stem(w) for w in t] for t in lists])

    return F.pandas_udf(run, "array<string>")(words(c))


def query_terms(queries: DataFrame) -> DataFrame:
    """(qid, terms) of queries(qid, q): a term for each blank-separated token; one of several words is a phrase, its stems joined by blanks."""
    each = queries.select("qid", F.explode(F.split("q", r"\s+")).alias("token")).select("qid", F.array_join(_stemmed(F.col("token")), " ").alias("term")).where("term <> ''")
    return each.groupBy("qid").agg(F.sort_array(F.collect_set("term")).alias("terms"))


@dataclass
class LexicalIndex:
    postings: DataFrame  # id, term, weight (idf * saturation, the term's part of the score)
    sequences: DataFrame  # id, dl, texts (array of struct: words in order, w)
    n: int
    avgdl: float

    @cached_property
    def documents(self) -> DataFrame:
        """(id, terms, weights): a row a document."""
        rows = self.postings.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("p"))
        return materialize(rows.select("id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights")), "documents")

    def weigh(self, tf: DataFrame) -> DataFrame:
        """(id, term, weight) of tf(id, dl, term, tf)."""
        idf = F.greatest(F.log((self.n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
        scored = tf.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", idf)
        part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / self.avgdl))
        return tf.join(scored, "term").select("id", "term", part.alias("weight"))

    def phrases(self, asked: DataFrame) -> DataFrame | None:
        """(id, term, weight) of the phrases in asked(qid, terms): where their stems follow each other in one text. None if there are none."""
        said = materialize(asked.select(F.explode("terms").alias("term")).where(F.instr("term", " ") > 0).distinct(), "phrases")
        lengths = sorted(r["n"] for r in said.select((F.size(F.split("term", " "))).alias("n")).distinct().collect())  # few
        if not lengths:
            return None
        grams = F.flatten(F.array(*[_ngrams("x.words", n) for n in lengths]))
        each = self.sequences.select("id", "dl", F.explode("texts").alias("x")).select("id", "dl", F.explode(grams).alias("term"), F.col("x.w").alias("w")).join(said, "term")
        return self.weigh(each.groupBy("id", "dl", "term").agg(F.sum("w").alias("tf")))


def _ngrams(c: str, n: int) -> Column:
    return F.expr(f"CASE WHEN size({c}) >= {n} THEN transform(sequence(1, size({c}) - {n - 1}), i -> array_join(slice({c}, i, {n}), ' ')) ELSE array() END")


def build(df: DataFrame, id_col: str, columns: dict[str, float]) -> LexicalIndex:
    """Index df's text columns, each with its weight, by Porter stems. Statistics cover all rows, whatever a search filters later.

    A posting holds its final share of the score, so that a query only adds up.
    Null texts count as empty; repeated ids must be removed before.
    """
    texts = F.array(*[F.struct(F.coalesce(_stemmed(F.col(c)), F.array().cast("array<string>")).alias("words"), F.lit(float(w)).alias("w")) for c, w in columns.items()])
    docs = materialize(df.select(F.col(id_col).alias("id"), texts.alias("texts")).withColumn("dl", F.aggregate("texts", F.lit(0), lambda a, x: a + F.size(x["words"]))), "sequences")
    stats = docs.select(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()  # one row
    index = LexicalIndex(None, docs, stats["n"], stats["avgdl"] or 1.0)
    each = docs.select("id", "dl", F.explode("texts").alias("x")).select("id", "dl", F.explode("x.words").alias("term"), F.col("x.w").alias("w"))
    index.postings = materialize(index.weigh(each.groupBy("id", "dl", "term").agg(F.sum("w").alias("tf"))), "postings")
    return index


def scores(index: LexicalIndex, queries: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(qid, id, bm25) of all matches for queries(qid, q), or of the ids in ``only``. Scores are rounded to nine places, for ties."""
    asked = materialize(query_terms(queries), "asked")
    phrases = index.phrases(asked)
    found = index.postings if phrases is None else index.postings.unionByName(phrases)
    found = found if only is None else found.join(only.select("id"), "id", "left_semi")
    return asked.select("qid", F.explode("terms").alias("term")).join(found, "term").groupBy("qid", "id").agg(F.round(F.sum("weight"), 9).alias("bm25"))


def top(scored: DataFrame, k: int, by: str = "bm25") -> DataFrame:
    """(qid, id, by, rank), rank from 0, the k best of each query; ties to the smaller id."""
    w = Window.partitionBy("qid").orderBy(F.desc(by), "id")
    return scored.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def best(index: LexicalIndex, queries: DataFrame, pools: DataFrame, keep: dict[int, int]) -> DataFrame:
    """(qid, pool, id, bm25, rank), rank from 0: for queries(qid, q) the keep[pool] best matches among the ids of each pool, from pools(id, pool).

    Each partition of the documents scores a block of queries at once and passes on no more than each query can keep, so what is
    shuffled is bounded by queries x keep x partitions, however common a term is. Ties go to the smaller id.
    """
    spark = queries.sparkSession
    asked = materialize(query_terms(queries), "asked")
    docs = index.documents.join(pools, "id")
    if (phrases := index.phrases(asked)) is not None:
        more = phrases.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("p"))
        both = lambda c, f: F.when(F.col("p").isNull(), F.col(c)).otherwise(F.concat(c, F.col(f"p.{f}"))).alias(c)
        docs = docs.join(more, "id", "left").select("id", "pool", both("terms", "term"), both("weights", "weight"))
    out = spark.createDataFrame([], "qid bigint, pool int, id bigint, bm25 double")
    for block in query_blocks(asked, BLOCK_QUERIES):
        out = out.unionByName(docs.mapInArrow(_scorer(spark.sparkContext.broadcast(_grouped(block)), keep), "qid bigint, pool int, id bigint, bm25 double"))  # at most BLOCK_QUERIES queries
    w = Window.partitionBy("qid", "pool").orderBy(F.desc("bm25"), "id")
    most = F.create_map(*[F.lit(x) for kv in keep.items() for x in kv])
    return out.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < most[F.col("pool")])


def query_blocks(queries: DataFrame, size: int) -> Iterator[pa.Table]:
    """The queries in tables of about ``size`` rows, one at a time on the driver: the parts of a hash of qid."""
    held = materialize(queries, "queries")
    parts = -(-held.count() // size)
    for part in range(parts):
        yield held.where(F.pmod(F.xxhash64("qid"), F.lit(parts)) == part).toArrow() if parts > 1 else held.toArrow()


def _grouped(block: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(qids, their distinct terms, the terms' numbers query by query, where each query begins)."""
    lists = block.column("terms").combine_chunks()
    coded = pc.dictionary_encode(lists.flatten())
    n = lists.value_lengths().to_numpy(zero_copy_only=False)
    return block.column("qid").to_numpy(), coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), np.append(0, np.cumsum(n))


def _scorer(handle, keep: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, vocabulary, wanted, begin = handle.value

        def score(t: pa.Table) -> pa.RecordBatch:
            ids, pool = t.column("id").to_numpy(), t.column("pool").to_numpy()
            lists = t.column("terms").combine_chunks()
            doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
            term = pc.index_in(lists.flatten(), value_set=vocabulary)
            hit = pc.is_valid(term).to_numpy(zero_copy_only=False)
            term = term.drop_null().to_numpy()
            doc, weight = doc[hit], t.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False)[hit]
            order = np.lexsort((doc, term))
            doc, weight = doc[order], weight[order]
            at = np.searchsorted(term[order], np.arange(len(vocabulary) + 1))
            found: list[tuple] = []
            for q in range(len(qids)):
                mine = wanted[begin[q] : begin[q + 1]]
                d = np.concatenate([doc[at[x] : at[x + 1]] for x in mine])
                if not len(d):
                    continue
                s = np.bincount(d, np.concatenate([weight[at[x] : at[x + 1]] for x in mine]), len(ids))
                d = np.flatnonzero(s)
                s = np.round(s[d], 9)
                for p, k in keep.items():
                    own = np.flatnonzero(pool[d] == p)
                    if len(own) > k:  # equals of the last are kept until ids decide
                        own = own[s[own] >= np.partition(s[own], len(own) - k)[len(own) - k]]
                        own = own[np.lexsort((ids[d[own]], -s[own]))[:k]]
                    found.append((q, p, d[own], s[own]))
            n = [len(x[2]) for x in found]
            cat = lambda i, kind: np.concatenate([x[i] for x in found]) if found else np.zeros(0, kind)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(qids[[x[0] for x in found]], n) if found else np.zeros(0, "int64")), pa.array(np.repeat([x[1] for x in found], n).astype("int32")), pa.array(ids[cat(2, "int64")]), pa.array(cat(3, "float64"))],
                names=["qid", "pool", "id", "bm25"],
            )

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK_DOCUMENTS:
                yield score(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield score(pa.Table.from_batches(held))

    return run
