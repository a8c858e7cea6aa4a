"""Mixing sources to target weights, with capped repetition.

Documents are counted by source and exact token length. What whole passes over
a source leave of its budget is a subset-sum problem over those counts: a
bounded-knapsack dynamic programme says how many documents of each length are
used once more, and seeded order says which.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import materialize

#: The split pattern of the byte-level vocabulary comes with the vocabulary's package.
DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"


@lru_cache(maxsize=2)
def _encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path if "/" in path else public_tokenizers.path(path), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, text: str = "text", tokenizer: str = DEFAULT_VOCABULARY, into: str = "n_tokens") -> DataFrame:
    """df with the exact number of tokens of its text; null and empty texts have 0."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoder(tokenizer).encode_ordinary
        for texts in batches:
            yield pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return df.withColumn(into, count(F.col(text)))


def unify_source(c):
    """One spelling of a source's name: lower case, inner blanks and dashes as underscores."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, seed: int = 0, exact_below: int = 32_768) -> np.ndarray:
    """How many items of each length to take so that their total is as near to budget as possible, never above it.

    The bulk is taken evenly over all lengths; the last part of the budget is
    filled by bounded knapsack (binary packs of each length, first pack that reaches a sum).
    """
    lengths, counts = np.asarray(lengths, "int64"), np.asarray(counts, "int64")
    take = np.zeros(len(lengths), "int64")
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not len(lengths):
        return take
    share = max(0.0, (budget - exact_below) / total)
    take = np.floor(counts * share).astype("int64")
    rest = budget - int((lengths * take).sum())
    order = np.random.default_rng(seed).permutation(len(lengths))
    for i in np.argsort(-lengths, kind="stable"):  # items longer than the exact part's range fill what they can, the longest first
        if lengths[i] <= exact_below // 2:
            break
        more = min(int(counts[i] - take[i]), rest // int(lengths[i]))
        take[i] += more
        rest -= more * int(lengths[i])
    for i in order:  # towards the range of the exact part
        if rest <= exact_below:
            break
        more = min(int(counts[i] - take[i]), max(0, (rest - exact_below // 2) // int(lengths[i])))
        take[i] += more
        rest -= more * int(lengths[i])
    size = int(min(rest, exact_below * 4))
    reached = np.zeros(size + 1, bool)
    reached[0] = True
    by = np.full(size + 1, -1, "int64")
    packs: list[tuple[int, int]] = []
    for i in order:
        left, k = int(min(counts[i] - take[i], size // lengths[i])), 1
        while left > 0 and not reached[size]:
            k = min(k, left)
            w = k * int(lengths[i])
            if w <= size:
                new = np.flatnonzero(reached[: size + 1 - w] & ~reached[w:]) + w
                reached[new] = True
                by[new] = len(packs)
                packs.append((int(i), k))
            left -= k
            k *= 2
        if reached[size]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, k = packs[by[at]]
        take[i] += k
        at -= k * int(lengths[i])
    return take


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, tokenizer: str = DEFAULT_VOCABULARY, salts: int = 32
) -> tuple[DataFrame, DataFrame]:
    """(chosen, report) for documents(doc_id, text, source) and targets(source, target_share, max_repeats).

    chosen has doc_id, source, n_tokens and uses (how often the document is in the
    mixture, max_repeats at most). report has a row for each target: target_share,
    fill_share (the share aimed at: targets of which there are documents, scaled to 1),
    tokens, actual_share, documents, uses, and sets_size, which marks the source whose scarcity set a default size. total_tokens defaults to the largest
    mixture in which every source with documents reaches its share; with a larger one
    sources at their cap fall short, as the report shows. A repeated doc_id counts once,
    documents without text, id or target aren't used, and rows of targets that
    agree but for spelling are added up. Empty tables give an empty mixture.
    """
    wanted = targets.where("source IS NOT NULL AND target_share > 0").groupBy(unify_source(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    goals = {r["source"]: (float(r["target_share"]), int(r["max_repeats"] or 1)) for r in wanted.collect()}  # a row a target
    spark = documents.sparkSession
    if not goals:
        none = spark.createDataFrame([], "doc_id bigint, source string, n_tokens bigint, uses int")
        return none, spark.createDataFrame([], "source string, target_share double, fill_share double, tokens bigint, actual_share double, documents bigint, uses bigint, sets_size boolean")
    own = documents.where(F.length("text") > 0).select("doc_id", unify_source(F.col("source")).alias("source"), "text").where(F.col("source").isin(*goals) & F.col("doc_id").isNotNull())
    counted = count_tokens(own, "text", tokenizer).drop("text").where("n_tokens > 0")
    counted = counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("x")).select("doc_id", "x.*")
    counted = counted.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(salts)).cast("int"))
    counted = materialize(counted, "tokens")
    histogram = counted.groupBy("source", "n_tokens", "salt").agg(F.count("*").alias("n"))
    totals = {r["source"]: int(r["t"]) for r in counted.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}  # a row a target
    shares = {s: goals[s][0] for s in totals}
    fill = {s: x / sum(shares.values()) for s, x in shares.items()}
    scarcest = min(sorted(totals), key=lambda s: totals[s] * goals[s][1] / fill[s], default=None) if total_tokens is None else None
    if total_tokens is None:
        total_tokens = int(min((totals[s] * goals[s][1] / fill[s] for s in totals), default=0))
    budgets = {s: min(int(round(fill[s] * total_tokens)), totals[s] * goals[s][1]) for s in totals}
    passes = {s: budgets[s] // totals[s] for s in totals}

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        source = pdf["source"].iloc[0]
        pdf = pdf.sort_values(["n_tokens", "salt"])
        by_length = pdf.groupby("n_tokens")["n"].sum()
        extra = budgets[source] - passes[source] * totals[source] if passes[source] < goals[source][1] else 0
        take = dict(zip(by_length.index, fit_budget(by_length.index.to_numpy(), by_length.to_numpy(), extra, seed)))
        before = pdf.groupby("n_tokens")["n"].cumsum() - pdf["n"]
        pdf["take"] = np.clip(pdf["n_tokens"].map(take) - before, 0, pdf["n"]).astype("int64")
        return pdf[["source", "n_tokens", "salt", "take"]]

    planned = histogram.groupBy("source").applyInPandas(plan, "source string, n_tokens bigint, salt int, take bigint")
    order = Window.partitionBy("source", "n_tokens", "salt").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    ranked = counted.join(planned, ["source", "n_tokens", "salt"]).withColumn("rn", F.row_number().over(order))
    base = F.create_map(*[F.lit(x) for s in passes for x in (s, int(passes[s]))]) if passes else F.create_map().cast("map<string,int>")
    uses = (base[F.col("source")] + F.when(F.col("rn") <= F.col("take"), 1).otherwise(0)).cast("int")
    chosen = materialize(ranked.select("doc_id", "source", "n_tokens", uses.alias("uses")).where("uses > 0"), "mix")
    reached = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("tokens"), F.count("*").alias("documents"), F.sum("uses").alias("uses"))
    aims = spark.createDataFrame([(s, float(g[0]), float(fill.get(s, 0.0)), s == scarcest) for s, g in sorted(goals.items())], "source string, target_share double, fill_share double, sets_size boolean")
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over a row a target
    report = aims.join(reached, "source", "left").withColumn("all", whole).select(
        "source", "target_share", "fill_share", F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)).alias("actual_share"),
        F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("uses", F.lit(0)).alias("uses"), "sets_size",
    )
    return chosen, report
