"""Bi-temporal predicates and supersession chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoweave.session import materialize


def live(facts: DataFrame) -> DataFrame:
    return facts.where("superseded_at IS NULL")


def dead(facts: DataFrame) -> DataFrame:
    return facts.where("superseded_at IS NOT NULL")


def as_of(facts: DataFrame, t: float) -> DataFrame:
    """Facts visible at world time t: valid by then, and not replaced by one valid by then. A dangling link hides a fact."""
    s = facts.select(F.col("id").alias("__sid"), F.col("valid_from").alias("__svf"))
    joined = facts.where(F.col("valid_from") <= t).join(s, F.col("superseded_by") == F.col("__sid"), "left")
    return joined.where(F.col("superseded_by").isNull() | (F.col("__svf") > t)).drop("__sid", "__svf")


def supersession_pairs(facts: DataFrame, min_gap: float | None = None) -> DataFrame:
    """(old_id, new_id, old_valid_from, new_valid_from); with min_gap only those that far apart."""
    n = facts.select(F.col("id").alias("new_id"), F.col("valid_from").alias("new_valid_from"))
    pairs = facts.select(F.col("id").alias("old_id"), F.col("superseded_by").alias("new_id"), F.col("valid_from").alias("old_valid_from")).join(n, "new_id")
    pairs = pairs.select("old_id", "new_id", "old_valid_from", "new_valid_from")
    return pairs if min_gap is None else pairs.where(F.col("new_valid_from") > F.col("old_valid_from") + min_gap)


def chain_heads(facts: DataFrame, hops: int = 20) -> DataFrame:
    """(id, head): where at most ``hops`` superseded_by links lead from each fact, links counting from closed facts only.

    Doubling joins: jumps of 1, 2, 4, ... links, those whose bit is set in ``hops`` being taken.
    A closed fact without a link is its own head; a link to a fact that doesn't exist ends there.
    """
    step = facts.select("id", F.when(F.col("superseded_at").isNotNull(), F.col("superseded_by")).alias("n")).select("id", F.coalesce("n", "id").alias("to"))
    at = step.select("id", F.col("id").alias("head"))
    n = hops
    while n:
        if n & 1:
            j = step.select(F.col("id").alias("head"), "to")
            at = materialize(at.join(j, "head", "left").select("id", F.coalesce("to", "head").alias("head")), "heads")
        n >>= 1
        if n:
            j = step.select(F.col("id").alias("to"), F.col("to").alias("then"))
            step = materialize(step.join(j, "to", "left").select("id", F.coalesce("then", "to").alias("to")), "jumps")
    return at
