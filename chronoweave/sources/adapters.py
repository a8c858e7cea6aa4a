"""Frames of the fact graph from the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.sources.tables import table

#: The present of every tested query; never the clock.
NOW = 1_787_600_000.0
AS_OF = 1_765_000_000.0


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Each fact once."""
    return table(spark, d, "facts").dropDuplicates(["id"])


def fact_entities(facts: DataFrame, entities: DataFrame) -> DataFrame:
    """(fact_id, entity_id), distinct: names of facts that are known entities."""
    said = facts.select(F.col("id").alias("fact_id"), F.explode(F.array_distinct(F.transform("entities", S.canonical_name))).alias("name"))
    return said.join(entities.select(F.col("id").alias("entity_id"), S.canonical_name(F.col("name")).alias("name")), "name").select("fact_id", "entity_id").distinct()


def entity_edges(links: DataFrame, facts: DataFrame) -> DataFrame:
    """(a, b, count, last_seen), a < b: how many facts mention both. Pairs arise within one fact, whose entities are few."""
    per = links.groupBy("fact_id").agg(F.sort_array(F.collect_set("entity_id")).alias("es")).join(facts.select(F.col("id").alias("fact_id"), "valid_from"), "fact_id")
    pairs = per.select(F.explode(F.expr("flatten(transform(es, (x, i) -> transform(slice(es, i + 2, size(es)), y -> struct(x AS a, y AS b))))")).alias("p"), "valid_from")
    return pairs.groupBy("p.a", "p.b").agg(F.count("*").alias("count"), F.max("valid_from").alias("last_seen"))


def triples(spark: SparkSession, d: str) -> DataFrame:
    """Typed relations of parts to suppliers."""
    return table(spark, d, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("subject_id"), F.concat("l_returnflag", "l_linestatus").alias("predicate"),
        F.col("l_suppkey").alias("object_id"),
    )


def observations(spark: SparkSession, d: str) -> DataFrame:
    """Metric observations: (id, metric, entity_id, value, occurred_at)."""
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("metric"), F.col("user_id").alias("entity_id"), "value",
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("occurred_at"),
    )


def judge_log(facts: DataFrame) -> DataFrame:
    """Verdicts of two judges on closed facts: (old_id, new_id, llm_verdict, local_verdict, local_margin)."""
    names = F.array(F.lit("supersedes"), F.lit("contradicts"), F.lit("unrelated"))
    llm = F.when(F.col("id") % 11 == 0, "").otherwise(F.get(names, (F.col("id") % 3).cast("int")))
    local = F.get(names, ((F.col("id") + F.when(F.col("id") % 5 == 0, 1).otherwise(0)) % 3).cast("int"))
    return facts.where("superseded_by IS NOT NULL").select(F.col("id").alias("old_id"), F.col("superseded_by").alias("new_id"), llm.alias("llm_verdict"), local.alias("local_verdict"), (F.col("id") % 100 / 100.0).alias("local_margin"))


def traces(spark: SparkSession, d: str) -> DataFrame:
    """A query log: (id, ts, kind, q, results), results as JSON with the cited fact ids."""
    lk = table(spark, d, "lookups").dropDuplicates(["lookup_id"])
    cited = F.expr("concat('{\"cited\":[', cast(1000 + lookup_id AS string), ',', cast(1001 + lookup_id * 3 AS string), ']}')")
    return lk.select(F.col("lookup_id").alias("id"), F.col("asked_at").alias("ts"), F.when(F.col("lookup_id") % 4 == 0, "ask").otherwise("query").alias("kind"), F.concat_ws(" ", F.lit("what is the"), "kind", F.lit("of"), "entity", F.lit("in"), "repo").alias("q"), cited.alias("results"))
