"""Metric series, latencies, calibration and judge statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.session import materialize


def series(obs: DataFrame, metric: str, entity: int | None = None, entities: DataFrame | None = None) -> DataFrame:
    """Observations of one metric (and entity) in order of time; with entities also their display names, empty where there is none."""
    rows = obs.where(F.col("metric") == S.snake_name(F.lit(metric)))
    rows = (rows if entity is None else rows.where(F.col("entity_id") == entity)).select("id", "entity_id", "occurred_at", "value")
    if entities is not None:
        rows = rows.join(entities.select(F.col("id").alias("entity_id"), "display"), "entity_id", "left").withColumn("display", F.coalesce("display", F.lit("")))
    return rows.orderBy("occurred_at", "id")


def metric_list(metrics: DataFrame, obs: DataFrame, k: int = 40) -> DataFrame:
    """(metric, observations, last): metrics with most observations first, those without any included."""
    n = obs.groupBy("metric").agg(F.count("*").alias("observations"), F.max("occurred_at").alias("last"))
    return metrics.select("metric").distinct().join(n, "metric", "left").withColumn("observations", F.coalesce("observations", F.lit(0))).orderBy(F.desc("observations"), "metric").limit(k)


def latency(samples: DataFrame, ring: int = 2048) -> DataFrame:
    """p50, p95 and maximum over the newest ``ring`` values of each group (id orders them): the value at position int(p * (n - 1))."""
    w = Window.partitionBy("route").orderBy(F.desc("id"))
    newest = samples.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= ring)
    s = newest.groupBy("route").agg(F.sort_array(F.collect_list("value")).alias("v"))  # at most ``ring`` values
    at = lambda p: F.get("v", F.floor(F.lit(p) * (F.size("v") - 1)).cast("int"))
    return s.select("route", F.size("v").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), F.array_max("v").alias("max"))


def upper_median(rows: DataFrame, group: str, value: str) -> DataFrame:
    """The element at n / 2 of each group's sorted values: equal values are counted first, then value ranges of a group, so that no group is gathered in a task."""
    counted = materialize(rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c")), "values")
    ends = counted.groupBy(group).agg(F.sum("c").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024), F.lit(1023))).otherwise(0).cast("int")
    placed = counted.join(ends, group).withColumn("b", bucket)
    sizes = placed.groupBy(group, "n", "b").agg(F.sum("c").alias("c"))  # at most 1,024 rows a group
    upto = sizes.withColumn("upto", F.sum("c").over(Window.partitionBy(group).orderBy("b")))
    mid = F.floor(F.col("n") / 2)
    at = upto.where((F.col("upto") > mid) & (F.col("upto") - F.col("c") <= mid)).select(group, "b", (mid - F.col("upto") + F.col("c")).alias("rest"))
    inside = placed.join(at, [group, "b"]).withColumn("to", F.sum("c").over(Window.partitionBy(group).orderBy(value)))
    return inside.where((F.col("to") > F.col("rest")) & (F.col("to") - F.col("c") <= F.col("rest"))).select(group, F.col(value).alias("upper_median"))


def agreement_by_margin(log: DataFrame) -> DataFrame:
    """Agreement of two judges by margin bucket; rows the first judge didn't see count as active."""
    bucket = F.when(F.col("local_margin") < 0.25, "0.00-0.25").when(F.col("local_margin") < 0.5, "0.25-0.50").when(F.col("local_margin") < 0.75, "0.50-0.75").otherwise("0.75-1.00")
    seen = F.col("llm_verdict") != ""
    return log.groupBy(bucket.alias("bucket")).agg(
        F.count_if(seen).alias("n"), F.count_if(seen & (F.col("llm_verdict") == F.col("local_verdict"))).alias("agree"), F.count_if(~seen).alias("active"),
        F.round(F.count_if(seen & (F.col("llm_verdict") == F.col("local_verdict"))) / F.greatest(F.count_if(seen), F.lit(1)), 6).alias("rate"),
    )


def class_quality(log: DataFrame) -> DataFrame:
    """Precision and recall of the second judge for each verdict of the first."""
    pairs = log.where("llm_verdict <> ''")
    truth = pairs.select(F.col("llm_verdict").alias("verdict"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("llm_verdict") == F.col("local_verdict")).cast("int").alias("tp"))
    said = pairs.select(F.col("local_verdict").alias("verdict"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("tp"))
    g = truth.unionByName(said).groupBy("verdict").agg(F.sum("t").alias("truth"), F.sum("p").alias("said"), F.sum("tp").alias("hit"))
    one = F.lit(1)
    return g.select("verdict", "truth", "said", F.round(F.col("hit") / F.greatest("said", one), 6).alias("precision"), F.round(F.col("hit") / F.greatest("truth", one), 6).alias("recall"))


def calibration(rows: DataFrame) -> DataFrame:
    """(bucket, n, mean_confidence, hit_rate) for rows(confidence, hit): fifths of confidence."""
    b = F.least(F.floor(F.col("confidence") * 5), F.lit(4)).cast("int")
    return rows.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"))


def threshold_sweep(rows: DataFrame) -> DataFrame:
    """(threshold, answered, right, wrong) for thresholds 0.10 to 0.90 by 0.05: one pass over the rows, one count for each threshold."""
    steps = list(range(10, 91, 5))
    counts = rows.agg(*[
        F.struct(F.lit(s / 100).alias("threshold"), F.count_if(F.col("confidence") >= s / 100).alias("answered"), F.count_if((F.col("confidence") >= s / 100) & F.col("hit")).alias("right"),
                 F.count_if((F.col("confidence") >= s / 100) & ~F.col("hit")).alias("wrong")).alias(f"s{s}") for s in steps])
    return counts.select(F.inline(F.array(*[f"s{s}" for s in steps])))


def metric_counts(metrics: DataFrame, new: DataFrame) -> DataFrame:
    """(metric, seen_count) after new(metric): every mention counts one, unknown metrics are added."""
    said = new.where("metric <> ''").groupBy(S.snake_name(F.col("metric")).alias("metric")).agg(F.count("*").alias("seen_count"))
    return metrics.select("metric", "seen_count").unionByName(said).groupBy("metric").agg(F.sum("seen_count").alias("seen_count"))


def store_observations(obs: DataFrame, new: DataFrame) -> DataFrame:
    """obs after new(metric, entity_id, value, day, valid_from): snake-case names, the day said or else the fact's time; equal rows count once."""
    rows = new.where("metric <> '' AND value IS NOT NULL").select(S.snake_name(F.col("metric")).alias("metric"), "entity_id", "value", S.observation_time(F.col("day"), F.col("valid_from")).alias("occurred_at"))
    return obs.select("metric", "entity_id", "value", "occurred_at").unionByName(rows).distinct()


def answer_summary(rows: DataFrame) -> DataFrame:
    """By split of rows(split, answerable, hit, abstained): answered right, confidently wrong, abstained rightly and needlessly."""
    ok = F.col("answerable")
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.count_if(ok & F.col("hit")).alias("hits"), F.count_if(ok & ~F.col("hit") & ~F.col("abstained")).alias("wrong"), F.count_if(~ok & ~F.col("abstained")).alias("confidently_wrong"),
        F.count_if(~ok & F.col("abstained")).alias("rightly_abstained"), F.count_if(ok & F.col("abstained")).alias("needlessly_abstained"),
    )


def recall_at(results: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(queries, recall, hit_rate) of results(qid, id, rank) for relevant(qid, id), over all queries with relevant ids."""
    found = relevant.join(results.where(F.col("rank") <= k).select("qid", "id", F.lit(1).alias("got")).distinct(), ["qid", "id"], "left")
    per = found.groupBy("qid").agg(F.avg(F.coalesce("got", F.lit(0))).alias("r"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"))


def recall_of(hits: DataFrame, relevant: DataFrame) -> DataFrame:
    """recall_at where the relevant ids of a query are too many to list: from hits(qid, id), the relevant ones among the first k, and relevant(qid, n), how many there are."""
    per = relevant.join(hits.distinct().groupBy("qid").agg(F.count("*").alias("h")), "qid", "left").select((F.coalesce("h", F.lit(0)) / F.col("n")).alias("r"))
    return per.agg(F.count("*").alias("queries"), F.round(F.avg("r"), 6).alias("recall"), F.round(F.avg(F.when(F.col("r") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"))


def first_appearance(seen: DataFrame, cap: int = 15) -> DataFrame:
    """(qid, id, score, pos): each fact a question met once, the best first, equals by first appearance, at most cap; from seen(qid, pos, id, score)."""
    once = seen.groupBy("qid", "id").agg(F.max("score").alias("score"), F.min("pos").alias("pos"))
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "pos")
    return once.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= cap).drop("rn")
