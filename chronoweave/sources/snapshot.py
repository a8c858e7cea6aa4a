"""Versioned parquet snapshots: atomic publication, retention, backups, fixtures, simple sinks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoweave.operators.hierarchy import hierarchy
from chronoweave.session import materialize


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[str]:
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory() and not s.getPath().getName().startswith("_"))


def publish(tables: dict[str, DataFrame], root: str, version: str) -> str:
    """Write all tables under a temporary name, then rename once: readers see the whole version or none of it."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/_new-{version}/{name}")
    fs, src = _fs(spark, f"{root}/_new-{version}")
    _, dst = _fs(spark, f"{root}/{version}")
    if fs.exists(dst) or not fs.rename(src, dst):
        fs.delete(src, True)
        raise FileExistsError(f"{root}/{version}")
    return f"{root}/{version}"


def latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{versions(spark, root)[-1]}/{name}")


def has(spark: SparkSession, root: str, version: str, name: str) -> bool:
    """Whether a version holds a table; those published before the table was thought of don't."""
    fs, p = _fs(spark, f"{root}/{version}/{name}")
    return fs.exists(p)


def retain(spark: SparkSession, root: str, keep: int = 7) -> list[str]:
    """Delete all but the newest versions; returns the deleted."""
    gone = versions(spark, root)[:-keep] if keep else versions(spark, root)
    for v in gone:
        fs, p = _fs(spark, f"{root}/{v}")
        fs.delete(p, True)
    return gone


def backup_if_due(tables: dict[str, DataFrame], root: str, now: dt.datetime, every: dt.timedelta = dt.timedelta(hours=24), keep: int = 7) -> str | None:
    """A backup named by its time, unless the last is younger than ``every``; the newest ``keep`` stay."""
    spark = next(iter(tables.values())).sparkSession
    old = versions(spark, root)
    if old and now - dt.datetime.strptime(old[-1], "%Y%m%dT%H%M%S") < every:
        return None
    path = publish(tables, root, now.strftime("%Y%m%dT%H%M%S"))
    retain(spark, root, keep)
    return path


def fixture(facts: DataFrame, edges: DataFrame, traces: DataFrame, per_repo: int = 50, chains: int = 100, seed: int = 7, **others: DataFrame) -> dict[str, DataFrame]:
    """A small closed copy: the best-supported facts of each repository, whole supersession chains in seeded order, what cited traces refer to, all that these lead to along
    superseded_by, and edges among them. Of others, frames with fact_id (links, vectors) are cut to these facts, ``entities`` to those linked, ``aliases`` to those entities."""
    w = Window.partitionBy(F.coalesce("repo", F.lit(""))).orderBy(F.desc("corroborations"), F.desc("recorded_at"), F.desc("id"))
    top = facts.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= per_repo).select("id")
    cited = traces.where(F.contains("results", F.lit('"cited"'))).select("id", F.explode(F.from_json("results", "cited array<bigint>")["cited"]).alias("fact"))
    tree = materialize(hierarchy(facts, "id", "superseded_by").select("node", "root", "path"), "chains")
    long = tree.groupBy("root").count().where("count > 1").orderBy(F.md5(F.concat_ws("-", F.col("root").cast("string"), F.lit(str(seed)))), "root").limit(chains).select("root")
    chosen = top.unionByName(cited.select(F.col("fact").alias("id"))).unionByName(tree.join(F.broadcast(long), "root", "left_semi").select(F.col("node").alias("id"))).distinct()
    ids = materialize(tree.join(chosen.withColumnRenamed("id", "node"), "node", "left_semi").select(F.explode("path").alias("id")).distinct(), "fixture")
    kept = facts.join(ids, "id", "left_semi")
    inner = edges.join(kept.select(F.col("id").alias("src")), "src", "left_semi").join(kept.select(F.col("id").alias("dst")), "dst", "left_semi")
    out = {"facts": kept, "edges": inner, "traces": traces.join(cited.select("id").distinct(), "id", "left_semi")}
    for name, df in others.items():
        if "fact_id" in df.columns:
            out[name] = df.join(ids.withColumnRenamed("id", "fact_id"), "fact_id", "left_semi")
    if "links" in out:
        linked = out["links"].select(F.col("entity_id")).distinct()
        if "entities" in others:
            out["entities"] = others["entities"].join(linked.withColumnRenamed("entity_id", "id"), "id", "left_semi")
        if "aliases" in others:
            out["aliases"] = others["aliases"].join(linked, "entity_id", "left_semi")
    return out


def write_probes(probes: DataFrame, path: str) -> None:
    """Probes as tab-separated text."""
    probes.select("q", "pattern", "miner", "as_of").write.mode("overwrite").option("sep", "\t").csv(path)


def dump_chunks(chunks: DataFrame, path: str, n: int, seed: int = 7, least_bytes: int = 2000) -> None:
    """n chunks of at least least_bytes in seeded order, as JSON lines."""
    big = chunks.where(F.octet_length("text") >= least_bytes)
    big.orderBy(F.md5(F.concat_ws("-", "path", F.lit(str(seed)))), "path", "end_offset").limit(n).write.mode("overwrite").json(path)
