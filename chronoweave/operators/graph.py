"""Breadth-first traversal over typed relations and co-mentions, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.session import materialize

OUT, IN, CO = 0, 1, 2


def link_stream(triples: DataFrame, co: DataFrame) -> DataFrame:
    """(id, other, pri, predicate, count): all ways from a node, typed out, typed in, then co-mentions."""
    t = triples.where("object_id IS NOT NULL").select("subject_id", "predicate", "object_id").distinct()
    zero = F.lit(0).cast("bigint").alias("count")
    return (
        t.select(F.col("subject_id").alias("id"), F.col("object_id").alias("other"), F.lit(OUT).alias("pri"), "predicate", zero)
        .unionByName(t.select(F.col("object_id").alias("id"), F.col("subject_id").alias("other"), F.lit(IN).alias("pri"), "predicate", zero))
        .unionByName(co.select("id", "other", F.lit(CO).alias("pri"), F.lit("co-mentioned").alias("predicate"), F.col("count").cast("bigint")))
    )


def traverse(start: int, links: DataFrame, hops: int = 2, per_node: int = 20, max_links: int = 200) -> DataFrame:
    """(link_no, level, id, other, pri, predicate): the links a first-in-first-out search follows from ``start``.

    Of each node the first per_node links count, by (pri, count descending, predicate,
    other); at most max_links in all. A co-mention of a node already seen is skipped, a
    typed link to one is kept; a node is expanded once, in the order of its first link.
    The frontier is bounded by max_links, so a level is one join and one small sort.
    """
    spark = links.sparkSession
    w = Window.partitionBy("id").orderBy("pri", F.desc("count"), "predicate", "other")
    frontier = spark.createDataFrame([(start, 0)], "id bigint, visit int")
    seen = {start}
    out: list[tuple] = []
    for level in range(1, hops + 1):
        rows = links.join(F.broadcast(frontier), "id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_node)
        # At most max_links nodes with per_node links each come to the driver.
        ordered = rows.orderBy("visit", "n").select("id", "other", "pri", "predicate").collect()
        coming: list[int] = []
        for r in ordered:
            if len(out) >= max_links:
                break
            if r["pri"] == CO and r["other"] in seen:
                continue
            out.append((len(out) + 1, level, r["id"], r["other"], r["pri"], r["predicate"]))
            if r["other"] not in seen:
                seen.add(r["other"])
                coming.append(r["other"])
        if not coming or len(out) >= max_links:
            break
        frontier = spark.createDataFrame([(x, i) for i, x in enumerate(coming)], "id bigint, visit int")
    return spark.createDataFrame(out, "link_no int, level int, id bigint, other bigint, pri int, predicate string")


def reachable(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(root, id, hop): for many starts at once, the nodes within so many undirected hops and the fewest hops to each."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("next")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("next"))).distinct()
    found = materialize(start.select(F.col("id").alias("root"), "id", F.lit(0).alias("hop")), "reach0")
    frontier = found
    for h in range(1, hops + 1):
        step = frontier.join(both, "id").select("root", F.col("next").alias("id")).distinct().join(found.select("root", "id"), ["root", "id"], "left_anti")
        frontier = materialize(step.withColumn("hop", F.lit(h)), f"reach{h}")
        found = found.unionByName(frontier)
    return found


def picture(entities: DataFrame, edges: DataFrame, k: int = 150) -> tuple[DataFrame, DataFrame]:
    """(nodes with degree, edges) induced by the k most seen entities."""
    top = materialize(entities.orderBy(F.desc("seen_count"), "id").limit(k).select("id", "name", "seen_count"), "picture")
    inner = edges.join(top.select(F.col("id").alias("a")), "a", "left_semi").join(top.select(F.col("id").alias("b")), "b", "left_semi")
    degree = inner.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return top.join(degree, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))), inner


def store_triples(triples: DataFrame, new: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(triples, predicate counts) after new(subject_id, predicate, object_id, object_literal): names are normalised, led to their
    canonical predicate by aliases(alias, predicate), and a triple that exists isn't stored again but counts."""
    name = F.replace(F.trim(F.lower("predicate")), F.lit(" "), F.lit("_"))
    known = aliases.select(F.col("alias").alias("predicate"), F.col("predicate").alias("__p")).distinct()
    routed = new.withColumn("predicate", name).where("subject_id IS NOT NULL AND predicate <> ''").join(known, "predicate", "left").withColumn("predicate", F.coalesce("__p", "predicate")).drop("__p")
    key = ["subject_id", "predicate", "object_id", "object_literal"]
    stored = triples.select(*key).unionByName(routed.select(*key)).distinct()
    return stored, triples.select("predicate").unionByName(routed.select("predicate")).groupBy("predicate").agg(F.count("*").alias("seen_count"))
