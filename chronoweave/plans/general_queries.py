"""Queries of the general data problems (hierarchies, as-of attributes, orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators.asof_lookup import as_known_at
from chronoweave.operators.hierarchy import hierarchy, hierarchy_blocks, loops
from chronoweave.operators.orphans import orphan_report, orphans
from chronoweave.plans.core_queries import WALKS
from chronoweave.sources.tables import table


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(table(spark, d, "facts"), "id", "superseded_by")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Each superseded fact and the end of its path."""
    return _tree(spark, d).where("parent IS NOT NULL OR dangling").select(F.col("node").alias("fact_id"), F.col("root").alias("root_id"))


def p2_tree(spark: SparkSession, d: str) -> DataFrame:
    """Depth, path and descendants of every fact; a fact of very many descendants has them in several rows, by block."""
    tree = hierarchy_blocks(table(spark, d, "facts"), "id", "superseded_by")
    return tree.select("node", "root", "depth", F.concat_ws(">", F.col("path").cast("array<string>")).alias("path"), "n_descendants", F.concat_ws(",", F.col("descendants").cast("array<string>")).alias("descendants"), "block", "in_loop", "loop_reached", "dangling")


def p2_loops(spark: SparkSession, d: str) -> DataFrame:
    return loops(_tree(spark, d)).select("root", F.concat_ws(",", F.col("members").cast("array<string>")).alias("members"), "length")


def _known(spark: SparkSession, d: str) -> DataFrame:
    facts = table(spark, d, "facts").select("id", "repo", "kind", "entities", "valid_from", "recorded_at", "superseded_at")
    versions = facts.withColumn("entity", F.explode(F.array_distinct("entities"))).drop("entities")
    return as_known_at(table(spark, d, "lookups"), versions, "lookup_id", "asked_at", ["repo", "kind", "entity"], "id", ["repo", "kind", "entity"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Each lookup with the fact known when it was asked."""
    return _known(spark, d).where("version_id IS NOT NULL").select(F.col("event_id").alias("lookup_id"), F.col("version_id").alias("fact_id"))


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How many lookups had an answer when they were asked."""
    return _known(spark, d).agg(F.count("*").alias("lookups"), F.count("version_id").alias("answered"))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    facts, edges, aliases, entities = (table(spark, d, t) for t in ("facts", "edges", "entity_aliases", "entities"))
    month = F.substring(S.epoch_date(F.col("recorded_at")), 1, 7).alias("period")
    none = F.lit(None).cast("double")
    refs = (
        facts.select(F.lit("facts").alias("ref_table"), F.col("id").alias("row_id"), F.lit("facts").alias("target"), F.col("superseded_by").alias("ref_id"), F.col("superseded_at").alias("ref_time"), month)
        .unionByName(edges.select(F.lit("edges").alias("ref_table"), F.col("src").alias("row_id"), F.lit("facts").alias("target"), F.col("dst").alias("ref_id"), F.col("recorded_at").alias("ref_time"), month))
        .unionByName(aliases.select(F.lit("entity_aliases").alias("ref_table"), F.col("id").alias("row_id"), F.lit("entities").alias("target"), F.col("entity_id").alias("ref_id"), none.alias("ref_time"), month))
    )
    parents = facts.select(F.lit("facts").alias("target"), F.col("id").alias("key"), F.col("recorded_at").alias("available_at")).unionByName(
        entities.select(F.lit("entities").alias("target"), F.col("id").alias("key"), none.alias("available_at"))
    )
    return orphans(refs, parents)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """References without a target, or with one that came later."""
    return _orphans(spark, d).select("ref_table", "row_id", "ref_id", "period").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_tree, p2_loops, p3_found, p3_coverage, p5_found, p5_report)}

_FACTS = "SELECT DISTINCT id, superseded_by FROM facts"
_UP = f"""
WITH RECURSIVE n AS ({_FACTS}),
l AS (SELECT n.id, p.id AS parent, n.superseded_by IS NOT NULL AND p.id IS NULL AS dangling FROM n LEFT JOIN n p ON p.id = n.superseded_by),
step AS (
  SELECT id AS start, id AS node, 0 AS k FROM l
  UNION
  SELECT s.start, l.parent, 0 FROM step s JOIN l ON l.id = s.node WHERE l.parent IS NOT NULL
),
anc AS (SELECT DISTINCT start, node FROM step),
looped AS (SELECT DISTINCT s.start AS id FROM (SELECT l.id AS start, a.node FROM l JOIN anc a ON a.start = l.parent) s WHERE s.node = s.start),
roots AS (
  SELECT a.start AS id, coalesce(min(a.node) FILTER (WHERE g.id IS NOT NULL), min(a.node) FILTER (WHERE l.parent IS NULL)) AS root,
    count(g.id) > 0 AS loop_reached
  FROM anc a JOIN l ON l.id = a.node LEFT JOIN looped g ON g.id = a.node GROUP BY a.start
)"""

SQL = {
    "p2_found": _UP + " SELECT r.id AS fact_id, r.root AS root_id FROM roots r JOIN n ON n.id = r.id WHERE n.superseded_by IS NOT NULL",
    "p2_loops": _UP + """ SELECT r.root, string_agg(CAST(r.id AS VARCHAR), ',' ORDER BY r.id) AS members, count(*) AS length
FROM roots r JOIN looped g ON g.id = r.id GROUP BY r.root""",
    "p3_found": """
SELECT lookup_id, fact_id FROM (
  SELECT q.lookup_id, f.id AS fact_id, row_number() OVER (PARTITION BY q.lookup_id ORDER BY f.valid_from DESC, f.recorded_at DESC, f.id DESC) AS rn
  FROM (SELECT DISTINCT * FROM lookups) q JOIN (SELECT DISTINCT id, repo, kind, unnest(list_distinct(entities)) AS entity, valid_from, recorded_at, superseded_at FROM facts) f
    ON f.repo = q.repo AND f.kind = q.kind AND f.entity = q.entity
  WHERE f.recorded_at <= q.asked_at AND f.valid_from <= q.asked_at AND (f.superseded_at IS NULL OR f.superseded_at > q.asked_at)
) WHERE rn = 1""",
    "p5_found": """
WITH refs AS (
  SELECT 'facts' AS ref_table, id AS row_id, superseded_by AS ref_id, superseded_at AS ref_time, recorded_at FROM facts WHERE superseded_by IS NOT NULL
  UNION ALL SELECT 'edges', src, dst, recorded_at, recorded_at FROM edges WHERE dst IS NOT NULL
)
SELECT DISTINCT ref_table, row_id, ref_id, strftime(make_timestamp(CAST(r.recorded_at * 1000000 AS BIGINT)), '%Y-%m') AS period
FROM refs r LEFT JOIN (SELECT id, min(recorded_at) AS known FROM facts GROUP BY id) t ON t.id = r.ref_id
WHERE t.id IS NULL OR t.known > r.ref_time
UNION
SELECT 'entity_aliases', a.id, a.entity_id, strftime(make_timestamp(CAST(a.recorded_at * 1000000 AS BIGINT)), '%Y-%m')
FROM entity_aliases a LEFT JOIN entities e ON e.id = a.entity_id WHERE a.entity_id IS NOT NULL AND e.id IS NULL""",
}
SQL["p2_tree"] = f"""
WITH RECURSIVE {WALKS}, an AS (SELECT id, unnest(list_slice(path, 2, len(path))) AS a FROM td UNION SELECT id, unnest(ring) FROM td WHERE ring IS NOT NULL),
de AS (SELECT a AS id, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ds FROM an WHERE a <> id GROUP BY 1)
SELECT td.id AS node, root, CAST(depth AS INT) AS depth, array_to_string(list_reverse(list_slice(path, 1, depth + 1)), '>') AS path, coalesce(de.n, 0) AS n_descendants, coalesce(de.ds, '') AS descendants, 0 AS block,
  coalesce(list_contains(ring, td.id), false) AS in_loop, ring IS NOT NULL AS loop_reached, s.id IS NULL AND f.superseded_by IS NOT NULL AS dangling
FROM td LEFT JOIN de ON de.id = td.id JOIN (SELECT DISTINCT ON (id) id, superseded_by FROM facts) f ON f.id = td.id LEFT JOIN (SELECT DISTINCT id FROM facts) s ON s.id = f.superseded_by"""
SQL["p3_coverage"] = f"SELECT (SELECT count(DISTINCT lookup_id) FROM lookups) AS lookups, count(*) AS answered FROM ({SQL['p3_found']}) x"
SQL["p5_report"] = f"""
SELECT ref_table, period, reason, count(*) AS orphans, count(DISTINCT ref_id) AS keys FROM (
  SELECT x.*, CASE WHEN (ref_table = 'entity_aliases' AND e.id IS NULL) OR (ref_table <> 'entity_aliases' AND f.id IS NULL) THEN 'missing' ELSE 'later' END AS reason
  FROM ({SQL['p5_found']}) x LEFT JOIN (SELECT DISTINCT id FROM facts) f ON f.id = x.ref_id LEFT JOIN (SELECT DISTINCT id FROM entities) e ON e.id = x.ref_id
) GROUP BY ALL"""
SQL = {k: v for k, v in SQL.items() if v}
