"""The ingest cycle: a batch of pieces becomes chunks, facts, entities, links, co-mentions, closures, edges and offsets, published as one new version of all tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import ingest, lexical, search, upsert
from chronoweave.protocols import Extractor, Judge, extract_facts, gate, judge_pairs
from chronoweave.session import materialize, numbered
from chronoweave.sources import snapshot

FACT = "id bigint, statement string, kind string, repo string, entities array<string>, files array<string>, confidence double, mass double, recorded_at double, valid_from double, superseded_at double, superseded_by bigint, src_session string, corroborations int, evidence string, stmt_hash string"
TABLES = {
    "facts": FACT,
    "entities": "id bigint, name string, display string, etype string, vkey string, seen_count bigint, last_seen double",
    "aliases": "id bigint, entity_id bigint, alias string, valid_from double, valid_to double, recorded_at double, confidence double",
    "links": "fact_id bigint, entity_id bigint",
    "co_mentions": "a bigint, b bigint, count bigint, last_seen double",
    "edges": "src bigint, dst bigint, edge_type string, recorded_at double",
    "offsets": "src_session string, end_offset bigint, last_seen double",
}
WAITING = "arrived bigint, src_session string, chunk_no int, text string, repo string, t double"


@dataclass
class Cycle:
    """State under ``root`` as published versions; ``apply`` is a foreachBatch function, repeatable for a batch id.

    Chunks beyond ``max_chunks`` are published as ``waiting`` and come first in the next batch; a batch without pieces takes of them alone.
    """

    spark: SparkSession
    root: str
    extractor: Extractor
    judge: Judge
    least_margin: float = 0.2
    chunk_bytes: int = ingest.CHUNK_BYTES
    overlap_bytes: int = ingest.OVERLAP_BYTES
    max_chunks: int | None = None
    keep: int = 7

    def table(self, name: str) -> DataFrame:
        """The newest version of one of TABLES."""
        done = snapshot.versions(self.spark, self.root)
        if not done or not snapshot.has(self.spark, self.root, done[-1], name):
            return self.spark.createDataFrame([], TABLES[name])
        return snapshot.latest(self.spark, self.root, name)

    def facts(self) -> DataFrame:
        return self.table("facts")

    def waiting(self) -> DataFrame:
        """The chunks left over by the batches so far."""
        done = snapshot.versions(self.spark, self.root)
        if not done or not snapshot.has(self.spark, self.root, done[-1], "waiting"):
            return self.spark.createDataFrame([], WAITING)
        return snapshot.latest(self.spark, self.root, "waiting")

    def apply(self, pieces: DataFrame, batch_id: int) -> None:
        """pieces(src_session, line_offset, piece, repo, t). A version that exists is the sign that the batch is done."""
        version = f"{batch_id:012d}"
        if version in snapshot.versions(self.spark, self.root):
            return
        old = self.facts()
        about = pieces.groupBy("src_session").agg(F.max("repo").alias("repo"), F.max("t").alias("t"))
        cut = ingest.chunks(pieces, self.chunk_bytes, self.overlap_bytes).join(about, "src_session").withColumn("arrived", F.lit(batch_id).cast("bigint"))
        names = [c.split()[0] for c in WAITING.split(", ")]
        # Numbered by arrival: the number tells chunks of one session in different batches apart.
        queue = self.waiting().select(*names).unionByName(cut.select(*names))
        queue = materialize(queue, "queue")
        keys = ["arrived", "src_session", "chunk_no"]
        queue = numbered(queue, keys, "place")
        taken = queue if self.max_chunks is None else queue.where(F.col("place") <= self.max_chunks)
        left = queue.select(*names).limit(0) if self.max_chunks is None else queue.where(F.col("place") > self.max_chunks).select(*names)
        now = max((x for x in (about.agg(F.max("t")).first()[0], taken.agg(F.max("t")).first()[0]) if x is not None), default=0.0)
        said = extract_facts(taken.select("src_session", F.col("place").alias("chunk_no"), "repo", "text"), self.extractor)
        clean = materialize(S.clean_fact(said).join(taken.select(F.col("place").alias("chunk_no"), "t"), "chunk_no"), "extracted")
        # The order of a batch is total: time, session, chunk, fact; numbers follow the facts known so far.
        top = old.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        ranked = numbered(clean, ["t", "src_session", "chunk_no", "fact_no"], "pos", top + 1)
        batch = ranked.withColumns({"mass": F.lit(1.0), "recorded_at": F.col("t"), "valid_from": F.col("t"), "stmt_hash": S.statement_hash(F.col("statement"))})
        everything, fresh = upsert.facts(old, materialize(batch, "ranked"))
        everything = materialize(everything, "everything")
        graph = upsert.links(fresh, self.table("entities"), self.table("aliases"), self.table("links"), self.table("co_mentions"), float(now))
        closed, edges = upsert.closures(everything, self.table("edges"), self._verdicts(old, everything, fresh), float(now))
        read = pieces.groupBy("src_session").agg(F.max("line_offset").alias("end_offset"), F.max("t").alias("last_seen"))
        offsets = ingest.keyed_merge(self.table("offsets"), read, ["src_session"], new_wins=True)
        tables = {"facts": closed, "entities": graph["entities"], "aliases": self.table("aliases"), "links": graph["links"], "co_mentions": graph["edges"], "edges": edges, "offsets": offsets, "waiting": left}
        snapshot.publish(tables, self.root, version)
        snapshot.retain(self.spark, self.root, self.keep)

    def _verdicts(self, old: DataFrame, everything: DataFrame, fresh: DataFrame) -> DataFrame:
        """What the batch's facts replace among those known before it."""
        names = everything.select(F.col("id").alias("fact_id"), F.explode("entities").alias("entity_id"))
        index = lexical.build(everything, "id", {"statement": 1.0})
        new = fresh.select(F.col("id").alias("qid"), F.col("statement").alias("q"), "repo", "kind", F.col("entities").alias("entity_ids"))
        pairs = search.supersede_candidates(new, old, names, index).select(F.col("id").alias("old_id"), F.col("qid").alias("new_id"))
        side = lambda p: everything.select(F.col("id").alias(f"{p}_id"), S.prompt_side(F.col("valid_from"), F.col("evidence"), F.col("kind"), F.col("statement")).alias(f"{p}_side"))
        judged = gate(judge_pairs(pairs.join(side("old"), "old_id").join(side("new"), "new_id"), self.judge), self.least_margin)
        return judged.select(F.col("old_id").alias("old"), F.col("new_id").alias("new"), "verdict")
