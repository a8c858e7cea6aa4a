"""One object for the whole graph: each method is one plan over the tables, returning a DataFrame or JSON lines."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import entities as E
from chronoweave.operators import graph, lexical, metrics, search, temporal, topics, vector
from chronoweave.protocols import Reasoner, ask, ask_local
from chronoweave.session import materialize
from chronoweave.sources import adapters as A


@dataclass
class FactGraph:
    """The tables of a data directory as a queryable graph; ``now`` is the present of every answer."""

    spark: SparkSession
    sf_dir: str
    now: float = A.NOW

    @cached_property
    def facts(self) -> DataFrame:
        return materialize(A.facts(self.spark, self.sf_dir), "facts")

    @cached_property
    def links(self) -> DataFrame:
        return materialize(A.fact_entities(self.facts, self.table("entities")), "links")

    @cached_property
    def edges(self) -> DataFrame:
        return materialize(A.entity_edges(self.links, self.facts), "edges")

    @cached_property
    def index(self) -> lexical.LexicalIndex:
        return lexical.build(self.facts.select("id", "statement", F.array_join("entities", " ").alias("names")), "id", {"statement": 2.0, "names": 1.0})

    @cached_property
    def vectors(self) -> DataFrame:
        return materialize(vector.usable(self.table("fact_vecs")), "vectors")

    def table(self, name: str) -> DataFrame:
        return A.table(self.spark, self.sf_dir, name)

    def health(self) -> DataFrame:
        return self.facts.agg(F.count("*").alias("facts"), F.count_if(F.col("superseded_at").isNull()).alias("live"), F.max("recorded_at").alias("last"))

    def query(self, text: str, repo: str | None = None, k: int = 5, as_of: float | None = None, vec: list[float] | None = None) -> DataFrame:
        q = self.spark.createDataFrame([(0, text, repo, vec)], "qid bigint, q string, repo string, vec array<float>")
        q = q.withColumn("q", F.array_join(S.query_tokens(F.col("q")), " "))
        return search.hybrid_search(q, self.facts, self.table("edges"), self.index, self.vectors, self.now, k, as_of).orderBy("rank")

    def brief(self, repo: str | None = None, k: int = 40) -> DataFrame:
        return search.by_kind(search.brief(temporal.live(self.facts), self.now, k, repo))

    def entity(self, name: str, k: int = 10) -> dict[str, DataFrame]:
        """Facts and co-mentions of an entity given by name, alias or beginning."""
        who = E.resolve(self.spark.createDataFrame([(name,)], "name string"), self.table("entities"), self.table("entity_aliases"), prefix=True).select("entity_id")
        own = self.links.join(who, "entity_id", "left_semi")
        near = E.neighbours(self.edges).join(who.withColumnRenamed("entity_id", "id"), "id", "left_semi")
        return {
            "facts": E.entity_facts(own, self.facts, self.now, k).join(self.facts.select(F.col("id").alias("fact_id"), "statement"), "fact_id").orderBy("rank"),
            "co_mentions": near.orderBy(F.desc("count"), "other").limit(15),
            "seen": self.table("entities").join(who.withColumnRenamed("entity_id", "id"), "id", "left_semi").select("id", "name", "seen_count"),
        }

    def fact(self, fact_id: int) -> DataFrame:
        """A fact with what replaced it and what it replaced."""
        f = self.facts.where(F.col("id") == fact_id)
        old = self.facts.where(F.col("superseded_by") == fact_id).groupBy(F.col("superseded_by").alias("id")).agg(F.sort_array(F.collect_list("id")).alias("supersedes"))
        rows = search.fact_out(f, self.now).join(f.select("id", "superseded_by", "superseded_at", "evidence"), "id").join(old, "id", "left")
        return rows.withColumn("supersedes", F.coalesce("supersedes", F.array().cast("array<bigint>")))

    def graph(self, entity_id: int, hops: int = 2, limit: int = 200) -> DataFrame:
        return graph.traverse(entity_id, graph.link_stream(A.triples(self.spark, self.sf_dir), E.neighbours(self.edges)), hops, 20, limit)

    def metrics(self, name: str | None = None, entity: int | None = None) -> DataFrame:
        o = A.observations(self.spark, self.sf_dir)
        return metrics.metric_list(o.select("metric"), o) if name is None else metrics.series(o, name, entity)

    def narrative(self, repo: str) -> DataFrame:
        return topics.evidence(self.facts.where(F.col("repo") == repo))

    def tools(self, tops: list[float], seen: dict[int, tuple], k: int = 8) -> dict:
        """What a reasoner may call, each with one argument: search, entity, graph and metric. Best scores and facts met are collected."""

        def run(text: str, k: int = k) -> list[str]:
            hits = self.query(text, k=k).collect()
            tops.append(round(hits[0]["score"], 3) if hits else 0.0)
            seen.update({h["id"]: h for h in hits})
            return [f"[{h['id']}] {h['statement']}" for h in hits]

        def entity(name: str) -> list[str]:
            views = self.entity(name)
            facts = views["facts"].collect()
            seen.update({r["fact_id"]: r for r in facts})
            return [f"[{r['fact_id']}] {r['statement']}" for r in facts] + [f"mentioned with {r['other']} ({r['count']})" for r in views["co_mentions"].collect()]

        def relations(name: str) -> list[str]:
            who = E.resolve(self.spark.createDataFrame([(name,)], "name string"), self.table("entities"), self.table("entity_aliases"), prefix=True).first()
            if who is None:
                raise LookupError(f"{name} is unknown")
            return [f"{r['id']} {r['predicate']} {r['other']}" for r in self.graph(who["entity_id"]).collect()]

        def metric(name: str) -> list[str]:
            return [" ".join(map(str, r)) for r in self.metrics(name).limit(40).collect()]

        return {"search": run, "entity": entity, "graph": relations, "metric": metric}

    def ask(self, question: str, reasoner: Reasoner, local: bool = False) -> dict:
        """The reasoner's answer over the tools, with its confidence, abstaining below the threshold. ``local``: by one plan, widened if retrieval is weak."""
        tops: list[float] = []
        seen: dict[int, tuple] = {}
        tools = self.tools(tops, seen)
        if local:
            strength = lambda: sum(min(t / 0.03, 1.0) for t in tops) / len(tops) if tops else 0.0
            out = ask_local(question, reasoner, tools, strength, lambda q: tools["search"](q, 20))
        else:
            out = ask(question, reasoner, tools)
        row = self.spark.createDataFrame([(out["answer"], tops)], "answer string, tops array<double>")
        cited = [i for i in row.select(S.citations(F.col("answer"))).first()[0] if i in seen]
        rows = self.facts.where(F.col("id").isin(cited or [-1])).join(search.live_contradictions(self.facts, self.table("edges")), "id", "left")
        c = rows.agg(F.avg(0.5 * F.col("confidence") + 0.5 * S.evidence_tier(F.col("evidence"))).alias("tier"), F.avg(F.when(F.coalesce("n", F.lit(0)) == 0, 1.0).otherwise(0.0)).alias("agreement")).first()
        total = row.select(F.size(F.regexp_extract_all("answer", F.lit(r"\[(\d+)\]"), F.lit(1)))).first()[0]
        score = row.select(S.answer_confidence(F.lit(min(len(cited) / 3, 1.0)), F.lit(len(cited) / total if total else 0.0), F.lit(c["tier"] or 0.0), F.lit(c["agreement"] or 0.0), S.retrieval_strength(F.col("tops")), S.leads_with_doubt(F.col("answer")))).first()[0]
        answer = row.select(S.with_abstain(F.col("answer"), F.lit(score < ABSTAIN_BELOW))).first()[0]
        return out | {"answer": answer, "cited": cited, "confidence": round(score, 3), "abstained": score < ABSTAIN_BELOW}


ABSTAIN_BELOW = 0.45


def as_json(df: DataFrame) -> list[str]:
    """Rows as JSON, for frames bounded by their query."""
    return [r["j"] for r in df.select(F.to_json(F.struct(*df.columns)).alias("j")).collect()]
