"""Seams for language models: protocols, and deterministic stand-ins for tests and offline use."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Judge(Protocol):
    def judge(self, old: list[str], new: list[str]) -> np.ndarray:
        """Logits of (supersedes, contradicts, unrelated) for each pair."""


class Extractor(Protocol):
    def extract(self, text: str, repo: str) -> list[dict]: ...


class Paraphraser(Protocol):
    def paraphrase(self, statement: str) -> list[str]: ...


class Reasoner(Protocol):
    def next_step(self, question: str, notes: list[str]) -> str:
        """A line ``tool(argument)``, or STOP."""

    def answer(self, question: str, notes: list[str]) -> str: ...


class HashEmbedder:
    """The unit sum of one seeded Gaussian vector a token."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), "float32")
        for i, t in enumerate(texts):
            for token in (t or "").lower().split():
                seed = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                out[i] += np.random.default_rng(seed).standard_normal(self.dim)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


class OverlapJudge:
    """More words in common speak for supersession, a negation on one side for contradiction."""

    def judge(self, old: list[str], new: list[str]) -> np.ndarray:
        out = []
        for a, b in zip(old, new):
            x, y = (set(t.rpartition("] ")[2].lower().split()) for t in (a, b))
            shared = len(x & y) / max(1, len(x | y))
            out.append([4 * shared, 2 * shared + 2 * (("not" in x) != ("not" in y)), 1.0])
        return np.array(out)


class LineExtractor:
    """Each line of a turn that ends in a full stop is an asserted fact."""

    def extract(self, text: str, repo: str) -> list[dict]:
        lines = [x.partition(": ")[2] or x for x in text.splitlines()]
        return [{"statement": x.strip(), "kind": "fact", "entities": [repo] if repo else [], "files": [], "confidence": 0.7, "evidence": "asserted"} for x in lines if x.strip().endswith(".")]


class EchoReasoner:
    """Searches the question once and answers with what was found, citing it."""

    def next_step(self, question: str, notes: list[str]) -> str:
        return "STOP" if notes else f"search({question})"

    def answer(self, question: str, notes: list[str]) -> str:
        return "\n".join(notes) or "unknown"


def embed_missing(facts: DataFrame, vectors: DataFrame, embedder: Embedder) -> DataFrame:
    """(fact_id, vec) for facts(id, statement) that have no vector yet."""
    todo = facts.select(F.col("id").alias("fact_id"), "statement").join(vectors.select("fact_id"), "fact_id", "left_anti")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"fact_id": b["fact_id"], "vec": list(embedder.embed(b["statement"].tolist()))})

    return todo.mapInPandas(run, "fact_id bigint, vec array<float>")


def judge_pairs(pairs: DataFrame, judge: Judge) -> DataFrame:
    """pairs(old_id, new_id, old_side, new_side) with verdict and margin (greatest minus second probability)."""
    names = ["supersedes", "contradicts", "unrelated"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            z = judge.judge(b["old_side"].tolist(), b["new_side"].tolist())
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            s = np.sort(p, axis=1)
            yield pd.DataFrame({"old_id": b["old_id"], "new_id": b["new_id"], "verdict": [names[i] for i in p.argmax(1)], "margin": s[:, -1] - s[:, -2]})

    return pairs.select("old_id", "new_id", "old_side", "new_side").mapInPandas(run, "old_id bigint, new_id bigint, verdict string, margin double")


def gate(shadow: DataFrame, least_margin: float) -> DataFrame:
    """Verdicts that the local judge may give alone: those of a margin of at least least_margin."""
    return shadow.where(F.col("margin") >= least_margin)


def extract_facts(chunks: DataFrame, extractor: Extractor) -> DataFrame:
    """(src_session, chunk_no, fact_no, repo, statement, kind, entities, files, confidence, evidence) of chunks(src_session, chunk_no, repo, text)."""
    schema = "src_session string, chunk_no int, fact_no int, repo string, statement string, kind string, entities array<string>, files array<string>, confidence double, evidence string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(r.src_session, r.chunk_no, i, r.repo, f["statement"], f["kind"], f["entities"], f["files"], f["confidence"], f["evidence"]) for r in b.itertuples() for i, f in enumerate(extractor.extract(r.text, r.repo))]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    return chunks.select("src_session", "chunk_no", "repo", "text").mapInPandas(run, schema)


def plan_steps(text: str, tools: set[str], most: int = 4) -> list[tuple[str, str]]:
    """The distinct ``tool(argument)`` lines of a plan before STOP, at most ``most``."""
    out: list[tuple[str, str]] = []
    for line in text.splitlines():
        line = line.strip().lstrip("-*0123456789. ")
        if line.upper().startswith("STOP"):
            break
        name, _, rest = line.partition("(")
        step = (name.strip().lower(), rest.rpartition(")")[0].strip().strip("\"'"))
        if step[0] in tools and step[1] and step not in out:
            out.append(step)
    return out[:most]


#: What is put among the notes when an answer cites nothing, and when the rounds are used up.
NUDGE, FINISH = "(cite facts by their ids, or look further)", "(answer now with what is known)"
WIDEN_BELOW = 0.5


def _run(steps: list[tuple[str, str]], plan: str, tools: dict[str, Callable[[str], list[str]]], notes: list[str]) -> bool:
    """Run the calls of a plan that weren't made before; whether there were any. A tool that fails leaves a note of it."""
    fresh = [s for s in plan_steps(plan, set(tools)) if s not in steps]
    for name, arg in fresh:
        steps.append((name, arg))
        try:
            notes += tools[name](arg) or [f"({name} found nothing for {arg})"]
        except LookupError as e:
            notes.append(f"({name}: {e})")
    return bool(fresh)


def ask(question: str, reasoner: Reasoner, tools: dict[str, Callable[[str], list[str]]], rounds: int = 8, seed: str | None = "search") -> dict:
    """The tool loop: the question itself is searched first; then each round the reasoner names tool calls or stops.

    An answer that cites nothing, though there were notes, is sent back once with a nudge. When the rounds are used up the reasoner must answer.
    """
    notes: list[str] = []
    steps: list[tuple[str, str]] = []
    if seed in tools:
        _run(steps, f"{seed}({question})", tools, notes)
    nudged = False
    answer = None
    for _ in range(rounds):
        if _run(steps, reasoner.next_step(question, notes), tools, notes):
            continue
        answer = reasoner.answer(question, notes)
        if nudged or not notes or re.search(r"\[\d+\]", answer):
            break
        nudged, answer = True, None
        notes.append(NUDGE)
    if answer is None:
        notes.append(FINISH)
        answer = reasoner.answer(question, notes)
    return {"question": question, "answer": answer, "steps": steps, "notes": notes, "nudged": nudged}


def ask_local(question: str, reasoner: Reasoner, tools: dict[str, Callable[[str], list[str]]], strength: Callable[[], float], widen: Callable[[str], list[str]]) -> dict:
    """One plan instead of a loop: its calls are run (the question is searched if it names none), a weak retrieval is widened once, then the answer is written."""
    notes: list[str] = []
    steps: list[tuple[str, str]] = []
    if not _run(steps, reasoner.next_step(question, notes), tools, notes):
        _run(steps, f"search({question})", tools, notes)
    widened = strength() < WIDEN_BELOW
    if widened:
        notes += [n for n in widen(question) if n not in notes]
    return {"question": question, "answer": reasoner.answer(question, notes), "steps": steps, "notes": notes, "widened": widened}


def first_json_object(text: str) -> dict | None:
    """The first JSON object in a model's reply."""
    at = text.find("{")
    while at >= 0:
        try:
            return json.JSONDecoder().raw_decode(text[at:])[0]
        except ValueError:
            at = text.find("{", at + 1)
    return None
