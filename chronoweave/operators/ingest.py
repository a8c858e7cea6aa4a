"""From transcript lines to facts: decoding, rendering, chunking, deduplication, upserts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S

CHUNK_BYTES, OVERLAP_BYTES, TOOL_BYTES = 24_000, 2_000, 400


def decode_items(lines: DataFrame) -> DataFrame:
    """Lines of the first format with ``piece``: the rendered turn, or null if there is nothing to say.

    Content is a string or an array of items; tool input and results are cut to 400
    characters; sidechain speakers get a prefix.
    """
    v = lines.withColumn("__v", F.expr("try_parse_json(message)"))
    v = v.withColumn("__items", F.expr("try_variant_get(__v, '$.content', 'array<variant>')"))
    t = "try_variant_get(x, '$.type', 'string')"
    one = (
        f"CASE WHEN {t} = 'text' THEN try_variant_get(x, '$.text', 'string') "
        f"WHEN {t} = 'tool_use' THEN concat('[tool:', coalesce(try_variant_get(x, '$.name', 'string'), ''), '] ', left(coalesce(to_json(try_variant_get(x, '$.input', 'variant')), ''), {TOOL_BYTES})) "
        f"WHEN {t} = 'tool_result' THEN concat('[result] ', left(coalesce(try_variant_get(x, '$.content', 'string'), ''), {TOOL_BYTES})) END"
    )
    # A string as content isn't an array; get_json_object gives it unquoted.
    text = F.coalesce(F.expr(f"array_join(filter(transform(__items, x -> {one}), s -> s rlike '(?U)\\\\S'), '\\n')"), F.get_json_object("message", "$.content"))
    role = F.concat(F.when(F.coalesce(F.col("is_sidechain"), F.lit(False)), "SUBAGENT-").otherwise(""), F.upper("rec_type"), F.lit(": "))
    ok = F.col("rec_type").isin("user", "assistant") & (F.length(S.stripped(F.col("__text"))) > 0)
    return v.withColumn("__text", text).withColumn("piece", F.when(ok, F.concat(role, S.redacted(S.stripped(F.col("__text")))))).drop("__v", "__items", "__text")


def decode_payloads(lines: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines(value) of the second format as (t, kind, cwd, piece): session_meta gives the folder, messages and function calls a piece. Columns in ``keep`` come along."""
    schema = "timestamp string, type string, payload struct<type:string,cwd:string,role:string,name:string,arguments:string,content:array<struct<text:string>>>"
    j = lines.select(*keep, F.from_json("value", schema).alias("j")).select(*keep, "j.*")
    said = F.array_join(F.transform("payload.content", lambda c: c["text"]), "\n")
    piece = (
        F.when((F.col("type") == "response_item") & (F.col("payload.type") == "message") & (F.length(S.stripped(said)) > 0), F.concat(F.upper("payload.role"), F.lit(": "), S.redacted(S.stripped(said))))
        .when((F.col("type") == "response_item") & (F.col("payload.type") == "function_call"), F.concat(F.lit("ASSISTANT: [tool:"), F.col("payload.name"), F.lit("] "), F.left(F.coalesce("payload.arguments", F.lit("")), F.lit(TOOL_BYTES))))
    )
    return j.select(*keep, S.rfc3339_epoch(F.col("timestamp")).alias("t"), "type", F.when(F.col("type") == "session_meta", F.col("payload.cwd")).alias("cwd"), piece.alias("piece"))


class Chunker:
    """Pieces of one session in order, cut into chunks of at least ``size`` bytes with whole trailing pieces of at most ``overlap`` bytes carried on."""

    def __init__(self, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES, pieces: list[str] | None = None, fresh: bool = False) -> None:
        self.size, self.overlap, self.pieces, self.fresh = size, overlap, pieces or [], fresh
        self.held = sum(len(p.encode()) for p in self.pieces)

    def push(self, piece: str) -> str | None:
        self.pieces.append(piece)
        self.held += len(piece.encode())
        self.fresh = True
        return self.flush() if self.held >= self.size else None

    def flush(self) -> str | None:
        """The chunk held; None if nothing but overlap is left."""
        if not self.fresh:
            return None
        out, tail, n = "\n\n".join(self.pieces), [], 0
        for p in reversed(self.pieces):
            n += len(p.encode())
            if n > self.overlap:
                break
            tail.insert(0, p)
        self.pieces, self.held, self.fresh = tail, sum(len(p.encode()) for p in tail), False
        return out


def chunks(pieces: DataFrame, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES) -> DataFrame:
    """(src_session, chunk_no, text, end_offset, n_pieces) of pieces(src_session, line_offset, piece), in order of offset.

    Rows stream through in sorted order, so a session is never held as a whole; a null piece only advances the offset.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, c, no, last, n = None, None, 0, 0, 0
        for batch in batches:
            rows = []
            for s, off, piece in zip(batch["src_session"], batch["line_offset"], batch["piece"]):
                if s != session:
                    if c is not None and (text := c.flush()) is not None:
                        rows.append((session, no, text, last, n))
                    session, c, no, n = s, Chunker(size, overlap), 0, 0
                last = off
                if piece:
                    n += 1
                    if (text := c.push(piece)) is not None:
                        rows.append((session, no, text, off, n))
                        no, n = no + 1, 0
            yield pd.DataFrame(rows, columns=["src_session", "chunk_no", "text", "end_offset", "n_pieces"])
        if c is not None and (text := c.flush()) is not None:
            yield pd.DataFrame([(session, no, text, last, n)], columns=["src_session", "chunk_no", "text", "end_offset", "n_pieces"])

    sorted_ = pieces.select("src_session", "line_offset", "piece").repartition("src_session").sortWithinPartitions("src_session", "line_offset")
    return sorted_.mapInPandas(run, "src_session string, chunk_no int, text string, end_offset bigint, n_pieces int")


def deduplicate(new: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(to insert, to corroborate) for a batch new(pos, statement, repo, src_session, confidence, ...).

    By statement hash and repo: the first of the batch is inserted unless a live fact says the same. A restatement from
    another session adds one corroboration, one from the same session nothing. to corroborate: (id or pos of the batch, times, and if the
    batch has valid_from and evidence, last and verified: the latest time it was said to be true, and whether as verified).
    """
    h = new.withColumn("h", S.statement_hash(F.col("statement"))).withColumn("r", F.coalesce("repo", F.lit("")))
    known = facts.where("superseded_at IS NULL").select(S.statement_hash(F.col("statement")).alias("h"), F.coalesce("repo", F.lit("")).alias("r"), "id", F.col("src_session").alias("own"))
    known = known.groupBy("h", "r").agg(F.min(F.struct("id", "own")).alias("k")).select("h", "r", "k.*")
    j = h.join(known, ["h", "r"], "left")
    first = h.groupBy("h", "r").agg(F.min(F.struct("pos", "src_session")).alias("f")).select("h", "r", F.col("f.pos").alias("first_pos"), F.col("f.src_session").alias("first_said"))
    j = j.join(first, ["h", "r"]).withColumn("first_session", F.coalesce("own", "first_said")).drop("first_said")
    insert = j.where("id IS NULL AND pos = first_pos").drop("h", "r", "id", "own", "first_pos", "first_session")
    again = j.where("(id IS NOT NULL OR pos <> first_pos) AND NOT (src_session <=> first_session)")
    said = [F.max("valid_from").alias("last")] if "valid_from" in new.columns else []
    said += [F.bool_or(F.col("evidence") == "verified").alias("verified")] if "evidence" in new.columns else []
    return insert, again.groupBy(F.col("id"), F.when(F.col("id").isNull(), F.col("first_pos")).alias("pos")).agg(F.count("*").alias("times"), *said)


def corroborate(facts: DataFrame, times: DataFrame) -> DataFrame:
    """facts after times(id, times, and maybe last, verified) independent restatements: what is said again is more certain, true at the latest time
    it was said to be, and verified once any of them was."""
    extra = [c for c in ("last", "verified") if c in times.columns]
    j = facts.join(times.select("id", F.col("times").alias("__n"), *[F.col(c).alias(f"__{c}") for c in extra]), "id", "left")
    n = F.coalesce("__n", F.lit(0))
    new = {"confidence": S.corroborated(F.col("confidence"), n), "corroborations": (F.col("corroborations") + n).cast("int")}
    if "last" in extra:
        new["valid_from"] = F.greatest("valid_from", "__last")
    if "verified" in extra:
        new["evidence"] = F.when(F.col("__verified"), "verified").otherwise(F.col("evidence"))
    return j.withColumns(new).select(*facts.columns)


def canary(statements: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, keywords, met) of expected(file, keywords): whether a statement of the file holds all the keywords."""
    j = expected.join(statements, "file", "left").withColumn("hit", F.coalesce(S.contains_all(F.col("statement"), F.col("keywords")), F.lit(False)))
    return j.groupBy("file", "keywords").agg(F.bool_or("hit").alias("met"))


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str], new_wins: bool) -> DataFrame:
    """Upsert: the union with one row a key, the new row where new_wins, else the old one."""
    first, second = (new, old) if new_wins else (old, new)
    return first.unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti"))
