"""Structured Streaming: chunking sessions with state, deduplicating facts with state, and applying batches once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chronoweave.functions import scalars as S
from chronoweave.operators.ingest import CHUNK_BYTES, OVERLAP_BYTES, Chunker

CHUNK = "src_session string, chunk_no int, text string, end_offset bigint"
#: A session silent for so long is taken to rest: what is held of it is emitted.
IDLE_MS = 600_000
FRESH = "repo string, hash string, statement string, src_session string, times int"


def stream_chunks(pieces: DataFrame, size: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES, idle_ms: int = IDLE_MS) -> DataFrame:
    """Chunks of a stream of pieces(src_session, line_offset, piece).

    What a session holds below ``size`` is emitted once it has had no line for ``idle_ms`` of processing time; at 0, at the end of each micro-batch,
    as by a reader that reads to the end of the file. A query that runs once over what is there (availableNow) and is
    not started again needs 0, for nothing wakes it later.

    State of a session: the pieces held, the offsets seen, the last of them and the chunk count. A line whose offset was seen is a delivery
    again and is skipped; one of a lower offset that comes later counts, after what came before it. No watermark: what comes late in world time counts like any other.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, fresh, no, last, known = state.get if state.exists else ([], False, 0, -1, [])
        c = Chunker(size, overlap, list(held), fresh)
        seen = {int(x) for x in known}
        rows = []
        if state.hasTimedOut:
            ending = True
        else:
            ending = idle_ms == 0
            pdf = pd.concat(list(batches)).sort_values("line_offset")  # what one micro-batch brings of one session
            for off, piece in zip(pdf["line_offset"], pdf["piece"]):
                if int(off) in seen:
                    continue
                seen.add(int(off))
                last = max(last, int(off))
                if piece and (text := c.push(piece)) is not None:
                    rows.append((key[0], no, text, last))
                    no += 1
        if ending and (text := c.flush()) is not None:
            rows.append((key[0], no, text, last))
            no += 1
        state.update((c.pieces, c.fresh, no, last, sorted(seen)))
        if c.fresh and idle_ms:
            state.setTimeoutDuration(idle_ms)
        if rows:
            yield pd.DataFrame(rows, columns=["src_session", "chunk_no", "text", "end_offset"])

    return pieces.groupBy("src_session").applyInPandasWithState(fold, CHUNK, "pieces array<string>, fresh boolean, no int, last bigint, seen array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


def stream_new_facts(facts: DataFrame) -> DataFrame:
    """Of a stream of facts(statement, repo, src_session) those that say something new (times 0), and restatements from other sessions (times > 0).

    State by (repo, hash): the session that said it first. A restatement by the same session gives nothing.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches))
        first = state.get[0] if state.exists else None
        rows = []
        again = pdf["src_session"].tolist()
        if first is None:
            first, again = again[0], again[1:]
            state.update((first,))
            rows.append((key[0], key[1], pdf["statement"].iloc[0], first, 0))
        n = sum(s != first for s in again)
        if n:
            rows.append((key[0], key[1], pdf["statement"].iloc[0], first, n))
        if rows:
            yield pd.DataFrame(rows, columns=["repo", "hash", "statement", "src_session", "times"])

    keyed = facts.select(F.coalesce("repo", F.lit("")).alias("repo"), S.statement_hash(F.col("statement")).alias("hash"), "statement", "src_session")
    return keyed.groupBy("repo", "hash").applyInPandasWithState(fold, FRESH, "first string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums of events(ts, event_type, value) by tumbling window; later than the watermark is dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def run_cycle(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """Start the loop: every ``seconds``, or once over what is there. apply(batch, batch_id) must be idempotent by batch_id;
    the checkpoint holds the offsets and admits one query at a time, which is its lease."""
    trigger = {"availableNow": True} if seconds is None else {"processingTime": f"{seconds} seconds"}
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**trigger)
    if seconds is not None or "ProcessingTimeTimeout" not in stream._jdf.queryExecution().analyzed().toString():
        return writer.start()
    # A stream with timeouts always asks for another batch, so that a run over what is there wouldn't end; the query keeps the setting it starts with.
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name, "true")
    conf.set(name, "false")
    try:
        return writer.start()
    finally:
        conf.set(name, before)


def once(spark: SparkSession, root: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that writes each batch under its id: a batch that is repeated after a failure overwrites itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    return write
