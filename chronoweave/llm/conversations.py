"""Rebuilding conversations from message rows.

A session's lines become ordered turns with speakers. Interleaved exchanges are
disentangled by reply links: the turns before are candidates, scored by
time, mentions and words in common (exact sets, compared only where a bound of the score
leaves a chance); the likeliest becomes the parent, and links form trees. Sessions that are
broken, empty or lack replies are marked with the reason.

Rows are spread by session, those of long sessions by stretches of some thousand turns. As many turns before a stretch as
a link can span come along as context, so even a session of very many rows is split without changing any link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.operators.hierarchy import hierarchy
from chronoweave.session import materialize

RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
MENTION = r"[a-z][a-z0-9_]*(?:[-./][a-z0-9_]+)+"
WORD = r"[\p{L}\p{N}]{3,}"
MINUTE_US = 60_000_000
#: Sessions of more turns are cut into stretches of about so many, by minutes.
STRETCH = 2_048
#: Up to so many minutes of long sessions are broadcast.
BROADCAST_ROWS = 200_000
#: A best candidate below this is no parent; the turn then begins a tree.
LEAST_SCORE = 0.9
#: What a change of speaker, nearness in time, mentions and words add at most, and what each turn further back takes off.
ROLE, NEAR, MENTIONS, WORDS, PER_TURN = 1.0, 1.0, 1.5, 2.0, 0.05
#: Beyond so many turns back no score reaches LEAST_SCORE.
LOOK_BACK = int((ROLE + NEAR + MENTIONS + WORDS - LEAST_SCORE) / PER_TURN + 1e-9)


def _set(tokens):
    """The distinct tokens, none of which holds a blank, as one string; null if there are none."""
    return F.nullif(F.array_join(F.array_distinct(tokens), " "), F.lit(""))


def message_lines(lines: DataFrame, with_text: bool = False) -> DataFrame:
    """(src_session, line_offset, line_id, role, t, ok, has_content, words, mentions): each line once, slim.

    t is null unless rec_timestamp is a valid RFC 3339 time; ok says whether both
    time and message are valid. Only user and assistant lines of the main chain have a role.
    Of a line delivered again the one ingested first counts.
    """
    chat = F.col("rec_type").isin("user", "assistant") & ~F.coalesce(F.col("is_sidechain"), F.lit(False))
    v = F.expr("try_parse_json(message)")
    src = lines.where("src_session IS NOT NULL").select(
        "src_session", "line_offset", "line_id", "ingested_at", F.when(chat, F.col("rec_type")).alias("role"),
        F.when(chat & F.col("rec_timestamp").rlike(RFC3339), F.expr("unix_micros(try_cast(rec_timestamp AS timestamp))")).alias("t"),
        F.when(chat, v).alias("v"),
    )
    src = src.select("*", F.expr("try_variant_get(v, '$.content', 'array<variant>')").alias("items"), F.expr("CASE WHEN schema_of_variant(try_variant_get(v, '$.content', 'variant')) = 'STRING' THEN try_variant_get(v, '$.content', 'string') END").alias("plain"))
    item_text = "CASE WHEN try_variant_get(x, '$.type', 'string') = 'text' THEN try_variant_get(x, '$.text', 'string') WHEN try_variant_get(x, '$.type', 'string') = 'tool_result' THEN coalesce(array_join(transform(try_variant_get(x, '$.content', 'array<variant>'), y -> try_variant_get(y, '$.text', 'string')), '\n'), try_variant_get(x, '$.content', 'string')) END"
    src = src.select("*", F.coalesce("plain", F.expr(f"array_join(transform(items, x -> {item_text}), '\n')")).alias("text"))
    tool = F.expr("coalesce(exists(items, x -> try_variant_get(x, '$.type', 'string') IN ('tool_use', 'tool_result')), false)")
    said = F.expr(r"coalesce(exists(items, x -> try_variant_get(x, '$.type', 'string') = 'text' AND coalesce(try_variant_get(x, '$.text', 'string') rlike '(?U)\\S', false)), false)")
    low = F.lower("text")
    tokens, mentions = F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.regexp_extract_all(low, F.lit(MENTION), F.lit(0))
    slim = src.select(
        "src_session", "line_offset", "line_id", "ingested_at", "role", "t",
        F.when(F.col("role").isNotNull(), F.col("v").isNotNull() & F.col("t").isNotNull()).alias("ok"),
        (tool | said | F.coalesce(F.col("plain").rlike(r"(?U)\S"), F.lit(False))).alias("has_content"),
        _set(tokens).alias("words"), _set(mentions).alias("mentions"), *([F.col("text")] if with_text else []),
    )
    first = Window.partitionBy("src_session", "line_offset").orderBy("ingested_at", "line_id")
    return slim.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n", "ingested_at")


class _Sets:
    """A column of token sets; ``size`` has their sizes. Sets are built when they are first compared."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        column = column.combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        parts = pc.split_pattern(column, " ")
        self.size = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False).astype("int64")
        self.ids = pc.dictionary_encode(parts.flatten()).indices.to_numpy(zero_copy_only=False)
        self.ends = np.cumsum(self.size)
        self.sets: dict[int, set[int]] = {}

    def __getitem__(self, i: int) -> set[int]:
        if (got := self.sets.get(i)) is None:
            got = self.sets[i] = set(self.ids[self.ends[i] - self.size[i] : self.ends[i]].tolist())
        return got

    def shared(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many tokens each pair of rows has in common."""
        return np.fromiter((len(self[a] & self[b]) for a, b in zip(i.tolist(), j.tolist())), "float64", len(i))


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (session, stretch, t, offset), context rows (own = false) before the stretch's own."""
    kept: pa.Table | None = None

    def run(t: pa.Table) -> pa.RecordBatch:
        n = t.num_rows
        get = lambda c: t.column(c).to_numpy()
        session = np.unique(np.array(t.column("src_session").to_pylist(), dtype=object).astype(str), return_inverse=True)[1]
        stretch, at, offset, role, line, own, before = get("stretch"), get("t"), get("line_offset"), get("is_user"), get("line_id"), get("own"), get("before")
        words, men = _Sets(t.column("words")), _Sets(t.column("mentions"))
        size, n_men = words.size.astype("float64"), men.size.astype("float64")
        best, parent = np.full(n, -1.0), np.full(n, -1)
        row = np.arange(n)
        for back in range(1, LOOK_BACK + 1):
            i, j = row[back:], row[:-back]
            fits = (session[i] == session[j]) & (stretch[i] == stretch[j])
            if not fits.any():
                break  # nor does any turn further back
            fits &= own[i]  # a turn of the context has its parent in its own stretch
            i, j = i[fits], j[fits]
            sure = ROLE * (role[i] != role[j]) + NEAR * np.exp(-(at[i] - at[j]) / 6e8) - PER_TURN * back
            product = np.maximum(1, np.sqrt(size[i] * size[j]))
            most_men = MENTIONS * ((n_men[i] > 0) & (n_men[j] > 0))
            most = sure + most_men + WORDS * np.minimum(size[i], size[j]) / product
            # What can't beat the best so far isn't compared; the margin is for rounding.
            open_ = (most + 1e-9 >= best[i]) & (most + 1e-9 >= LEAST_SCORE)
            i, j, sure, product, most_men = i[open_], j[open_], sure[open_], product[open_], most_men[open_]
            by_men = np.zeros(len(i))
            some = most_men > 0
            by_men[some] = MENTIONS * men.shared(i[some], j[some]) / np.minimum(n_men[i[some]], n_men[j[some]])
            most = sure + by_men + WORDS * np.minimum(size[i], size[j]) / product
            open_ = (most + 1e-9 >= best[i]) & (most + 1e-9 >= LEAST_SCORE)
            i, j = i[open_], j[open_]
            score = np.round(sure[open_] + by_men[open_] + WORDS * words.shared(i, j) / product[open_], 9)
            better = (score > best[i]) & (score >= LEAST_SCORE)
            best[i[better]], parent[i[better]] = score[better], j[better]
        root, depth = [0] * n, [0] * n
        for k, p in enumerate(parent.tolist()):
            root[k], depth[k] = (root[p], depth[p] + 1) if p >= 0 else (k, 0)
        root = np.array(root)
        mine = np.flatnonzero(own)
        same = np.zeros(n, bool)
        group_first, group_last, turn_no = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, "int64")
        if len(mine):
            a, b = mine[:-1], mine[1:]
            joined = (session[a] == session[b]) & (stretch[a] == stretch[b])
            same[b] = joined & role[a] & role[b]
            opens = np.flatnonzero(np.append(True, ~joined))
            turn_no[mine] = before[mine] + np.arange(len(mine)) - np.repeat(opens, np.diff(np.append(opens, len(mine)))) + 1
            group_first[mine], group_last[mine] = True, True
            group_first[b[joined]] = False
            group_last[a[joined]] = False
        has = parent[mine] >= 0
        out = {
            "src_session": t.column("src_session").take(pa.array(mine)).combine_chunks(), "stretch": pa.array(stretch[mine]), "turn_no": pa.array(turn_no[mine]), "t": pa.array(at[mine]), "line_offset": pa.array(offset[mine]),
            "line_id": pa.array(line[mine]), "is_user": pa.array(role[mine]), "parent_line": pa.array(line[np.maximum(parent[mine], 0)], mask=~has),
            "score": pa.array(best[mine], mask=~has), "local_root": pa.array(line[root[mine]]), "crosses": pa.array(~own[root[mine]]), "local_depth": pa.array(np.array(depth)[mine].astype("int32")),
            "repeats_user": pa.array(same[mine]), "opens": pa.array(group_first[mine]), "closes": pa.array(group_last[mine]),
        }
        return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out.values()], names=list(out))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([kept, table]) if kept is not None else table
        n = table.num_rows
        session = pc.equal(table.column("src_session"), table.column("src_session")[n - 1]).to_numpy()
        last = session & (table.column("stretch").to_numpy() == table.column("stretch")[n - 1].as_py())
        cut = n - int(np.argmin(last[::-1])) if not last.all() else 0
        if cut:
            yield run(table.slice(0, cut))
        kept = table.slice(cut)
    if kept is not None and kept.num_rows:
        yield run(kept)


LINKS = (
    "src_session string, stretch bigint, turn_no bigint, t bigint, line_offset bigint, line_id bigint, is_user boolean, parent_line bigint, score double, "
    "local_root bigint, crosses boolean, local_depth int, repeats_user boolean, opens boolean, closes boolean"
)


def reply_links(slim: DataFrame) -> DataFrame:
    """One row a turn (valid line with content) with its place and its likeliest parent; from message_lines, which should be materialised."""
    turns = slim.where("role IS NOT NULL AND ok AND has_content").select("src_session", "t", F.coalesce("line_offset", F.lit(-1)).alias("line_offset"), "line_id", (F.col("role") == "user").alias("is_user"), "words", "mentions")
    minute = F.floor(F.col("t") / MINUTE_US).cast("bigint").alias("minute")
    long = turns.groupBy("src_session").agg(F.count("*").alias("n")).where(F.col("n") > STRETCH).select("src_session")
    # Only long sessions have minutes here. A stretch begins where the number of turns so far passes a multiple of STRETCH.
    order = Window.partitionBy("src_session").orderBy("minute")
    minutes = turns.select("src_session", minute).join(long, "src_session", "left_semi").groupBy("src_session", "minute").agg(F.count("*").alias("n"))
    upto = minutes.withColumn("upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("upto") - F.col("n"))
    placed = upto.withColumn("home", F.floor(F.col("begin") / STRETCH)).withColumn("before", F.min("begin").over(Window.partitionBy("src_session", "home")))
    # Any stretch that begins within LOOK_BACK turns after this minute has it as context.
    targets = F.array_union(F.array("home"), F.sequence(F.floor(F.col("upto") / STRETCH), F.floor((F.col("upto") + LOOK_BACK) / STRETCH)))
    placed = materialize(placed.select("src_session", "minute", "home", "before", F.explode(targets).alias("stretch")), "stretches")
    zero = F.lit(0).cast("bigint")
    n = placed.limit(BROADCAST_ROWS + 1).count()
    if n:
        rows = turns.withColumn("minute", minute).join(F.broadcast(placed) if n <= BROADCAST_ROWS else placed, ["src_session", "minute"], "left").drop("minute")
    else:  # no session is long
        rows = turns.withColumns({"stretch": zero, "home": zero, "before": zero})
    rows = rows.select(*turns.columns, F.coalesce("stretch", zero).alias("stretch"), F.coalesce(F.col("stretch") == F.col("home"), F.lit(True)).alias("own"), F.coalesce("before", zero).alias("before"))
    return rows.repartition("src_session", "stretch").sortWithinPartitions("src_session", "stretch", "t", "line_offset").mapInArrow(_links, LINKS)


def session_verdicts(slim: DataFrame, links: DataFrame, lines: DataFrame | None = None) -> DataFrame:
    """(src_session, turns, threads, reason): reason is null for a usable session.

    Else the first that holds of: broken (a line without valid message or time),
    empty (no turn), starts_without_user, ends_without_reply, missing_reply (two user turns in a row).
    """
    lines_of = slim.groupBy("src_session").agg(F.coalesce(F.bool_or(~F.col("ok")), F.lit(False)).alias("broken"))
    parts = links.groupBy("src_session", "stretch").agg(
        F.count("*").alias("turns"), F.count_if(F.col("parent_line").isNull()).alias("threads"), F.bool_or("repeats_user").alias("again"),
        F.bool_or(F.col("opens") & F.col("is_user")).alias("first"), F.bool_or(F.col("closes") & F.col("is_user")).alias("last"),
    )
    sessions = parts.groupBy("src_session").agg(
        F.sum("turns").alias("turns"), F.sum("threads").alias("threads"), F.bool_or("again").alias("again"),
        F.min_by("first", "stretch").alias("first"), F.max_by("last", "stretch").alias("last"), F.sort_array(F.collect_list(F.struct("stretch", "first", "last"))).alias("parts"),
    )
    between = F.expr("exists(sequence(1, size(parts) - 1), i -> i > 0 AND i < size(parts) AND parts[i - 1].last AND parts[i].first)")
    judged = lines_of.join(sessions, "src_session", "left").select(
        "src_session", F.coalesce("turns", F.lit(0)).alias("turns"), F.coalesce("threads", F.lit(0)).alias("threads"),
        F.when(F.col("broken"), "broken").when(F.col("turns").isNull(), "empty").when(~F.col("first"), "starts_without_user").when(F.col("last"), "ends_without_reply")
        .when(F.col("again") | F.when(F.size("parts") > 1, between).otherwise(False), "missing_reply").alias("reason"),
    )
    return judged


def conversations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, sessions) of session lines (src_session, line_offset, line_id, rec_type, rec_timestamp, is_sidechain, message, ingested_at).

    turns has, for usable sessions, src_session, turn_no (by time, then offset), role, text,
    line_id, said_at, parent_line, score and thread (the line_id of its tree's first turn);
    sessions is session_verdicts. Lines without a session are left out; nulls in any other
    column make a line broken or give it no role, as message_lines says. Empty input gives empty frames.
    """
    slim = materialize(message_lines(lines, with_text=True), "lines")
    links = materialize(reply_links(slim), "links")
    sessions = session_verdicts(slim, links)
    # Trees that reach over a stretch's begin: the few links whose local root lies in the context are followed to the end.
    crossing = links.where("crosses").select("local_root").distinct().join(links.select(F.col("line_id").alias("local_root"), F.col("local_root").alias("up"), "crosses"), "local_root")
    heads = crossing.select(F.col("local_root").alias("id"), F.when(F.col("up") != F.col("local_root"), F.col("up")).alias("parent"))
    tops = heads.select(F.col("parent").alias("id"), F.lit(None).cast("bigint").alias("parent")).where("id IS NOT NULL").join(heads.select("id"), "id", "left_anti")
    trees = hierarchy(heads.unionByName(tops), "id", "parent").select(F.col("node").alias("local_root"), F.col("root").alias("whole"))
    good = sessions.where("reason IS NULL").select("src_session")
    turns = (
        links.join(good, "src_session", "left_semi").join(trees, "local_root", "left")
        .join(slim.select("src_session", "line_id", "text"), ["src_session", "line_id"])
        .select("src_session", "turn_no", F.when(F.col("is_user"), "user").otherwise("assistant").alias("role"), "text", "line_id", F.timestamp_micros("t").alias("said_at"), "parent_line", "score", F.coalesce("whole", "local_root").alias("thread"))
    )
    return turns, sessions
