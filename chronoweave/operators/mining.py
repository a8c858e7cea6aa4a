"""Retrieval evaluation: document frequency, rare-token patterns, probes, self-evaluation, hit rates."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.functions import scalars as S
from chronoweave.operators import temporal
from chronoweave.session import materialize

ELIGIBLE = "evidence = 'verified' OR corroborations >= 1 OR confidence >= 0.9"


def _join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join by sorting. Sizes of tables on disk are of packed columns, and those of exploded rows are guessed as if nothing had been exploded,
    so a plan chosen by size would send tables of hundreds of MB through the driver."""
    return left.join(right.hint("merge"), on, how)


def document_frequency(facts: DataFrame, cap: int = 200) -> DataFrame:
    """(token, df) over live facts: distinct lower-case tokens among each statement's first ``cap``."""
    t = temporal.live(facts).select(F.explode(F.array_distinct(F.transform(F.slice(S.tokens(F.col("statement")), 1, cap), F.lower))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("df"))


def rare_patterns(facts: DataFrame, df: DataFrame, most: int = 3, max_df: int = 40) -> DataFrame:
    """(id, pattern): a fact's two or three rarest content tokens in order of the statement, joined by .*; none if even the rarest is common."""
    # Each token once, where it stands first: within the row, so that only the join by token and the ranking by id move rows.
    firsts = lambda ts, low: F.filter(F.transform(ts, lambda t, i: F.struct(i.alias("p"), t.alias("t"), F.get(low, i).alias("token"))), lambda x: F.array_position(low, x["token"]) == x["p"] + 1)
    once = S.bind(S.tokens(F.col("statement")), lambda ts: S.bind(F.transform(ts, F.lower), lambda low: firsts(ts, low)))
    pos = facts.select("id", F.explode(once).alias("x")).select("id", "x.p", "x.t", "x.token").where((F.octet_length("t") >= 4) & ~F.col("token").isin(*S.STOPWORDS))
    w = Window.partitionBy("id").orderBy("df", "p")
    best = _join(pos, df, "token").select("id", "p", "t", "df").repartition("id").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    g = best.groupBy("id").agg(F.min("df").alias("least"), F.sort_array(F.collect_list(F.struct("p", F.replace(F.col("t"), F.lit("."), F.lit("\\.")).alias("t")))).alias("ts"))
    return g.where((F.col("least") <= max_df) & (F.size("ts") >= 2)).select("id", F.array_join(F.transform("ts", lambda x: x["t"]), ".*").alias("pattern"))


#: Pieces joined by .*, which need not be compiled to be known as a regular expression.
_PLAIN = re.compile(r"(?:[A-Za-z0-9_ -]|\\\.|\.\*)*")


def _is_regex(pattern: Column) -> Column:
    def check(patterns: pd.Series) -> pd.Series:
        def ok(p: str | None) -> bool:
            try:
                return p is not None and (_PLAIN.fullmatch(p) or re.compile(p)) is not None
            except re.error:
                return False

        return patterns.map(ok)

    return F.pandas_udf(check, "boolean")(pattern)


_PIECE = r"(?:\\.|[a-z0-9_-]){3,}"


def _grams(c: Column, k: int) -> Column:
    """The substrings of k characters, each once."""
    return F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - (k - 1), F.lit(1))), lambda i: F.substr(c, i, F.lit(k))), lambda g: F.length(g) == k))


def narrow(patterns: DataFrame, facts: DataFrame, most: int = 20) -> DataFrame:
    """(id, pattern, matches) of the patterns that match at most ``most`` live statements, anywhere and in any case. Patterns that are no regular
    expression, or have no three literal characters in a row, are left out.

    A pattern is a sequence of literal pieces. Any statement it matches holds each piece within one of its words, so pieces are sought among the
    distinct words, by their rarest gram. A pattern goes to its rarest piece, and so do the statements that hold it; there the expression
    is tried, so what moves are patterns and statements, and never a row for each pair of them.
    """
    literal = F.transform(F.regexp_extract_all(F.lower("pattern"), F.lit(_PIECE), F.lit(0)), lambda p: F.regexp_replace(p, r"\\(.)", "$1"))
    pieces = F.array_distinct(F.filter(F.flatten(F.transform("literal", lambda p: F.split(p, r"\s+"))), lambda p: F.length(p) >= 3))
    valid = patterns.where(_is_regex(F.col("pattern"))).select("id", "pattern", literal.alias("literal")).where(F.size("literal") > 0)
    valid = materialize(valid.select("id", "pattern", pieces.alias("pieces")), "valid")
    live = temporal.live(facts).select(F.col("id").alias("fid"), "statement")
    said = live.select("fid", F.explode(F.array_distinct(F.split(F.lower("statement"), r"\s+"))).alias("word")).where(F.length("word") >= 3)
    words = materialize(said.groupBy("word").agg(F.count("*").alias("n")), "words")
    held = words.select("word", "n", F.explode(F.concat(_grams(F.col("word"), 3), _grams(F.col("word"), 5))).alias("gram"))
    spelled = valid.select("id", F.explode("pieces").alias("piece"))
    # The grams of five if a piece has any: these are rarer, and no more are needed.
    sought = spelled.select("piece").distinct().select("piece", F.explode(F.when(F.length("piece") >= 5, _grams(F.col("piece"), 5)).otherwise(_grams(F.col("piece"), 3))).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("of"))
    rarest = _join(sought, counts, "gram").groupBy("piece").agg(F.min(F.struct("of", "gram")).alias("k")).select("piece", F.col("k.gram").alias("gram"))
    spots = materialize(_join(rarest, held, "gram").where(F.contains(F.col("word"), F.col("piece"))).select("piece", "word", "n"), "spots")
    width = spots.groupBy("piece").agg(F.sum("n").alias("n"))
    chosen = _join(spelled, width, "piece", "left").groupBy("id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("k")).where("k.n > 0").select("id", F.col("k.piece").alias("piece"))
    keyed = materialize(_join(chosen, valid.select("id", "pattern"), "id"), "keyed")
    needed = _join(spots, keyed.select("piece").distinct(), "piece", "left_semi").select("piece", "word")
    held_by = _join(said, needed, "word").groupBy("fid").agg(F.collect_set("piece").alias("pieces"))
    meet = _join(held_by, live, "fid").select("statement", F.explode("pieces").alias("piece"))
    test = F.expr("statement rlike concat('(?i)', pattern)")
    hits = _join(keyed, meet, "piece").where(test).select("id")
    unindexed = valid.where(F.size("pieces") == 0).select("id", "pattern")  # blanks stand in each of their pieces
    if unindexed.limit(1).count():
        hits = hits.unionByName(unindexed.crossJoin(live.hint("shuffle_replicate_nl")).where(test).select("id"))
    n = F.coalesce("n", F.lit(0))
    return _join(valid.select("id", "pattern"), hits.groupBy("id").agg(F.count("*").alias("n")), "id", "left").where(n <= most).select("id", "pattern", n.alias("matches"))


def quota_sample(rows: DataFrame, group: str, n: int, seed: int = 7) -> DataFrame:
    """About n rows, each group in proportion: ceil(n * its size / all), in seeded order, then the first n."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("__n")).withColumn("__all", F.sum("__n").over(Window.partitionBy(F.lit(0))))  # over a row a group
    shares = sizes.select(group, F.ceil(F.lit(n) * F.col("__n") / F.col("__all")).alias("__k"))
    w = Window.partitionBy(group).orderBy(F.md5(F.concat_ws("-", F.col("id").cast("string"), F.lit(str(seed)))), "id")
    # No group gives more than n: that limit applies before the shuffle, so no group comes whole to a task.
    cut = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).join(F.broadcast(shares), group).where(F.col("__rn") <= F.col("__k"))
    return cut.orderBy(group, "__rn").limit(n).drop("__k", "__rn")


def chain_probes(facts: DataFrame, heads: DataFrame, patterns: DataFrame) -> DataFrame:
    """(q, pattern, miner, as_of): a closed fact's statement asks for the live head of its chain."""
    old = temporal.dead(facts).join(heads, "id").where("head <> id").select(F.col("statement").alias("q"), F.col("head").alias("id"))
    return old.join(temporal.live(facts).select("id"), "id", "left_semi").join(patterns, "id").select("q", "pattern", F.lit("chain").alias("miner"), F.lit(None).cast("string").alias("as_of"))


def time_probes(facts: DataFrame, patterns: DataFrame) -> DataFrame:
    """(q, pattern, miner, as_of): a closed fact asked for as of the first midnight after it became true, if it was still valid."""
    pairs = temporal.supersession_pairs(facts)
    at = S.next_midnight(F.col("old_valid_from"))
    rows = pairs.where(at < F.col("new_valid_from")).select(F.col("old_id").alias("id"), S.epoch_date(at).alias("as_of"))
    return rows.join(facts.select("id", F.col("statement").alias("q")), "id").join(patterns, "id").select("q", "pattern", F.lit("time").alias("miner"), "as_of")


def hit_rates(results: DataFrame, probes: DataFrame, k: int = 5) -> DataFrame:
    """(miner, probes, hits) for results(qid, rank, statement) and probes(qid, pattern, miner)."""
    j = probes.join(results.where(F.col("rank") <= k), "qid", "left").withColumn("hit", F.coalesce(F.expr("statement rlike concat('(?i)', pattern)"), F.lit(False)))
    return j.groupBy("qid", "miner").agg(F.bool_or("hit").alias("hit")).groupBy("miner").agg(F.count("*").alias("probes"), F.count_if("hit").alias("hits"))


def citation_recall(traces: DataFrame, facts: DataFrame) -> DataFrame:
    """(traces, recall): the mean over traces of the share of cited ids that exist, rounded to three places."""
    c = traces.select("id", F.explode(F.from_json("results", "cited array<bigint>")["cited"]).alias("fact_id"))
    j = c.join(facts.select(F.col("id").alias("fact_id"), F.lit(1).alias("there")), "fact_id", "left")
    return j.groupBy("id").agg(F.avg(F.coalesce("there", F.lit(0))).alias("r")).agg(F.count("*").alias("traces"), F.round(F.avg("r"), 3).alias("recall"))


def similar_questions(asked: DataFrame, past: DataFrame, newest: int = 400, least: int = 2) -> DataFrame:
    """(qid, past_id, shared): the newest past question that shares most tokens with each question, if more than ``least``.

    Tokens of a past question count as often as they occur.
    """
    recent = past.orderBy(F.desc("ts"), F.desc("id")).limit(newest)
    a = asked.select("qid", F.explode(F.array_distinct(F.transform(S.query_tokens(F.col("q")), F.lower))).alias("token"))
    b = recent.select(F.col("id").alias("past_id"), F.explode(F.transform(F.slice(S.tokens(F.col("q")), 1, 16), F.lower)).alias("token"))
    n = a.join(b, "token").groupBy("qid", "past_id").agg(F.count("*").alias("shared")).where(F.col("shared") > least)
    w = Window.partitionBy("qid").orderBy(F.desc("shared"), F.desc("past_id"))
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
