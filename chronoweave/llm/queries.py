"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.llm import conversations as talk
from chronoweave.llm import leakage, mixing, secrets, similar_vectors, splitting, subjects
from chronoweave.llm.sql import SQL
from chronoweave.session import materialize
from chronoweave.sources.tables import table

VECTOR_TABLES = ("fact_vecs", "fact_vecs_local")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Each credential of each message."""
    return secrets.credentials(table(spark, d, "session_lines"))


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every message with its credentials replaced."""
    return secrets.redact_messages(table(spark, d, "session_lines")).select("line_id", "message", "n_secrets")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions to drop."""
    slim = materialize(talk.message_lines(table(spark, d, "session_lines")), "lines")
    return talk.session_verdicts(slim, talk.reply_links(slim)).where("reason IS NOT NULL").select("src_session")


def p4_links(spark: SparkSession, d: str) -> DataFrame:
    """Each turn of each session, usable or not: its place, and the turn it most likely replies to."""
    slim = materialize(talk.message_lines(table(spark, d, "session_lines")), "lines")
    return talk.reply_links(slim).select("line_id", "turn_no", "parent_line")


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """The ordered turns of the usable sessions, with reply links and threads."""
    return talk.conversations(table(spark, d, "session_lines"))[0]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of facts among each other's ten most similar, of cosine 0.90 at least."""
    return _union([similar_vectors.mutual_pairs(table(spark, d, t)).select(F.lit(t).alias("vec_table"), F.col("a").alias("fact_id_a"), F.col("b").alias("fact_id_b")) for t in VECTOR_TABLES])


def p6_top(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar of every vector whose id is divisible by 50."""
    return _union([similar_vectors.top_k(table(spark, d, t), queries=F.col("id") % 50 == 0).select(F.lit(t).alias("vec_table"), "query", "rank", "id", F.round("cosine", 6).alias("cosine")) for t in VECTOR_TABLES])


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_text(table(spark, d, "chunks"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that had to be cut."""
    return _pieces(spark, d).where("n_pieces > 1 AND piece_no = 0").select("chunk_id")


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).select("chunk_id", "end_offset", "piece_no", "n_pieces", "start_byte", "end_byte", "overlap_bytes", "start_char", "piece")


def p7_joined(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of each chunk without their overlap, joined again: a hash of the text, and whether every piece is within the limit."""
    body = F.expr("substring(encode(piece, 'UTF-8'), overlap_bytes + 1)")
    rows = _pieces(spark, d).select("chunk_id", "piece_no", body.alias("body"), (F.octet_length("piece") <= 6000).alias("fits"))
    whole = rows.groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("piece_no", "body"))).alias("x"), F.bool_and("fits").alias("fits"))
    return whole.select("chunk_id", F.md5(F.aggregate("x", F.lit(b""), lambda a, y: F.concat(a, y["body"]))).alias("hash"), "fits")


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the evaluation items of which they hold a passage."""
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """For each leaked item the documents that hold it and the longest passage."""
    return _leaks(spark, d).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"), F.max("words").alias("longest"), F.max("item_words").alias("item_words"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subject_labels"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects of each document."""
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and sentences of the corpus by subject; documents with two subjects count for both."""
    return _subjects(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("sentences").alias("sentences"))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p4_found, p4_links, p4_turns, p6_found, p6_top, p7_found, p7_pieces, p7_joined, p8_found, p8_report, p9_mix, p9_report, p10_found, p10_composition)}
