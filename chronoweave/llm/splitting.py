"""Splitting oversized texts at natural boundaries, with overlap.

The text is seen as its UTF-8 bytes, one character each (ISO-8859-1), so that
the bounded quantifiers of one regular expression count bytes. Its
alternatives stand in order of boundary strength: the rest of the text, a turn, a paragraph, a
line, a word, a character; each takes as much as the limit allows. All is done
with SQL string and array functions, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN = r"(?:SUBAGENT-)?(?:USER|ASSISTANT): "
BLANK_LINE = r"(?<=\n\r?\n)"
NOT_INSIDE_CHARACTER = r"(?![\x80-\xBF])"


def body_pattern(size: int) -> str:
    take = rf".{{1,{size}}}"
    ends = [r"\z", rf"{BLANK_LINE}(?={TURN})", rf"{BLANK_LINE}(?![\r\n])", r"(?<=\n)", r"(?<=[ \t])", NOT_INSIDE_CHARACTER]
    return "(?s)(?:" + "|".join(take + e for e in ends) + ")"


#: From these the overlap may start: the strongest boundary found wins, and of that kind the earliest.
TAIL_PATTERNS = [rf"(?s){BLANK_LINE}{TURN}.*\z", rf"(?s){BLANK_LINE}[^\r\n].*\z", r"(?s)(?<=\n)[^\r\n].*\z", r"(?s)(?<=[ \t])[^ \t\r\n].*\z", r"(?s)[^\x80-\xBF].*\z"]


def _bytes(c):
    return F.decode(F.encode(c, "UTF-8"), "ISO-8859-1")


def _text(c):
    return F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")


def split_text(df: DataFrame, text: str = "text", limit: int = 6000, overlap: int = 500) -> DataFrame:
    """One row a piece, with all columns of df but text (a column of df named as one of ours is dropped).

    piece_no counts from 0 of n_pieces; piece is the text of at most ``limit``
    UTF-8 bytes. The pieces without their first overlap_bytes, joined, are the
    text. start_byte and end_byte give the piece's place in the text, overlap
    included; start_char that of its first character. The overlap of at most ``overlap`` bytes comes from
    the piece before, from its strongest boundary on. A text within the limit is one piece;
    null and empty texts have none.
    """
    if limit - overlap < 4 or overlap < 0:
        raise ValueError("limit must exceed overlap by 4 bytes at least")
    ours = ["piece_no", "n_pieces", "piece", "start_byte", "end_byte", "overlap_bytes", "start_char"]
    kept = [c for c in df.columns if c != text and c not in ours]
    raw = df.where(F.length(text) > 0).select(*kept, _bytes(F.col(text)).alias("__b"))
    whole = F.length("__b") <= limit
    cut = raw.withColumn("__bodies", F.when(whole, F.array("__b")).otherwise(F.regexp_extract_all("__b", F.lit(body_pattern(limit - overlap)), F.lit(0)))).drop("__b")
    running = lambda lengths: F.aggregate(lengths, F.array(F.lit(0).cast("bigint")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    placed = cut.withColumns({
        "__at": running(F.transform("__bodies", lambda x: F.length(x).cast("bigint"))),
        "__char": running(F.transform("__bodies", lambda x: F.length(F.regexp_replace(x, r"[\x80-\xBF]", "")).cast("bigint"))),
    })
    rows = placed.select(
        *kept, F.size("__bodies").alias("n_pieces"),
        F.explode(F.transform("__bodies", lambda x, i: F.struct(
            i.alias("piece_no"), x.alias("body"), F.get("__at", i).alias("at"), F.get("__char", i).alias("char"),
            F.when(i > 0, F.get("__bodies", i - 1)).alias("before"),
        ))).alias("p"),
    )
    # The window keeps three bytes more where the body has them, for the look-behind; what it matches stays within the overlap.
    if overlap:
        window = F.expr(f"right(p.before, {overlap} + 3)")
        spare = F.greatest(F.length(window) - overlap, F.lit(0))
        tails = []
        for pattern in TAIL_PATTERNS:
            plain = F.nullif(F.regexp_extract(window, pattern, 0), F.lit(""))
            # A first match that begins within the spare bytes is too long: look again behind them.
            late = F.nullif(F.regexp_extract(F.expr(f"right(p.before, {overlap})"), pattern, 0), F.lit(""))
            tails.append(F.when(F.length(plain) <= F.length(window) - spare, plain).otherwise(late))
        # A body within the overlap comes along whole: it begins at a cut.
        tail = F.when(F.length("p.before") <= overlap, F.col("p.before")).otherwise(F.coalesce(*tails, F.lit("")))
    else:
        tail = F.lit("")
    rows = rows.withColumn("__tail", F.when(F.col("p.before").isNull(), "").otherwise(tail))
    return rows.select(
        *kept, F.col("p.piece_no").alias("piece_no"), "n_pieces", _text(F.concat("__tail", "p.body")).alias("piece"),
        (F.col("p.at") - F.length("__tail")).alias("start_byte"), (F.col("p.at") + F.length("p.body")).alias("end_byte"),
        F.length("__tail").alias("overlap_bytes"), (F.col("p.char") - F.length(F.regexp_replace("__tail", r"[\x80-\xBF]", ""))).alias("start_char"),
    )
