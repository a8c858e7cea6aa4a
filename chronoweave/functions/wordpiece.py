"""WordPiece tokens by a given vocabulary, in Arrow batches."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PIECE = re.compile(r"\w+|[^\w\s]")


def basic_tokens(text: str) -> list[str]:
    """Lower case without accents, cut at blanks and around punctuation."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return [p for w in _PIECE.findall(plain) for p in (re.split(r"(_)", w) if "_" in w else [w]) if p]


def wordpieces(text: str, vocabulary: dict[str, int], unknown: str = "[UNK]", longest: int = 100) -> list[int]:
    """Ids of the longest known beginnings of each word, later parts marked ##; a word that can't be cut so is unknown."""
    out: list[int] = []
    for word in basic_tokens(text):
        ids, at = [], 0
        while at < len(word) <= longest:
            end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
            if end is None:
                break
            ids.append(vocabulary[("##" if at else "") + word[at:end]])
            at = end
        out += ids if at == len(word) else [vocabulary[unknown]]
    return out


def with_wordpieces(df: DataFrame, text: str, vocabulary: dict[str, int], into: str = "ids") -> DataFrame:
    """df with the ids of a text; null for a null text. The vocabulary goes to each worker with the function."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else wordpieces(t, vocabulary) for t in texts], dtype="object")

    return df.withColumn(into, run(F.col(text)))
