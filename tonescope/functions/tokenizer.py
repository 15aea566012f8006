"""Tokens of masked headlines for small encoders: basic split, word pieces, and fixed-length ids."""

from __future__ import annotations

import functools
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN, LONGEST = "[UNK]", 100


def _plain(texts: pd.Series) -> pd.Series:
    """Canonical decomposition without combining marks; there is no such built-in function."""
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))


def strip_marks(text: Column) -> Column:
    def plain(texts: pd.Series) -> pd.Series:
        return _plain(texts)

    return F.pandas_udf(plain, T.StringType())(text)


def without_accents(text: str) -> str:
    """Compatibility decomposition without combining characters, as vectorizers of scikit-learn do it."""
    return text if text.isascii() else unicodedata.normalize("NFKD", text).translate(_combining())


@functools.lru_cache(maxsize=1)
def _combining() -> dict[int, None]:
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}


def strip_accents(text: Column) -> Column:
    def plain(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else without_accents(t))

    return F.pandas_udf(plain, T.StringType())(text)


def basic_tokens(text: Column) -> Column:
    """Lower-case words without accents; each sign of punctuation or symbol is a token."""
    return F.regexp_extract_all(F.lower(strip_marks(text)), F.lit(r"[\p{P}\p{S}]|[^\s\p{Z}\p{P}\p{S}]+"), F.lit(0))


def pieces_of(word: str, vocabulary: dict[str, int]) -> list[str]:
    """Longest pieces from the left, those inside a word with ## in front; the unknown token if a part is in no piece."""
    out: list[str] = []
    begin = 0
    while begin < len(word) <= LONGEST:
        head = "##" if begin else ""
        end = next((e for e in range(len(word), begin, -1) if head + word[begin:e] in vocabulary), None)
        if end is None:
            return [UNKNOWN]
        out.append(head + word[begin:end])
        begin = end
    return out if begin == len(word) else [UNKNOWN]


def word_piece_ids(df: DataFrame, tokens: str, vocabulary: list[str]) -> DataFrame:
    """df with ``piece_ids``; a word's pieces are looked up once for each batch."""
    known = df.sparkSession.sparkContext.broadcast({p: i for i, p in enumerate(vocabulary)})  # one model's vocabulary

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(column: pd.Series) -> pd.Series:
        table, seen = known.value, {}

        def of(word: str) -> list[int]:
            if word not in seen:
                seen[word] = [table.get(p, table[UNKNOWN]) for p in pieces_of(word, table)]
            return seen[word]

        return column.map(lambda ws: None if ws is None else [i for w in ws for i in of(w)])

    return df.withColumn("piece_ids", ids(F.col(tokens)))


def encode(ids: Column, length: int, start: int, end: int, padding: int) -> tuple[Column, Column]:
    """(input ids, attention mask) of a fixed length: start, as many pieces as there is room for, end, padding."""
    body = F.concat(F.array(F.lit(start)), F.slice(ids, 1, length - 2), F.array(F.lit(end)))
    room = F.lit(length) - F.size(body)
    return F.concat(body, F.array_repeat(F.lit(padding), room)), F.concat(F.array_repeat(F.lit(1), F.size(body)), F.array_repeat(F.lit(0), room))
