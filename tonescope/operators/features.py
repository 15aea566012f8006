"""Words, word runs and characters of headlines, weighed as scikit-learn's vectorizers weigh them, as sparse rows."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PARAMS
from ..functions import rules
from ..functions.text import let
from ..functions.tokenizer import strip_accents, without_accents
from .linear import BLOCKS, GROUP, block, scores, sparse_parts
from .store import dropped, small_batches, stored, trimmed

#: What a word boundary parts, the same as (?U)\w in the JVM; white space alike.
WORD = regex.compile(r"[\p{Alphabetic}\p{M}\p{Nd}\p{Pc}\p{Join_Control}]{2,}")
SOLID = regex.compile(r"[^\p{White_Space}]+")
VOCABULARY = "kind string, place int, term string, idf double"
#: Terms of a task's table at which it passes them on.
MOST_TERMS = 200_000


def word_grams(text: Column | str, most: int = PARAMS.word_ngram_max) -> Column:
    """Words of two characters or more of lower-case text, then their runs of 2 to most words; the words are found once."""

    def runs(found: Column, n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.size(found) - n + 1), lambda i: F.array_join(F.slice(found, i, n), " "))
        return F.when(F.size(found) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(F.regexp_extract_all(text, F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda found: F.concat(found, *[runs(found, n) for n in range(2, most + 1)]))


def idf_table(df: DataFrame, headline: str = "headline", most: int = PARAMS.word_ngram_max) -> DataFrame:
    """(term, df, idf) of masked lower-case runs of 1 to most words without accents; idf = ln((1 + n) / (1 + df)) + 1."""
    plain = df.select(strip_accents(F.lower(rules.mask_entities(headline))).alias("text"))
    terms = plain.select(F.array_distinct(word_grams("text", most)).alias("terms"))
    counts = terms.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    total = df.agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(total)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row


def masked(headline: Column | str) -> Column:
    """What the models read: headlines that differ only in an entity are one to them."""
    return F.lower(rules.mask_entities(headline))


def grams_of(text: str, most: int = PARAMS.word_ngram_max) -> list[str]:
    """Words and word runs of a masked text without accents."""
    found = WORD.findall(without_accents(text))
    return found + [" ".join(found[i : i + n]) for n in range(2, most + 1) for i in range(len(found) - n + 1)]


def chars_in(word: str, low: int = PARAMS.char_ngram_min, high: int = PARAMS.char_ngram_max) -> list[str]:
    """Runs of low to high characters of a word with a space at either end."""
    w = f" {word} "
    return [w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def chars_of(text: str) -> list[str]:
    """Those of all words of a masked text."""
    return list(chain.from_iterable(map(chars_in, SOLID.findall(text))))


KINDS = ("grams", "chars")


class Coder:
    """Numbers for the terms of texts: ``find`` gives a term's number. Each distinct word's runs are looked up once,
    while the table of words is not full."""

    def __init__(self, find: dict[str, Callable[[str], int]], most_words: int = 50_000):
        self.find, self.most_words = find, most_words
        self.words: dict[str, np.ndarray] = {}

    def __call__(self, text: str) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Of each kind the numbers of a text's terms, each once, and how often each comes."""
        grams = grams_of(text)
        out = {"grams": np.unique(np.fromiter(map(self.find["grams"], grams), np.int64, len(grams)), return_counts=True)}
        words = Counter(SOLID.findall(text))
        if len(self.words) > self.most_words:
            self.words.clear()
        each = []
        for w in words:
            if (codes := self.words.get(w)) is None:
                runs = chars_in(w)
                codes = self.words[w] = np.fromiter(map(self.find["chars"], runs), np.int64, len(runs))
            each.append(codes)
        codes = np.concatenate(each) if each else np.zeros(0, np.int64)
        places, at = np.unique(codes, return_inverse=True)
        weights = np.repeat(np.fromiter(words.values(), np.int64, len(words)), [len(x) for x in each])
        out["chars"] = places, np.bincount(at, weights, len(places)).astype(np.int64) if len(places) else places
        return out


class _Numbers(dict):
    """Numbers for terms in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _count_terms(batches):
    """(kind, term, tf, df) of a task's texts, passed on whenever a table is full."""

    def fresh():
        tables = {k: _Numbers() for k in KINDS}
        return tables, Coder({k: t.__getitem__ for k, t in tables.items()}), {k: np.zeros((2, 1024), np.int64) for k in KINDS}

    tables, coder, counts = fresh()

    def passed_on():
        for kind, table in tables.items():
            if table:
                tf, df = counts[kind][:, : len(table)]
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(table)), pa.array(list(table)), pa.array(tf), pa.array(df)], ["kind", "term", "tf", "df"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for kind, (places, n) in coder(text or "").items():
                while counts[kind].shape[1] < len(tables[kind]):
                    counts[kind] = np.concatenate([counts[kind], np.zeros_like(counts[kind])], 1)
                counts[kind][0, places] += n
                counts[kind][1, places] += 1
            if max(map(len, tables.values())) >= MOST_TERMS:
                yield from passed_on()
                tables, coder, counts = fresh()
    yield from passed_on()


@dataclass
class Runs:
    """Numbers of runs of symbols. A level holds the beginnings of so many symbols: the code of each is its place on the
    level before, times the number of symbols, plus its last symbol; and the run's number, or -1 if it only begins others."""

    symbols: int
    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, table: np.ndarray, length: np.ndarray, symbols: int) -> Runs:
        """Of runs as rows of a table, each of so many symbols."""
        levels, node, symbols = [], np.zeros(len(table), np.int64), max(1, symbols)
        for n in range(1, table.shape[1] + 1):
            there = np.flatnonzero(length >= n)
            codes, at = np.unique(node[there] * symbols + table[there, n - 1], return_inverse=True)
            node[there], number = at, np.full(len(codes), -1, np.int64)
            ends = there[length[there] == n]
            number[node[ends]] = ends
            levels.append((codes, number))
        return cls(symbols, levels)

    def find(self, symbol: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) of all runs in a row of symbols (-1: none that is known); no run goes on in another group."""
        place, node = np.arange(len(symbol)), np.zeros(len(symbol), np.int64)
        places, numbers = [place[:0]], [node[:0]]
        for n, (codes, number) in enumerate(self.levels):
            inside = place + n < len(symbol)
            place, node = place[inside], node[inside]
            last = symbol[place + n]
            code = np.where((last >= 0) & (group[place] == group[place + n]), node * self.symbols + last, -1)
            at = np.searchsorted(codes, code)
            known = codes[np.minimum(at, len(codes) - 1)] == code if len(codes) else np.zeros(len(code), bool)
            place, node = place[known], at[known]
            ends = number[node] >= 0
            places.append(place[ends])
            numbers.append(number[node[ends]])
        return np.concatenate(places), np.concatenate(numbers)


@dataclass
class Encoder:
    """Texts to sparse rows, some texts at a time. Terms are found as runs of numbers, of words and of characters, by arrays:
    texts hold many words that a worker never saw before, whose characters a table of strings would look up one by one."""

    words: dict[str, int]
    letters: np.ndarray  # of code points
    runs: dict[str, Runs]
    idf: dict[str, np.ndarray]

    @classmethod
    def of(cls, terms: dict[str, list[str]], idf: dict[str, np.ndarray]) -> Encoder:
        grams = [t.split(" ") for t in terms["grams"]]
        words = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(grams)))}
        length = {"grams": np.fromiter(map(len, grams), np.int64, len(grams)), "chars": np.fromiter(map(len, terms["chars"]), np.int64, len(terms["chars"]))}
        points = _points("".join(terms["chars"]))
        letters = np.full(int(points.max(initial=0)) + 1, -1, np.int64)
        known = np.unique(points)
        letters[known] = np.arange(len(known))
        flat = {"grams": np.fromiter((words[w] for g in grams for w in g), np.int64, int(length["grams"].sum())), "chars": letters[points]}
        runs = {}
        for kind, symbols in (("grams", len(words)), ("chars", len(known))):
            table = np.zeros((len(length[kind]), int(length[kind].max(initial=0))), np.int64)
            table[np.arange(table.shape[1]) < length[kind][:, None]] = flat[kind]
            runs[kind] = Runs.of(table, length[kind], symbols)
        return cls(words, letters, runs, idf)

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sparse rows as (places, values, ends from a leading 0 on): counts times weights, each kind of length 1."""
        size = sum(map(len, self.idf.values()))
        text, word, n = self._grams(texts), self._words(texts), len(self.idf["grams"])
        key = np.concatenate([text[0] * size + text[1], word[0] * size + n + word[1]])
        count = np.concatenate([np.ones(len(text[0])), word[2]])
        order = np.argsort(key)
        key, count = key[order], count[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        key, count = key[first], np.add.reduceat(count, first) if len(first) else count
        row, place = key // size if size else key, key % size if size else key
        value = count * np.concatenate([self.idf["grams"], self.idf["chars"]])[place]
        part = 2 * row + (place >= n)  # a row's terms of one kind
        value /= np.sqrt(np.bincount(part, value * value, 2 * len(texts)))[part]
        return place, value, np.searchsorted(row, np.arange(len(texts) + 1))

    def _grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, number) of all words and word runs."""
        found = [WORD.findall(without_accents(t or "")) for t in texts]
        group = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        symbol = np.fromiter((self.words.get(w, -1) for f in found for w in f), np.int64, len(group))
        place, number = self.runs["grams"].find(symbol, group)
        return group[place], number

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, number, count) of the runs of characters in each of a text's distinct words, which are counted first."""
        each = [Counter(SOLID.findall(t or "")) for t in texts]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(each)))}
        point = _points("".join(f" {w} " for w in distinct))
        symbol = np.where(point < len(self.letters), self.letters[np.minimum(point, len(self.letters) - 1)], -1)
        place, number = self.runs["chars"].find(symbol, np.repeat(np.arange(len(distinct)), [len(w) + 2 for w in distinct]))
        of = np.repeat(np.arange(len(distinct)), [len(w) + 2 for w in distinct])[place]
        number = number[np.argsort(of, kind="stable")]
        size = np.bincount(of, minlength=len(distinct))
        text = np.repeat(np.arange(len(texts)), [len(c) for c in each])
        word = np.fromiter((distinct[w] for c in each for w in c), np.int64, len(text))
        count = np.fromiter((n for c in each for n in c.values()), float, len(text))
        n = size[word]
        at = np.arange(int(n.sum())) + np.repeat((np.cumsum(size) - size)[word] - (np.cumsum(n) - n), n)
        return np.repeat(text, n), number[at], np.repeat(count, n)

    def blocks(self, texts: list[str | None], chars: int = 200_000):
        """encoded() of some texts at a time, so that memory is bounded."""
        begin, size = 0, 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= chars or i + 1 == len(texts):
                yield begin, i + 1, *self.encoded(texts[begin : i + 1])
                begin, size = i + 1, 0


def _points(text: str) -> np.ndarray:
    """A text's code points."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


@dataclass
class TextFeatures:
    """The most frequent terms of each kind, at most so many, with their weights; sparse rows hold the words' terms first."""

    terms: dict[str, list[str]]
    idf: dict[str, np.ndarray]

    @property
    def size(self) -> int:
        return sum(len(t) for t in self.terms.values())

    @classmethod
    def fit(cls, rows: DataFrame, text: str, max_features: int = PARAMS.max_features) -> TextFeatures:
        """From masked texts. Terms are ranked by how often they occur, then by themselves; the driver gets those kept."""
        small_batches(rows.sparkSession)
        n = rows.count()
        found = rows.select(text).mapInArrow(trimmed(_count_terms), "kind string, term string, tf long, df long")
        counts = stored(found.groupBy("kind", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")))  # both kinds' terms come of it
        terms, idf = {}, {}
        for kind in KINDS:
            top = counts.where(F.col("kind") == kind).orderBy(F.desc("tf"), "term").limit(max_features).select("term", "df").toArrow()
            terms[kind] = top.column("term").to_pylist()
            idf[kind] = np.log((1 + n) / (1 + top.column("df").to_numpy())) + 1
        dropped(counts)  # all terms of all texts
        return cls(terms, idf)

    def encoder(self) -> Encoder:
        """What executors need of the terms, made once."""
        if "_encoder" not in self.__dict__:
            self._encoder = Encoder.of(self.terms, self.idf)
        return self._encoder

    def encoded(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.encoder().encoded(texts)

    def sparse(self, rows: DataFrame, text: str, targets: str) -> DataFrame:
        """Blocks of masked texts' sparse rows and their targets, stored."""
        shared = rows.sparkSession.sparkContext.broadcast(self.encoder())  # the vocabulary, at most max_features of each kind

        def task(batches):
            encoder = shared.value
            for b in batches:
                goals, ends = sparse_parts(b.column(1))
                goals = goals.reshape(len(ends) - 1, -1)
                for begin, end, idx, val, upto in encoder.blocks(b.column(0).to_pylist()):
                    yield block(idx, val.astype(np.float32), upto, goals[begin:end])

        out = stored(rows.select(text, F.col(targets).alias("targets")).mapInArrow(trimmed(task), BLOCKS), **GROUP)
        shared.destroy()
        return out

    def scored(self, rows: DataFrame, text: Column, weights: np.ndarray, name: str) -> DataFrame:
        """rows with an array of each head's score of a masked text."""
        return rows.withColumn(name, self.scoring(rows.sparkSession, weights, "array<double>", list)(text))

    def scoring(self, spark: SparkSession, weights: np.ndarray, kind: str, answer: Callable):
        """A function of columns: of a masked text and numbers, what ``answer`` makes of the heads' scores (rows, heads) and of
        each column of numbers. All of it is one step in one worker of a task, which gives its memory back."""
        small_batches(spark)
        shared = spark.sparkContext.broadcast((self.encoder(), weights, answer))

        def task(batches):
            encoder, w, answer = shared.value
            for texts, *numbers in batches:
                parts = [scores(*block, w) for _, _, *block in encoder.blocks(texts.where(texts.notna(), None).to_list())]
                z = np.concatenate([np.zeros((0, len(w))), *parts])
                yield pd.Series(answer(z, *[c.to_numpy(float, na_value=np.nan) for c in numbers]), dtype=object if kind.startswith("array") else float)

        def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            return trimmed(task)(batches)

        def one(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            return trimmed(task)((b,) for b in batches)

        return lambda text, *numbers: F.pandas_udf(run if numbers else one, kind)(text, *numbers)

    def save(self, spark: SparkSession, path: str) -> None:
        table = pd.DataFrame([(k, i, t, float(w)) for k in KINDS for i, (t, w) in enumerate(zip(self.terms[k], self.idf[k]))], columns=["kind", "place", "term", "idf"])
        spark.createDataFrame(table, VOCABULARY).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TextFeatures:
        rows = spark.read.schema(VOCABULARY).parquet(path).toPandas().sort_values(["kind", "place"])
        of = {k: rows[rows.kind == k] for k in KINDS}
        return cls({k: of[k].term.to_list() for k in KINDS}, {k: of[k].idf.to_numpy() for k in KINDS})
