"""Toxicity by weak supervision.

1. Labelled rows give lexicons: words, word beginnings of 4 to 6 letters, and beginnings that several different words
   of a text share, that are far more frequent in toxic texts than in others.
2. Many voters look at a text: each lexicon, split into several, votes "toxic" if one of its terms occurs; pattern
   voters vote on how many different terms occur, on their absence, on shouting and on repeated signs.
3. A generative label model estimates, without labels, how often each voter fires on toxic and on other texts, by
   expectation maximization; voters that agree more than the model explains are correlated, and share their weight.
4. A logistic regression over words and word beginnings is trained on the model's posterior labels, of the sample's
   texts and of its single words that hold a term, and its probability is every text's score.

Labels are read only for step 1's counts and the share of toxic rows; step 3 and 4 see votes and posteriors.

Defined results: a null text scores as an empty one, which is what the classifier gives without features; without
labelled rows of both classes, or without terms, every score is 0. Ids with labels of both classes are not learnt from;
repeated labels of an id count once; of rows that repeat a labelled id, that with the smallest text is learnt from.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks, mix64, release, trimmed, tune
from .quality import labelled_sample

WORD = re.compile(r"[^\W\d_]+").findall
PREFIXES = (4, 5, 6)
#: Marks of beginnings: of a word, of several different words.
BEGINNING = "-+"
WORD_PARTS, PREFIX_PARTS = 6, 2


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels nothing may learn from: crc32 of the key as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(F.encode(F.col(key).cast("string"), "utf-8")) % 5 == 0, F.lit(True))


def features_of(word: str) -> list[str]:
    """A lower-case word, and its beginnings, marked by a hyphen, if it is longer than they are."""
    return [word, *[word[:n] + "-" for n in PREFIXES if len(word) > n]]


def text_features(words: set[str]) -> set[str]:
    """Those of a text's words, and with a plus the beginnings that two or more different words have: by chance a word
    begins like a stem, but a text that uses the stem has several words of it."""
    times = Counter(w[:n] for w in words for n in PREFIXES if len(w) > n)
    return {f for w in words for f in features_of(w)} | {b + "+" for b, c in times.items() if c > 1}


def text_words(text: str | None) -> list[str]:
    return WORD(text.lower()) if text else []


def _part(term: str) -> int:
    """The lexicon voter of a term: by its kind and a hash."""
    h = sum(map(ord, term)) * 2654435761 % 2**32 >> 8
    if term[-1] not in BEGINNING:
        return h % WORD_PARTS
    return WORD_PARTS + PREFIXES.index(len(term) - 1) * PREFIX_PARTS + h % PREFIX_PARTS


LEXICONS = WORD_PARTS + len(PREFIXES) * PREFIX_PARTS
#: Pattern voters: two or more terms, no word term, no beginning, shouting, repeated signs.
VOTERS = LEXICONS + 5


def votes_of(text: str | None, present: set[str], terms: dict[str, int]) -> list[int]:
    """1 toxic, -1 not toxic, 0 abstains, for each voter. present: the features of the text's words."""
    out = [0] * VOTERS
    hits = [t for t in present if t in terms]
    for t in hits:
        out[terms[t]] = 1
    words = [t for t in hits if t[-1] not in BEGINNING]
    distinct = len(words) + len({t[: PREFIXES[0]] for t in hits if t[-1] in BEGINNING}) + any(t[-1] == "+" for t in hits)
    out[LEXICONS] = 1 if distinct >= 2 else -1 if not distinct else 0
    out[LEXICONS + 1] = 0 if words else -1
    out[LEXICONS + 2] = 0 if len(hits) > len(words) else -1
    letters = sum(map(str.isalpha, text)) if text else 0
    out[LEXICONS + 3] = 1 if letters >= 20 and sum(map(str.isupper, text)) > 0.6 * letters else 0
    out[LEXICONS + 4] = 1 if text and re.search(r"[!?]{3}", text) else 0
    return out


# --- the label model ------------------------------------------------------------------------


@dataclass(frozen=True)
class LabelModel:
    """P(vote | class) of each voter (voters x votes -1, 0, 1 x classes), the share of toxic, and each voter's weight."""

    table: np.ndarray
    prior: float
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        odds = math.log(self.prior / (1 - self.prior)) + sum(self.weight[j] * np.log(self.table[j, votes[:, j] + 1, 1] / self.table[j, votes[:, j] + 1, 0]) for j in range(votes.shape[1]))
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


def fit_label_model(votes: np.ndarray, prior: float, rounds: int = 30) -> LabelModel:
    """Expectation maximization from the votes' majority; correlations come from what the classes leave unexplained."""
    n, k = votes.shape
    prior = min(max(prior, 0.01), 0.99)
    weight, rho = np.ones(k), np.eye(k)
    lean = votes.sum(1) + 1e-3
    p = np.where(votes.max(1) > 0, 1 / (1 + np.exp(-np.clip(lean, -8, 8))), 0.02)
    model = None
    for _ in range(rounds):
        table = np.empty((k, 3, 2))
        for v in (-1, 0, 1):
            is_v = votes == v
            table[:, v + 1, 1] = is_v.T @ p + 0.1
            table[:, v + 1, 0] = is_v.T @ (1 - p) + 0.1
        table /= table.sum(1, keepdims=True)
        # residuals against the class means; voters that move together beyond them are correlated
        mean = table[:, 2] - table[:, 0]
        res = votes - (p[:, None] * mean[:, 1] + (1 - p)[:, None] * mean[:, 0])
        dev = np.sqrt((res**2).mean(0)) + 1e-6
        rho = (res / dev).T @ (res / dev) / max(n, 1)
        weight = 1 / (1 + (np.clip(np.abs(rho), 0, 1) * (np.abs(rho) > 0.1)).sum(1) - np.clip(np.abs(np.diag(rho)), 0, 1) * (np.abs(np.diag(rho)) > 0.1))
        model = LabelModel(table, prior, weight, rho)
        new = model.posterior(votes)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


# --- training -------------------------------------------------------------------------------


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -60.0
    terms: dict[str, int] = field(default_factory=dict)
    label_model: LabelModel | None = None


def train_toxicity(docs: DataFrame, labels: DataFrame, sample: int = 1500, key: str = "doc_id", column: str = "toxic") -> ToxicityModel:
    """sample: labelled rows of each class that training reads at most. Rows of the held-out fold are never read.

    Texts stay with the tasks. The driver gets the hashes of their words and features, then the names of the features
    that several texts have, then the words that hold a term.
    """
    spark = docs.sparkSession
    tune(spark)
    rows, sizes = labelled_sample(docs, labels, column, sample, key, where=~held_out(key))
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 1:
        return ToxicityModel()
    keep = Scratch(spark)
    rows = keep(rows.select(F.col(key).cast("long").alias("k"), "text", "label"))

    def hashes(batches):
        for b in batches:
            out = []
            for t in b.column(1).to_pylist():
                words = set(text_words(t))
                out.append([np.unique(np.fromiter(map(hash_of, x), "<u4", len(x))).tobytes() for x in (words, text_features(words))] + votes_of(t, set(), {})[LEXICONS + 3 :])
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *[pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)]], ["k", "label", "words", "features", "loud", "signs"])

    got = rows.mapInArrow(trimmed(hashes), "k long, label int, words binary, features binary, loud int, signs int").toArrow().sort_by("k")
    labels_, words = got.column("label").to_numpy(), [np.frombuffer(x, "<u4") for x in got.column("words").to_pylist()]
    # copies with one label would make chance words look telling; a copy with the other label tells the most
    unlike = np.sort(np.concatenate([(at := np.flatnonzero(labels_ == c))[different([words[i] for i in at])] for c in (0, 1)]))
    got = got.take(pa.array(unlike))
    if not len(got) or not 0 < got.column("label").to_numpy().sum() < len(got):
        return ToxicityModel()
    value, times = np.unique(np.frombuffer(b"".join(got.column("features").to_pylist()), "<u4"), return_counts=True)
    often = spark.sparkContext.broadcast(value[times >= LEAST_TEXTS])  # features of the sample's texts

    def names(batches):
        known = set(often.value.tolist())
        for b in batches:
            found = [" ".join(sorted(f for f in text_features(set(text_words(t))) if hash_of(f) in known)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found)], ["k", "features"])

    named = rows.mapInArrow(trimmed(names), "k long, features string").toArrow().sort_by("k").take(pa.array(unlike))
    one: dict[str, str] = {}
    of = [[one.setdefault(f, f) for f in x.split(" ")] if x else [] for x in named.column("features").to_pylist()]

    def holding(terms: dict[str, int]) -> list[str]:
        shared = spark.sparkContext.broadcast(terms)

        def hold(batches):
            for b in batches:
                words = {w for t in b.column(1).to_pylist() for w in set(text_words(t)) if any(f in shared.value for f in features_of(w))}
                yield pa.RecordBatch.from_arrays([pa.array(sorted(words), pa.string())], ["word"])

        kept = spark.createDataFrame([(int(k),) for k in got.column("k").to_pylist()], "k long")
        return sorted(r["word"] for r in rows.join(F.broadcast(kept), "k", "left_semi").mapInArrow(trimmed(hold), "word string").distinct().collect())

    model = fit_toxicity(of, got.column("label").to_numpy(), np.stack([got.column("loud").to_numpy(), got.column("signs").to_numpy()], 1), sizes[1] / (sizes[0] + sizes[1]), holding)
    keep.drop(rows)
    del got, named, of, one, words
    release(spark)
    return model


#: A feature that fewer texts of the sample have tells nothing.
LEAST_TEXTS = 4


def fit_toxicity(of: list[list[str]], labels: np.ndarray, signs: np.ndarray, share: float, holding, least: float = 25.0) -> ToxicityModel:
    """of: each text's features. holding: terms -> the texts' words that hold one.

    least: the log-likelihood ratio (G squared) from which a feature is taken to go with toxic texts or with others.
    """
    n = [int((labels == c).sum()) for c in (0, 1)]
    found = telling(of, labels.astype(np.float64), least)
    df = [Counter(f for fs, y in zip(of, labels) if y == c for f in fs if f in found) for c in (0, 1)]
    # a term is one with which most texts are toxic, at the whole table's share of toxic rows
    terms = {f: _part(f) for f, (more, _) in found.items() if more and df[1][f] * share / n[1] > 3 * (df[0][f] + 0.25) * (1 - share) / n[0]}
    if not terms:
        return ToxicityModel()
    votes = np.array([votes_of(None, {f for f in fs if f in terms}, terms) for fs in of], np.int64)
    votes[:, LEXICONS + 3 :] = signs
    # the sample has as many toxic rows as it can; the model learns at the sample's own share
    label_model = fit_label_model(votes, n[1] / sum(n))
    p = label_model.posterior(votes)
    names = list(telling(of, p, least))
    # most toxic texts hold several terms; words that hold one are texts by themselves, so that one can be enough, but not
    # where a stem tells by several of its words
    stems = tuple(t[:-1] for t in terms if t[-1] == "+")
    alone = [features_of(w) for w in holding({t: v for t, v in terms.items() if t[-1] != "+" and not t.startswith(stems)})]
    votes = np.array([votes_of(None, set(fs), terms) for fs in alone], np.int64).reshape(-1, VOTERS)
    weights, bias = _linear([*of, *alone], np.concatenate([p, label_model.posterior(votes)]), names, 0.5)
    return ToxicityModel(weights, bias, terms, label_model)


def different(words: list[np.ndarray], alike: float = 0.4) -> np.ndarray:
    """Indices of texts whose sets of word hashes are not nearly those of an earlier one (Jaccard of alike or more)."""
    if not words:
        return np.zeros(0, np.int64)
    value, times = np.unique(np.concatenate(words), return_counts=True)
    rare = value[times <= max(8, 0.05 * len(words))]
    seen: dict[tuple[int, int, int], list[int]] = {}
    sets: dict[int, np.ndarray] = {}
    for i, ws in enumerate(words):
        mine = np.intersect1d(ws, rare, assume_unique=True)
        mine = mine if len(mine) else ws
        h = mine.astype(np.uint64)
        least = [int(mix64(h + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min()) if len(h) else 0 for k in range(20)]
        keys = [(k, least[k], least[k + 1]) for k in range(0, 20, 2)]
        both = [len(np.intersect1d(mine, sets[j], assume_unique=True)) / max(1, len(mine) + len(sets[j])) for j in {j for k in keys for j in seen.get(k, ())}]
        if any(x / (1 - x) >= alike for x in both) or (not len(h) and seen.get(keys[0])):
            continue
        sets[i] = mine
        for k in keys:
            seen.setdefault(k, []).append(i)
    return np.array(sorted(sets), np.int64)


def hash_of(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def telling(of: list[list[str]], p: np.ndarray, least: float) -> dict[str, tuple[bool, float]]:
    """Features whose presence goes with p (1 toxic) beyond chance: whether it is more frequent there, and G squared."""
    one, all_ = Counter(), Counter()
    for fs, q in zip(of, p):
        all_.update(fs)
        if q > 0.01:
            for f in fs:
                one[f] += q
    share = float(np.clip(p.mean(), 1e-6, 1 - 1e-6))
    out = {}
    for f, c in all_.items():
        if c < LEAST_TEXTS:
            continue
        a = float(one[f])
        g = 2 * ((a * math.log(a / (c * share)) if a > 0 else 0) + ((c - a) * math.log((c - a) / (c * (1 - share))) if c - a > 1e-9 else 0))
        if g >= least:
            out[f] = (a > c * share, g)
    return out


def _linear(of: list[list[str]], p: np.ndarray, names: list[str], share: float, penalty: float = 1e-5, steps: int = 1000) -> tuple[dict[str, float], float]:
    """Logistic regression on posterior labels over the presence of the named features, by accelerated gradient steps."""
    n, names = len(p), sorted(names)
    number = {f: i for i, f in enumerate(names)}
    hits = [[number[f] for f in fs if f in number] for fs in of]
    row = np.repeat(np.arange(n), [len(h) for h in hits])
    col = np.array([i for h in hits for i in h], np.int64)
    df = np.bincount(col, minlength=len(names))
    scale = 1 / np.sqrt(df / n + 0.01)  # rare features move as fast as frequent ones
    val = scale[col]
    # the classes weigh as in the whole table, not as in the sample
    weight = share * p / max(p.sum(), 1e-9) + (1 - share) * (1 - p) / max((1 - p).sum(), 1e-9)
    rate = 1 / (0.25 * float((weight * (np.bincount(row, weights=val**2, minlength=n) + 1)).sum()) + penalty)
    w, b, v, vb, at = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0, 1.0
    for _ in range(steps):
        g = weight * (1 / (1 + np.exp(-np.clip(np.bincount(row, weights=val * v[col], minlength=n) + vb, -40, 40))) - p)
        new, newb = v - rate * (np.bincount(col, weights=val * g[row], minlength=len(names)) + penalty * v), vb - rate * g.sum()
        nxt = (1 + math.sqrt(1 + 4 * at * at)) / 2
        v, vb = new + (at - 1) / nxt * (new - w), newb + (at - 1) / nxt * (newb - b)
        w, b, at = new, newb, nxt
    real = w * scale
    return {f: float(x) for f, x in zip(names, real) if abs(x) > 1e-6}, float(b)


# --- scoring --------------------------------------------------------------------------------


class Scorer:
    """Scores of texts; what a word adds is kept for the words seen so far."""

    def __init__(self, model: ToxicityModel, most: int = 300_000):
        self.weights, self.bias, self.most = model.weights, model.bias, most
        self.words: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {}

    def score(self, text: str | None) -> float:
        if len(self.words) > self.most:
            self.words.clear()
        found: set[str] = set()
        begun: set[str] = set()
        for w in set(text_words(text)):
            if (known := self.words.get(w)) is None:
                stems = (w[:n] + "+" for n in PREFIXES if len(w) > n)
                known = self.words[w] = tuple(f for f in features_of(w) if f in self.weights), tuple(f for f in stems if f in self.weights)
            found.update(known[0])
            for f in known[1]:
                (found if f in begun else begun).add(f)
        z = self.bias + math.fsum(self.weights[f] for f in found)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """df (or its columns ``keep``) with ``score`` and ``predicted`` (score >= 0.5), from the text alone.

    prefix goes before the new names; columns of df that have them are replaced.
    """
    tune(df.sparkSession)
    names = [c for c in (df.columns if keep is None else keep) if c not in (f"{prefix}score", f"{prefix}predicted")]
    source = df.select(*names) if text in names else df.select(*names, F.col(text).alias("_text"))
    at, n = (names.index(text) if text in names else len(names)), len(names)
    schema = T.StructType([*df.select(*names).schema.fields, T.StructField(f"{prefix}score", T.DoubleType()), T.StructField(f"{prefix}predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # some thousand features at most

    def score(batches):
        scorer = Scorer(shared.value)
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, j in blocks(texts, 4_000_000):
                s = np.array([scorer.score(t) for t in texts[i:j]], np.float64)
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[:n]], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=schema.names)

    return source.mapInArrow(trimmed(score), schema)
