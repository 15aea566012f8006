"""Quality rules: counts of a text's words, signs and repeats, and a trained n-gram classifier.

The classifier is a logistic regression over hashed word 1- and 2-grams and character 3- and 4-grams (code points, case
kept). Each of the four families gives the mean weight of its n-grams in the whole text, so texts of any length
compare. It is trained on a bounded sample of labelled rows (``sample`` of each class, those with the smallest
hashes of doc_id, and of these as many as ``sample_bytes`` hold), and its scores become probabilities by a logistic
curve that is fitted on the fifth of the sample that training did not see, weighted to the classes' real shares.
Scoring runs in Arrow batches.

Defined results: a null text has no words and fails the base rules; unless the sample's training part and its fifth
both hold rows of both classes, every text gets the probability 1, so only the base rules reject. Ids with labels of
both classes are not learnt from; repeated labels of an id count once; of rows that repeat a labelled id, that with
the smallest text is learnt from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, blocks, mix64, release, trimmed, tune

BUCKETS = 1 << 18
FAMILIES = 4
SPACE = " \t\n\r\x0b\x0c"
SIGNS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


# --- counts -----------------------------------------------------------------------------


def counts_of(text: str | None, codes: np.ndarray) -> tuple[int, int, int, int, int]:
    """COUNTS of one text, whose words have these codes."""
    if not text:
        return 0, 0, 0, 0, 0
    chars = len(text) - sum(map(text.count, SPACE))
    signs = sum(map(text.count, SIGNS))
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    again = 0
    if len(codes) >= 4:
        if codes.max() < 1 << 21:
            window = (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]
        else:  # a text of millions of different words
            pair = np.unique((codes[:-2] << 32) | codes[1:-1], return_inverse=True)[1]
            window = (pair << 32) | codes[2:]
        _, which, n = np.unique(window, return_inverse=True, return_counts=True)
        if len(n) < len(window):
            twice = n[which] > 1
            hit = np.zeros(len(codes), bool)
            for k in range(3):
                hit[k : len(codes) - 2 + k] |= twice
            again = int(hit.sum())
    return len(codes), chars, signs, len(lines) - len(set(lines)), again


def word_codes(texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes]]:
    """Each text's words (runs of other than ASCII white space) as codes, and the words by code."""
    table: dict[bytes, int] = {}
    out = []
    for t in texts:
        words = t.encode("utf-8", "surrogatepass").split() if t else []
        out.append(np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words)))
    return out, list(table)


# --- n-grams ------------------------------------------------------------------------------


def grams(texts: list[str | None], codes: list[np.ndarray], words: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each family: the buckets of all texts' n-grams in turn, and how many each text has."""
    import zlib

    hashes = mix64(np.fromiter(map(zlib.crc32, words), np.uint64, len(words)) + np.uint64(1 << 40))
    flat, size = [[] for _ in range(FAMILIES)], [[] for _ in range(FAMILIES)]
    with np.errstate(over="ignore"):
        for t, c in zip(texts, codes):
            h = hashes[c]
            pair = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
            x = np.frombuffer((t or "").encode("utf-32-le", "surrogatepass"), np.uint32)
            y = x * np.uint32(0x85EBCA6B)
            three = y[:-2] * np.uint32(0x01000193) + (y[1:-1] << np.uint32(7)) + (y[2:] >> np.uint32(3)) if len(x) > 2 else x[:0]
            four = three[:-1] * np.uint32(0xC2B2AE35) + y[3:] if len(x) > 3 else x[:0]
            for k, v in enumerate((h >> np.uint64(46), pair >> np.uint64(46), three >> np.uint32(14), four >> np.uint32(14))):
                flat[k].append(v.astype(np.int32))
                size[k].append(len(v))
    return [np.concatenate(f) if f else np.zeros(0, np.int32) for f in flat], [np.array(s, np.int64) for s in size]


@dataclass(frozen=True)
class QualityModel:
    """weights: FAMILIES x BUCKETS; probability = logistic(slope * score + shift)."""

    weights: np.ndarray
    slope: float
    shift: float

    def scores(self, texts, codes, words) -> np.ndarray:
        z = np.zeros(len(texts))
        for w, f, n in zip(self.weights, *grams(texts, codes, words)):
            some = np.flatnonzero(n)
            if len(some):
                z[some] += np.add.reduceat(w[f].astype(np.float64), (np.cumsum(n) - n)[some]) / n[some]
        return z

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -60, 60)))


#: Keeps every text: what there is without labelled rows of both classes.
KEEPS_ALL = QualityModel(np.zeros((FAMILIES, BUCKETS), np.float32), 0.0, 60.0)


# --- training -----------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, sample: int, key: str = "doc_id", where=None) -> tuple[DataFrame, dict[int, int]]:
    """(key, text, label) of at most ``sample`` rows of each class, by hash of the key, and the classes' sizes.

    Ids that have labels of both classes are in neither; an id is one row, with its smallest text.
    """
    known = labels.select(F.col(key), F.col(column).cast("int").alias("label")).where(F.col(key).isNotNull() & F.col("label").isin(0, 1))
    known = known if where is None else known.where(where)
    known = known.groupBy(key).agg(F.min("label").alias("label"), F.max("label").alias("_most")).where("label = _most").drop("_most")
    sizes = {int(c): int(n) for c, n in known.groupBy("label").count().collect()}
    order = [F.xxhash64(F.lit(7), F.col(key)), F.col(key)]
    chosen = known.where("label = 0").orderBy(*order).limit(sample).unionAll(known.where("label = 1").orderBy(*order).limit(sample))
    rows = docs.select(key, "text").join(F.broadcast(chosen), key)  # at most 2 x sample rows of two numbers
    return rows.groupBy(key, "label").agg(F.min("text").alias("text")).select(key, "text", "label"), sizes


def train_quality(docs: DataFrame, labels: DataFrame, sample: int = 800, key: str = "doc_id", column: str = "quality", sample_bytes: int = 64 << 20) -> QualityModel:
    """sample, sample_bytes: labelled rows of each class, and bytes of all their n-grams, that training reads at most;
    the bound of what comes to the driver. Rows beyond sample_bytes, in the order of the hash, are not learnt from."""
    spark = docs.sparkSession
    tune(spark)
    rows, sizes = labelled_sample(docs, labels, column, sample, key)
    if min(sizes.get(0, 0), sizes.get(1, 0)) < 1:
        return KEEPS_ALL

    def featurize(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            out = []
            for i, j in blocks(texts, 200_000):
                codes, words = word_codes(texts[i:j])
                flat, size = grams(texts[i:j], codes, words)
                ends = [np.cumsum(n) for n in size]
                for r in range(j - i):
                    at, share = [], []
                    for k in range(FAMILIES):
                        u, c = np.unique(flat[k][ends[k][r] - size[k][r] : ends[k][r]], return_counts=True)
                        at.append(u.astype(np.int64) + k * BUCKETS)
                        share.append(c / max(1, size[k][r]))
                    out.append((np.concatenate(at).astype("<i4").tobytes(), np.concatenate(share).astype("<f4").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(2), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.binary())], ["k", "label", "at", "share"])

    keep = Scratch(spark)
    found = keep(rows.select(F.col(key).cast("long"), "text", "label").mapInArrow(trimmed(featurize), "k long, label int, at binary, share binary"))
    upto = F.sum(F.length("at") + F.length("share")).over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit(7), "k"), "k"))  # 2 x sample rows
    bounded = found.withColumn("upto", upto).where(F.col("upto") <= sample_bytes // 2).drop("upto")
    model = fit_quality(bounded.toArrow().sort_by("k"), sizes)
    keep.drop(found)
    release(spark)
    return model


def flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column's rows in turn, and how many each row has."""
    one = column.combine_chunks()
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    ends = np.frombuffer(one.buffers()[1], "<i4")[one.offset : one.offset + len(one) + 1].astype(np.int64)
    return np.frombuffer(one.buffers()[2], kind)[ends[0] // 4 : ends[-1] // 4], np.diff(ends) // 4


def spans(size: np.ndarray, most: int = 1 << 20):
    """(first row, row after the last, first number, number after the last) of runs of rows with about so many numbers."""
    stop = np.cumsum(size)
    i = 0
    while i < len(size):
        begin = int(stop[i] - size[i])
        j = max(i + 1, int(np.searchsorted(stop, begin + most, side="right")))
        yield i, j, begin, int(stop[j - 1])
        i = j


def fit_quality(rows: pa.Table, sizes: dict[int, int]) -> QualityModel:
    """The model of rows (label, at, share): buckets of n-grams and their shares in the text, as 4-byte numbers.

    Memory: the rows' bytes twice, and work space for a run of rows.
    """
    y = rows.column("label").to_numpy().astype(np.float64)
    held = np.arange(len(y)) % 5 == 0
    if min((y[~held] == 0).sum(), (y[~held] == 1).sum(), (y[held] == 0).sum(), (y[held] == 1).sum()) < 1:
        return KEEPS_ALL
    at, size = flat(rows.column("at"), "<i4")
    share, _ = flat(rows.column("share"), "<f4")
    n = int((~held).sum())
    of = lambda i, j: np.repeat(np.arange(i, j), size[i:j])
    # n-grams of one training text only say nothing about other texts
    seen = np.zeros(FAMILIES * BUCKETS, np.int64)
    for i, j, p, q in spans(size):
        seen += np.bincount(at[p:q][~held[of(i, j)]], minlength=len(seen))
    seen = seen >= 2
    d = int(seen.sum())
    number = (np.cumsum(seen) - 1).astype(np.int32)
    col = np.empty(sum(int(seen[at[p:q]].sum()) for _, _, p, q in spans(size)), np.int32)
    val, count, k = np.empty(len(col), np.float32), np.zeros(len(y), np.int64), 0
    total, square = np.zeros(d), np.zeros(d)
    for i, j, p, q in spans(size):
        m = seen[at[p:q]]
        row, c, v = of(i, j)[m], number[at[p:q][m]], share[p:q][m]
        col[k : k + len(c)], val[k : k + len(c)] = c, v
        k += len(c)
        count += np.bincount(row, minlength=len(y))
        t = ~held[row]
        total += np.bincount(c[t], weights=v[t], minlength=d)
        square += np.bincount(c[t], weights=v[t].astype(np.float64) ** 2, minlength=d)
    # each column to unit deviation, so that rare and frequent n-grams count alike before the penalty
    dev = np.sqrt(np.maximum(square / n - (total / n) ** 2, 0)) + 1e-4
    for p in range(0, len(col), 1 << 20):
        val[p : p + (1 << 20)] /= dev[col[p : p + (1 << 20)]]
    weight = np.where(y == 1, 0.5 / max(1, (y[~held] == 1).sum()), 0.5 / max(1, (y[~held] == 0).sum()))
    weight[held] = 0
    w, b = _logistic(count, col, val, y, weight, d, penalty=3e-6)
    z = products(count, col, val, w) + b
    real = np.array([sizes[0], sizes[1]], np.float64)
    h = np.flatnonzero(held)
    share_h = np.array([(y[h] == c).sum() for c in (0, 1)])
    slope, shift = platt(z[h], y[h], np.where(y[h] == 1, real[1] / share_h[1], real[0] / share_h[0]))
    full = np.zeros(FAMILIES * BUCKETS)
    full[seen] = w / dev
    return QualityModel(full.reshape(FAMILIES, BUCKETS).astype(np.float32), slope, slope * b + shift)


def products(size: np.ndarray, col: np.ndarray, val: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Each row's sum of val x w[col]; rows have ``size`` entries in turn."""
    out = np.zeros(len(size))
    for i, j, p, q in spans(size):
        some = i + np.flatnonzero(size[i:j])
        if len(some):
            first = np.cumsum(size[i:j]) - size[i:j]
            out[some] = np.add.reduceat(val[p:q] * w[col[p:q]], first[some - i])
    return out


def _logistic(size, col, val, y, weight, d, penalty, steps=80):
    """Weighted logistic regression by accelerated gradient steps; no randomness."""
    w, b, v, vb, at = np.zeros(d), 0.0, np.zeros(d), 0.0, 1.0
    norm = np.zeros(len(y))
    for i, j, p, q in spans(size):
        norm += np.bincount(np.repeat(np.arange(i, j), size[i:j]), weights=val[p:q].astype(np.float64) ** 2, minlength=len(y))
    rate = 1 / (0.25 * float((weight * (norm + 1)).sum()) + penalty)
    for _ in range(steps):
        z = products(size, col, val, v) + vb
        g = weight * (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y)
        slope = penalty * v
        for i, j, p, q in spans(size):
            slope += np.bincount(col[p:q], weights=val[p:q] * np.repeat(g[i:j], size[i:j]), minlength=d)
        new, newb = v - rate * slope, vb - rate * g.sum()
        nxt = (1 + np.sqrt(1 + 4 * at * at)) / 2
        v, vb = new + (at - 1) / nxt * (new - w), newb + (at - 1) / nxt * (newb - b)
        w, b, at = new, newb, nxt
    return w, b


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """slope and shift of the logistic curve for P(y = 1 | z), by Newton steps with smoothed targets."""
    pos, neg = weight[y == 1].sum(), weight[y == 0].sum()
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = z.std() or 1.0
    x = np.stack([z / scale, np.ones_like(z)], 1)
    p = np.array([1.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        g = x.T @ (weight * (q - target)) / weight.sum() + 1e-4 * p
        h = (x * (weight * np.maximum(q * (1 - q), 1e-6))[:, None]).T @ x / weight.sum() + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return float(max(p[0], 0) / scale), float(p[1])


# --- scoring ------------------------------------------------------------------------------


def score_quality(df: DataFrame, model: QualityModel, threshold: float = 0.5, min_words: int = 50, repeat_percent: int = 50, text: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """df (or its columns ``keep``) with COUNTS, base_failed, quality_score and kept, with prefix before these names;
    columns of df that have the new names are replaced.

    base_failed: fewer than min_words words, or more than repeat_percent of them in 3-word windows that come again.
    kept: the base rules hold and the probability of good quality is at least threshold.
    """
    tune(df.sparkSession)
    new = {prefix + c for c in (*COUNTS, "base_failed", "quality_score", "kept")}
    names = [c for c in (df.columns if keep is None else keep) if c not in new]
    source = df.select(*names) if text in names else df.select(*names, F.col(text).alias("_text"))
    at, k = (names.index(text) if text in names else len(names)), len(names)
    kinds = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("quality_score", T.DoubleType()), ("kept", T.BooleanType())]
    schema = T.StructType([*df.select(*names).schema.fields, *[T.StructField(prefix + n, t) for n, t in kinds]])
    shared = df.sparkSession.sparkContext.broadcast(model)  # 4 MB, whatever the table's size

    def score(batches):
        m = shared.value
        for b in batches:
            texts = b.column(at).to_pylist()
            for i, j in blocks(texts, 500_000):
                codes, words = word_codes(texts[i:j])
                n = np.array([counts_of(t, c) for t, c in zip(texts[i:j], codes)], np.int64)
                p = m.probability(m.scores(texts[i:j], codes, words))
                failed = (n[:, 0] < min_words) | (100 * n[:, 4] > repeat_percent * n[:, 0])
                found = [*map(pa.array, n.T), pa.array(failed), pa.array(p), pa.array(~failed & (p >= threshold))]
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[:k]], *found], names=schema.names)

    return source.mapInArrow(trimmed(score), schema)

