"""Boosted trees that grow leaf by leaf over binned features.

Values become bins between quantiles, and rows that are equal then are one row with its counts, stored once. All trees are
grown in one barrier stage: its tasks hold their rows' bins, and add up histograms of the leaves that may be split next.
A leaf's larger gain goes first, until a tree has its leaves; every task takes the same decisions from the same sums. If a
task is lost Spark runs the stage again.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PARAMS
from .linear import sigmoid
from .store import stored

#: Distinct rows that a task of the barrier stage holds, about, as long as there are slots for more tasks.
TASK_ROWS = 250_000
#: What a leaf must hold: rows, and the sum of p (1 - p) over them. Fixed values of the boosting library that is matched.
LEAST_ROWS, LEAST_WEIGHT = 20, 1e-3
MOST_BINS = 255

TREES = "tree int, node int, feature int, bin int, low int, high int, value double"


def bin_edges(df: DataFrame, features: list[str], most: int = MOST_BINS) -> list[np.ndarray]:
    """Upper edges of each feature's bins: its quantiles, each value its own bin where there are few."""
    shares = F.lit([i / most for i in range(1, most)])
    row = df.agg(*[F.percentile_approx(F.col(f).cast("double"), shares, 20 * most).alias(f) for f in features]).first()
    return [np.unique(np.array(row[f] or [], float)) for f in features]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many edges are below it. Missing values are the least."""
    out = np.empty(values.shape, np.int16)
    for f, e in enumerate(edges):
        x = values[:, f]
        out[:, f] = np.searchsorted(e, np.where(np.isnan(x), -np.inf, x), side="left")
    return out


@dataclass
class Leaf:
    rows: np.ndarray
    hist: np.ndarray  # of each bin of each feature: sums of slopes, weights and rows
    gain: float = 0.0
    feature: int = -1
    bin: int = -1
    low: Leaf | None = None
    high: Leaf | None = None
    node: int = -1


class Grower:
    """Grows one tree after the other on a task's rows; ``add_up`` adds arrays of all tasks."""

    def __init__(self, bins: np.ndarray, n_bins: list[int], pos: np.ndarray, count: np.ndarray, rate: float, leaves: int, add_up: Callable[[np.ndarray], np.ndarray]):
        self.begin = np.concatenate([[0], np.cumsum(n_bins)]).astype(np.int64)
        self.codes = bins.astype(np.int64) + self.begin[:-1]
        self.feature = np.repeat(np.arange(len(n_bins)), n_bins)
        self.last = np.zeros(int(self.begin[-1]), bool)
        self.last[self.begin[1:] - 1] = True
        self.pos, self.count, self.rate, self.leaves, self.add_up = pos.astype(float), count.astype(float), rate, leaves, add_up
        total = add_up(np.array([self.pos.sum(), self.count.sum()]))
        share = min(1 - 1e-15, max(1e-15, total[0] / max(total[1], 1)))
        self.base = math.log(share / (1 - share))
        self.score = np.full(len(bins), self.base)

    def histogram(self, rows: np.ndarray) -> np.ndarray:
        codes = self.codes[rows].ravel()
        n = len(self.feature)
        return np.stack([np.bincount(codes, np.repeat(x[rows], self.codes.shape[1]), n) for x in (self.grad, self.hess, self.count)])

    def best(self, leaf: Leaf) -> Leaf:
        """leaf with its best cut: rows of the feature's bins up to one go low."""
        upto = np.cumsum(leaf.hist, 1)
        before = np.concatenate([np.zeros((3, 1)), upto], 1)[:, self.begin[:-1]]
        low = upto - before[:, self.feature]
        whole = (upto[:, self.begin[1:] - 1] - before)[:, self.feature]
        high = whole - low
        fits = ~self.last & (np.minimum(low[2], high[2]) >= LEAST_ROWS) & (np.minimum(low[1], high[1]) >= LEAST_WEIGHT)
        if fits.any():
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(fits, low[0] ** 2 / low[1] + high[0] ** 2 / high[1] - whole[0] ** 2 / whole[1], -np.inf)
            at = int(gain.argmax())
            leaf.gain, leaf.feature, leaf.bin = float(gain[at]), int(self.feature[at]), int(at - self.begin[self.feature[at]])
        return leaf

    def expand(self, leaves: list[Leaf]) -> None:
        """The parts that the leaves' best cuts make, in one exchange: low parts are summed, high parts are the rest."""
        for leaf in leaves:
            is_low = self.codes[leaf.rows, leaf.feature] - self.begin[leaf.feature] <= leaf.bin
            leaf.low, leaf.high = Leaf(leaf.rows[is_low], np.zeros(0)), Leaf(leaf.rows[~is_low], np.zeros(0))
        sums = self.add_up(np.stack([self.histogram(leaf.low.rows) for leaf in leaves]))
        for leaf, hist in zip(leaves, sums):
            leaf.low.hist, leaf.high.hist = hist, leaf.hist - hist
            self.best(leaf.low)
            self.best(leaf.high)

    def tree(self) -> list[tuple[int, int, int, int, int, float]]:
        """(node, feature, bin, low node, high node, value) of one more tree; the scores follow it."""
        p = sigmoid(self.score)
        self.grad, self.hess = self.count * p - self.pos, self.count * p * (1 - p)
        every = np.arange(len(self.score))
        root = self.best(Leaf(every, self.add_up(self.histogram(every)), node=0))
        open_, inner = [root], []
        while len(open_) < self.leaves:
            leaf = max(open_, key=lambda x: x.gain)
            if leaf.gain <= 1e-12:
                break
            if leaf.low is None:
                self.expand([x for x in open_ if x.low is None and x.gain > 1e-12])
            at = next(i for i, x in enumerate(open_) if x is leaf)
            leaf.low.node, leaf.high.node = 2 * len(inner) + 1, 2 * len(inner) + 2
            open_[at : at + 1] = [leaf.low, leaf.high]
            inner.append(leaf)
        out = [(x.node, x.feature, x.bin, x.low.node, x.high.node, 0.0) for x in inner]
        for x in open_:
            grad, hess = x.hist[:2, : self.begin[1]].sum(1)
            value = -self.rate * grad / hess if hess > 0 else 0.0
            self.score[x.rows] += value
            out.append((x.node, -1, -1, -1, -1, value))
        return sorted(out)


def _grow(n_bins: list[int], trees: int, rate: float, leaves: int) -> Callable:
    """The barrier stage's task: rows of (bins, positives, rows) to the trees, which the first task passes on."""

    def task(batches):
        from pyspark import BarrierTaskContext

        here = BarrierTaskContext.get()
        n = len(here.getTaskInfos())

        def add_up(x: np.ndarray) -> np.ndarray:
            if n == 1:
                return x
            parts = here.allGather(base64.b64encode(x.tobytes()).decode())
            return np.sum([np.frombuffer(base64.b64decode(p)).reshape(x.shape) for p in parts], 0)

        bins, pos, count = [np.zeros((0, len(n_bins)), np.int16)], [np.zeros(0)], [np.zeros(0)]
        for b in batches:
            bins.append(np.frombuffer(b"".join(b.column(0).to_pylist()), np.int16).reshape(-1, len(n_bins)))
            pos.append(b.column(1).to_numpy())
            count.append(b.column(2).to_numpy())
        grower = Grower(np.concatenate(bins), n_bins, np.concatenate(pos), np.concatenate(count), rate, leaves, add_up)
        rows = [(-1, 0, -1, -1, -1, -1, grower.base)]
        for t in range(trees):
            rows += [(t, *node) for node in grower.tree()]
        if here.partitionId() == 0:
            kinds = (pa.int32(),) * 6 + (pa.float64(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["tree", "node", "feature", "bin", "low", "high", "value"])

    return task


@dataclass
class Trees:
    """Trees as arrays; node numbers run on through all trees."""

    features: list[str]
    edges: list[np.ndarray]
    table: pd.DataFrame

    def __post_init__(self):
        t = self.table.sort_values(["tree", "node"], kind="stable")
        self.base = float(t[t.tree < 0].value.iloc[0])
        t = t[t.tree >= 0]
        sizes = t.groupby("tree").size().to_numpy()
        self.roots = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        shift = np.repeat(self.roots, sizes)
        self.feature, self.bin, self.value = t.feature.to_numpy(), t.bin.to_numpy(), t.value.to_numpy()
        self.low, self.high = t.low.to_numpy() + shift, t.high.to_numpy() + shift

    def margin(self, values: np.ndarray) -> np.ndarray:
        bins = binned(values, self.edges)
        every, out = np.arange(len(values)), np.full(len(values), self.base)
        for root in self.roots.tolist():
            at = np.full(len(values), root)
            going = every[self.feature[at] >= 0]
            while len(going):
                node = at[going]
                at[going] = np.where(bins[going, self.feature[node]] <= self.bin[node], self.low[node], self.high[node])
                going = going[self.feature[at[going]] >= 0]
            out += self.value[at]
        return out

    def predict(self, df: DataFrame, name: str = "gbt_prob") -> DataFrame:
        """df with the probability of label 1."""
        shared = df.sparkSession.sparkContext.broadcast(self)  # as many nodes as the settings allow

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            return pd.Series(sigmoid(shared.value.margin(np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], 1))))

        return df.withColumn(name, probability(*[F.col(f).cast("double") for f in self.features]))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.table, TREES).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/trees")
        edges = [(i, f, e.tolist()) for i, (f, e) in enumerate(zip(self.features, self.edges))]
        spark.createDataFrame(edges, "place int, feature string, edges array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Trees:
        edges = spark.read.parquet(f"{path}/edges").orderBy("place").collect()
        return cls([r["feature"] for r in edges], [np.array(r["edges"], float) for r in edges], spark.read.schema(TREES).parquet(f"{path}/trees").toPandas())


def fit_trees(df: DataFrame, features: list[str], label: str, trees: int = PARAMS.gbt_trees, rate: float = PARAMS.gbt_rate, leaves: int = PARAMS.gbt_leaves, most_bins: int = MOST_BINS) -> Trees:
    """Boosted trees for a label of 0 or 1. Missing values are the least; rows without label don't count."""
    spark = df.sparkSession
    rows = df.where(F.col(label).isNotNull())
    edges = bin_edges(rows, features, most_bins)

    @F.pandas_udf("binary")
    def packed(*columns: pd.Series) -> pd.Series:
        bins = binned(np.stack([c.to_numpy(float, na_value=np.nan) for c in columns], 1), edges)
        return pd.Series([x.tobytes() for x in bins])

    bins = rows.select(packed(*[F.col(f).cast("double") for f in features]).alias("bins"), F.col(label).cast("double").alias("y"))
    distinct = stored(bins.groupBy("bins").agg(F.sum("y").alias("pos"), F.count("*").cast("double").alias("n")).select("bins", "pos", "n"))
    tasks = max(1, min(spark.sparkContext.defaultParallelism, math.ceil(distinct.count() / TASK_ROWS)))
    grown = distinct.repartition(tasks).mapInArrow(_grow([len(e) + 1 for e in edges], trees, rate, leaves), TREES, barrier=True)
    return Trees(list(features), edges, grown.toPandas())
