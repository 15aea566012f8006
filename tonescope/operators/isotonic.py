"""Isotonic regression by pooled blocks: each range of values pools its own neighbours, then blocks pool over range ends."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "low double, high double, total double, n double"
NAMES = ["low", "high", "total", "n"]


def pool(low: np.ndarray, high: np.ndarray, total: np.ndarray, n: np.ndarray, held: list | None = None) -> list[list[float]]:
    """Blocks in order, each with a larger mean than the one before; those that violate it are pooled."""
    held = [] if held is None else held
    for block in zip(low.tolist(), high.tolist(), total.tolist(), n.tolist()):
        now = list(block)
        while held and held[-1][2] * now[3] >= now[2] * held[-1][3]:  # mean of the last >= mean of this
            last = held.pop()
            now = [last[0], now[1], last[2] + now[2], last[3] + now[3]]
        held.append(now)
    return held


def _pooled(batches):
    held: list[list[float]] = []
    for b in batches:
        pool(*(b.column(i).to_numpy() for i in range(4)), held)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], NAMES)


@dataclass
class Isotonic:
    """The curve: knots with equal values inside blocks, straight lines between them, constant beyond the ends."""

    x: np.ndarray
    y: np.ndarray

    @classmethod
    def fit(cls, df: DataFrame, label: str, p: str) -> Isotonic:
        """Of rows with both values. Equal values of p are one block from the start.

        A range's rows never meet those of another: only its blocks go on. The means of blocks of 0/1 labels are growing
        fractions, so n rows leave some n^(2/3) blocks at most, however many values differ.
        """
        parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        tied = df.where(F.col(label).isNotNull() & F.col(p).isNotNull()).groupBy(F.col(p).cast("double").alias("low")).agg(F.sum(F.col(label).cast("double")).alias("total"), F.count("*").cast("double").alias("n"))
        ranged = tied.select("low", F.col("low").alias("high"), "total", "n").repartitionByRange(parts, "low").sortWithinPartitions("low").mapInArrow(_pooled, BLOCK)
        blocks = ranged.repartition(1).sortWithinPartitions("low").mapInArrow(_pooled, BLOCK).toPandas()
        value = (blocks.total / blocks.n).to_numpy()
        wide = (blocks.high > blocks.low).to_numpy()
        order = np.argsort(np.concatenate([np.arange(len(blocks)) * 2, np.flatnonzero(wide) * 2 + 1]))
        return cls(np.concatenate([blocks.low, blocks.high[wide]])[order], np.concatenate([value, value[wide]])[order])

    def values(self, v: np.ndarray) -> np.ndarray:
        """The curve at v; missing values, and those of a curve without knots, are NaN."""
        return np.interp(v, self.x, self.y) if len(self.x) else np.full(len(v), np.nan)

    def transform(self, df: DataFrame, p: str, name: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.x, self.y))  # of the size of the blocks

        @F.pandas_udf("double")
        def curve(column: pd.Series) -> pd.Series:
            x, y = shared.value
            v = column.to_numpy(float, na_value=np.nan)
            out = pd.Series(np.interp(v, x, y) if len(x) else np.full(len(v), np.nan))
            return out.where(~np.isnan(v), None) if len(x) else pd.Series([None] * len(v), dtype=float)

        return df.withColumn(name, curve(F.col(p).cast("double")))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(pd.DataFrame({"x": self.x, "y": self.y}), "x double, y double").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Isotonic:
        rows = spark.read.parquet(path).toPandas().sort_values("x")
        return cls(rows.x.to_numpy(), rows.y.to_numpy())
