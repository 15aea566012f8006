"""Clickbait models: TF-IDF, logistic regression, boosted trees on rule features, calibration, and students of a teacher."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PARAMS
from ..functions import rules
from . import linear
from .boosting import Trees, fit_trees
from .features import TextFeatures, idf_table, masked
from .isotonic import Isotonic
from .linear import sigmoid
from .store import dropped, stored

__all__ = ["Calibrator", "Heads", "Scorer", "blend", "fit_heads", "fit_logistic", "fit_scorer", "fit_stack", "idf_table", "stacked", "with_logistic", "with_stack"]

STACKED = [*rules.FEATURES, "lr_prob"]


def logit(p, off: float = 1e-6):
    """Of a probability, which is kept a little off 0 and 1."""
    q = F.greatest(F.lit(off), F.least(F.lit(1 - off), p))
    return F.log(q / (1 - q))


@dataclass
class Heads:
    """Linear heads over the TF-IDF of words, word runs and characters; a row of weights for each, the intercept last."""

    features: TextFeatures
    weights: np.ndarray
    names: list[str]

    def predict(self, df: DataFrame, headline: str = "headline") -> DataFrame:
        """df with a column of logits for each head."""
        keep = df.columns
        rows = self.features.scored(df, masked(headline), self.weights, "_heads")
        return rows.select(*[c for c in keep if c not in self.names], *[F.col("_heads")[i].alias(n) for i, n in enumerate(self.names)])

    def save(self, spark: SparkSession, path: str) -> None:
        self.features.save(spark, f"{path}/vocabulary")
        head, place = np.nonzero(self.weights)
        table = pd.DataFrame({"head": head.astype("int32"), "place": place.astype("int32"), "weight": self.weights[head, place]})
        spark.createDataFrame(table, "head int, place int, weight double").write.mode("overwrite").parquet(f"{path}/weights")
        spark.createDataFrame([(i, n) for i, n in enumerate(self.names)], "head int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/heads")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Heads:
        features = TextFeatures.load(spark, f"{path}/vocabulary")
        names = [r["name"] for r in spark.read.parquet(f"{path}/heads").orderBy("head").collect()]
        weights = np.zeros((len(names), features.size + 1))
        table = spark.read.parquet(f"{path}/weights").toPandas()
        weights[table["head"], table["place"]] = table["weight"]
        return cls(features, weights, names)


def fit_heads(train: DataFrame, targets: dict[str, tuple[str, object]], headline: str = "headline", penalty: float | None = None, c: float = 1.0, max_features: int = PARAMS.max_features, iterations: int = PARAMS.lr_iterations, tolerance: float = 1e-6) -> Heads:
    """Heads for targets (name -> (column, loss of ``linear``)). Sparse rows are stored once; missing targets add nothing.

    The penalty is 1 / (c n) if not given, as of a regression whose summed loss weighs c.
    """
    columns = [F.coalesce(F.col(t).cast("double"), F.lit(float("nan"))) for t, _ in targets.values()]
    rows = stored(train.select(masked(headline).alias("text"), F.array(*columns).alias("targets")))
    features = TextFeatures.fit(rows, "text", max_features)
    sparse = features.sparse(rows, "text", "targets")
    penalty = 1.0 / (c * max(1, rows.count())) if penalty is None else penalty
    dropped(rows)
    weights = linear.fit_heads(sparse, features.size, [loss for _, loss in targets.values()], penalty, iterations, tolerance)
    dropped(sparse)
    return Heads(features, weights, list(targets))


def fit_logistic(train: DataFrame, label: str, headline: str = "headline", c: float = 1.0, iterations: int = PARAMS.lr_iterations) -> Heads:
    """A logistic regression over TF-IDF with an L2 penalty of 1 / (c n)."""
    return fit_heads(train, {"_lr": (label, linear.logistic)}, headline, c=c, iterations=iterations)


def probability_of(z: np.ndarray, *_) -> np.ndarray:
    """Of the first head's logits, as small as numbers can be."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-z[:, 0]))


def with_logistic(model: Heads, df: DataFrame, headline: str = "headline") -> DataFrame:
    """df with ``lr_prob`` and the rules' features, both of the masked text."""
    rows = df.withColumn("lr_prob", model.features.scoring(df.sparkSession, model.weights, "double", probability_of)(masked(headline)))
    return rules.with_features(rows.withColumn("_named", rules.mask_entities(headline)), "_named").drop("_named")


def stacked(model: Heads, train: DataFrame, label: str) -> DataFrame:
    """What trees are grown from: the rules' features, lr_prob and the label, computed once and stored."""
    return stored(with_logistic(model, train).select(label, *STACKED))


def fit_stack(scored: DataFrame, label: str, trees: int = PARAMS.gbt_trees, rate: float = PARAMS.gbt_rate, leaves: int = PARAMS.gbt_leaves) -> Trees:
    """Boosted trees over the rules' features and the regression's probability."""
    return fit_trees(scored, STACKED, label, trees, rate, leaves)


def with_stack(model: Trees, scored: DataFrame) -> DataFrame:
    return model.predict(scored, "gbt_prob")


class Calibrator:
    """Isotonic regression from ``least`` rows on, else a logistic curve."""

    def __init__(self, df: DataFrame, label: str, p: str, least: int = 200):
        rows = df.select(F.col(label).cast("double").alias("label"), F.col(p).cast("double").alias("p")).where("label IS NOT NULL AND p IS NOT NULL")
        n = rows.count()
        self.method = "isotonic" if n >= least else "sigmoid"
        if self.method == "isotonic":
            self.model = Isotonic.fit(rows, "label", "p")
        else:
            one = stored(rows.select(F.array(F.lit(0)).alias("idx"), F.array("p").alias("val"), F.array("label").alias("targets")))
            self.model = linear.fit_heads(one, 1, [linear.logistic], 1e-6 / max(1, n), tolerance=1e-9)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Calibrator:
        out = cls.__new__(cls)
        out.method = spark.read.parquet(f"{path}/method").first()["method"]
        if out.method == "isotonic":
            out.model = Isotonic.load(spark, f"{path}/isotonic")
        else:
            out.model = np.array([list(spark.read.parquet(f"{path}/sigmoid").first())])
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        if self.method == "isotonic":
            self.model.save(spark, f"{path}/isotonic")
        else:
            spark.createDataFrame([tuple(self.model[0].tolist())], "slope double, intercept double").coalesce(1).write.mode("overwrite").parquet(f"{path}/sigmoid")
        spark.createDataFrame([(self.method,)], "method string").coalesce(1).write.mode("overwrite").parquet(f"{path}/method")

    @property
    def curve(self) -> Callable[[np.ndarray], np.ndarray]:
        """The curve as a function of arrays."""
        return self.model.values if self.method == "isotonic" else functools.partial(_sigmoid_curve, *self.model[0].tolist())

    def transform(self, df: DataFrame, p: str) -> DataFrame:
        if self.method == "isotonic":
            out = self.model.transform(df, p, "calibrated")
        else:
            slope, intercept = self.model[0].tolist()
            out = df.withColumn("calibrated", 1 / (1 + F.exp(-(F.lit(slope) * F.col(p) + intercept))))
        return out.withColumn("calibrated", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "calibrated")))


def _sigmoid_curve(slope: float, intercept: float, p: np.ndarray) -> np.ndarray:
    return sigmoid(slope * p + intercept)


def _boosted(stack: Trees, curve: Callable | None, z: np.ndarray, *features: np.ndarray) -> np.ndarray:
    """The trees' probability of the rules' features and the regression's logits, on the calibration's curve if there is one."""
    p = sigmoid(stack.margin(np.stack([*features, probability_of(z)], 1)))
    return p if curve is None else np.clip(curve(p), 0.0, 1.0)


@dataclass(frozen=True)
class Scorer:
    """The whole model: regression over text, boosted trees over rules and regression, calibration."""

    logistic: Heads
    stack: Trees
    calibrator: Calibrator | None = None

    def predict(self, df: DataFrame, headline: str = "headline", calibrated: bool = True) -> DataFrame:
        """df with ``probability``; entities are masked before anything is computed."""
        keep = df.columns
        rows = df.select(F.struct(*keep).alias("_row"), rules.mask_entities(headline).alias("_named"))
        rows = rules.with_features(rows, "_named")
        calibrator = self.calibrator if calibrated else None
        answer = functools.partial(_boosted, self.stack, calibrator.curve if calibrator else None)
        scored = self.logistic.features.scoring(df.sparkSession, self.logistic.weights, "double", answer)
        return rows.select("_row.*", scored(F.lower("_named"), *[F.col(f) for f in rules.FEATURES]).alias("probability")).select(*[c for c in keep if c != "probability"], "probability")

    def save(self, spark: SparkSession, folder: str) -> None:
        self.logistic.save(spark, f"{folder}/logistic")
        self.stack.save(spark, f"{folder}/stack")
        if self.calibrator is not None:
            self.calibrator.save(spark, f"{folder}/calibrator")
        spark.createDataFrame([(self.calibrator is not None,)], "calibrated boolean").coalesce(1).write.mode("overwrite").parquet(f"{folder}/parts")

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Scorer:
        calibrated = spark.read.parquet(f"{folder}/parts").first()["calibrated"]
        return cls(Heads.load(spark, f"{folder}/logistic"), Trees.load(spark, f"{folder}/stack"), Calibrator.load(spark, f"{folder}/calibrator") if calibrated else None)


def fit_scorer(train: DataFrame, validation: DataFrame, label: str, trees: int = PARAMS.gbt_trees, iterations: int = PARAMS.lr_iterations) -> Scorer:
    """Regression and trees of the training rows, calibration of the validation rows."""
    logistic = fit_logistic(train, label, iterations=iterations)
    stack = fit_stack(stacked(logistic, train, label), label, trees=trees)
    raw = stored(Scorer(logistic, stack).predict(validation, calibrated=False).select(label, "probability"))
    return Scorer(logistic, stack, Calibrator(raw, label, "probability"))


def blend(binary, intensity):
    """What a page badge shows: the mean of both heads."""
    return 0.5 * F.col(binary) + 0.5 * F.col(intensity)
