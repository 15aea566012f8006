"""Does an article deliver what its headline promises? Windows of the body, a pluggable scorer, and a verdict."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PARAMS
from ..functions.text import col, normalize, windows, words


def body_window_rows(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ("doc_id", "headline")) -> DataFrame:
    """(keep..., n_windows, idx, window) for each window; a body without sentences has none."""
    found = windows(body, PARAMS.body_window_sents, PARAMS.max_windows)
    return df.select(*keep, found.alias("_w")).select(*keep, F.size("_w").alias("n_windows"), F.posexplode("_w").alias("idx", "window"))


def overlap_scorer(rows: DataFrame) -> DataFrame:
    """rows with entail and contradict, from shared words. Transparent, and no inference of meaning: the share of the
    headline's words that the window has, and half of what is missing where the window negates."""
    head, body = (F.array_distinct(words(normalize(c))) for c in ("headline", "window"))
    share = F.size(F.array_intersect(head, body)) / F.greatest(F.lit(1), F.size(head))
    negates = F.arrays_overlap(body, F.array(*[F.lit(w) for w in ("not", "no", "never", "none")]))
    return rows.withColumn("entail", share).withColumn("contradict", F.when(negates, (1 - share) / 2).otherwise(0.0))


@dataclass(frozen=True)
class PairModel:
    """An inference model in a worker: logits of (premise, hypothesis) pairs, a row for each, and its labels by column, as
    its configuration names them."""

    logits: Callable[[list[str], list[str]], np.ndarray]
    labels: dict[int, str]


def label_places(labels: dict[int, str]) -> tuple[int, int | None]:
    """The columns of entailment and of contradiction, which models order as they like; a model may lack the second."""
    named = {i: name.lower() for i, name in labels.items()}
    entail = next((i for i, name in sorted(named.items()) if "entail" in name and "not" not in name), None)
    if entail is None:
        raise ValueError(f"no label of {labels} tells entailment")
    return entail, next((i for i, name in sorted(named.items()) if "contra" in name), None)


@functools.lru_cache(maxsize=2)
def _loaded(load: Callable[[], PairModel]) -> PairModel:
    """One for each worker, for as long as it lives."""
    return load()


def model_scorer(load: Callable[[], PairModel], batch: int = 64) -> Callable[[DataFrame], DataFrame]:
    """A scorer for delivery_gap() by an inference model: windows are premises, headlines hypotheses.

    ``load``, a function that workers can import, is called once in each of them. Pairs go to the model ``batch`` at a time.
    A model without a label for contradiction tells none (0); a null headline is an empty one.
    """

    @F.pandas_udf("entail double, contradict double")
    def probabilities(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = _loaded(load)
        entail, contra = label_places(model.labels)
        for windows_, heads in parts:
            out = [np.zeros((0, len(model.labels)))]
            for at in range(0, len(windows_), batch):
                z = np.asarray(model.logits(windows_[at : at + batch].fillna("").to_list(), heads[at : at + batch].fillna("").to_list()), float)
                e = np.exp(z - z.max(1, keepdims=True))
                out.append(e / e.sum(1, keepdims=True))
            p = np.concatenate(out)
            yield pd.DataFrame({"entail": p[:, entail], "contradict": p[:, contra] if contra is not None else np.zeros(len(p))})

    def score(rows: DataFrame) -> DataFrame:
        scored = rows.withColumn("_p", probabilities("window", "headline"))
        return scored.withColumns({c: F.col(f"_p.{c}") for c in ("entail", "contradict")}).drop("_p")

    return score


_PLAIN = re.compile("[^a-z0-9 ]+")


def shared_words_model() -> PairModel:
    """The rule of overlap_scorer() as a model: it stands where an inference model plugs in, and infers no meaning."""

    def logits(premises: list[str], hypotheses: list[str]) -> np.ndarray:
        out = np.empty((len(premises), 3))
        for i, (premise, head) in enumerate(zip(premises, hypotheses)):
            body, words_ = (set(_PLAIN.sub("", t.lower()).split()) for t in (premise, head))
            share = len(words_ & body) / max(1, len(words_))
            contra = (1 - share) / 2 if body & {"not", "no", "never", "none"} else 0.0
            out[i] = contra, 1 - share - contra, share
        return np.log(np.maximum(out, 1e-300))

    return PairModel(logits, {0: "CONTRADICTION", 1: "NEUTRAL", 2: "ENTAILMENT"})


def verdict(delivery: Column | str, contradiction: Column | str) -> Column:
    d, c = col(delivery), col(contradiction)
    return F.when(d >= 0.6, "delivered").when((c >= 0.5) | ((d < 0.3) & (c >= 0.15)), "overpromises").when(d >= 0.3, "partially_supported").otherwise("not_directly_supported")


def delivery_gap(df: DataFrame, scorer: Callable[[DataFrame], DataFrame] = overlap_scorer, keep: tuple[str, ...] = ("doc_id", "headline")) -> DataFrame:
    """A row for each article: delivery_score, gap_score, max_contradiction, verdict, best_window, n_windows; or error."""
    scored = scorer(body_window_rows(df, keep=keep))
    best = scored.groupBy(*keep).agg(F.max("entail").alias("delivery"), F.max("contradict").alias("contra"), F.min_by("window", F.struct(-F.col("entail"), F.col("idx"))).alias("window"), F.max("n_windows").alias("n_windows"))
    result = best.select(
        *keep, F.round("delivery", 3).alias("delivery_score"), F.round(1 - F.col("delivery"), 3).alias("gap_score"), F.round("contra", 3).alias("max_contradiction"),
        verdict("delivery", "contra").alias("verdict"), F.substring("window", 1, 280).alias("best_window"), F.col("n_windows").cast("bigint").alias("n_windows"),
    )
    joined = df.select(*keep).join(result, list(keep), "left")
    return joined.withColumn("error", F.when(F.col("n_windows").isNull(), "empty body"))
