"""A student of a teacher: small linear heads that learn the teacher's answers instead of labels.

The teacher answers with logits of three kinds: intensity, each dimension of the taxonomy, and binary. The student's heads
learn the first and the last by squared error and the taxonomy softened by a temperature. The divergence counts both
outcomes of a dimension, so that it is least where student and teacher agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import PARAMS
from ..functions import rules
from ..functions.lexicon import DIMENSIONS
from . import linear, stats
from .models import Heads, Scorer, fit_heads, logit
from .store import stored

HEADS = ("intensity", *DIMENSIONS, "binary")
STUDENT_FEATURES = 20_000
#: Answers are no surer than this from either side (logits within some 6); the fit's tolerance and penalty.
SUREST, TOLERANCE, PENALTY = 0.0025, 1e-4, 1e-3


def teacher_logits(scorer: Scorer, df: DataFrame, headline: str = "headline") -> DataFrame:
    """df with ``teacher_<head>``: the scorer's probability as the binary answer, the rules' scores as the taxonomy's, and
    their common score as the intensity's, all of the masked text, as logits."""
    rows = scorer.predict(df.withColumn("_named", rules.mask_entities(headline)), "_named")
    scored = rules.with_scores(rows, "_named")
    answers = {"intensity": rules.rules_score(), "binary": F.col("probability")} | {d: F.col(s) for d, s in zip(DIMENSIONS, rules.SCORES)}
    return scored.withColumns({f"teacher_{h}": logit(answers[h], SUREST) for h in HEADS}).drop("_named", "probability", *rules.SCORES)


def fit_student(taught: DataFrame, headline: str = "headline", temperature: float = PARAMS.student_temperature, penalty: float = PENALTY, max_features: int = STUDENT_FEATURES, iterations: int = PARAMS.lr_iterations) -> Heads:
    """A student of the answers in ``taught`` (teacher_logits()); a missing answer is not learnt from.

    Its vocabulary is a tenth of the teacher's. All heads are fitted at once, in passes over rows that are stored once.
    """
    losses = {h: linear.squared if h in ("intensity", "binary") else linear.tempered(temperature) for h in HEADS}
    return fit_heads(taught, {f"student_{h}": (f"teacher_{h}", losses[h]) for h in HEADS}, headline, penalty=penalty, max_features=max_features, iterations=iterations, tolerance=TOLERANCE)


def compared(student: Heads, taught: DataFrame, label: str | None = None, headline: str = "headline", threshold: float = 0.5) -> DataFrame:
    """(head, roc_auc, average_precision, f1, ece, spearman, mae, n): how each head follows the teacher.

    The teacher's answer counts as yes from ``threshold`` on; ranks and errors are between both probabilities. With a
    label, two more rows compare teacher and student with it, as ``teacher_label`` and ``student_label``.
    """
    rows = student.predict(taught, headline)
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    pairs = [F.struct(F.lit(h).alias("head"), p(f"student_{h}").alias("p"), p(f"teacher_{h}").alias("t"), (p(f"teacher_{h}") >= threshold).cast("int").alias("y")) for h in HEADS]
    if label:
        y = F.col(label).cast("int")
        pairs += [F.struct(F.lit(f"{who}_label").alias("head"), p(f"{who}_binary").alias("p"), y.cast("double").alias("t"), y.alias("y")) for who in ("teacher", "student")]
    long = stored(rows.select(F.explode(F.array(*pairs)).alias("x")).select("x.*"))
    return stats.report(long, ["head"], "y", "p").join(stats.spearman(long, ["head"], "t", "p").drop("n"), "head")
