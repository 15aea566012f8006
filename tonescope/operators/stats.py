"""Agreement, ranking and calibration measures as aggregates.

Ranks and curves are computed on counts by distinct score, and by ranges of scores, so no window sees all rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import stored

#: Lower edges of ten bins as sums of tenths in binary give them. Fixed values.
EDGES = tuple(i * 0.1 for i in range(10))


def alpha_terms(df: DataFrame, keys: list[str], unit: str, value: str, metric: str = "interval") -> DataFrame:
    """(keys..., alpha, n_values): Krippendorff's alpha of annotations, one row for each.

    Units with one value or none do not count. Sums of values and squares by unit stand for all pairs within it.
    """
    v = F.col(value).cast("double")
    clean = df.where(v.isNotNull() & ~F.isnan(v)).withColumn("_v", v)
    size = F.col("_m").cast("double")
    if metric == "nominal":
        counts = clean.groupBy(*keys, unit, "_v").agg(F.count("*").alias("_c"))
        units = counts.groupBy(*keys, unit).agg(F.sum("_c").alias("_m"), F.sum(F.col("_c").cast("double") * F.col("_c")).alias("_sq")).where("_m > 1")
        seen = units.groupBy(*keys).agg(F.sum((size * size - F.col("_sq")) / (size - 1)).alias("_o"), F.sum("_m").cast("double").alias("_n"))
        totals = counts.join(units.select(*keys, unit), [*keys, unit], "left_semi").groupBy(*keys, "_v").agg(F.sum("_c").cast("double").alias("_c"))
        expected = totals.groupBy(*keys).agg(F.sum(F.col("_c") * F.col("_c")).alias("_sq"), F.count("*").alias("_kinds"))
        whole = seen.join(expected, keys) if keys else seen.crossJoin(expected)  # one row each
        spread = (F.col("_n") * F.col("_n") - F.col("_sq")) / (F.col("_n") - 1)
    else:
        units = clean.groupBy(*keys, unit).agg(F.count("*").alias("_m"), F.sum("_v").alias("_s"), F.sum(F.col("_v") * F.col("_v")).alias("_q"), F.min("_v").alias("_low"), F.max("_v").alias("_high")).where("_m > 1")
        observed = 2 * (size * F.col("_q") - F.col("_s") * F.col("_s")) / (size - 1)
        whole = units.groupBy(*keys).agg(F.sum(observed).alias("_o"), F.sum("_m").cast("double").alias("_n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.when(F.min("_low") < F.max("_high"), 2).otherwise(1).alias("_kinds"))
        spread = 2 * (F.col("_n") * F.col("_q") - F.col("_s") * F.col("_s")) / (F.col("_n") - 1)
    result = F.when((F.col("_kinds") < 2) | (spread == 0), F.lit(1.0)).otherwise(1 - F.col("_o") / spread)
    return whole.where("_n > 0").select(*keys, result.alias("alpha"), F.col("_n").cast("bigint").alias("n_values"))


def krippendorff_alpha(df: DataFrame, unit: str, value: str, metric: str = "interval") -> float:
    row = alpha_terms(df, [], unit, value, metric).first()
    if row is None:
        raise ValueError("no unit has two values")
    return row["alpha"]


def agreement(pairs: DataFrame, keys: list[str], unit: str, a: str, b: str) -> DataFrame:
    """(keys..., alpha, exact_agreement, n_units) of two annotators; a unit's row holds both values."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    n = F.sum(both.cast("int"))
    simple = pairs.groupBy(*keys).agg((F.sum((both & (F.col(a) == F.col(b))).cast("int")) / F.greatest(F.lit(1), n)).alias("exact_agreement"), n.cast("bigint").alias("n_units"))
    long = pairs.select(*keys, unit, F.explode(F.array(a, b)).alias("_value"))
    terms = alpha_terms(long, keys, unit, "_value").drop("n_values")
    return simple.join(terms, keys, "left") if keys else simple.crossJoin(terms)  # one row each


def bin_of(p) -> object:
    return F.greatest(F.lit(0), F.size(F.filter(F.array(*[F.lit(e) for e in EDGES]), lambda e: p >= e)) - 1)


def calibration_error(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """(keys..., ece): mean gap of confidence and accuracy over ten bins, weighted by their rows."""
    bins = df.groupBy(*keys, bin_of(F.col(p)).alias("_bin")).agg(F.count("*").cast("double").alias("_n"), F.avg(F.col(p)).alias("_conf"), F.avg(F.col(y).cast("double")).alias("_acc"))
    return bins.groupBy(*keys).agg((F.sum(F.col("_n") * F.abs(F.col("_conf") - F.col("_acc"))) / F.sum("_n")).alias("ece"))


def below(df: DataFrame, keys: list[str], value: str, sums: dict[str, str]) -> DataFrame:
    """df (one row for each key and value) with new columns: sums of columns over the key's smaller values, and over all of
    them (``_of`` before the name).

    Works by ranges of (key, value) that Spark cuts from a sample, about equal in rows whatever the values are: totals of
    ranges first, then sums within each, so that no task sorts all values of a key. The ranges are stored, as a sample
    taken again could cut elsewhere.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(parts, *keys, value).withColumn("_range", F.spark_partition_id()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    totals = ranged.groupBy(*keys, "_range").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    totals = totals.select(*keys, "_range", *[zero(F.sum(f"_t_{n}").over(earlier)).alias(f"_b_{n}") for n in sums], *[F.sum(f"_t_{n}").over(Window.partitionBy(*keys)).alias(f"_of_{n}") for n in sums])
    own = ranged.withColumns({f"_i_{n}": zero(F.sum(c).over(inside)) for n, c in sums.items()})
    own = own.join(totals.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_r"), *[c for c in totals.columns if c not in (*keys, "_range")]), (F.col("_range") == F.col("_r")) & _all([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]))
    return own.withColumns({n: F.col(f"_b_{n}") + F.col(f"_i_{n}") for n in sums}).drop("_range", "_r", *[f"_k_{k}" for k in keys], *[f"_{x}_{n}" for n in sums for x in "bi"])


def _all(conditions: list) -> object:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def tied(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """(keys..., _p, _pos, _all): positives and rows of each score."""
    return df.groupBy(*keys, F.col(p).alias("_p")).agg(F.sum(F.col(y).cast("double")).alias("_pos"), F.count("*").cast("double").alias("_all"))


def _curve(counts: DataFrame, keys: list[str], least: int) -> DataFrame:
    curve = below(counts, keys, "_p", {"pos_below": "_pos", "all_below": "_all"})
    pos_n, n_all = F.col("_of_pos_below"), F.col("_of_all_below")
    neg, neg_below = F.col("_all") - F.col("_pos"), F.col("all_below") - F.col("pos_below")
    step = F.col("_pos") * (pos_n - F.col("pos_below")) / (n_all - F.col("all_below"))
    sums = curve.groupBy(*keys).agg(F.sum(F.col("_pos") * (neg_below + neg / 2)).alias("_area"), F.sum(step).alias("_steps"), F.max(pos_n).alias("_pos_n"), F.max(n_all).alias("_n"))
    pos, n = F.col("_pos_n"), F.col("_n")
    auc, ap = F.when((pos > 0) & (pos < n) & (n >= least), F.col("_area") / (pos * (n - pos))), F.when(pos > 0, F.col("_steps") / pos)
    return sums.select(*keys, auc.alias("roc_auc"), ap.alias("average_precision"), n.cast("bigint").alias("n"), pos.cast("bigint").alias("n_pos"))


def ranking(df: DataFrame, keys: list[str], y: str, p: str, least: int = 0) -> DataFrame:
    """(keys..., roc_auc, average_precision, n, n_pos). Ties count half in the area; precision is summed at each step of recall.

    roc_auc is null for one class only, and for fewer than ``least`` rows.
    """
    return _curve(tied(df, keys, y, p), keys, least)


def quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys..., a column for each share, n): exact quantiles, interpolated between neighbours, of the values that are there.

    Values are counted first, and placed by ranges, so that no task holds all values of a key.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count("*").cast("double").alias("_c"))
    curve = below(counts, keys, "_v", {"less": "_c"})
    n = F.col("_of_less")
    at = lambda place: F.max(F.when((F.col("less") <= place) & (place < F.col("less") + F.col("_c")), F.col("_v")))
    out = {}
    for name, share in shares.items():
        place = (n - 1) * share
        low, high, part = at(F.floor(place)), at(F.ceil(place)), F.max(place - F.floor(place))
        out[name] = low + (high - low) * part
    return curve.groupBy(*keys).agg(*[c.alias(k) for k, c in out.items()], F.max(n).cast("bigint").alias("n"))


def thresholded(df: DataFrame, keys: list[str], y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """(keys..., f1, positive_rate, n); f1 is 0 where it is undefined."""
    hit, true = (F.col(p) >= threshold).cast("double"), F.col(y).cast("double")
    f1 = 2 * F.sum(hit * true) / F.nullif(F.sum(hit) + F.sum(true), F.lit(0.0))
    return df.groupBy(*keys).agg(F.coalesce(f1, F.lit(0.0)).alias("f1"), F.avg(hit).alias("positive_rate"), F.count("*").alias("n"))


def report(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """(keys..., roc_auc, average_precision, f1, ece, positive_rate, n), all of counts by score, which are stored once."""
    counts = stored(tied(df, keys, y, p))
    hit, pos, n = (F.col("_p") >= 0.5).cast("double"), F.col("_pos"), F.col("_all")
    f1 = 2 * F.sum(hit * pos) / F.nullif(F.sum(hit * n) + F.sum(pos), F.lit(0.0))
    simple = counts.groupBy(*keys).agg(F.coalesce(f1, F.lit(0.0)).alias("f1"), (F.sum(hit * n) / F.sum(n)).alias("positive_rate"), F.sum(n).cast("bigint").alias("n"))
    bins = counts.groupBy(*keys, bin_of(F.col("_p")).alias("_bin")).agg(F.sum(n).alias("_n"), F.sum(F.col("_p") * n).alias("_conf"), F.sum(pos).alias("_acc"))
    errors = bins.groupBy(*keys).agg((F.sum(F.abs(F.col("_conf") - F.col("_acc"))) / F.sum("_n")).alias("ece"))
    out = _curve(counts, keys, 0).drop("n", "n_pos")
    for part in (simple, errors):
        out = out.join(part, keys) if keys else out.crossJoin(part)  # one row each
    return out.select(*keys, "roc_auc", "average_precision", "f1", "ece", "positive_rate", "n")


def spearman(df: DataFrame, keys: list[str], t: str, p: str, least: int = 8) -> DataFrame:
    """(keys..., spearman, mae, n): correlation of mean ranks, and mean absolute error; null for fewer than ``least`` rows
    or a constant column."""
    finite = df.where(F.col(t).isNotNull() & F.col(p).isNotNull() & ~F.isnan(F.col(t).cast("double")) & ~F.isnan(F.col(p).cast("double")))
    cells = stored(finite.groupBy(*keys, F.col(t).cast("double").alias("_t"), F.col(p).cast("double").alias("_p")).agg(F.count("*").cast("double").alias("_c")))
    for x in "tp":
        by = below(cells.groupBy(*keys, f"_{x}").agg(F.sum("_c").alias("_k")), keys, f"_{x}", {"less": "_k"})
        ranks = by.select(*keys, f"_{x}", (F.col("less") + (F.col("_k") + 1) / 2).alias(f"_r{x}"))
        cells = cells.join(ranks, [*keys, f"_{x}"])
    a, b, c = F.col("_rt"), F.col("_rp"), F.col("_c")
    n = F.sum(c)
    cov = F.sum(c * a * b) - F.sum(c * a) * F.sum(c * b) / n
    va, vb = F.sum(c * a * a) - F.sum(c * a) * F.sum(c * a) / n, F.sum(c * b * b) - F.sum(c * b) * F.sum(c * b) / n
    enough = (n >= least) & (va > 0) & (vb > 0)
    return cells.groupBy(*keys).agg(F.when(enough, cov / F.sqrt(va * vb)).alias("spearman"), F.when(enough, F.sum(c * F.abs(F.col("_t") - F.col("_p"))) / n).alias("mae"), n.cast("bigint").alias("n"))


def finite(c) -> object:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf)


def cross_entropy(logit, target) -> object:
    """Binary cross-entropy of a logit, without overflow."""
    return F.greatest(logit, F.lit(0.0)) - logit * target + F.log1p(F.exp(-F.abs(logit)))


def multitask_loss(df: DataFrame, taxonomy: list[tuple[str, str]], weights: tuple[float, float, float] = (1.0, 0.5, 0.5)) -> DataFrame:
    """(loss): weighted mean errors of logits against targets; a task counts the rows where its target is finite.

    Columns: intensity_logit, intensity, binary_logit, label, and (logit, target) pairs for the taxonomy.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    i, y = F.col("intensity"), F.col("label")
    guess = 1 / (1 + F.exp(-F.col("intensity_logit")))
    terms = [F.when(finite(i), (guess - unit(i)) * (guess - unit(i)))]
    tax_sum = sum((F.coalesce(F.when(finite(F.col(t)), cross_entropy(F.col(z), unit(F.col(t)))), F.lit(0.0)) for z, t in taxonomy), F.lit(0.0))
    tax_n = sum((finite(F.col(t)).cast("int") for _, t in taxonomy), F.lit(0))
    binary = F.when(finite(y), cross_entropy(F.col("binary_logit"), y))
    out = F.coalesce(F.avg(terms[0]), F.lit(0.0)) * weights[0] + F.coalesce(F.sum(tax_sum) / F.nullif(F.sum(tax_n), F.lit(0)), F.lit(0.0)) * weights[1] + F.coalesce(F.avg(binary), F.lit(0.0)) * weights[2]
    return df.agg(out.alias("loss"))
