"""Labels of an annotating model: cache, budget, votes, the gold gate, and training targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PARAMS
from ..functions import rules
from ..functions.lexicon import DIMENSIONS
from ..functions.text import cache_key
from . import stats


def request_cost(tokens_in: Column, cache_write: Column, cache_read: Column, tokens_out: Column, price_in: float = PARAMS.input_usd_per_mtok, price_out: float = PARAMS.output_usd_per_mtok) -> Column:
    """Dollars of a request; writing to the provider's cache costs a quarter more, reading from it a tenth."""
    return ((tokens_in + 1.25 * cache_write + 0.1 * cache_read) * price_in + tokens_out * price_out) / 1e6


def rule_labels(df: DataFrame, headline: str = "headline") -> DataFrame:
    """df with a 0-2 label for each dimension, as a dry run makes them from the rules, and out_of_scope."""
    scored = rules.with_scores(df, headline)
    return scored.withColumns({d: rules.ordinal(F.col(s)) for d, s in zip(DIMENSIONS, rules.SCORES)} | {"out_of_scope": F.lit(False)}).drop(*rules.SCORES)


def votes(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Each dimension's median over a headline's samples, cut to a whole number; out_of_scope by more than half."""
    median = {d: F.floor(F.percentile(d, 0.5)).cast("int").alias(d) for d in DIMENSIONS}
    return samples.groupBy(*keys).agg(*median.values(), (F.sum(F.col("out_of_scope").cast("int")) > F.count("*") / 2).alias("out_of_scope"), F.count("*").alias("n_samples"))


def latest(cache: DataFrame, order: str = "line_no") -> DataFrame:
    """One record for each cache key, the last that was written."""
    newest = F.row_number().over(Window.partitionBy("key").orderBy(F.col(order).desc()))
    return cache.withColumn("_n", newest).where("_n = 1").drop("_n")


def cache_split(headlines: DataFrame, cache: DataFrame, model: str, version: str = "1") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached labels, misses), by the key of model, codebook version and headline."""
    keyed = headlines.withColumn("key", cache_key(model, version, "headline"))
    known = latest(cache)
    return keyed.join(known, "key"), keyed.join(known, "key", "left_anti")


def within_budget(costs: DataFrame, budget: float = PARAMS.max_usd_per_run, order: str = "doc_id", cost: str = "usd", parts: int | None = None) -> DataFrame:
    """costs with ``spent`` (by the rows before) and only the rows that start before the budget is used up.

    A running sum by ranges of the order: totals of ranges first, then sums within each.
    """
    from .dedup import _checkpoint_dir

    _checkpoint_dir(costs)
    parts = parts or int(costs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = costs.repartitionByRange(parts, order).withColumn("_part", F.spark_partition_id()).checkpoint()
    sums = ranged.groupBy("_part").agg(F.sum(cost).alias("_sum"))
    before = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_before"))
    inside = F.coalesce(F.sum(cost).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return ranged.join(F.broadcast(before), "_part").withColumn("spent", F.col("_before") + inside).where(F.col("spent") < budget).drop("_part", "_before")


def label(headlines: DataFrame, cache: DataFrame, model: str, scorer: Callable[[DataFrame], DataFrame] = rule_labels, limit: int | None = None, order: str = "doc_id") -> DataFrame:
    """Cached labels where there are any, the scorer's for the rest; at most the run's cap of headlines, in order."""
    most = min(limit or PARAMS.max_headlines, PARAMS.max_headlines)
    hits, misses = cache_split(headlines.orderBy(order).limit(most), cache, model)
    columns = ["headline", *DIMENSIONS, "out_of_scope"]
    return hits.select(*columns).unionByName(scorer(misses).select(*columns))


def labelling_run(headlines: DataFrame, cache: DataFrame, model: str, annotate: Callable[[DataFrame, int], DataFrame], usd: Column, n_samples: int = PARAMS.n_samples, budget: float = PARAMS.max_usd_per_run, limit: int | None = None, order: str = "doc_id", version: str = "1") -> tuple[DataFrame, DataFrame]:
    """(labels of the run's headlines, new records for the cache), as an annotating run makes them.

    Headlines come in order, at most the run's cap. What the cache holds is taken from it, and costs nothing; so does a
    headline that came before. The run ends at the first headline that would need the annotator when the money is
    spent. annotate: (rows with key and headline, number of samples) -> a row for each key and sample with labels. usd:
    what one sample of a headline costs. A headline's samples are voted into one record.
    """
    most = min(limit or PARAMS.max_headlines, PARAMS.max_headlines)
    rows = headlines.orderBy(order).limit(most).withColumn("key", cache_key(model, version, "headline"))
    first = rows.groupBy("key").agg(F.min(order).alias("_first"))
    known = latest(cache)
    asked = rows.join(first, "key").join(known.select("key", F.lit(True).alias("_hit")), "key", "left")
    asked = asked.withColumn("_ask", F.col("_hit").isNull() & (F.col(order) == F.col("_first"))).withColumn("_usd", F.when(F.col("_ask"), usd * n_samples).otherwise(0.0).cast("double"))
    asked = asked.select(order, "key", "headline", "_ask", "_usd")
    before = F.coalesce(F.sum("_usd").over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))  # the cap's rows
    ends = F.min(F.when(F.col("_ask") & (F.col("_spent") >= budget), F.col(order)))
    spent = asked.withColumn("_spent", before)
    last = spent.agg(ends.alias("_end"))
    run = spent.crossJoin(F.broadcast(last)).where("_end IS NULL OR " + order + " < _end").drop("_end")  # one row
    fresh = votes(annotate(run.where("_ask").select("key", "headline"), n_samples), ["key"])
    columns = [*DIMENSIONS, "out_of_scope"]
    every = known.select("key", *columns).unionByName(fresh.select("key", *columns))
    return run.select(order, "key", "headline", F.col("_ask").alias("asked"), F.col("_spent").alias("spent")).join(every, "key").drop("key"), fresh


def coverage(df: DataFrame, labels: DataFrame, headline: str = "headline") -> DataFrame:
    """(n, n_labelled): how many rows have a label for their headline."""
    known = labels.select(F.col("headline").alias(headline)).distinct().withColumn("_known", F.lit(1))
    return df.select(headline).join(known, headline, "left").agg(F.count("*").alias("n"), F.count("_known").alias("n_labelled"))


def gated_targets(df: DataFrame, labels: DataFrame | None, report: DataFrame | None, headline: str = "headline", order: str = "line_no") -> DataFrame:
    """targets() with the dimensions that the agreement report finds usable; without labels or report the rules' scores."""
    usable = [] if labels is None or report is None else [r["dimension"] for r in report.where("usable").select("dimension").collect()]
    if not usable:
        scored = rules.with_scores(df, headline)
        return scored.withColumnsRenamed({s: f"target_{d}" for d, s in zip(DIMENSIONS, rules.SCORES)})
    return targets(df, labels, usable, headline, order)


def gold_gate(gold: DataFrame, labels: DataFrame, least: float = PARAMS.min_gold_alpha) -> DataFrame:
    """(dimension, alpha, exact_agreement, n_units, usable): agreement with gold labels on equal headlines."""
    left = gold.select(F.col("headline"), *[F.col(d).alias(f"gold_{d}") for d in DIMENSIONS])
    right = labels.select(F.col("headline"), *[F.col(d).alias(f"label_{d}") for d in DIMENSIONS])
    both = left.join(right, "headline").withColumn("unit", F.monotonically_increasing_id())
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"gold_{d}").alias("a"), F.col(f"label_{d}").alias("b")) for d in DIMENSIONS]))
    long = both.select("unit", each.alias("e")).select("e.dimension", "unit", F.col("e.a").cast("double").alias("a"), F.col("e.b").cast("double").alias("b"))
    return stats.agreement(long, ["dimension"], "unit", "a", "b").withColumn("usable", F.col("alpha") >= least)


def targets(df: DataFrame, labels: DataFrame, usable: list[str], headline: str = "headline", order: str = "line_no") -> DataFrame:
    """df with target_<dimension>: the rule's score, or half of the label where the dimension is usable and there is one.

    Headlines out of scope keep the rules' scores; of several labels for a headline the last counts.
    """
    scored = rules.with_scores(df, headline)
    known = labels.where(~F.col("out_of_scope")) if "out_of_scope" in labels.columns else labels
    last = known.groupBy(F.col("headline").alias("_h")).agg(*[F.max_by(d, order).alias(f"_l_{d}") for d in DIMENSIONS])
    joined = scored.join(last, scored[headline] == last["_h"], "left") if usable else scored
    new = {f"target_{d}": F.coalesce(F.col(f"_l_{d}") / 2.0, F.col(s)) if d in usable else F.col(s) for d, s in zip(DIMENSIONS, rules.SCORES)}
    return joined.withColumns(new).drop(*rules.SCORES, "_h", *[f"_l_{d}" for d in DIMENSIONS])
