"""Train, validation and test sets that never part a group of near copies, and keep the labels' shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PARAMS


class LeakageError(AssertionError):
    """Groups in more than one set."""


def grouped_stratified_split(df: DataFrame, test_size: float = PARAMS.test_size, val_size: float = PARAMS.val_size, seed: int = PARAMS.seed, group: str = "dup_group", label: str = "label_clickbait") -> DataFrame:
    """df with ``split``. A group has its majority's label (a tie counts as 1); within a label, groups in the order of a
    hash go to test, then to validation, then to training. Shares round half to even; of two groups or fewer none leaves
    training."""
    labels = df.groupBy(group).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    hashed = labels.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(seed), F.col(group)))).withColumn("_range", F.substring("_hash", 1, 3))
    # a place among all groups of a label is the sizes of earlier ranges of hashes, and a place in its own range
    ranges = hashed.groupBy("_label", "_range").agg(F.count("*").alias("_k"))
    before, whole = Window.partitionBy("_label").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_label")
    ranges = ranges.select("_label", "_range", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_before"), F.sum("_k").over(whole).alias("_n"))
    inside = F.row_number().over(Window.partitionBy("_label", "_range").orderBy("_hash", group))
    taken = lambda share: F.when(F.col("_n") > 2, F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(share), 0).cast("int"))).otherwise(0)
    placed = hashed.withColumn("_place", inside).join(F.broadcast(ranges), ["_label", "_range"]).withColumn("_at", F.col("_before") + F.col("_place"))  # 4,096 ranges of each label
    chosen = placed.select(group, F.when(F.col("_at") <= taken(test_size), "test").when(F.col("_at") <= taken(test_size) + taken(val_size), "val").otherwise("train").alias("split"))
    return df.join(chosen, group, "left")


def straddling(df: DataFrame, group: str = "dup_group") -> DataFrame:
    """(group, n_splits) of the groups in several sets."""
    return df.groupBy(group).agg(F.countDistinct("split").alias("n_splits")).where("n_splits > 1")


def check_no_leakage(df: DataFrame, group: str = "dup_group") -> None:
    bad = [r[0] for r in straddling(df, group).orderBy(group).limit(10).collect()]
    if bad:
        raise LeakageError(f"groups in several sets: {bad}")


def balance(df: DataFrame, label: str = "label_clickbait") -> DataFrame:
    """(split, n, positive_share)."""
    return df.groupBy("split").agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("positive_share"))


def exact_sample(df: DataFrame, share: float, row_id: str = "doc_id", seed: int = 7) -> DataFrame:
    """df with ``sampled``: true for an exact share of the rows (rounded half to even), those with the smallest hashes.

    Rows are counted by the hash's first 16 bits; only the range in which the share ends is put in order.
    """
    hashed = df.withColumn("_hash", F.md5(F.concat_ws("|", F.lit(seed), row_id))).withColumn("_range", F.conv(F.substring("_hash", 1, 4), 16, 10).cast("int"))
    counts = hashed.groupBy("_range").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_range")  # 65,536 rows at most
    ranges = counts.select("_range", "_n", (F.sum("_n").over(upto) - F.col("_n")).alias("_before"), F.bround(F.sum("_n").over(Window.partitionBy()) * F.lit(share), 0).alias("_most"))
    rows = hashed.join(F.broadcast(ranges), "_range")
    edge = (F.col("_before") < F.col("_most")) & (F.col("_before") + F.col("_n") > F.col("_most"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", row_id))
    whole = rows.where(~edge).withColumn("sampled", F.col("_before") < F.col("_most"))
    part = rows.where(edge).withColumn("sampled", F.col("_before") + place <= F.col("_most"))
    return whole.unionByName(part).drop("_hash", "_range", "_n", "_before", "_most")


def at_most(df: DataFrame, most: int, row_id: str = "doc_id", seed: int = 7) -> DataFrame:
    """df, or an exact sample of ``most`` of its rows by their hashes if it has more: a bound for fitting a model."""
    n = df.count()
    return df if n <= most else exact_sample(df, most / n, row_id, seed).where("sampled").drop("sampled")
