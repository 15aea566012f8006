import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonescope.operators import stats


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def alpha_by_pairs(units, delta):
    units = [[v for v in u if v is not None] for u in units]
    units = [u for u in units if len(u) > 1]
    every = [v for u in units for v in u]
    n = len(every)
    seen = sum(delta(a, b) / (len(u) - 1) for u in units for i, a in enumerate(u) for j, b in enumerate(u) if i != j)
    chance = sum(delta(a, b) for i, a in enumerate(every) for j, b in enumerate(every) if i != j) / (n - 1)
    return 1.0 if not chance else 1 - seen / chance


@pytest.mark.parametrize("metric", ["interval", "nominal"])
def test_alpha_matches_all_pairs(spark, metric):
    r = random.Random(5)
    units = [[r.choice([0, 1, 2, None]) for _ in range(r.randint(1, 4))] for _ in range(30)]
    df = frame(spark, [(i, float(v) if v is not None else None) for i, u in enumerate(units) for v in u], "u int, v double")
    delta = (lambda a, b: (a - b) ** 2) if metric == "interval" else (lambda a, b: float(a != b))
    assert stats.krippendorff_alpha(df, "u", "v", metric) == pytest.approx(alpha_by_pairs(units, delta))


def test_alpha_edges(spark):
    same = frame(spark, [(i, 1.0) for i in (1, 1, 2, 2)], "u int, v double")
    assert stats.krippendorff_alpha(same, "u", "v") == 1.0 == stats.krippendorff_alpha(same, "u", "v", "nominal")
    with pytest.raises(ValueError):
        stats.krippendorff_alpha(frame(spark, [(1, 1.0), (2, None)], "u int, v double"), "u", "v")


def test_curves_match_brute_force(spark):
    r = random.Random(2)
    data = [(r.random() < 0.3, round(r.random(), 1)) for _ in range(200)]
    got = stats.report(frame(spark, [(int(y), p) for y, p in data], "y int, p double"), [], "y", "p").first()
    pos, neg = [p for y, p in data if y], [p for y, p in data if not y]
    assert got["roc_auc"] == pytest.approx(sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg))
    ap = sum(sum(1 for y, p in data if y and p == t) * sum(1 for y, p in data if y and p >= t) / sum(1 for _, p in data if p >= t) for t in {p for _, p in data}) / len(pos)
    assert got["average_precision"] == pytest.approx(ap)
    tp, hat = sum(1 for y, p in data if y and p >= 0.5), sum(1 for _, p in data if p >= 0.5)
    assert got["f1"] == pytest.approx(2 * tp / (hat + len(pos))) and got["positive_rate"] == pytest.approx(hat / 200)


def test_ece_uses_binary_edges(spark):
    rows = [(1, 0.3), (0, 0.6), (1, 0.7), (0, 1.0), (1, 0.0)]
    bins = [r[0] for r in frame(spark, rows, "y int, p double").select(stats.bin_of(__import__("pyspark.sql.functions", fromlist=["col"]).col("p"))).collect()]
    assert bins == [2, 5, 6, 9, 0]


def test_spearman(spark):
    rows = [(float(i % 5), float((i * i) % 7)) for i in range(20)]
    rank = lambda v: [sum(x < a for x in v) + (sum(x == a for x in v) + 1) / 2 for a in v]
    a, b = rank([x for x, _ in rows]), rank([y for _, y in rows])
    ma, mb = sum(a) / 20, sum(b) / 20
    want = sum((x - ma) * (y - mb) for x, y in zip(a, b)) / math.sqrt(sum((x - ma) ** 2 for x in a) * sum((y - mb) ** 2 for y in b))
    got = stats.spearman(frame(spark, rows, "t double, p double"), [], "t", "p").first()
    assert got["spearman"] == pytest.approx(want) and got["n"] == 20
    assert stats.spearman(frame(spark, rows[:7], "t double, p double"), [], "t", "p").first()["spearman"] is None
    assert stats.spearman(frame(spark, [(1.0, float(i)) for i in range(9)], "t double, p double"), [], "t", "p").first()["spearman"] is None


def test_loss_masks_targets(spark):
    schema = "intensity_logit double, intensity double, binary_logit double, label double, z double, t double"
    whole = stats.multitask_loss(frame(spark, [(0.0, 0.5, 0.0, 1.0, 0.0, 1.0)], schema), [("z", "t")]).first()["loss"]
    assert whole == pytest.approx(0.5 * math.log(2) * 2)
    odd = [(0.0, 0.5, 0.0, 1.0, 0.0, 1.0), (5.0, float("nan"), 900.0, float("inf"), 3.0, None)]
    assert stats.multitask_loss(frame(spark, odd, schema), [("z", "t")]).first()["loss"] == pytest.approx(whole)
    clipped = stats.multitask_loss(frame(spark, [(50.0, 7.5, 0.0, None, 0.0, None)], schema), [("z", "t")]).first()["loss"]
    assert clipped == pytest.approx(0.0, abs=1e-9)


def test_quantiles(spark):
    r = np.random.default_rng(4)
    rows = [(k, float(v)) for k in "ab" for v in r.choice([r.normal() * 50, 1.0, 2.5, r.normal()], 101 + ord(k))] + [("c", 3.0), ("c", None)]
    got = {x["k"]: x for x in stats.quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"p50": 0.5, "p95": 0.95}).collect()}
    for k in "abc":
        values = [v for x, v in rows if x == k and v is not None]
        assert got[k]["n"] == len(values) and (got[k]["p50"], got[k]["p95"]) == pytest.approx(tuple(np.percentile(values, [50, 95])))


@pytest.mark.parametrize("parts", ["1", "7"])
def test_quantiles_of_any_scale(spark, parts):
    """Values from 1e-9 to 1e12 of either sign, most of them close together, in many ranges."""
    r = np.random.default_rng(8)
    v = np.concatenate([10.0 ** r.uniform(-9, 12, 900) * r.choice([-1, 1], 900), 1000 + r.random(3000), [0.0, -0.0, 5.0, 5.0]])
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame([("a", float(x)) for x in v] + [(None, 1.0), (None, 3.0)], "k string, v double")
        got = {x["k"]: x for x in stats.quantiles(df, ["k"], "v", {"p1": 0.01, "p50": 0.5, "p99": 0.99}).collect()}
        placed = stats.below(df.where("k IS NOT NULL").groupBy("k", "v").agg(F.count("*").cast("double").alias("c")), ["k"], "v", {"less": "c"}).collect()
        shares = stats.below(df.where("k IS NOT NULL").groupBy("k", "v").agg(F.count("*").cast("double").alias("c")).withColumn("one", F.lit(1.0)), ["k"], "v", {"x": "one"}).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert (got["a"]["p1"], got["a"]["p50"], got["a"]["p99"]) == pytest.approx(tuple(np.percentile(v, [1, 50, 99])), rel=1e-12)
    assert got[None]["p50"] == 2.0 and got[None]["n"] == 2
    order = np.sort(v)
    assert all(x["less"] == np.searchsorted(order, x["v"]) and x["_of_less"] == len(v) for x in placed) and shares == len(placed)


def test_small_groups_have_no_area(spark):
    df = spark.createDataFrame([("a", i % 2, i / 10) for i in range(7)] + [("b", i % 2, i / 10) for i in range(8)], "k string, y int, p double")
    assert {r["k"]: r["roc_auc"] is None for r in stats.ranking(df, ["k"], "y", "p", least=8).collect()} == {"a": True, "b": False}
