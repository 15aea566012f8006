import pytest

from tonescope import __main__ as cli
from tonescope.functions.lexicon import DIMENSIONS
from tonescope.operators import models
from tonescope.plans import stages


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("batch"))
    cli.main(["ingest", path], spark)
    cli.main(["dedup", path], spark)
    cli.main(["split", path], spark)
    return path


def test_stages_pass_their_contracts(spark, folder):
    rows = spark.read.parquet(f"{folder}/processed")
    assert rows.count() == spark.read.parquet(f"{folder}/raw").count() > 400
    groups = rows.select("dup_group").distinct().count()
    assert groups <= 60  # variants of a headline are near copies
    assert rows.groupBy("dup_group").agg({"split": "max", "*": "count"}).count() == groups
    assert {r["split"] for r in rows.select("split").distinct().collect()} == {"train", "val", "test"}


def test_bands_join_variants_too(spark, folder):
    assert 10 <= stages.deduplicate(spark, folder, exact=False).select("dup_group").distinct().count() <= 60
    stages.deduplicate(spark, folder)


def test_training(spark, folder):
    report = {(r["split"], r["model"]): r for r in stages.train(spark, folder, trees=3, iterations=15).collect()}
    assert {m for _, m in report} == {"rules", "logistic", "boosted", "calibrated"}
    assert all(0 <= r["ece"] <= 1 for r in report.values())
    scorer = models.Scorer.load(spark, f"{folder}/models")
    assert scorer.logistic.features.size > 500 and len(scorer.stack.roots) == 3
    found = stages.score(spark, folder, spark.createDataFrame([("Guess what happened next",)], "headline string")).first()
    assert found["model"] == "boosted-calibrated" and 0 <= found["manipulation_score"] <= 1


def test_labels_are_cached(spark, folder):
    first = stages.label_headlines(spark, folder, limit=20).count()
    lines = spark.read.json(f"{folder}/label_cache").count()
    assert first == 20 and stages.label_headlines(spark, folder, limit=20).count() == 20 and spark.read.json(f"{folder}/label_cache").count() == lines == 20


def test_gold(spark, folder, tmp_path):
    gold = ["Guess what the cat did,1,0,0,0,0,0", "Coach slams rivals,0,1,0,0,0,0", "Deadly storm and disaster,0,0,2,0,0,0", "A calm day,0,0,0,0,0,0"]
    (tmp_path / "gold.csv").write_text("\n".join(["headline," + ",".join(DIMENSIONS), *gold]))
    rows = {r["dimension"]: r for r in stages.validate_gold(spark, folder, str(tmp_path / "gold.csv")).collect()}
    assert all(rows[d]["alpha"] == 1.0 and rows[d]["usable"] for d in DIMENSIONS) and rows["fear"]["n_units"] == 4


def test_posts(spark, folder):
    cli.main(["posts", folder], spark)
    assert spark.read.parquet(f"{folder}/posts").count() == 240
