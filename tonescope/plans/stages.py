"""The batch pipeline: ingest, near duplicates, splits, training. Each stage reads and writes a table under one folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PARAMS
from ..functions import rules
from ..operators import contracts, dedup, labels, models, split, stats
from ..operators.store import stored
from ..sources import io


def ingest(spark: SparkSession, folder: str, sources: list[tuple[str, int, str]] = ()) -> DataFrame:
    """raw: cleaned headlines of (path, label, source) files, or of the invented sample where there are none."""
    if sources:
        parts = [io.read_lines(spark, path, label, source) for path, label, source in sources]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        rows = rows.withColumn("row_id", F.monotonically_increasing_id())
    else:
        rows = io.sample_headlines(spark)
    io.write_stage(contracts.validated(io.clean(rows), contracts.RAW), f"{folder}/raw")
    return spark.read.parquet(f"{folder}/raw")


def ingest_posts(spark: SparkSession, folder: str, archive: str | None = None) -> DataFrame:
    """posts: graded posts of a zip archive, or of the invented sample."""
    if archive:
        read = lambda suffix, schema: io.read_jsonl_from_zip(spark, archive, suffix, schema)
        rows = io.graded_posts(read("instances.jsonl", io.INSTANCE), read("truth.jsonl", io.TRUTH))
    else:
        rows = io.sample_posts(spark)
    io.write_stage(rows, f"{folder}/posts")
    return spark.read.parquet(f"{folder}/posts")


def deduplicate(spark: SparkSession, folder: str, exact: bool = True) -> DataFrame:
    """interim: raw headlines with their groups, by exact similarity or by unverified bands."""
    rows = contracts.validated(spark.read.parquet(f"{folder}/raw"), contracts.RAW)
    named = dedup.texts(rows, "row_id")
    links = dedup.jaccard_pairs(named) if exact else dedup.lsh_links(named, verify=False)
    out = dedup.with_groups(rows, links, "row_id").drop("group_min")
    io.write_stage(contracts.validated(out, contracts.DEDUPED), f"{folder}/interim")
    return spark.read.parquet(f"{folder}/interim")


def split_sets(spark: SparkSession, folder: str) -> DataFrame:
    """processed: training sets in folders of their own; fails if a group is in several."""
    rows = contracts.validated(spark.read.parquet(f"{folder}/interim"), contracts.DEDUPED)
    out = split.grouped_stratified_split(rows)
    split.check_no_leakage(out)
    io.write_stage(contracts.validated(out, contracts.SPLIT), f"{folder}/processed", by_split=True)
    return split.balance(spark.read.parquet(f"{folder}/processed"))


def train(spark: SparkSession, folder: str, trees: int = PARAMS.gbt_trees, iterations: int = PARAMS.lr_iterations) -> DataFrame:
    """report: measures of rules, regression, boosted trees and calibrated trees by set; models are saved beside it."""
    rows = spark.read.parquet(f"{folder}/processed")
    one = lambda name: rows.where(F.col("split") == name)
    scorer = models.fit_scorer(one("train"), one("val"), "label_clickbait", trees, iterations)
    keep = ["headline", "split", "label_clickbait", "lr_prob", *rules.FEATURES]
    boosted = models.with_stack(scorer.stack, models.with_logistic(scorer.logistic, rows).select(*keep)).select(*keep, "gbt_prob")
    final = stored(rules.with_scores(scorer.calibrator.transform(boosted, "gbt_prob")).withColumn("rules_prob", rules.rules_baseline()))
    ladder = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("p")) for n, c in (("rules", "rules_prob"), ("logistic", "lr_prob"), ("boosted", "gbt_prob"), ("calibrated", "calibrated"))]))
    long = final.where("split <> 'train'").select("split", "label_clickbait", ladder.alias("m")).select("split", "label_clickbait", "m.model", "m.p")
    report = stats.report(long, ["split", "model"], "label_clickbait", "p")
    scorer.save(spark, f"{folder}/models")
    report.write.mode("overwrite").json(f"{folder}/report")
    return spark.read.json(f"{folder}/report")


def score(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """rows with the scoring record, by the saved model if there is one, else by the rules."""
    try:
        scorer = models.Scorer.load(spark, f"{folder}/models")
    except Exception as missing:
        if not any(s in str(missing) for s in ("PATH_NOT_FOUND", "does not exist")):
            raise
        return rules.with_score_record(rows)
    return rules.with_score_record(scorer.predict(rows), probability="probability")


def label_headlines(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """labels: dry-run labels of the training headlines, with what the cache holds; new ones are appended to it."""
    cache = f"{folder}/label_cache"
    heads = spark.read.parquet(f"{folder}/processed").select(F.col("row_id").alias("doc_id"), "headline")
    try:
        known = io.read_cache(spark, cache)
    except Exception as missing:  # the first run has no cache
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        known = spark.createDataFrame([], io.CACHE).select("key", "labels.*", "n_samples", F.lit(0).cast("bigint").alias("line_no"))
    out = labels.label(heads, known, "dry-run", limit=limit)
    io.write_stage(out, f"{folder}/labels")
    out = spark.read.parquet(f"{folder}/labels")
    keyed = out.withColumn("key", labels.cache_key("dry-run", "1", "headline")).join(known.select("key").distinct(), "key", "left_anti")
    io.append_jsonl(keyed.select("key", F.struct(*[c for c in out.columns if c != "headline"]).alias("labels"), F.lit(1).alias("n_samples")), cache)
    return out


def validate_gold(spark: SparkSession, folder: str, gold: str) -> DataFrame:
    """agreement: of dry-run labels with a file of gold labels; dimensions below the least alpha are not usable."""
    rows = io.read_gold(spark, gold)
    report = labels.gold_gate(rows, labels.rule_labels(rows.select("headline")))
    report.write.mode("overwrite").json(f"{folder}/agreement")
    return spark.read.json(f"{folder}/agreement")
