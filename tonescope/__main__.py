"""python -m tonescope STAGE FOLDER: run a stage of the batch pipeline."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import stages


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tonescope", description=__doc__)
    commands = parser.add_subparsers(dest="stage", required=True)
    add = lambda name, text: commands.add_parser(name, help=text)
    for name, text in (("ingest", "headlines, one a line"), ("posts", "graded posts"), ("dedup", "near-duplicate groups"), ("split", "training sets"), ("train", "models and report"), ("label", "dry-run labels"), ("validate-gold", "agreement with gold labels")):
        add(name, text).add_argument("folder")
    commands.choices["ingest"].add_argument("--source", nargs=3, action="append", metavar=("PATH", "LABEL", "NAME"), help="a file of headlines; without any, a sample is made")
    commands.choices["posts"].add_argument("--archive")
    commands.choices["dedup"].add_argument("--bands", action="store_true", help="unverified bands instead of exact similarity")
    commands.choices["label"].add_argument("--limit", type=int)
    commands.choices["validate-gold"].add_argument("--gold", required=True)
    a = parser.parse_args(args)
    spark = spark or SparkSession.builder.appName("tonescope").getOrCreate()
    run = {
        "ingest": lambda: stages.ingest(spark, a.folder, [(p, int(label), n) for p, label, n in a.source or ()]),
        "posts": lambda: stages.ingest_posts(spark, a.folder, a.archive),
        "dedup": lambda: stages.deduplicate(spark, a.folder, not a.bands),
        "split": lambda: stages.split_sets(spark, a.folder),
        "train": lambda: stages.train(spark, a.folder),
        "label": lambda: stages.label_headlines(spark, a.folder, a.limit),
        "validate-gold": lambda: stages.validate_gold(spark, a.folder, a.gold),
    }
    run[a.stage]().show(40, truncate=60)


if __name__ == "__main__":
    main()
