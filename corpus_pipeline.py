"""From raw documents to packed training sequences, in stages that are written as Parquet and read again.

Toxic documents go, then those of low quality, then all but one of each group of near copies; the rest is packed into
sequences of 2048 tokens. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonescope.llm import minhash, quality, queries, toxicity
from tonescope.llm.common import new_path

#: Five-word shingles at a similarity of 0.8; a link at 0.8 is missed by all 32 bands with a chance of 5e-8.
COPIES = minhash.NearDup(percent=80, shingle=5, rows=4, bands=32)


def _free(docs: DataFrame, prefix: str) -> str:
    """A prefix that no column of docs begins with, so that a stage's own columns replace none of them."""
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    return prefix


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose whole text scores below one half, with all their columns.

    A null or empty text scores by no word and stays, as far as the labels make clean texts the rule; repeated rows are
    scored alike, each for itself; no documents give none.
    """
    model = toxicity.train_toxicity(docs, queries.labels(spark, sf_dir))
    prefix = _free(docs, "_toxic_")
    scored = toxicity.score_toxicity(docs, model, prefix=prefix)
    return scored.where(F.col(f"{prefix}predicted") == 0).select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base rules and the model, with all their columns.

    Texts of fewer than 50 words, null and empty ones with them, go; repeated rows are judged alike, each for itself; no
    documents give none.
    """
    model = quality.train_quality(docs, queries.labels(spark, sf_dir))
    prefix = _free(docs, "_quality_")
    return quality.score_quality(docs, model, prefix=prefix).where(F.col(f"{prefix}kept")).select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id, with all its columns.

    Documents without words or without id are copies of nothing and stay; all rows of a kept id stay; no documents give
    none.
    """
    return minhash.without_copies(docs, COPIES)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its sequence and place there; other columns go.

    A null or empty text is its end token alone; a repeated row is a document of its own; no documents give no pieces.
    """
    return queries.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("minhash_near_dedup", drop_copies),
    ("best_fit_packing", pack),
]

#: The stages train models and pack by search; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
