"""The corpus that queries run on: first sentences of documents as headlines, with phrases in front that fire each rule.

Raw documents hold few of the rules' phrases. A CASE over doc_id, the same in Spark and in SQL, puts one of twelve
beginnings before each first sentence, the last being none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BEGINNINGS = (
    "Guess what: here's why it matters, ",
    "Senator slams rival in furious speech: ",
    "Deadly storm: ",
    "New survey proves it: ",
    "Heartbreaking and absolutely stunning: ",
    "MUST READ NOW: ",
    "Really?! This one is for you! ",
    "12 things to keep: ",
    "Item #9 of the list: ",
    "NASA and FBI report: ",
    "Joe Biden and the GOP on the budget: ",
    "",
)
SENTENCE = r"(?s)^(.*?[.!?])[ \n\t\r]"
#: Letters that patterns with word boundaries take for word characters in Spark but not in the SQL engine.
LATIN = r"[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{024F}]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, headline, body)."""
    sentence = F.split("text", r"(?<=[.!?])[ \n\t\r]", 2)[0]
    begin = F.element_at(F.array(*[F.lit(b) for b in BEGINNINGS]), (F.col("doc_id") % 12 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", "lang", F.concat(begin, sentence).alias("headline"), F.col("text").alias("body"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """probe with label (toxic) and intensity, of the documents that have labels."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = probe(spark, sf_dir).join(labels.select("doc_id", "quality", "toxic"), "doc_id")
    return rows.withColumn("label", F.col("toxic").cast("int")).withColumn("intensity", 0.5 * F.col("toxic") + 0.5 * (1 - F.col("quality")))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PROBE_SQL = f"""probe AS (
    SELECT doc_id, lang, list_extract([{", ".join(map(quoted, BEGINNINGS))}], CAST(doc_id % 12 + 1 AS INTEGER))
        || coalesce(nullif(regexp_extract(text, {quoted(SENTENCE)}, 1), ''), text) AS headline, text AS body
    FROM documents
)"""
LABELLED_SQL = f"""{PROBE_SQL}, labelled AS (
    SELECT p.*, quality, toxic, CAST(toxic AS INTEGER) AS label, CAST(0.5 AS DOUBLE) * toxic + CAST(0.5 AS DOUBLE) * (1 - quality) AS intensity
    FROM probe p JOIN labels USING (doc_id)
)"""
