"""Sources and sinks: text lines, posts, labels, caches, pages, and the tables between stages."""

from __future__ import annotations

import zipfile
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PARAMS
from ..functions.lexicon import DIMENSIONS
from ..functions.text import strip

INSTANCE = "id string, postText array<string>, targetTitle string, targetParagraphs array<string>"
TRUTH = "id string, truthMean double, truthClass string"
GOLD = "headline string, " + ", ".join(f"{d} int" for d in DIMENSIONS)
CACHE = "key string, labels struct<" + ", ".join(f"{d}: int" for d in DIMENSIONS) + ", out_of_scope: boolean>, n_samples int"


def read_lines(spark: SparkSession, path: str, label: int, source: str, outlet: str | None = None) -> DataFrame:
    """Headlines, one a line, plain or gzip; blank lines are left out."""
    rows = spark.read.text(path).select(strip("value").alias("headline")).where("headline <> ''")
    return rows.withColumns({"label_clickbait": F.lit(label), "source": F.lit(source), "outlet": F.lit(outlet).cast("string")})


def _unzipped(suffix: str):
    """The task that reads archives: (path, line) of the first member whose name ends with suffix, some lines at a time."""

    def task(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                with zipfile.ZipFile(pa.BufferReader(content.as_buffer())) as z:
                    name = next((n for n in z.namelist() if n.endswith(suffix)), None)
                    if name is None:
                        raise FileNotFoundError(f"no member of {path} ends with {suffix}")
                    with z.open(name) as f:
                        while lines := list(islice(f, 2_000)):
                            kept = [x for x in lines if x.strip()]
                            yield pa.RecordBatch.from_arrays([pa.array([path] * len(kept), pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], ["path", "line"])

    return task


def read_jsonl_from_zip(spark: SparkSession, archive: str, suffix: str, schema: str) -> DataFrame:
    """The first member of a zip archive whose name ends with suffix, as JSON lines in their order; blank ones don't count.

    The archive may be wherever Spark reads from, and be several (a folder or a pattern): each is one task's, which holds
    its packed bytes, up to 2 GB, and reads the member as a stream. A line that is no JSON is a row of nulls.
    """
    files = spark.read.format("binaryFile").load(archive).select("path", "content")
    lines = files.mapInArrow(_unzipped(suffix), "path string, line string")
    return lines.select(F.from_json("line", schema).alias("j")).select("j.*")


def graded_posts(instances: DataFrame, truth: DataFrame, source: str = "posts") -> DataFrame:
    """Posts with their graded truth. Posts without truth are left out; of several truths for an id the last read counts."""
    last = truth.withColumn("_n", F.monotonically_increasing_id()).groupBy("id").agg(F.max_by("truthMean", "_n").alias("intensity"), F.max_by("truthClass", "_n").alias("truthClass"))
    paragraphs = F.filter(F.transform(F.coalesce("targetParagraphs", F.array().cast("array<string>")), strip), lambda p: p != "")
    rows = instances.join(last, "id").select(
        "id", strip(F.array_join(F.coalesce("postText", F.array().cast("array<string>")), " ")).alias("headline"), F.coalesce("targetTitle", F.lit("")).alias("target_title"),
        F.substring(F.array_join(paragraphs, " "), 1, PARAMS.max_body_chars).alias("body"), "intensity", (F.col("truthClass") == "clickbait").cast("int").alias("label_clickbait"), F.lit(source).alias("source"),
    )
    return rows.where(F.length("headline") >= PARAMS.min_post_chars)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').schema(GOLD).csv(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """Cache records with their line numbers, in the order of files and lines."""
    rows = spark.read.schema(CACHE).json(path).where("key IS NOT NULL")
    return rows.withColumn("line_no", F.monotonically_increasing_id()).select("key", "labels.*", "n_samples", "line_no")


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def write_stage(df: DataFrame, path: str, by_split: bool = False) -> None:
    """A stage's table; training sets are parted by split, so a reader of one set reads that alone."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy("split") if by_split else writer).parquet(path)


def variants(seeds: DataFrame, times: int, headline: str = "headline") -> DataFrame:
    """Each row in ``times`` variants, numbered by ``i``: the headline as it is, then with the number of a report behind it."""
    rows = seeds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.withColumn(headline, F.when(F.col("i") == 0, F.col(headline)).otherwise(F.concat(headline, F.lit(" — report "), F.col("i").cast("string"))))


def sample_headlines(spark: SparkSession, times: int = 25) -> DataFrame:
    """Invented headlines, half of them bait, each in ``times`` variants: near copies for tests of the whole pipeline."""
    bait = [f"You won't believe what {x} did on {d}" for x, d in (("the mayor", "Monday"), ("this baker", "Tuesday"), ("our neighbour", "Friday"))]
    bait += [f"{n} things about {x} that will shock you" for n, x in ((7, "tea"), (12, "parking"), (21, "old maps"), (9, "rain"))]
    bait += ["Guess what happened next at the harbour!!", "This one trick keeps bread fresh", "Here's why everyone talks about lamps"]
    wire = [f"{x} approves {y}" for x in ("Council", "Ministry") for y in ("new bus lines", "the annual budget", "a bridge repair plan")]
    wire += ["Harbour reports record cargo in March", "Court hears appeal in land dispute", "Rain expected along the coast", "Library opens second reading room"]
    seeds = spark.createDataFrame([(i, h, 1 if i < 10 else 0) for i, h in enumerate(bait + wire)], "seed int, headline string, label_clickbait int")
    return variants(seeds, times).select((F.col("seed") * times + F.col("i")).cast("bigint").alias("row_id"), "headline", "label_clickbait", F.lit("sample").alias("source"), F.lit(None).cast("string").alias("outlet"))


def sample_posts(spark: SparkSession, times: int = 40) -> DataFrame:
    """Invented posts of graded intensity; the label is intensity of one half or more."""
    seeds = [("Quarterly trade figures published", 0.05), ("Town hall debates tram line", 0.1), ("Why your kettle may be too loud", 0.55), ("The reason will surprise you", 0.9), ("Ten signs of a good umbrella", 0.7), ("Weather service updates its maps", 0.2)]
    rows = spark.createDataFrame([(i, h, x) for i, (h, x) in enumerate(seeds)], "seed int, headline string, intensity double")
    return variants(rows.withColumn("target_title", F.col("headline")), times).select(
        F.concat_ws("-", F.lit("post"), "seed", "i").alias("id"), "headline", "target_title", F.concat("target_title", F.lit(". The article repeats it at length.")).alias("body"), "intensity", (F.col("intensity") >= 0.5).cast("int").alias("label_clickbait"), F.lit("sample").alias("source"),
    )


def clean(df: DataFrame, row_id: str = "row_id", headline: str = "headline") -> DataFrame:
    """Ends trimmed, lengths within bounds, and of equal headlines the one with the smallest row id."""
    rows = df.withColumn(headline, strip(headline)).where(F.length(headline).between(PARAMS.min_headline_chars, PARAMS.max_headline_chars))
    first = rows.groupBy(headline).agg(F.min(row_id).alias("_first"))
    return rows.join(first.select(F.col("_first").alias(row_id)), row_id, "left_semi")
