"""The feedback queue as a stream: read, check, append, and count by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import with_validity

SCHEMA = "headline string, model_score double, user_verdict string, comment string, ts double"


def read_feedback(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    reader = (spark.readStream if streaming else spark.read).schema(SCHEMA)
    return reader.json(path).withColumn("ts", F.timestamp_seconds("ts"))


def valid_feedback(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected)."""
    checked = with_validity(rows, "feedback")
    return checked.where("valid").drop("valid"), checked.where("NOT valid").drop("valid")


def append_feedback(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Append the accepted events that are there to target, each once, as JSON lines."""
    accepted, _ = valid_feedback(read_feedback(spark, source))
    return accepted.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)


def stamped(rows: DataFrame) -> DataFrame:
    """rows with ``ts``, the seconds at which they came in, where they have none."""
    now = F.unix_micros(F.current_timestamp()) / 1e6
    return rows.withColumn("ts", F.coalesce(F.col("ts"), now) if "ts" in rows.columns else now)


def queue_count(spark: SparkSession, path: str) -> int:
    """Events in the queue; none if there is no queue yet."""
    try:
        return spark.read.text(path).count()
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return 0


def verdict_windows(events: DataFrame, ts: str, kind: str, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, kind, n) by tumbling windows; the same plan serves a stream (late bounds its state) and a batch."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), kind, "n")
