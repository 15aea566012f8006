"""Token ids in ORC files.

Documents are dealt once into ranges of ids, sorted within each, encoded in Arrow batches and written by Spark's ORC
writer: integer columns in run-length encoding, row indexes, and Bloom filters on doc_id. The files' order (their
``range`` number, then the rows' order) is the order of the ids, so a reader can take stripes in parallel, and a
look-up of documents skips stripes and row groups by their minimum, maximum and Bloom filter.

Defined results: a null or empty text has no ids but the end id; rows of equal doc_id are ordered by a hash of their
text, equal rows by their place in the table, so ranges can part them; null doc_ids come first; an empty table gives an
empty file set that reads as an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, checkpointed, chunk_encoder, new_path, partitions, tune

SCHEMA = "doc_id long, part int, place long, ids array<int>"


def write_tokens(df: DataFrame, path: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", spaced: bool = False, ranges: int | None = None) -> None:
    """Encode every whole text of df, append end_id, and write the ids to ORC files at path in ascending key order."""
    tune(df.sparkSession)
    n = ranges or max(2 * partitions(df.sparkSession), 8)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("_hash"), F.monotonically_increasing_id().alias("_at"))
    order = ["doc_id", "_hash", "_at"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("part"))

    def encode(batches):
        encoder, place = chunk_encoder(tokenizer, spaced, 1_000_000), 0
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in blocks(texts):
                flat, counts = encoder.encode(texts[i:j])
                stop = np.cumsum(counts + 1)
                ids = np.full(int(stop[-1]), end_id, np.int32)
                keep = np.ones(len(ids), bool)
                keep[stop - 1] = False
                ids[keep] = flat
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]).astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(place + np.arange(j - i)), lists], ["doc_id", "part", "place", "ids"])
                place += j - i

    (
        rows.mapInArrow(encode, SCHEMA)
        .write.mode("overwrite")
        .option("orc.compress", "ZSTD")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of the files; with doc_ids only theirs, by a filter that reaches the stripes' metadata."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def token_digest(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of what read_tokens gives; start counts the ids of all documents before.

    The sums of the ranges are added up first (one row for each), then the rows' within a range.
    """

    def digest(batches):
        for b in batches:
            lists = b.column("ids")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
            crc = [zlib.crc32(flat[i:j]) for i, j in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("place"), pa.array((ends - starts).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "place", "n_tokens", "ids_crc32"])

    rows = checkpointed(tokens.mapInArrow(digest, "doc_id long, part int, place long, n_tokens long, ids_crc32 long"))
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    earlier = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", earlier).join(before, "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokens_by_orc(df: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write df's ids to the shared folder, read them back, and digest them."""
    spark = df.sparkSession
    path = new_path(spark, "tokens")
    write_tokens(df, path, tokenizer, end_id)
    return token_digest(read_tokens(spark, path))
