"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing. Of records with equal payloads the smallest id is a response and the others are revisits that carry headers
only. The archives are plain WARC/1.1 files that Spark's text writer makes: a row is a record up to its block, and the
line separator is the record's end. Any file system that Spark knows will do.

Reading. Spark's text reader splits files at the magic line that begins each record; the magic has no part in common
with its own beginning, so where a split starts does not matter. A payload may hold the magic too, so each piece only
is a candidate. Tasks emit for each candidate its offset and its successor's, from the record's own length. Pointer
jumping from the file's start, first inside a split, then over splits, keeps the candidates that the chain reaches;
the others are parts of payloads. Payloads are hashed where they are read, unless one holds the magic: its pieces are
put together by a second scan of those alone.

Defined results: a null payload is empty; a null url is written as the record's own id; line ends in a url are left
out; rows that repeat an id and a payload are all responses if that id is the smallest; a row without id is a response;
an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, log2_ceil, new_path, tune, with_group

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: The date of all records; a run's own date would make archives differ from run to run.
DATE = "2024-01-01T00:00:00Z"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


# --- writing --------------------------------------------------------------------------------


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    return F.translate(F.concat(*[F.lpad(F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]), HEX32, BASE32)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, most_broadcast: int = 1_000_000, records_per_file: int = 100_000) -> None:
    """One record for each row; equal payloads of at least min_bytes bytes are stored once.

    The rows that become revisits are found on (id, digest) alone. Only they meet the pages again: broadcast if they
    are at most most_broadcast, by a shuffle otherwise.
    """
    rows = pages.select(F.col(key).cast("long").alias("id"), F.regexp_replace(F.col(url).cast("string"), "[\r\n]", "").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", base32_sha1(F.encode("payload", "utf-8"))).withColumn("bytes", F.octet_length("payload"))
    lean = rows.where(F.col("bytes") >= min_bytes).where("id is not null").select("id", "digest", F.lit(1).alias("one"))
    known = with_group(lean, "digest", {"first": ("min", "id"), "n": ("sum", "one")}, "id", having=F.col("n") > 1)
    again = checkpointed(known.where("id <> first").select("id", "digest", "first").distinct())
    rows = rows.join(F.broadcast(again) if again.count() <= most_broadcast else again, ["id", "digest"], "left")
    revisit = F.col("first").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    rows = rows.withColumn("block", F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))))
    head = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), name("id"), F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), F.coalesce("url", name("id")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length("block").cast("string"), F.lit(END),
    )
    rows.select(F.concat(head, F.col("block")).alias("value")).write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", records_per_file).text(path)


# --- candidates -----------------------------------------------------------------------------

_FIELD = re.compile(rb"([A-Za-z0-9-]+):[ \t]*([^\r\n]*)\r\n").match
CANDIDATE = "file string, block long, place long, rel long, size long, next long, type string, id string, url string, refers_to string, digest string, payload_bytes long, sha1 string, complete boolean"


def parse_head(piece: bytes) -> tuple[dict[str, str], int] | None:
    """Fields by lower-case name and the header's length, or None if this is not a record's header."""
    at, fields = 0, {}
    while not piece.startswith(b"\r\n", at):
        m = _FIELD(piece, at)
        if m is None:
            return None
        fields[m[1].decode().lower()] = m[2].decode("utf-8", "replace")
        at = m.end()
    return (fields, at + 2) if fields.get("content-length", "").isdigit() and "warc-type" in fields else None


def payload_of(block: bytes) -> tuple[bytes, int | None]:
    """The HTTP body, and the length that its headers state."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return block, None
    m = re.search(rb"(?i)^content-length:[ \t]*(\d+)", head, re.M)
    return body, int(m[1]) if m else None


def sha1_32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, value): what lies between magic lines, in order within a split."""
    return spark.read.option("lineSep", MAGIC).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _record(piece: bytes) -> tuple:
    """Bytes from the magic's start to the successor's, and what the candidate says of itself."""
    got = parse_head(piece)
    if got is None:
        return (None,) * 7 + (None, False)
    fields, head = got
    n = int(fields["content-length"])
    whole = len(piece) == head + n + len(END)
    size = sha = None
    if whole:
        body, stated = payload_of(piece[head : head + n])
        if fields["warc-type"] == "revisit":
            size = stated
        else:
            size, sha = len(body), sha1_32(body)
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return len(MAGIC) + head + n + len(END), fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, size, sha, whole


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """A row for each piece. rel: its magic's place from the split's first byte; next: the successor's, if it has one."""

    def emit(batches):
        now, place, rel = None, 0, 0
        for b in batches:
            out = []
            for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (file, block) != now:
                    now, place, rel = (file, block), 0, 0
                step, *said = _record(value)
                at = rel - len(MAGIC)
                out.append((file, block, place, at, len(value), None if step is None else at + step, *said))
                rel += len(value) + len(MAGIC)
                place += 1
            cols = list(zip(*out)) if out else [[]] * 14
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [c.split(" ")[0] for c in CANDIDATE.split(", ")])

    return pieces(spark, path).mapInArrow(emit, CANDIDATE)


def located(found: DataFrame) -> DataFrame:
    """candidates' rows with offset and successor in the file, and stop, the split's end. Splits are summed in order."""
    splits = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begins = splits.select("file", "block", F.coalesce(F.sum("bytes").over(order), F.lit(0)).alias("begin"), "bytes")
    rows = found.join(begins, ["file", "block"])
    rows = rows.withColumn("offset", F.col("begin") + F.col("rel")).withColumn("successor", F.col("begin") + F.col("next"))
    return rows.withColumn("stop", F.col("begin") + F.col("bytes") - len(MAGIC)).where("offset >= 0").drop("rel", "next", "begin", "bytes", "place")


# --- the chain ------------------------------------------------------------------------------


def jump_inside(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """For sorted candidate offsets of a split: where each one's chain leaves the split (-1: it breaks off).

    Pointer jumping: every round doubles the steps that a pointer stands for.
    """
    n = len(offset)
    at = np.searchsorted(offset, successor)
    inside = (at < n) & (offset[np.minimum(at, n - 1)] == successor)
    leaves = np.where(inside | (successor <= offset[-1]), -1, successor)  # a successor inside that is none breaks the chain
    to = np.where(inside, at, np.arange(n))
    for _ in range(log2_ceil(n) + 1):
        to = to[to]
    return leaves[to]


def reached_inside(offset: np.ndarray, successor: np.ndarray, entry: int) -> np.ndarray:
    """Which candidates the chain from entry passes; by doubling the set that is reached and the pointers at once."""
    n = len(offset)
    hit = np.zeros(n + 1, bool)
    start = np.searchsorted(offset, entry)
    if start < n and offset[start] == entry:
        hit[start] = True
    at = np.searchsorted(offset, successor)
    to = np.append(np.where((at < n) & (offset[np.minimum(at, n - 1)] == successor), at, n), n)
    for _ in range(log2_ceil(n) + 1):
        hit[to[hit]] = True
        to = to[to]
    return hit[:n]


def _numbers(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)


def reachable(rows: DataFrame) -> DataFrame:
    """Of located, checkpointed candidates those that the chain from the file's start reaches."""
    spans = rows.select("file", "block", "offset", "successor", "stop")

    def leave(t: pa.Table) -> pa.Table:
        t = t.sort_by("offset")
        return t.select(["file", "block", "offset"]).append_column("leaves", pa.array(jump_inside(_numbers(t, "offset"), _numbers(t, "successor"))))

    most = spans.groupBy("file").agg(F.countDistinct("block").alias("n")).agg(F.max("n")).first()[0] or 0
    entries = spans.where("offset = 0").select("file", "offset").distinct()
    if most > 1:
        jumps = checkpointed(spans.groupBy("file", "block").applyInArrow(leave, "file string, block long, offset long, leaves long").where("leaves >= 0").select("file", "offset", "leaves"))
        entries = checkpointed(entries)
        for _ in range(log2_ceil(most) + 1):
            entries = checkpointed(entries.unionAll(entries.join(jumps, ["file", "offset"]).select("file", F.col("leaves").alias("offset"))).distinct())
            further = jumps.select("file", F.col("offset").alias("leaves"), F.col("leaves").alias("beyond"))
            jumps = checkpointed(jumps.join(further, ["file", "leaves"], "left").select("file", "offset", F.coalesce("beyond", "leaves").alias("leaves")))
    marked = spans.join(entries.withColumn("entry", F.lit(True)), ["file", "offset"], "left")

    def reach(t: pa.Table) -> pa.Table:
        t = t.sort_by("offset")
        offset, successor, hit = _numbers(t, "offset"), _numbers(t, "successor"), np.zeros(t.num_rows, bool)
        for e in offset[t.column("entry").combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)].tolist():
            hit |= reached_inside(offset, successor, e)
        return t.select(["file", "offset"]).filter(pa.array(hit))

    chain = marked.select("file", "block", "offset", "successor", "entry").groupBy("file", "block").applyInArrow(reach, "file string, offset long")
    return rows.join(chain, ["file", "offset"], "left_semi")


# --- reading --------------------------------------------------------------------------------


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(type, id, url, refers_to, digest, payload_bytes, sha1) of every record; sha1 is that of the payload as read.

    Raises if a file's chain breaks off before the file's end, or a payload does not have its digest.
    """
    tune(spark)
    rows = checkpointed(located(checkpointed(candidates(spark, path))))
    real = checkpointed(reachable(rows))
    ends = rows.groupBy("file").agg(F.max(F.col("stop")).alias("stop"))
    broken = ends.join(real.groupBy("file").agg(F.max("successor").alias("successor")), "file", "left").where("successor is null or successor <> stop")
    if (bad := broken.first()) is not None:
        raise ValueError(f"the chain of {bad['file']} breaks off: {bad}")
    columns = ["type", "id", "url", "refers_to", "digest", "payload_bytes", "sha1"]
    out = real.where("complete").select(columns)
    cut = real.where("not complete")
    if not cut.isEmpty():
        out = out.unionAll(joined_payloads(spark, path, rows, real).select(columns))
    wrong = out.where("type = 'response' and digest is not null and digest <> sha1")
    if (bad := wrong.first()) is not None:
        raise ValueError(f"a payload does not have its digest: {bad}")
    return out


def joined_payloads(spark: SparkSession, path: str, rows: DataFrame, real: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their pieces are read again and put together in order."""
    files = real.where("not complete").select("file").distinct()
    starts = real.select("file", "offset", F.col("offset").alias("start"), F.col("complete").alias("alone"))
    last = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    owned = rows.join(files, "file", "left_semi").select("file", "offset").join(starts, ["file", "offset"], "left")
    owned = owned.withColumn("owner", F.last("start", ignorenulls=True).over(last)).withColumn("alone", F.last("alone", ignorenulls=True).over(last)).where("not alone").select("file", "offset", "owner")

    def with_places(batches):
        now, rel = None, 0
        for b in batches:
            at = []
            for file, block, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (file, block) != now:
                    now, rel = (file, block), 0
                at.append(rel - len(MAGIC))
                rel += len(value) + len(MAGIC)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], ["file", "block", "value", "rel"])

    again = pieces(spark, path).mapInArrow(with_places, "file string, block long, value binary, rel long")
    again = located(again.select("*", F.octet_length("value").cast("long").alias("size"), F.lit(None).cast("long").alias("next"), F.lit(0).alias("place")))

    def join(t: pa.Table) -> pa.Table:
        t = t.sort_by("offset")
        whole = MAGIC.encode().join(t.column("value").to_pylist())
        fields, head = parse_head(whole)
        body, stated = payload_of(whole[head : head + int(fields["content-length"])])
        said = _record(whole)
        return pa.table([[x] for x in (*said[1:6], len(body) if said[1] != "revisit" else stated, sha1_32(body))], schema=pa.schema([("type", pa.string()), ("id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("sha1", pa.string())]))

    kept = again.select("file", "offset", "value").join(owned, ["file", "offset"])
    return kept.groupBy("file", "owner").applyInArrow(join, "type string, id string, url string, refers_to string, digest string, payload_bytes long, sha1 string")


def page_number(name: Column) -> Column:
    return F.regexp_extract(name, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long") if hasattr(name, "try_cast") else F.regexp_extract(name, r"^<urn:x-page:(-?\d+)>$", 1).cast("long")


def warc_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write pages to archives in the shared folder, and tell from them (page_id, payload_bytes, payload_digest, record_type, refers_to)."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, min_bytes=min_bytes)
    got = read_warc(spark, path)
    digest = F.when(F.col("type") == "revisit", F.col("digest")).otherwise(F.col("sha1"))
    return got.select(page_number(F.col("id")).alias("page_id"), "payload_bytes", digest.alias("payload_digest"), F.col("type").alias("record_type"), page_number(F.col("refers_to")).alias("refers_to"))
