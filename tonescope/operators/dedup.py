"""Near-duplicate headlines: exact Jaccard joins of character shingles, MinHash bands, and groups.

Equal normalized headlines are one text from the start, so copies never meet each other in a join; a group's rows get
their text's group back at the end. Pairs are pairs of texts, each named by its smallest row id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PARAMS
from ..functions.text import normalize, shingles
from .store import shared_folder, stored


def texts(df: DataFrame, row_id: str = "doc_id", headline: str = "headline") -> DataFrame:
    """(rep, norm): the distinct normalized headlines, named by their smallest row id.

    Rows are small but what follows is heavy, so they keep all partitions, where adaptive execution would join them.
    """
    rows = df.where(F.col(headline).isNotNull()).groupBy(normalize(headline).alias("norm")).agg(F.min(row_id).alias("rep"))
    return rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rep")


#: Hashes up to which their counts are broadcast (16 bytes each), so that sets are put in order where they are.
MOST_HASHES = 1_000_000


def hashed_sets(distinct: DataFrame, k: int = PARAMS.shingle_size) -> DataFrame:
    """(rep, set): a text's shingles as 64-bit hashes."""
    return distinct.select("rep", F.transform(shingles("norm", k), lambda x: F.xxhash64(x)).alias("set"))


def rarest_first(sets: DataFrame) -> DataFrame:
    """sets with each set's hashes in one order for all: the rarest first, equal ones by hash.

    Hashes are counted map-side. Few of them, as of short shingles, are broadcast; more are joined, a row for each.
    """
    counts = stored(sets.select(F.explode("set").alias("hash")).groupBy("hash").agg(F.count("*").alias("df")))
    if counts.count() > MOST_HASHES:
        rows = sets.select("rep", F.explode("set").alias("hash")).join(counts, "hash")
        ordered = rows.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "hash"))).alias("sorted"))  # as long as a text
        return ordered.select("rep", F.transform("sorted", lambda x: x["hash"]).alias("set"))
    table = counts.orderBy("hash").toArrow()
    shared = sets.sparkSession.sparkContext.broadcast((table.column("hash").to_numpy(), table.column("df").to_numpy()))

    @F.pandas_udf("array<long>")
    def ordered(column: pd.Series) -> pd.Series:
        hashes, df = shared.value
        size = column.map(len).to_numpy(int)
        flat = np.concatenate([np.zeros(0, np.int64), *column]).astype(np.int64)
        row = np.repeat(np.arange(len(size)), size)
        flat = flat[np.lexsort((flat, df[np.searchsorted(hashes, flat)], row))]
        return pd.Series(np.split(flat, np.cumsum(size)[:-1]) if len(size) else [], dtype=object)

    return sets.select("rep", ordered("set").alias("set"))


def jaccard_pairs(distinct: DataFrame, k: int = PARAMS.shingle_size, threshold: float = PARAMS.lsh_threshold) -> DataFrame:
    """(a, b, jaccard) of all pairs of texts with a Jaccard similarity of threshold or more, a < b.

    Two such sets differ in few shingles. Shingles fall into more parts than that by their hashes, so the sets are equal in
    one part at least, and only texts with an equal part are joined, as lean rows (``part_keys``). Any one shingle is in a
    share of all texts, so that pairs that share a rare one grow with the square of the texts; equal parts of several
    shingles are chance but for near copies. Lengths and bitmaps bound the overlap at once, and each pair that is left
    meets its whole sets, as hashes, once.
    """
    sets = stored(hashed_sets(distinct, k).select("rep", F.size("set").alias("n"), "set", *[_bits("set", w).alias(f"w{w}") for w in range(WORDS)]))
    keyed = sets.select("rep", "n", *[f"w{w}" for w in range(WORDS)], part_keys(threshold)("set").alias("keys"), parts_of("n", threshold).alias("mine"))
    rows = keyed.select("rep", "n", *[f"w{w}" for w in range(WORDS)], F.posexplode("keys").alias("at", "key"), "mine").withColumn("own", F.col("at") < F.col("mine"))
    side = lambda x, of: of.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), "key", *[F.col(f"w{w}").alias(f"{x}{w}") for w in range(WORDS)])
    # the longer text (of equally long ones the one with the smaller id) is in its own class of lengths
    near = ((F.col("na") > F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))) & (F.col("nb") >= F.col("na") * threshold)
    least = (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9  # the overlap that the threshold asks for
    # bits that one set has alone bound the overlap
    alone = lambda x, y: sum((F.bit_count(F.col(f"{x}{w}").bitwiseAND(F.bitwise_not(f"{y}{w}"))) for w in range(WORDS)), F.lit(0))
    fits = (F.col("na") - alone("a", "b") >= least) & (F.col("nb") - alone("b", "a") >= least)
    pairs = side("a", rows.where("own")).hint("merge").join(side("b", rows), "key").where(near & fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("rep").alias(side), F.col("set").alias(f"s{side}")), side)
    both = F.size(F.array_intersect("sa", "sb"))
    scored = pairs.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), both.alias("both"))
    found = scored.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))
    return found.where(F.col("jaccard") >= threshold)


#: The longest set of a class of lengths is so much longer than its shortest, about.
CLASS = 1.1


def _classes(most: int) -> np.ndarray:
    """The shortest lengths of the classes up to one that holds ``most``, and of the class behind it."""
    first = [1]
    while first[-1] <= most:
        first.append(max(first[-1] + 1, int(first[-1] * CLASS)))
    return np.array(first)


def _parts(first: np.ndarray, threshold: float) -> np.ndarray:
    """Parts of each class: one more than shingles in which two sets of the threshold differ, the longer one of that class."""
    return np.floor(2 * (first[1:] - 1) * (1 - threshold) / (1 + threshold) + 1e-9).astype(np.int64) + 1


def parts_of(n: str, threshold: float):
    """How many parts the own class of a set of n shingles has: so many of its keys come first."""

    def parts(column: pd.Series) -> pd.Series:
        first = _classes(int(column.max()) if len(column) else 1)
        return pd.Series(_parts(first, threshold)[np.searchsorted(first, column.to_numpy(), side="right") - 1])

    return F.pandas_udf(parts, "long")(n)


def part_keys(threshold: float):
    """A function of columns of sets: a key for each part of a set's own class of lengths, then of each class up to the
    longest set that reaches the threshold with it. A part's key is the sum of its mixed hashes; equal parts have equal keys.
    """

    def keys(column: pd.Series) -> pd.Series:
        size = column.map(len).to_numpy(int)
        flat = np.concatenate([np.zeros(0, np.int64), *column]).astype(np.int64).view(np.uint64)
        row = np.repeat(np.arange(len(size)), size)
        first = _classes(int(size.max(initial=1) / threshold + 1e-9))
        parts = _parts(first, threshold)
        begin, end = (np.searchsorted(first, n, side="right") - 1 for n in (size, np.floor(size / threshold + 1e-9)))
        upto = np.concatenate([[0], np.cumsum(parts)])
        count = np.where(size > 0, upto[end + 1] - upto[begin], 0)
        start = np.cumsum(count) - count
        mixed, where = _mixed(flat), _mixed(flat ^ np.uint64(0x5BD1E9955BD1E995))
        out = np.zeros(int(count.sum()), np.uint64)
        for ahead in range(int((end - begin).max(initial=-1)) + 1):
            c = begin + ahead
            there = np.flatnonzero((c <= end)[row])
            of = c[row[there]]
            np.add.at(out, start[row[there]] + upto[of] - upto[begin[row[there]]] + (where[there] % parts[of].astype(np.uint64)).astype(np.int64), mixed[there])
        at = np.arange(len(out)) - np.repeat(start - upto[begin], count)  # of all parts of all classes
        out = _mixed(out ^ _mixed(at.astype(np.uint64))).view(np.int64)
        return pd.Series(np.split(out, np.cumsum(count)[:-1]) if len(size) else [], dtype=object)

    return F.pandas_udf(keys, "array<long>")


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


#: A text's set is also kept as a bitmap of so many 64-bit words.
WORDS = 4


def _bits(hashes: str, word: int):
    """The bitmap's word: a bit for each hash that falls there."""
    bit = lambda h: F.when(F.shiftrightunsigned(h, 6).bitwiseAND(WORDS - 1) == word, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long"))
    return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a.bitwiseOR(bit(h)))


def minhash(distinct: DataFrame, k: int = PARAMS.shingle_size, permutations: int = PARAMS.num_perm) -> DataFrame:
    """(rep, norm, signature): the smallest value of each of so many hash functions over the shingles.

    Shingles are hashed in the JVM; the functions run over Arrow batches, as higher-order functions are interpreted.
    """
    draw = np.random.default_rng(1)
    a, b = (draw.integers(1, 2**63, permutations, dtype=np.uint64) | np.uint64(1) for _ in range(2))

    def least(sets: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return sets.map(lambda s: ((s.astype(np.int64).view(np.uint64)[None, :] * a[:, None] + b[:, None]) >> np.uint64(1)).min(1).astype(np.int64))

    hashed = F.transform(shingles("norm", k), lambda x: F.xxhash64(x))
    return distinct.select("rep", "norm", F.pandas_udf(least, T.ArrayType(T.LongType()))(hashed).alias("signature"))


#: Bands and rows of 128 permutations for a threshold of 0.8 when false positives and negatives weigh alike.
BANDS, ROWS = 9, 13


def bucket_rows(signed: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(rep, bucket) for each band."""
    buckets = F.array(*[F.xxhash64(F.lit(b), F.slice("signature", b * rows + 1, rows)) for b in range(bands)])
    return signed.select("rep", F.explode(buckets).alias("bucket"))


#: Members of a bucket that meet in one task, about; and members from which on a bucket's rows are spread before they are counted out.
BLOCK, HOT = 256, 4_096


def dealt(buckets: DataFrame, block: int = BLOCK, hot: int = HOT, salts: int = 64) -> DataFrame:
    """(bucket, first, second, own, rep): members of buckets that hold two or more, in blocks by their hashes, dealt to each
    pair of blocks that holds theirs. So a task sees two blocks at most, however many members a bucket has."""
    buckets = stored(buckets)
    counts = stored(buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    big = counts.where(F.col("n") > hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    marked = buckets.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(salts)).cast("int")).join(big, ["bucket", "salt"], "left")
    few = marked.where("n IS NULL").select("rep", "bucket").join(counts.where(F.col("n") <= hot), "bucket")
    rows = marked.where("n IS NOT NULL").select("bucket", "rep", "n").unionAll(few.select("bucket", "rep", "n"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(7)), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return rows.select("bucket", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "rep")


def _similar(threshold: float):
    """The task of a pair of blocks: its pairs of different blocks (or of the one) whose similarity reaches the threshold."""

    def task(t: pa.Table) -> pa.Table:
        rep, own, sets = t.column("rep").to_numpy(), t.column("own").to_numpy(), t.column("set").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        hashes, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        row, both = np.repeat(np.arange(len(rep)), size), np.zeros((len(rep), len(rep)), np.float32)
        for begin in range(0, len(hashes), 8192):
            here = (code >= begin) & (code < begin + 8192)
            part = np.zeros((len(rep), min(8192, len(hashes) - begin)), np.float32)
            part[row[here], code[here] - begin] = 1
            both += part @ part.T
        either = size[:, None] + size[None, :] - both
        pairs = (both >= threshold * either) & (rep[:, None] < rep[None, :])
        if t.column("first")[0].as_py() != t.column("second")[0].as_py():
            pairs &= own[:, None] != own[None, :]
        i, j = np.nonzero(pairs)
        return pa.table({"a": rep[i], "b": rep[j]})

    return task


def lsh_links(distinct: DataFrame, verify: bool = True, threshold: float = PARAMS.lsh_threshold, k: int = PARAMS.shingle_size, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """(a, b): links of band candidates. Unverified, a bucket's texts are all linked with its smallest, which joins the
    same texts as all pairs would; verified, pairs of a bucket are kept if their exact similarity reaches threshold.

    Verified pairs are found in blocks inside tasks, so only pairs that are links become rows.
    """
    buckets = bucket_rows(minhash(distinct, k))
    if not verify:
        least = buckets.groupBy("bucket").agg(F.min("rep").alias("a"))
        return buckets.join(least, "bucket").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    members = dealt(buckets, block, hot).join(hashed_sets(distinct, k), "rep")
    kind = dict(distinct.dtypes)["rep"]
    return members.groupBy("bucket", "first", "second").applyInArrow(_similar(threshold), f"a {kind}, b {kind}").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(rep, component): the smallest text that each end of a link reaches, by spreading the least label and jumping.

    Rounds are checkpointed in the session's shared folder; the loop ends when no label changes.
    """
    _checkpoint_dir(links)
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("component")).withColumnRenamed("a", "rep").checkpoint()
    for _ in range(most_rounds):
        around = both.join(labels.select(F.col("rep").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        spread = labels.join(around, labels.rep == around.a).select("rep", F.least("component", "near").alias("next"), "component")
        jump = labels.select(F.col("rep").alias("next"), F.col("component").alias("beyond"))
        new = spread.join(jump, "next").select("rep", F.least("next", "beyond").alias("component"), F.col("component").alias("before")).checkpoint()
        labels = new.select("rep", "component")
        if new.where("component <> before").isEmpty():
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")


def _checkpoint_dir(df: DataFrame) -> None:
    shared_folder(df.sparkSession)


def with_groups(df: DataFrame, links: DataFrame, row_id: str = "doc_id", headline: str = "headline") -> DataFrame:
    """df with ``group_min`` (the smallest row id of the row's group) and ``dup_group``, numbered from 0 in its order."""
    named = df.withColumn("norm", normalize(headline)).join(texts(df, row_id, headline), "norm")
    placed = stored(named.join(components(links), "rep", "left").withColumn("group_min", F.coalesce("component", "rep")))
    return placed.join(numbered(placed.select("group_min").distinct()), "group_min").drop("norm", "rep", "component")


def numbered(groups: DataFrame, buckets: int | None = None) -> DataFrame:
    """(group_min, dup_group): consecutive numbers in group_min's order, by ranges: counts of ranges first, then places in each."""
    buckets = buckets or int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = groups.repartitionByRange(buckets, "group_min").withColumn("part", F.spark_partition_id())
    _checkpoint_dir(groups)
    ranged = ranged.checkpoint()
    sizes = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("group_min")) - 1
    return ranged.withColumn("place", place).join(F.broadcast(before), "part").select("group_min", (F.col("before") + F.col("place")).alias("dup_group"))
