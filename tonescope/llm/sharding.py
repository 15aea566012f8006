"""Sharding by histogram sort.

Rows are dealt to shards by ranges of an integer key so that the shards' bytes are near equal. Nothing is sampled:
tasks count the exact bytes and rows below candidate boundaries (probes), the counts of all tasks are summed, and the
probes are refined between the two that enclose each wanted boundary until every splitter meets its tolerance. Only
then do the rows move, once, to the ranges that the splitters make. A key whose rows reach beyond a boundary is parted
there: its rows are ordered by a hash of their place in the table, and the same counting finds the place to cut.

Defined results: null keys come first, as if smaller than any; rows with one key are neighbours, but a boundary may part
them; a null or empty text counts one byte; an empty table gives an empty result; columns named shard or slot are
replaced, others keep their names and values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, tune

#: What a null key counts as.
LOWEST = -(2**63)


@dataclass(frozen=True)
class Splitters:
    """Boundaries: a row is beyond cut i if its key > keys[i]. rows[i]: the rows up to there; shard[i]: it also parts two shards.

    goal: the bytes wanted up to each cut. under: those of smaller keys, and under_rows their rows, where that is known
    and keys[i] has several rows, else -1.
    """

    keys: np.ndarray
    rows: np.ndarray
    bytes: np.ndarray
    shard: np.ndarray
    goal: np.ndarray
    under: np.ndarray
    under_rows: np.ndarray
    rounds: int


def find_splitters(sizes: DataFrame, n_shards: int, per_shard: int = 32, tolerance: float = 0.0, inner_tolerance: float = 0.25, probes: int = 2048) -> Splitters:
    """Splitters of sizes (key long, size long) into n_shards of near equal bytes, each in per_shard ranges.

    tolerance: how far, in parts of a shard, the bytes below a shard's splitter may be from their goal; with 0 a
    splitter is the smallest key at which the goal is reached. inner_tolerance: the same, in parts of a range, for
    the boundaries inside shards. A round moves (probes x 24 bytes) per task, whatever the table's size.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    parts = n_shards * per_shard
    goal = np.array([int(total) * i / parts for i in range(1, parts)])
    of_shard = np.arange(1, parts) % per_shard == 0
    slack = np.where(of_shard, tolerance * total / n_shards, inner_tolerance * total / parts)
    return reach(sizes, goal, slack, of_shard, probes)


def reach(sizes: DataFrame, goal: np.ndarray, slack: np.ndarray, of_shard: np.ndarray, probes: int = 2048) -> Splitters:
    """Splitters of sizes (key long, size long) at each of which ascending goals of bytes are reached, or nearly."""
    low, high, total, n = sizes.agg(F.min("key"), F.max("key"), F.sum("size"), F.count("*")).first()
    if not n or not len(goal):
        none = np.zeros(0, np.int64)
        return Splitters(none, none, none, np.zeros(0, bool), none, none, none, 0)
    below = {low - 1: (0, 0), high: (int(total), n)}  # key -> bytes and rows up to it
    rounds = 0
    while True:
        known = np.array(sorted(below), dtype=object)
        upto = np.array([below[k][0] for k in known], np.float64)
        right = np.searchsorted(upto, goal, side="left")  # the first known key at which the goal is reached
        near = np.minimum(np.abs(upto[right] - goal), np.abs(upto[np.maximum(right - 1, 0)] - goal)) <= np.where(slack > 0, slack, -1)
        gap = np.array([known[i] - known[i - 1] if i else 1 for i in right], dtype=object)
        left = np.flatnonzero(~near & (gap > 1))
        if not len(left):
            break
        spans = sorted({(known[right[i] - 1], known[right[i]]) for i in left})
        each = max(2, probes // len(spans))
        ask = sorted({a + (b - a) * j // each for a, b in spans for j in range(1, each)} - set(known))
        below.update(_count_below(sizes, ask))
        rounds += 1
    take = []
    for i, r in enumerate(right):
        closer = slack[i] > 0 and r and goal[i] - upto[r - 1] < upto[r] - goal[i]
        take.append(known[r - 1] if closer else known[r])
    keys = np.maximum.accumulate(np.array(take, np.int64))  # a loose cut may not fall behind an exact one before it
    rows, size = (np.array([below[int(k)][j] for k in keys], np.int64) for j in (1, 0))
    before = [below.get(int(k) - 1, (0, r)) for k, r in zip(keys, rows)]
    several = np.array([r - b[1] > 1 for r, b in zip(rows, before)])
    under, under_rows = (np.array([b[j] if m else -1 for b, m in zip(before, several)], np.int64) for j in (0, 1))
    return Splitters(keys, rows, size, of_shard, goal, under, under_rows, rounds)


def _count_below(sizes: DataFrame, ask: list[int]) -> dict[int, tuple[int, int]]:
    """Exact bytes and rows with a key <= each probe."""
    probes = np.array(ask, np.int64)

    def count(batches):
        size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
        for b in batches:
            at = np.searchsorted(probes, b.column(0).to_numpy(zero_copy_only=False), side="left")
            np.add.at(size, at, b.column(1).to_numpy(zero_copy_only=False))
            rows += np.bincount(at, minlength=len(rows))
        some = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(size[some]), pa.array(rows[some])], ["at", "size", "rows"])

    got = sizes.mapInArrow(count, "at long, size long, rows long").groupBy("at").agg(F.sum("size"), F.sum("rows")).collect()
    size, rows = np.zeros(len(probes) + 1, np.int64), np.zeros(len(probes) + 1, np.int64)
    for at, s, r in got:
        size[at], rows[at] = s, r
    return {int(k): (int(s), int(r)) for k, s, r in zip(ask, np.cumsum(size), np.cumsum(rows))}


#: Beyond it come all rows of a key.
LAST = 2**63 - 1


def histogram_shards(df: DataFrame, n_shards: int, key: str = "doc_id", size: Column | None = None, tie: list[Column] = (), law: str = "bytes", per_shard: int = 32, tolerance: float = 0.0) -> DataFrame:
    """df with ``shard`` (0 to n_shards - 1) and ``slot`` (the row's place in its shard, gapless from 0).

    key: a column of integers. size: bytes of a row; by default those of its text, plus 1. tie: orders rows of one
    key that no boundary parts. law: "bytes" (sizes near equal) or "rows" (each row counts 1). The result is ordered by
    key within a shard.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"no law {law}")
    spark = df.sparkSession
    tune(spark)
    keep = Scratch(spark)
    names = [c for c in df.columns if c not in ("shard", "slot")]
    own = "_"
    while any(c.startswith(own) for c in names):
        own += "_"
    col = lambda c: F.col(own + c)
    weight = F.lit(1).cast("long") if law == "rows" else size if size is not None else F.octet_length(F.coalesce("text", F.lit(""))).cast("long") + 1
    at = F.coalesce(F.col(key).cast("long"), F.lit(LOWEST + 1))
    sizes = keep(df.select(at.alias("key"), weight.alias("size")))
    cuts = find_splitters(sizes, n_shards, per_shard, tolerance)
    keys, rows, ties = cuts.keys, cuts.rows.copy(), np.full(len(cuts.keys), LAST)
    # boundaries that fall among the rows of one key
    parted = np.flatnonzero((cuts.under >= 0) & (cuts.bytes - cuts.goal > (cuts.bytes - cuts.under) / 1e9) & (cuts.goal > cuts.under))
    if len(parted):
        df = keep(df.withColumn(own + "row", F.monotonically_increasing_id()))  # a row's place must not change any more
        placed = F.xxhash64(col("row"))
        for k in np.unique(keys[parted]).tolist():
            mine = parted[keys[parted] == k]
            inside = keep(df.where(at == k).select(placed.alias("key"), weight.alias("size")))
            found = reach(inside, cuts.goal[mine] - cuts.under[mine[0]], np.zeros(len(mine)), cuts.shard[mine])
            ties[mine], rows[mine] = found.keys, cuts.under_rows[mine[0]] + found.rows
            keep.drop(inside)
    keep.drop(sizes)
    # equal cuts (fewer keys than ranges) leave ranges between them empty
    shard_of = np.concatenate([[0], np.cumsum(cuts.shard)]).astype(np.int64)
    first = np.concatenate([[0], rows])  # rows before each range
    shard_first = np.array([first[np.flatnonzero(shard_of == s)[0]] if (shard_of == s).any() else 0 for s in range(n_shards)], np.int64) if len(keys) else np.zeros(n_shards, np.int64)
    hot = np.unique(keys[parted])

    @F.pandas_udf("int")
    def range_of(k, t):
        import pandas as pd

        k, t = k.to_numpy(np.int64), t.to_numpy(np.int64)
        out = np.searchsorted(keys, k, side="left")
        for h in hot:
            some = np.flatnonzero(k == h)
            i, j = np.searchsorted(keys, [h, h + 1], side="left")
            out[some] += np.searchsorted(ties[i:j], t[some], side="left")
        return pd.Series(out.astype(np.int32))

    places = spark.createDataFrame([(int(i), int(s), int(first[i] - shard_first[s])) for i, s in enumerate(shard_of)], f"{own}range int, shard int, {own}base long")
    place = F.broadcast(places)  # n_shards x per_shard rows
    within = Window.partitionBy(own + "range").orderBy(col("key"), col("tie"), *tie)
    dealt = df.withColumn(own + "key", at).withColumn(own + "tie", F.xxhash64(col("row")) if len(parted) else F.lit(0).cast("long"))
    dealt = dealt.withColumn(own + "range", range_of(col("key"), col("tie")))
    dealt = dealt.withColumn(own + "slot", F.row_number().over(within) - 1)
    return dealt.drop("shard", "slot").join(place, own + "range", "left").select(*names, "shard", (col("slot") + col("base")).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order within a file."""
    sharded.sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(path)
