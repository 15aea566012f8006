"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import functools
import gc
import itertools
import math
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a hot key are dealt over so many sub-keys.
SALTS = 64


# --- the shared folder ------------------------------------------------------------------


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="tonescope-")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a new local one only where it is unset and all runs on this machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = f"file://{_own_folder()}"
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_written: list[tuple[SparkSession, str]] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nobody uses; it is removed when the session's program ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            _remove(spark, path)
        except Exception:  # the session may be over; the folder belongs to the cluster's own cleaning then
            return


def checkpointed(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, with its lineage cut; it survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables of one run in the shared folder: written once and read from there, so they survive lost executors.

    As they are files, their readers get as many partitions as their bytes need, and both sides of a join of two of
    them can be split where a key is skewed. What is superseded is dropped at once, the rest when the program ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self._paths = spark, []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = new_path(self.spark, "table")
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        for path in [p for t, p in self._paths if any(t is x for x in tables)]:
            _remove(self.spark, path)
            _written.remove((self.spark, path))
        self._paths = [(t, p) for t, p in self._paths if not any(t is x for x in tables)]


def release(spark: SparkSession) -> None:
    """Let go of what ended steps hold: Spark deletes shuffle files and broadcasts when the driver's JVM has collected
    their plans, which it may not do for long by itself; and the driver's Python gives freed memory back."""
    give_back()
    spark._jvm.System.gc()


#: Rows and bytes of an Arrow batch at most (a single longer row is a batch by itself), as texts can be long.
BATCH_ROWS, BATCH_BYTES = 2_000, 16 << 20


def tune(spark: SparkSession) -> None:
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# --- hot keys ---------------------------------------------------------------------------


def salt(*columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")


def with_group(df: DataFrame, key: str, aggs: dict[str, tuple[str, str]], spread: str, having: Column | None = None) -> DataFrame:
    """df with aggregates of each row's key group beside the row.

    aggs: new column -> ("min" | "max" | "sum", column). Rows are first aggregated by (key, salt of spread), then by
    key; the result goes back to (key, salt), where the rows join it. So no task ever holds a whole group, and
    nothing is broadcast. Rows with a null key get null aggregates. having: only rows of groups where it holds.
    """
    salted = df.withColumn("_salt", salt(spread))
    fold = {"min": F.min, "max": F.max, "sum": F.sum}
    part = salted.where(F.col(key).isNotNull()).groupBy(key, "_salt").agg(*[fold[f](c).alias(n) for n, (f, c) in aggs.items()])
    whole = part.groupBy(key).agg(F.collect_list("_salt").alias("_salts"), *[fold[f](n).alias(n) for n, (f, _) in aggs.items()])
    whole = whole if having is None else whole.where(having)
    back = whole.withColumn("_salt", F.explode("_salts")).drop("_salts")
    return salted.join(back, [key, "_salt"], "left" if having is None else "inner").drop("_salt")


def attach(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join of left with right (one row for each key) where a key may have any share of left's rows.

    Each row of right goes once to every salt that its key has in left.
    """
    salted = left.withColumn("_salt", salt(spread))
    return salted.join(salted.select(key, "_salt").distinct().join(right, key), [key, "_salt"]).drop("_salt")


def grouped(batches, n_keys: int = 1):
    """Tables of consecutive rows with equal first n_keys columns, of a stream that is sorted by them."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows - 1, bool)
        for c in t.columns[:n_keys]:
            x = c.to_numpy()
            change |= x[1:] != x[:-1]
        cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            yield t.slice(i, j - i)
        rest = t.slice(int(cuts[-1]))
    if rest is not None and rest.num_rows:
        yield rest


# --- connected components ---------------------------------------------------------------


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that each end of an edge reaches. edges: (a, b), longs.

    Alternates the large-star and small-star steps of Kiveris et al. until the edges form stars around the smallest
    nodes. A step's tables are written to the shared folder, and the last step's are dropped. The smallest neighbours
    are found with map-side sums, so hubs don't gather; joins are of stored tables, which Spark splits at hubs.
    """
    keep = Scratch(edges.sparkSession)
    now = keep(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(rounds):
        if _are_stars(now):
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m")))
        large = keep(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct())
        keep.drop(now, least)
        least = keep(large.groupBy("u").agg(F.min("v").alias("m")))
        ends = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        now = keep(large.join(least, "u").select(F.explode(ends).alias("e")).select("e.u", "e.v").where("u <> v").distinct())
        keep.drop(large, least)
    else:
        raise RuntimeError(f"the components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or a smaller and a larger one."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)").isEmpty()


# --- tokenizers -------------------------------------------------------------------------

#: Unicode White_Space, as the tokenizers' patterns understand \s. Fixed values.
WHITE = "\t-\r \x85\xa0  -     　"


class _Codes(dict):
    """Numbers for keys in the order in which they are first asked for; ``new`` lists the keys without ids yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str | bytes] = []

    def __missing__(self, key):
        self.new.append(key)
        self[key] = n = len(self)
        return n


class ChunkEncoder:
    """Token ids of whole texts by the tokenizers library, through a table of chunks that were encoded before.

    The pre-tokenizers in use never join characters across the start of a run of white space, and look ahead only
    within that run and the character after it. So a text's ids are those of its chunks (white space with the word
    behind it) in turn. spaced: white space has ids of its own (byte-level BPE); else it is dropped (word BPE), and
    chunks are the words between ASCII white space, whose A-Z are small letters to such tokenizers. Texts that hold the
    literal form of an added token, which the library finds before it cuts words, are encoded whole. When the table
    holds ``most`` chunks, those that came once go, which only costs time. Keys are words after one space (str) or
    literal chunks (bytes).
    """

    def __init__(self, path: str, spaced: bool, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # chunks hold no literal forms, but their small letters may
        self.whole = Tokenizer.from_file(path)
        added = self.whole.get_added_tokens_decoder().values()
        if any(a.normalized for a in added):
            raise ValueError("added tokens that are found in normalized text are not supported")
        self.added = sorted(a.content for a in added)
        self.most = most
        self.spaced = spaced
        if hasattr(self.tokenizer.model, "_resize_cache"):  # the table here takes its place
            self.tokenizer.model._resize_cache(1)
        self.chunks = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
        self.rare = re.compile(f"[{WHITE.replace(' ', '').replace('-' + chr(13), chr(9) + chr(11) + '-' + chr(13))}]").search
        # Latin letters in small form are what the normalizers of word BPE would make of them; without these it is faster
        self.bare = None if spaced else Tokenizer.from_file(path)
        if self.bare is not None:
            self.bare.normalizer = None
            tells = "ÀÉß ŐƵ Straße Iİ"
            same = self.bare.encode(tells.lower(), add_special_tokens=False).ids == self.tokenizer.encode(tells, add_special_tokens=False).ids
            self.bare = self.bare if same else None
        (self.zero,) = self.tokenizer.encode("0", add_special_tokens=False).ids
        self._clear()

    def _clear(self) -> None:
        self.codes = _Codes()
        self.ids = np.zeros(1 << 20, np.int32)
        self.ends = np.zeros(1 << 18, np.int64)  # ends[i]: where the ids of code i begin, and those of i - 1 end
        self.n = 0
        self.seen = np.zeros(0, np.int64)  # how often each chunk came

    def _prune(self) -> None:
        """Keep the chunks that came more than once, half of the table at most; the rest would hardly come again."""
        seen = self.seen[: self.n]
        keep = np.flatnonzero(seen >= 2)
        if len(keep) > self.most // 2:
            keep = np.sort(np.argsort(-seen, kind="stable")[: self.most // 2])
        names, kept = list(self.codes), _Codes()
        kept.update(zip((names[i] for i in keep.tolist()), range(len(keep))))
        begin, size = self.ends[keep], self.ends[keep + 1] - self.ends[keep]
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        self.ids[:total] = self.ids[np.repeat(begin - stop + size, size) + np.arange(total)]
        self.ends[: len(keep) + 1] = np.concatenate([[0], stop])
        self.codes, self.n, self.seen = kept, len(keep), seen[keep] // 2

    def _keys(self, text: str | None) -> list[str | bytes]:
        if not text:
            return []
        if not self.spaced:
            return text.encode().lower().split()
        if not (text[0] in " \n" or text[-1] in " \n" or "  " in text or "\n " in text or " \n" in text or "\n\n" in text or self.rare(text)):
            # single spaces and line ends between words only: a line end is a chunk, and no space is before the next word
            keys = text.replace("\n", " \n ").split(" ")
            keys[0], at = keys[0].encode(), 0
            for _ in range(text.count("\n")):
                at = keys.index("\n", at + 1)
                keys[at], keys[at + 1] = b"\n", keys[at + 1].encode()
            return keys
        return [c[1:] if c[0] == " " and len(c) > 1 and c[1] not in WHITE else c.encode() for c in self.chunks(text)]

    def _learn(self) -> None:
        """Words of letters, with a dot or comma behind, are encoded many to a text, with a digit between them: it always
        is a token by itself there."""
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        many = encode if self.bare is None else getattr(self.bare, "encode_batch_fast", self.bare.encode_batch)
        new, self.codes.new = self.codes.new, []
        size: list[np.ndarray] = []
        found: list[np.ndarray] = []
        for at in range(0, len(new), 2_000):
            words = [k.decode() if k.__class__ is bytes else k for k in new[at : at + 2_000]]
            if self.bare is not None:
                ok = np.fromiter(((w.isalpha() or (w[-1] in ".," and w[:-1].isalpha())) and max(w) < "\u0250" for w in words), bool, len(words))
                literal = words
                joined = [w.lower() for w in itertools.compress(literal, ok)]
            else:
                ok = np.fromiter((w.isalpha() or (w[-1] in ".," and w[:-1].isalpha()) for w in words), bool, len(words))
                literal = [w if k.__class__ is bytes else " " + w for w, k in zip(words, new[at : at + 2_000])]
                joined = list(itertools.compress(literal, ok))
            each = [x.ids for x in encode(list(itertools.compress(literal, ~ok)), add_special_tokens=False)]
            ids = np.array(many(["0".join(joined)], add_special_tokens=False)[0].ids if joined else [], np.int32)
            cut = ids == self.zero
            stops = np.flatnonzero(cut)
            if len(stops) != max(0, len(joined) - 1):
                raise RuntimeError("the tokenizer does not keep chunks apart")
            n = np.empty(len(words), np.int64)
            n[ok] = np.diff(np.concatenate([[-1], stops, [len(ids)]])) - 1 if joined else 0
            n[~ok] = list(map(len, each))
            out = np.empty(int(n.sum()), np.int32)
            mine = np.repeat(ok, n)
            out[mine] = ids[~cut]
            out[~mine] = [i for x in each for i in x]
            size.append(n)
            found.append(out)
        flat, begin = np.concatenate(found), int(self.ends[self.n])
        while begin + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(new) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.ids[begin : begin + len(flat)] = flat
        self.ends[self.n + 1 : self.n + len(new) + 1] = begin + np.cumsum(np.concatenate(size))
        self.n += len(new)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the number of each text's ids; null is an empty text."""
        apart = [i for i, t in enumerate(texts) if t and any(a in t for a in self.added)]
        if apart:
            flat, counts = self.encode([None if i in apart else t for i, t in enumerate(texts)])
            whole = [np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, np.int32) for i in apart]
            flat = np.insert(flat, np.repeat(np.cumsum(counts)[apart], list(map(len, whole))), np.concatenate(whole))
            counts[apart] = list(map(len, whole))
            return flat, counts
        if len(self.codes) > self.most:
            self._prune()
        look, keys, counts = self.codes.__getitem__, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            some = self._keys(t)
            counts[i] = len(some)
            keys.append(np.fromiter(map(look, some), np.int64, len(some)))
        codes = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        if self.codes.new:
            self._learn()
        came = np.bincount(codes, minlength=self.n)
        came[: len(self.seen)] += self.seen
        self.seen = came
        begin = self.ends[codes]
        size = self.ends[codes + 1] - begin
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        flat = self.ids[np.repeat(begin - stop + size, size) + np.arange(total)]
        upto = np.concatenate([[0], stop])[np.cumsum(counts)] if len(counts) else np.zeros(0, np.int64)
        return flat, np.diff(upto, prepend=0)


@functools.lru_cache(maxsize=4)
def chunk_encoder(path: str, spaced: bool, most: int) -> ChunkEncoder:
    """One for each Python worker."""
    return ChunkEncoder(path, spaced, most)


def give_back() -> None:
    """Return freed memory to the system."""
    import ctypes

    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library; freed memory may stay with the process
        pass


def fresh_worker() -> None:
    """Free what tasks of earlier stages left in this Python worker; workers live on from stage to stage."""
    chunk_encoder.cache_clear()
    give_back()


def trimmed(task):
    """task, with the worker's freed memory given back before and after it."""

    @functools.wraps(task)
    def run(batches):
        fresh_worker()
        try:
            yield from task(batches)
        finally:
            fresh_worker()

    return run


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def blocks(texts: list[str | None], chars: int = 2_000_000):
    """Index ranges of consecutive texts of about so many characters, so that one step's memory is bounded."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


# --- hashing in numpy ---------------------------------------------------------------------


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mix of unsigned 64-bit integers (the finalizer of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def log2_ceil(n: int) -> int:
    return max(1, math.ceil(math.log2(max(n, 2))))
