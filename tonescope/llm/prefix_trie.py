"""Conversation prefix trie: the distinct beginnings of conversations as succinct level-order tries (LOUDS).

Conversations are sequences of turns (role, text); a node stands for each distinct beginning. Equal conversations are one
sequence with a number first. Sequences are dealt to shards by a beginning that a task's fair share of turns, ``most`` at most, lies under; numpy
builds a trie for each shard, and rolls its nodes up in reverse level order. Beginnings with more turns under them (the
root always, hot first turns, long shared openings) are the heavy upper levels: they are summed by Spark, and merged with
what their shards pass up.

Turns are told apart by two 64-bit hashes of role and text, beginnings by the exclusive or of hashes of (place, turn).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, attach, ceil_div, grouped, partitions, trimmed, tune, with_group

#: Turns under a beginning up to which one task builds its trie; ids in a row on their way to a digest.
MOST, IDS = 50_000, 4_096
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

NODE = "depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


# --- succinct tries ------------------------------------------------------------------------


class Louds:
    """A level-order unary degree sequence: for each node in level order, from a super-root on, a one for each child and a
    zero. ``labels[i]`` are the labels of node i, which the i-th one (from 0) leads to."""

    def __init__(self, bits: np.ndarray, labels: np.ndarray):
        self.bits, self.labels = bits, labels

    @classmethod
    def of(cls, parent: np.ndarray, labels: np.ndarray) -> Louds:
        """From each node's parent, -1 for the super-root, in level order."""
        degree = np.bincount(parent + 1, minlength=len(parent) + 1)
        bits = np.ones(len(parent) + len(degree), bool)
        bits[np.cumsum(degree + 1) - 1] = False
        return cls(bits, labels)

    def __len__(self) -> int:
        return len(self.labels)

    def parent(self) -> np.ndarray:
        """Zeros before a node's one count the nodes before its parent, with the super-root as the first."""
        return np.cumsum(~self.bits)[np.flatnonzero(self.bits)] - 1

    def degree(self) -> np.ndarray:
        """Children of each node: ones between zeros."""
        return np.diff(np.flatnonzero(~self.bits)) - 1

    def levels(self) -> np.ndarray:
        """Where each level begins, and the end."""
        parent, cuts = self.parent(), [0]
        end = int(np.searchsorted(parent, 0))  # the super-root's children
        while cuts[-1] < len(parent):
            cuts.append(end)
            end = int(np.searchsorted(parent, end))
        return np.array(cuts)

    def roll_up(self, values: np.ndarray, add=np.add) -> np.ndarray:
        """Of each node: the values in its subtree added up (or another ufunc's fold), from the last level to the first."""
        out, parent, cuts = values.copy(), self.parent(), self.levels()
        for begin, end in zip(cuts[-2:0:-1].tolist(), cuts[:1:-1].tolist()):
            add.at(out, parent[begin:end], out[begin:end])
        return out

    def packed(self) -> tuple[bytes, bytes]:
        return np.packbits(self.bits, bitorder="little").tobytes(), self.labels.tobytes()

    @classmethod
    def unpacked(cls, n: int, bits: bytes, labels: bytes) -> Louds:
        return cls(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")[: 2 * n + 1].astype(bool), np.frombuffer(labels, np.int64).reshape(n, 2))


def build(seq: np.ndarray, depth: np.ndarray, first: np.ndarray, labels: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The trie of sequences, and the node of each row. Rows: sequence number, place in it (from 0), the number of its
    shard beginning, labels; sorted by (seq, depth). Beginnings are the super-root's children."""
    node = np.full(len(seq), -1)
    parents, kept, n = [], [], 0
    order = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[order], prepend=-1, append=depth.max(initial=-1) + 1))
    for level, (b, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        rows = order[b:e]
        above = node[rows - 1] if level else np.full(len(rows), -1)
        key = (labels[rows, 1], labels[rows, 0], above) if level else (first[rows],)
        by = np.lexsort(key)
        new = np.zeros(len(rows), bool)
        new[0] = True
        for k in key:
            new[1:] |= k[by][1:] != k[by][:-1]
        node[rows[by]] = n + np.cumsum(new) - 1
        parents.append(above[by][new])
        kept.append(rows[by][new])
        n += int(new.sum())
    parent, rows = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (parents, kept))
    return Louds.of(parent, labels[rows]), node


TRIES = "bucket int, n_nodes long, louds binary, labels binary, depth array<long>, words array<long>, n_ends array<long>, conv_id array<long>, ends array<string>, above array<struct<p1: long, p2: long>>"


def _tries(batches):
    """A trie for each bucket of shards, with what its nodes hold."""
    for t in grouped(batches):
        c = {n: t.column(n).to_numpy() for n in ("bucket", "conv_id", "at", "depth", "p1", "p2", "q1", "q2", "k1", "k2", "words", "n")}
        seq = np.cumsum(np.diff(c["conv_id"], prepend=c["conv_id"][0] - 1) != 0) - 1 if t.num_rows else c["conv_id"]
        top = c["at"] == 0
        heads = pd.MultiIndex.from_arrays([c["depth"][top], c["p1"][top], c["p2"][top]]).factorize()[0]
        first = np.zeros(len(seq), np.int64)
        first[top] = heads
        trie, node = build(seq, c["at"], first, np.stack([c["k1"], c["k2"]], 1))
        size = len(trie)
        rows = np.full(size, len(seq))
        np.minimum.at(rows, node, np.arange(len(seq)))  # any row of a node tells its depth and words
        conv = np.full(size, np.iinfo(np.int64).max)
        np.minimum.at(conv, node, c["conv_id"])
        ends, n_ends = np.full(size, None, object), np.zeros(size, np.int64)
        text = t.column("ends").to_numpy(zero_copy_only=False)
        last = np.flatnonzero(np.array([x is not None for x in text], bool))
        ends[node[last]] = text[last]
        np.add.at(n_ends, node[last], c["n"][last])
        bits, labels = trie.packed()
        n_top = int((trie.parent() < 0).sum())
        above = [{"p1": a, "p2": b} for a, b in zip(c["q1"][rows[:n_top]].tolist(), c["q2"][rows[:n_top]].tolist())]
        out = {"bucket": int(c["bucket"][0]), "n_nodes": size, "louds": bits, "labels": labels, "depth": c["depth"][rows], "words": c["words"][rows], "n_ends": n_ends, "conv_id": conv, "ends": ends.tolist(), "above": above}
        kinds = pa.schema([("bucket", pa.int32()), ("n_nodes", pa.int64()), ("louds", pa.binary()), ("labels", pa.binary()), *[(n, pa.list_(pa.int64())) for n in ("depth", "words", "n_ends", "conv_id")], ("ends", pa.list_(pa.string())), ("above", pa.list_(pa.struct([("p1", pa.int64()), ("p2", pa.int64())])))])
        yield pa.RecordBatch.from_pylist([out], schema=kinds)


def _nodes(batches):
    """The nodes of tries, rolled up; those below the super-root name the beginning above them, others their parent."""
    for batch in batches:
        for x in (batch.slice(i, 1) for i in range(batch.num_rows)):
            n = x.column("n_nodes")[0].as_py()
            trie = Louds.unpacked(n, x.column("louds")[0].as_py(), x.column("labels")[0].as_py())
            depth, words, n_ends, conv = (x.column(c).flatten().to_numpy() for c in ("depth", "words", "n_ends", "conv_id"))
            n_convs = trie.roll_up(n_ends)
            leaves = trie.roll_up((trie.degree() == 0).astype(np.int64))
            saved = trie.roll_up((n_convs - 1) * words)
            parent = trie.parent()
            inner = parent >= 0
            conv_above = pa.array(np.where(inner, conv[parent], 0), mask=~inner)
            above = x.column("above").flatten()
            pad = lambda c: pa.concat_arrays([above.field(c), pa.nulls(n - len(above), pa.int64())])  # noqa: B023, E731
            ends = pa.array([e or NO_ENDS for e in x.column("ends").flatten().to_pylist()], pa.string())
            columns = [pa.array(depth), pa.array(conv), pa.array(n_convs), pa.array(trie.degree().astype(np.int64)), pa.array(leaves), pa.array(saved), ends, conv_above, pad("p1"), pad("p2")]
            yield pa.RecordBatch.from_arrays(columns, ["depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "parent_conv_id", "q1", "q2"])


# --- digests of the ids that end at a node -------------------------------------------------


def _id_rows(batches):
    """Consecutive ids of a node, in order, as text; several rows for many."""
    for t in grouped(batches, 3):
        d, p1, p2 = (t.column(i)[0].as_py() for i in range(3))
        ids = t.column(3).to_numpy()
        for b in range(0, len(ids), IDS):
            yield pa.RecordBatch.from_pydict({"depth": [d], "p1": [p1], "p2": [p2], "first": [int(ids[b])], "ids": [",".join(map(str, ids[b : b + IDS].tolist()))]})


def _digests(batches):
    """The digest of each node's ids as they stream by; none of them is held."""
    now, sha = None, None
    for batch in batches:
        out = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key != now:
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = key, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["depth", "p1", "p2", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_pydict({k: [v] for k, v in zip(("depth", "p1", "p2", "ends"), (*now, sha.hexdigest()))})


def ends_of(lasts: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends): the digest of the ids of conversations that end at each beginning, in ascending order.

    lasts: (conv_id, depth, p1, p2). Ranges of ids make rows of some thousand ids each; a digest reads a node's rows in
    turn, so a node at which a third of all conversations end is a few long rows that one task streams.
    """
    key = ["depth", "p1", "p2"]
    ranged = lasts.select(*key, "conv_id").repartitionByRange(partitions(lasts.sparkSession), "conv_id").sortWithinPartitions(*key, "conv_id")
    rows = ranged.mapInArrow(_id_rows, "depth long, p1 long, p2 long, first long, ids string")
    return rows.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(_digests, "depth long, p1 long, p2 long, ends string")


# --- turns ------------------------------------------------------------------------------------


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, k1, k2, words): turns numbered from 1 by turn (null first), then by role and text where turns tie.

    A null role or text is an empty one; rows without conv_id belong to no conversation. Equal rows are a turn each.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    count = F.size(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).cast("long")
    return rows.withColumn("place", F.row_number().over(order).cast("long")).select("conv_id", "place", F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit("turn"), "text", "role").alias("k2"), count.alias("words"))


def borrowed(conv_id: Column, heads: int = 4) -> Column:
    """How many turns a conversation takes from the one that its block of ids begins with."""
    return F.crc32(conv_id.cast("string").cast("binary")) % heads


def rebuilt(turns: DataFrame, block: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) where each conversation c begins with the first turns of conversation c - c % block, as many
    as ``borrowed`` says, and goes on with its own behind as many. ``part`` and ``place`` order the new turns."""
    convs = turns.where("place = 1").select("conv_id")
    own = turns.where(F.col("place") > borrowed(F.col("conv_id"), heads)).withColumn("part", F.lit(1))
    source = turns.where((F.col("conv_id") % block == 0) & (F.col("place") < heads)).withColumnRenamed("conv_id", "base")
    takers = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % block).alias("base"), borrowed(F.col("conv_id"), heads).alias("h")).where("h > 0")
    taken = takers.join(source, "base").where("place <= h").withColumn("part", F.lit(0))
    names = ["conv_id", "part", "place", "k1", "k2", "words"]
    return convs, taken.select(names).unionAll(own.select(names))


# --- the trie ---------------------------------------------------------------------------------


def fingerprints(turns: DataFrame) -> DataFrame:
    """turns by depth, with p1, p2 of the beginning that ends with each, q1, q2 of the one before, and whether it is the last.

    Windows stream a conversation's turns through a task, so that long conversations spill, and never gather.
    """
    order = Window.partitionBy("conv_id").orderBy("part", "place")
    rows = turns.withColumn("depth", F.row_number().over(order).cast("long"))
    rows = rows.withColumns({"h1": F.xxhash64("depth", "k1", "k2"), "h2": F.xxhash64("k2", "depth", "k1")})
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"p1": F.bit_xor("h1").over(upto), "p2": F.bit_xor("h2").over(upto), "last": F.lead("depth").over(order).isNull()})
    return rows.select("conv_id", "depth", "k1", "k2", "words", "p1", "p2", F.col("p1").bitwiseXOR(F.col("h1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("h2")).alias("q2"), "last")


class PrefixTrie:
    """The trie of conversations convs (conv_id) with turns (conv_id, part, place, k1, k2, words)."""

    KEY = ("depth", "p1", "p2")

    def __init__(self, convs: DataFrame, turns: DataFrame, most: int = MOST):
        if most < 1:
            raise ValueError("a shard has a turn at least")
        spark = convs.sparkSession
        self.keep = keep = Scratch(spark)
        tune(spark)
        every = keep(fingerprints(turns))
        turnless = convs.join(every.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select("conv_id", *[F.lit(0).cast("long").alias(c) for c in self.KEY])
        lasts = keep(every.where("last").select("conv_id", *self.KEY).unionAll(turnless))
        same = lasts.groupBy(*self.KEY).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))
        #: Distinct sequences: the smallest of their conversations, how many there are, and the digest of their ids.
        self.sequences = keep(same.join(ends_of(lasts), list(self.KEY)))
        one = self.sequences.select("conv_id", "n", F.col("depth").alias("length"), "ends")
        rows = every.join(one, "conv_id").withColumn("ends", F.when(F.col("depth") == F.col("length"), F.col("ends")))
        rows = keep(rows.drop("last"))
        keep.drop(every, lasts)
        n = rows.count()
        n_buckets = max(2 * partitions(spark), ceil_div(n, most))
        most = max(1, min(most, ceil_div(n, n_buckets)))  # no shard is more than a bucket's fair share
        heavy = with_group(rows.withColumns({"node": F.struct(*self.KEY), "below": F.col("length") - F.col("depth") + 1}), "node", {"size": ("sum", "below")}, "conv_id", having=F.col("size") > most)
        #: Rows of the sequences within the heavy upper levels.
        self.upper = keep(heavy.select("conv_id", *self.KEY, "q1", "q2", "words", "n"))
        start = rows.join(self.upper.groupBy("conv_id").agg(F.max("depth").alias("start")), "conv_id", "left").withColumn("start", F.coalesce("start", F.lit(0)))
        bucket = F.pmod(F.xxhash64(*self.KEY), F.lit(n_buckets)).cast("int")
        dealt = start.where("depth = start + 1").select("conv_id", "start", bucket.alias("bucket"))
        shards = rows.join(dealt, "conv_id").where("depth > start").withColumn("at", F.col("depth") - F.col("start") - 1)
        names = ("bucket", "conv_id", "at", *self.KEY, "q1", "q2", "k1", "k2", "words", "n", "ends")
        ordered = shards.select(*names).repartition(n_buckets, "bucket").sortWithinPartitions("bucket", "conv_id", "at")
        #: Succinct tries: LOUDS bits and labels by bucket of shards, and what their nodes hold.
        self.tries = keep(ordered.mapInArrow(trimmed(_tries), TRIES))
        keep.drop(rows)

    def nodes(self) -> DataFrame:
        """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), all nodes."""
        keep, key = self.keep, list(self.KEY)
        low = keep(self.tries.mapInArrow(trimmed(_nodes), f"{NODE}, parent_conv_id long, q1 long, q2 long"))
        tops = low.where("parent_conv_id IS NULL")
        zero = F.lit(0).cast("long")
        root = self.sequences.select("conv_id", *[zero.alias(c) for c in (*key, "q1", "q2", "words")], "n")
        rows = self.upper.unionAll(root)
        high = keep(rows.groupBy(*key).agg(F.sum("n").alias("n_convs"), F.min("conv_id").alias("conv_id"), *[F.max(c).alias(c) for c in ("words", "q1", "q2")]))
        child = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
        children = high.where("depth > 0").select(*child).unionAll(tops.select(*child)).groupBy(*key).agg(F.count("*").alias("n_children"))
        own = high.select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), zero.alias("leaves"))
        passed = own.unionAll(tops.select("conv_id", F.col("depth") - 1, "saved_tokens", "n_leaves")).groupBy("conv_id", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        upwards = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        merged = rows.select("conv_id", *key).join(passed, ["conv_id", "depth"], "left").withColumns({c: F.sum(F.coalesce(c, zero)).over(upwards) for c in ("saved", "leaves")})
        merged = merged.groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("leaves"))
        high = high.join(children, key, "left").join(merged, key).join(self.sequences.select(*key, "ends"), key, "left")
        leaf = F.col("n_children").isNull()
        high = high.select("depth", "conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), F.when(leaf, 1).otherwise(F.col("leaves")).alias("n_leaves"), "saved_tokens", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"), "p1", "p2", "q1", "q2")
        high = keep(high)
        own_key, above = F.struct(F.col("depth").alias("depth"), F.col("p1").alias("p1"), F.col("p2").alias("p2")), F.struct((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))
        hung = high.where("depth > 0").drop("p1", "p2").unionByName(tops.drop("parent_conv_id")).withColumn("above", above)
        hung = attach(hung, high.select(own_key.alias("above"), F.col("conv_id").alias("parent_conv_id")), "above", "conv_id")
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        top = high.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
        return low.where("parent_conv_id IS NOT NULL").select(names).unionAll(hung.select(names)).unionAll(top.select(names))


def prefix_trie(conversations: DataFrame, block: int = 20, heads: int = 4, most: int = MOST) -> DataFrame:
    """The nodes of the trie of rebuilt conversations (conv_id, turn, role, text); other columns are not read.

    Turns are ordered by turn (null first), ties by role and text; a null role or text is an empty one, equal rows are a
    turn each, and rows without conv_id belong to no conversation. Conversations that are left without turns are members
    of the root alone. An empty table has no nodes. Texts count whole.
    """
    turns = Scratch(conversations.sparkSession)(ordered_turns(conversations))
    return PrefixTrie(*rebuilt(turns, block, heads), most=most).nodes()
