"""Near-duplicate documents by MinHash bands and odd sketches.

A document is its set of distinct word shingles; two are linked if 100 * |intersection| >= percent * |union|.

1. One pass over the texts gives each document's set size, a 128-bit fingerprint of its set, MinHash bands, an odd
   sketch: the samples (i, minimum i) folded into a parity bitmap, in which the population count of the XOR of two
   sketches tells how many samples differ; and a parity bitmap of the whole set, whose XOR count is never more than
   the number of shingles that one set has alone. Documents of equal sets form a class; one of each goes on.
2. Members of a band's bucket are compared with the bucket's smallest document (a star, never all pairs): sketch and
   bitmap first. Of a document's centres that pass, the nearest is confirmed on full sets; then those that would
   still join components. So most sets travel once.
3. Two linked documents of a bucket need not both be linked with its centre. So in buckets that still hold several
   components, the members outside the largest one are compared with all members, in blocks inside tasks. Tasks give
   the best few pairs of each two components, which are confirmed on full sets; if a task had more, all pairs that
   still could join components follow in a second turn.

A link of similarity s is missed only if no band agrees, (1 - s^rows)^bands, or its sketch is far off, which is held to
a tenth of that at the threshold; with the defaults both are 4.5e-7 at 0.85 (samples taken as independent). The bitmap
of the whole set loses nothing. Hot buckets: a centre's pairs are dealt in chunks, each with one copy of the centre.

Defined results: documents without words (or null) have n_shingles 0 and are linked with nothing; with fewer words than
a shingle the whole sequence is the one shingle; rows that repeat a doc_id are one document, and if their texts differ
its set is the one with the smallest fingerprint; a row without doc_id is linked with nothing and kept; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, connected_components, grouped, mix64, partitions, release, trimmed, tune


@dataclass(frozen=True)
class NearDup:
    percent: int = 85
    shingle: int = 3
    rows: int = 5
    bands: int = 25
    bits: int = 512
    #: The sketches lose at most this share of what the bands lose, of links at the threshold.
    share: float = 0.1
    block: int = 2048
    #: So many documents share one copy of their centre.
    chunk: int = 256
    #: Pairs of two components that a block task gives in the first turn.
    first: int = 8
    #: At most so many rows of ids are broadcast when sets are read; beyond it the join is a shuffle.
    most_broadcast: int = 400_000

    @property
    def samples(self) -> int:
        return self.rows * self.bands

    def most_apart(self) -> float:
        """The XOR population count up to which a pair is confirmed on full sets."""
        return _most_apart(self)

    def band_loss(self) -> float:
        """The chance that a link at the threshold has no band in common."""
        return (1 - (self.percent / 100) ** self.rows) ** self.bands


@lru_cache
def _most_apart(p: NearDup) -> int:
    """The least count that a link at the threshold exceeds with a chance of at most p.share of the bands' loss."""
    s, n = p.percent / 100, p.samples
    j = np.arange(p.bits + 1)
    odd, chance = (j == 0).astype(np.float64), np.zeros(p.bits + 1)
    for differ in range(n + 1):
        chance += comb(n, differ) * (1 - s) ** differ * s ** (n - differ) * odd
        for _ in range(2):  # a sample that differs throws two bits
            up, down = odd * (1 - j / p.bits), odd * j / p.bits
            odd = np.append(0.0, up[:-1]) + np.append(down[1:], 0.0)
    beyond = np.append(np.cumsum(chance[::-1])[::-1][1:], 0.0)  # summed from the small end, as tails are small
    return int(np.argmax(beyond <= p.share * p.band_loss()))


def estimate(xor_count: np.ndarray, samples: int, bits: int) -> np.ndarray:
    """Similarity from the population count of two odd sketches' XOR."""
    return 1 + bits / (4 * samples) * np.log(np.maximum(1 - 2 * xor_count / bits, 1e-9))


# --- sets -----------------------------------------------------------------------------------


class Shingler:
    """64-bit hashes of texts' distinct shingles, sorted. Words: runs of other than ASCII white space, A-Z lowered."""

    def __init__(self, width: int, most: int = 250_000):
        import xxhash

        self.digest = xxhash.xxh3_64_intdigest
        self.width, self.most = width, most
        self.words: dict[bytes, int] = {}

    def hashes(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > self.most:
            self.words.clear()
        known = self.words
        h = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            x = known.get(w)
            if x is None:
                x = known[w] = self.digest(w)
            h[i] = x
        n = min(self.width, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(h) - n + 1, n, np.uint64)
            for k in range(n):
                out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k]
            return np.unique(mix64(out))


def signature(h: np.ndarray, p: NearDup, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest value of the set under each of the samples' hash functions."""
    out = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 4096):  # bounded memory for texts of any length
            x = h[None, at : at + 4096] * a[:, None]
            x += b[:, None]
            np.minimum(out, x.min(1), out=out)
    return out >> np.uint64(20)


def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def bands_of(sig: np.ndarray, p: NearDup) -> np.ndarray:
    """A bucket number for each band."""
    with np.errstate(over="ignore"):
        x = np.arange(p.bands, dtype=np.uint64) + np.uint64(1)
        for k in range(p.rows):
            x = mix64(x * np.uint64(0xFF51AFD7ED558CCD) + sig.reshape(p.bands, p.rows)[:, k])
        return x.view(np.int64)


def odd_sketch(sig: np.ndarray, p: NearDup) -> bytes:
    with np.errstate(over="ignore"):
        place = mix64(sig + np.arange(len(sig), dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(p.bits)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=p.bits) & 1).astype(np.uint8)).tobytes()


def parity(h: np.ndarray) -> bytes:
    """The parity bitmap of a set: a bit for each value of the hashes' low bits, at least 4 bits for each hash."""
    bits = max(64, 1 << (4 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """Rows of a parity bitmap's words, folded to n words: what the set's bitmap of that length is."""
    while words.shape[-1] > n:
        half = words.shape[-1] // 2
        words = words[..., :half] ^ words[..., half:]
    return words


def may_link(x: bytes, y: bytes, size_x: int, size_y: int, percent: int) -> bool:
    """False only if the bitmaps prove that two sets are not linked: their XOR count is at most the symmetric difference."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    n = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, n) ^ folded(b, n)).sum()) * (100 + percent) <= (size_x + size_y) * (100 - percent)


SUMMARY = "doc_id long, n_shingles long, class binary, sketch binary, parity binary, bands array<long>"


def fingerprint(h: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        return np.array([len(h), h.sum(), mix64(h ^ np.uint64(0xA0761D6478BD642F)).sum()], "<u8").tobytes()


def summaries(source: DataFrame, p: NearDup) -> DataFrame:
    """SUMMARY of each row of (doc_id, text); all but doc_id and n_shingles are null for an empty set."""
    a, b = hash_functions(p.samples)
    names = [f.split(" ")[0] for f in SUMMARY.split(", ")]

    def summarize(batches):
        shingler = Shingler(p.shingle)
        for batch in batches:
            size, kind, sketch, whole, bands = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                h = shingler.hashes(t)
                size.append(len(h))
                if not len(h):
                    for out in (kind, sketch, whole, bands):
                        out.append(None)
                    continue
                sig = signature(h, p, a, b)
                kind.append(fingerprint(h))
                sketch.append(odd_sketch(sig, p))
                whole.append(parity(h))
                bands.append(bands_of(sig, p))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *[pa.array(x, pa.binary()) for x in (kind, sketch, whole)], pa.array(bands, pa.list_(pa.int64()))], names)

    return source.mapInArrow(trimmed(summarize), SUMMARY)


def small(table: DataFrame, p: NearDup) -> DataFrame:
    """table, to be broadcast if it has few enough rows."""
    return F.broadcast(table) if table.count() <= p.most_broadcast else table


def one_set_each(base: DataFrame, many: DataFrame, p: NearDup) -> DataFrame:
    """base in which all rows of an id in many have the summary with the smallest fingerprint."""
    here, rest = base.join(small(many, p), "doc_id", "left_semi"), base.join(small(many, p), "doc_id", "left_anti")
    names = [c for c in base.columns if c != "doc_id"]
    chosen = here.where("class IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("class", *[c for c in names if c != "class"])).alias("c"))
    same = here.select("doc_id").join(chosen, "doc_id", "left").select("doc_id", *[F.coalesce("c.n_shingles", F.lit(0).cast("long")).alias(c) if c == "n_shingles" else F.col(f"c.{c}").alias(c) for c in names])
    return rest.select(base.columns).unionAll(same.select(base.columns))


# --- pairs ----------------------------------------------------------------------------------

#: A task's group: a centre and a chunk of the documents to compare it with; role 0 is the centre.
GROUP = ["a", "chunks", "chunk"]


def dealt(pairs: DataFrame, p: NearDup) -> DataFrame:
    """(doc_id, role, GROUP) of pairs (a, b, n), n being about how many documents are compared with a."""
    chunks = F.ceil(F.col("n") / p.chunk).cast("int")
    each = pairs.select("a", "b", chunks.alias("chunks")).withColumn("chunk", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int"))
    centres = each.select(F.col("a").alias("doc_id"), F.lit(0).alias("role"), *GROUP).distinct()
    return centres.unionAll(each.select(F.col("b").alias("doc_id"), F.lit(1).alias("role"), *GROUP))


def gathered(rows: DataFrame) -> DataFrame:
    """rows with each group together, its centre first."""
    return rows.repartition(partitions(rows.sparkSession), *GROUP).sortWithinPartitions(*GROUP, "role", "doc_id")


def with_centres(batches):
    """(batch as a table, row numbers of members, their centres' row numbers); a centre's row may be of an earlier batch."""
    last = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if last is None else pa.concat_tables([last, t]).combine_chunks()
        role = t.column("role").to_numpy()
        centre = np.maximum.accumulate(np.where(role == 0, np.arange(len(role)), -1))
        members = np.flatnonzero(role == 1)
        yield t, members, centre[members]
        if len(centre) and centre[-1] >= 0:
            last = t.slice(int(centre[-1]), 1)


def apart(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """XOR population counts of sketches, as rows of unsigned 64-bit words."""
    return np.bitwise_count(one ^ many).sum(-1)


def sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def near_pairs(pairs: DataFrame, reps: DataFrame, p: NearDup) -> DataFrame:
    """(a, b, n, apart) of the pairs that sizes, sketches and bitmaps allow; apart: the sketches' XOR count."""

    def near(batches):
        most = p.most_apart()
        for t, members, centres in with_centres(batches):
            words, size = sketches(t.column("sketch")), t.column("n_shingles").to_numpy()
            count = apart(words[members], words[centres])
            x, y = size[members], size[centres]
            ok = np.flatnonzero((100 * np.minimum(x, y) >= p.percent * np.maximum(x, y)) & (count <= most))
            maps = t.column("parity")
            ok = ok[[may_link(maps[i].as_py(), maps[j].as_py(), int(size[i]), int(size[j]), p.percent) for i, j in zip(members[ok].tolist(), centres[ok].tolist())]] if len(ok) else ok
            n = t.column("chunks").to_numpy()[members[ok]].astype(np.int64) * p.chunk
            yield pa.RecordBatch.from_arrays([pa.array(t.column("a").to_numpy()[members[ok]]), pa.array(t.column("doc_id").to_numpy()[members[ok]]), pa.array(n), pa.array(count[ok].astype(np.int32))], ["a", "b", "n", "apart"])

    rows = dealt(pairs, p).join(reps.select("doc_id", "n_shingles", "sketch", "parity"), "doc_id")
    return gathered(rows).mapInArrow(trimmed(near), "a long, b long, n long, apart int")


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(source: DataFrame, pairs: DataFrame, many: DataFrame | None, p: NearDup) -> DataFrame:
    """Links (a, b): the pairs (a, b, n), a stored table, whose full sets are linked. many: ids of several rows."""
    rows = dealt(pairs, p)
    rows = F.broadcast(rows) if 2 * pairs.count() <= p.most_broadcast else rows  # two rows for each pair at most
    schema = "doc_id long, role int, a long, chunks int, chunk int, mark binary, set binary"

    def hashes(batches):
        shingler = Shingler(p.shingle)
        for b in batches:
            before, h = None, None
            found, marks = [], []
            for t in b.column("text").to_pylist():
                if t is not before:  # a document may be in several groups
                    h, before = (shingler.hashes(t), t) if t != before else (h, t)
                found.append(h.tobytes())
                marks.append(fingerprint(h))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "role", *GROUP)], pa.array(marks, pa.binary()), pa.array(found, pa.binary())], ["doc_id", "role", *GROUP, "mark", "set"])

    def sets(texts: DataFrame) -> DataFrame:
        return texts.join(rows, "doc_id").select("doc_id", "role", *GROUP, "text").mapInArrow(trimmed(hashes), schema)

    if many is None:
        found = sets(source).drop("mark")
    else:
        repeated = sets(source.join(small(many, p), "doc_id", "left_semi")).where(F.length("set") > 0)
        repeated = repeated.groupBy("doc_id", "role", *GROUP).agg(F.min(F.struct("mark", "set")).alias("s")).select("doc_id", "role", *GROUP, "s.set")
        found = sets(source.join(small(many, p), "doc_id", "left_anti")).drop("mark").unionAll(repeated)

    def confirm(batches):
        for t, members, centres in with_centres(batches):
            set_ = t.column("set")
            centre, y = -1, None
            keep = []
            for i, j in zip(members.tolist(), centres.tolist()):
                if j != centre:
                    centre, y = j, np.frombuffer(set_[j].as_py(), np.uint64)
                if linked(np.frombuffer(set_[i].as_py(), np.uint64), y, p.percent):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(t.column(c).to_numpy()[keep]) for c in ("a", "doc_id")], ["a", "b"])

    return gathered(found).mapInArrow(trimmed(confirm), "a long, b long")


# --- what the stars leave open ----------------------------------------------------------------

BLOCK = ["bucket", "first", "second"]


def block_tasks(placed: DataFrame, keep: Scratch, p: NearDup) -> DataFrame:
    """(BLOCK, side, doc_id, component) of members (bucket, doc_id, component) whose bucket holds several components.

    A bucket's largest component is its main one. If the members outside are one block at most, they (side 1) go to
    every block of the main one (side 0), and second is -1. Else all members, in blocks, meet in pairs of blocks.
    """
    counts = placed.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    kinds = counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("main"), F.count("*").alias("kinds"))
    kinds = keep(kinds.where("kinds > 1 AND n > 2").select("bucket", (F.col("n") - F.col("main.c")).alias("out"), "n", F.col("main.component").alias("main")))
    rows = placed.join(kinds, "bucket").withColumn("side", (F.col("component") != F.col("main")).cast("int"))
    few, mains = F.col("out") <= p.block, F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("out")) / p.block)).cast("int")
    blocks = F.ceil(F.col("n") / p.block).cast("int")
    deal = lambda k: F.pmod(F.xxhash64("doc_id", F.lit(3)), k).cast("int")
    upto = lambda k: F.sequence(F.lit(0), k - 1)
    own = rows.withColumn("own", F.when(~few, deal(blocks)).when(F.col("side") == 0, deal(mains)))
    tasks = own.withColumn("other", F.explode(F.when(~few, upto(blocks)).when(F.col("side") == 1, upto(mains)).otherwise(F.array("own"))))
    first = F.when(few, F.col("other")).otherwise(F.least("own", "other"))
    return tasks.select("bucket", first.alias("first"), F.when(few, -1).otherwise(F.greatest("own", "other")).alias("second"), F.when(few, F.col("side")).otherwise(F.col("own")).alias("side"), "doc_id", "component")


def candidates(t: pa.Table, p: NearDup, most: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """(a, b, n, open) of a block task: pairs of different components which sizes, sketches and bitmaps allow.

    most: how many pairs of two components are given, the nearest ones; open: whether there are more.
    """
    first, second = t.column("first")[0].as_py(), t.column("second")[0].as_py()
    ids, component, side, size = (t.column(c).to_numpy() for c in ("doc_id", "component", "side", "n_shingles"))
    words, maps = sketches(t.column("sketch")), [np.frombuffer(x, np.uint64) for x in t.column("parity").to_pylist()]
    limit = p.most_apart()
    out, opened = [], False
    left = np.flatnonzero(side == (1 if second < 0 else first))
    right = np.arange(len(ids)) if second < 0 else np.flatnonzero(side == second)
    for i in left.tolist():
        others = right[component[right] != component[i]]
        if second < 0:  # pairs outside the main component are the first block's
            others = others[(side[others] == 0) | ((first == 0) & (others > i))]
        elif first == second:
            others = others[others > i]
        others = others[100 * np.minimum(size[others], size[i]) >= p.percent * np.maximum(size[others], size[i])]
        count = apart(words[i], words[others])
        others, count = others[count <= limit], count[count <= limit]
        room = (size[others] + size[i]) * (100 - p.percent)
        differ = np.empty(len(others), np.int64)
        lengths = np.array([len(maps[j]) for j in others], np.int64)
        for n in np.unique(lengths).tolist():
            at, least = np.flatnonzero(lengths == n), min(n, len(maps[i]))
            for k in range(0, len(at), 256):
                some = at[k : k + 256]
                differ[some] = apart(folded(maps[i], least), folded(np.stack([maps[j] for j in others[some]]), least))
        ok = differ * (100 + p.percent) <= room
        others, differ = others[ok], differ[ok]
        if len(others):
            if most is not None:
                order = np.lexsort([differ, component[others]])
                kind = component[others][order]
                place = np.arange(len(order)) - np.searchsorted(kind, kind)
                opened |= bool((place >= most).any())
                others, differ = others[order[place < most]], differ[order[place < most]]
            out.append((np.full(len(others), i), others, differ))
    if not out:
        return (*[np.zeros(0, np.int64)] * 3, False)
    a, b, d = map(np.concatenate, zip(*out))
    if most is not None:
        ca, cb = np.minimum(component[a], component[b]), np.maximum(component[a], component[b])
        order = np.lexsort([d, cb, ca])
        new = np.concatenate([[True], (np.diff(ca[order]) != 0) | (np.diff(cb[order]) != 0)])
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        opened |= bool((place >= most).any())
        a, b = a[order[place < most]], b[order[place < most]]
    one, two = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
    return one, two, np.unique(one, return_counts=True)[1][np.searchsorted(np.unique(one), one)], opened


def block_pairs(placed: DataFrame, reps: DataFrame, keep: Scratch, p: NearDup, most: int | None) -> DataFrame:
    """(a, b, n, open): candidates of all block tasks."""

    def find(batches):
        for t in grouped(batches, len(BLOCK)):
            a, b, n, opened = candidates(t, p, most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64)), pa.array(np.full(len(a), opened))], ["a", "b", "n", "open"])

    rows = block_tasks(placed, keep, p).join(reps.select("doc_id", "n_shingles", "sketch", "parity"), "doc_id").select(*BLOCK, "side", "doc_id", "component", "n_shingles", "sketch", "parity")
    tasks = rows.repartition(partitions(rows.sparkSession), *BLOCK).sortWithinPartitions(*BLOCK, "doc_id")
    return tasks.mapInArrow(trimmed(find), "a long, b long, n long, open boolean").groupBy("a", "b").agg(F.max("n").alias("n"), F.max("open").alias("open"))


# --- the operator ---------------------------------------------------------------------------


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, component) after links between their components, or with nodes that are in none yet."""
    label = lambda side: parts.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    over = links.join(label("a"), "a", "left").join(label("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    tops = connected_components(over).withColumnRenamed("component", "top")
    whole = parts.join(tops.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    alone = tops.join(parts.select("node"), "node", "left_anti")
    return whole.unionAll(alone.select("node", F.col("top").alias("component")))


def placed_in(rows: DataFrame, parts: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the component of their key, which is the key itself where it is in none."""
    known = parts.select(F.col("node").alias(key), F.col("component").alias(name))
    return rows.join(known, key, "left").withColumn(name, F.coalesce(name, key))


def near_duplicates(docs: DataFrame, p: NearDup = NearDup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs."""
    spark = docs.sparkSession
    tune(spark)
    keep = Scratch(spark)
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    base = keep(summaries(source, p))
    many = keep(base.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if many.isEmpty():
        many = None
    else:
        base = keep(one_set_each(base, many, p))
    whole = base.where("class IS NOT NULL AND doc_id IS NOT NULL")
    reps = keep(whole.groupBy("class").agg(F.min(F.struct("doc_id", "n_shingles", "sketch", "parity", "bands")).alias("r")).select("class", "r.*"))

    # the star: each member with the bucket's smallest document
    banded = reps.select("doc_id", F.explode("bands").alias("bucket"))
    centres = keep(banded.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("centre")).where("n > 1"))
    members = keep(banded.join(centres, "bucket"))
    pairs = keep(members.where("centre <> doc_id").groupBy(F.col("centre").alias("a"), F.col("doc_id").alias("b")).agg(F.max("n").alias("n")))
    near = keep(near_pairs(pairs, reps, p))
    keep.drop(centres, pairs)
    best = keep(near.groupBy("b").agg(F.min(F.struct("apart", "a", "n")).alias("x")).select("x.a", "b", "x.n"))
    parts = keep(connected_components(confirmed(source, best, many, p)))
    release(spark)

    # the other centres that would still join components
    ends = placed_in(placed_in(near, parts, "a", "ca"), parts, "b", "cb").where("ca <> cb")
    rest = keep(ends.join(best, ["a", "b"], "left_anti").select("a", "b", "n"))
    parts = _after(keep, parts, source, rest, many, p)
    keep.drop(best)

    # pairs without the centre
    for most in (p.first, None):
        placed = keep(placed_in(members.where("n > 2").select("bucket", "doc_id"), parts, "doc_id", "component"))
        found = keep(block_pairs(placed, reps, keep, p, most))
        new = keep(found.join(near.select("a", "b"), ["a", "b"], "left_anti"))
        parts = _after(keep, parts, source, new, many, p)
        opened = not found.where("open").isEmpty()
        keep.drop(placed, found, new)
        release(spark)
        if not opened:
            break

    of_class = keep(placed_in(reps.select("class", "doc_id"), parts, "doc_id", "component_id").select("class", "component_id"))
    keep.drop(reps, members, near, rest, parts)
    has = F.col("class").isNotNull() & F.col("doc_id").isNotNull()
    some = base.where(has).join(of_class, "class").select("doc_id", "n_shingles", "component_id")
    named = some.unionAll(base.where(~has).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _after(keep: Scratch, parts: DataFrame, source: DataFrame, pairs: DataFrame, many: DataFrame | None, p: NearDup) -> DataFrame:
    """parts after the links among pairs."""
    if pairs.isEmpty():
        return parts
    new = keep(merged(parts, keep(confirmed(source, pairs, many, p))))
    keep.drop(parts)
    return new


def without_copies(docs: DataFrame, p: NearDup = NearDup(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that are not the smallest of their component. Rows that repeat a key go together."""
    gone = Scratch(docs.sparkSession)(near_duplicates(docs, p, key, text).where(~F.col("kept")).select(F.col("doc_id").alias(key)).distinct())
    return docs.join(small(gone, p), key, "left_anti").select(docs.columns)
