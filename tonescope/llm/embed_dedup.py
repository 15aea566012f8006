"""Near-duplicate embeddings by search in a robust-pruned flat graph.

Two vectors are linked if their labels are equal and not null and their cosine, in double precision, is at least the
threshold. Vectors that are equal form a class, and one of each goes on.

1. Cluster centres come from a bounded sample; every vector belongs to the shards of its nearest centres (label, length,
   centre), so shards overlap. A shard is cut into blocks of bounded size.
2. Build: in each block, a vector's nearest ones and some distant ones are candidates for its edges; robust pruning
   drops those that a chosen edge already leads to. Vertices that the block's medoid does not reach get an edge from
   their nearest reached one. The adjacency lists of a vector from all its shards are united.
3. Search: in each block, and each pair of a shard's blocks, a greedy search from the medoids looks for every vector;
   from what it finds in range it expands over the graph as long as new vectors are near the range. A search that does
   not come upon the vector itself has failed, and expands from there.
4. Each hit's cosine decides. A pair is counted in one task only: the lowest shard that both share. Tasks give counts
   and links that join components, never all pairs.
5. Audit: each task compares some of its vectors with all of its block, and searches again, wider, if it lost links, at
   last by comparing all. Over all tasks, the links of two bounded samples (any vectors, and vectors with links) are
   counted by brute force against all rows. Below the wanted recall vectors go to more shards, and if that does not
   help, all vectors of a label are compared in blocks, so the result never has a recall below ``recall`` in the audit.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without label or id, are
linked with nothing (n_links 0); rows that repeat an id are one vector, that with the smallest label and content if
they differ; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import logging
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, connected_components, grouped, mix64, partitions, release, trimmed, tune

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class FlatGraph:
    threshold: float = 0.98
    #: Vectors of a block of a shard at most, about; and of a shard on average.
    block: int = 2048
    shards_each: int = 2
    #: Vectors that centres are made of, 8 for each centre at least. Shards grow with the data beyond 8 million vectors of a label.
    sample: int = 32_768
    most_centres: int = 4096
    near: int = 40
    far: int = 12
    degree: int = 24
    alpha: float = 1.2
    beam: int = 16
    #: Vectors within this of the threshold are expanded, too.
    slack: float = 0.03
    #: Vectors of each of the two samples that are compared with all rows, and of those that each task compares.
    audit: int = 256
    task_audit: int = 32
    #: The least share of links, in a task and over all, with which the search is not run again.
    recall: float = 0.95
    tries: int = 3
    #: Compare all vectors of a block; what a failed audit leads to at last.
    exact: bool = False


# --- vectors ----------------------------------------------------------------------------------


def label_number(df: DataFrame, label: str) -> Column:
    """A long for each label: whole numbers as they are, others (shares, texts) by 60 bits of a digest; labels are never rounded."""
    kind, c = df.select(label).schema[0].dataType, F.col(label)
    if isinstance(kind, T.IntegralType | T.NullType):
        return c.cast("long")
    c = c + F.lit(0.0) if isinstance(kind, T.FractionalType) else c  # one zero
    return F.conv(F.substring(F.sha2(c.cast("string").cast("binary"), 256), 1, 15), 16, 10).cast("long")


def unit_vectors(df: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(vec_id, label, size, unit) of the rows that can be linked; unit: the normed vector's doubles."""

    def norm(batches):
        for b in batches:
            out = []
            for v in b.column(2).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64)
                n = np.sqrt(x @ x) if len(x) and np.isfinite(x).all() else 0.0
                if n and not np.isfinite(n):  # components whose squares are too large
                    x = x / np.abs(x).max()
                    n = np.sqrt(x @ x)
                elif len(x) and not n and np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()
                    n = np.sqrt(x @ x)
                out.append((x / n).astype("<f8").tobytes() if n else None)
            unit = pa.array(out, pa.binary())
            size = pa.array([len(o) // 8 if o else 0 for o in out], pa.int32())
            ok = unit.is_valid()
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in (b.column(0), b.column(1), size, unit)], ["vec_id", "label", "size", "unit"])

    rows = df.select(F.col(key).cast("long").alias("vec_id"), label_number(df, label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    return rows.where("vec_id is not null and label is not null and v is not null").mapInArrow(norm, "vec_id long, label long, size int, unit binary")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def centres(rows: DataFrame, g: FlatGraph) -> dict[int, np.ndarray]:
    """Cluster centres by vector length, from a sample of g.sample vectors; as many as the largest label's shards need."""
    if g.exact:
        return {}
    sizes = rows.groupBy("label", "size").count().groupBy("size").agg(F.max("count")).collect()
    some = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(g.sample).select("size", "unit").toArrow()
    out = {}
    for size, n in sizes:
        x = matrix(some.filter(pa.compute.equal(some.column("size"), size)).column("unit"))
        k = min(g.most_centres, len(x) // 8, -(-n * g.shards_each // g.block))
        if k <= g.shards_each:  # every shard would hold nearly all
            continue
        c = x[:k].copy()
        for _ in range(10):
            own = np.concatenate([(x[at : at + 2048] @ c.T).argmax(1) for at in range(0, len(x), 2048)])
            sums = np.zeros_like(c)
            np.add.at(sums, own, x)
            norm = np.linalg.norm(sums, axis=1)
            c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
        out[int(size)] = c
    return out


def sharded(rows: DataFrame, g: FlatGraph) -> DataFrame:
    """rows with clusters (sorted), their nearest centres: at most most_centres x 8 bytes x length are broadcast."""
    known = rows.sparkSession.sparkContext.broadcast(centres(rows, g))

    def assign(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            size = t.column("size").to_numpy()
            clusters = np.zeros((len(size), g.shards_each), np.int32)
            for s in np.unique(size).tolist():
                c = known.value.get(s)
                if c is None:
                    continue
                at = np.flatnonzero(size == s)
                x = matrix(t.column("unit").take(pa.array(at)))
                k = min(g.shards_each, len(c))
                best = np.argsort(-(x @ c.T), axis=1)[:, :k]
                clusters[at] = np.sort(np.concatenate([best, best[:, :1].repeat(g.shards_each - k, 1)], 1), 1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(clusters.tolist(), pa.list_(pa.int32()))], [*b.schema.names, "clusters"])

    return rows.mapInArrow(trimmed(assign), "vec_id long, label long, size int, copies long, unit binary, clusters array<int>")


def block_members(rows: DataFrame, keep: Scratch, g: FlatGraph) -> DataFrame:
    """A row for each vector and shard: (label, size, cluster, side, n, ...), side being its block, n the shard's rows."""
    each = rows.withColumn("cluster", F.explode(F.array_distinct("clusters")))
    shard = ["label", "size", "cluster"]
    counts = keep(each.groupBy(*shard).agg(F.count("*").alias("n")))
    side = F.pmod(F.xxhash64("vec_id", F.lit(9)), F.ceil(F.col("n") / g.block)).cast("int")
    return each.join(F.broadcast(counts) if counts.count() <= 100_000 else counts, shard).withColumn("side", side)


# --- the graph --------------------------------------------------------------------------------


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def build_graph(x: np.ndarray, ids: np.ndarray, g: FlatGraph) -> list[np.ndarray]:
    """Neighbours of each row, by robust pruning of its nearest rows and of some others; all reach from the medoid."""
    n = len(x)
    if n <= 2:
        return [np.delete(np.arange(n), i) for i in range(n)]
    near = min(g.near, n - 1)
    far = min(g.far, n - 1)
    draw = mix64(ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(far, dtype=np.uint64))
    candidates = np.empty((n, near + far), np.int64)
    for at in range(0, n, 512):
        sims = x[at : at + 512] @ x.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -2
        candidates[at : at + 512, :near] = np.argpartition(-sims, near - 1, axis=1)[:, :near]
    candidates[:, near:] = draw % np.uint64(n)
    out: list[np.ndarray] = []
    for at in range(0, n, 256):
        c = candidates[at : at + 256]
        m = len(c)
        y = x[c]
        d = np.maximum(1 - np.einsum("ijk,ik->ij", y, x[at : at + m]), 0)
        d[c == np.arange(at, at + m)[:, None]] = np.inf
        between = np.maximum(1 - y @ y.transpose(0, 2, 1), 0)
        left = np.isfinite(d)
        chosen = np.full((m, g.degree), -1)
        rows = np.arange(m)
        for k in range(g.degree):
            dd = np.where(left, d, np.inf)
            best = dd.argmin(1)
            some = np.isfinite(dd[rows, best])
            if not some.any():
                break
            chosen[some, k] = c[rows, best][some]
            left &= ~((g.alpha * between[rows, best] <= d) & some[:, None])
            left[rows, best] = False
        out += [np.unique(r[r >= 0]) for r in chosen]
    return connect(x, out, medoid(x), g)


def connect(x: np.ndarray, edges: list[np.ndarray], start: int, g: FlatGraph) -> list[np.ndarray]:
    """Back edges where there is room, then an edge from the nearest reached row to every row that is not reached."""
    n = len(x)
    back: list[list[int]] = [[] for _ in range(n)]
    for i, es in enumerate(edges):
        for j in es.tolist():
            if len(edges[j]) + len(back[j]) < g.degree + 8:
                back[j].append(i)
    edges = [np.unique(np.concatenate([e, np.array(b, np.int64)])) for e, b in zip(edges, back)]
    reached = np.zeros(n, bool)
    wave = [start]
    reached[start] = True
    while True:
        while wave:
            new = np.unique(np.concatenate([edges[i] for i in wave]))
            new = new[~reached[new]]
            reached[new] = True
            wave = new.tolist()
        lost = np.flatnonzero(~reached)
        if not len(lost):
            return edges
        seen = np.flatnonzero(reached)
        sims = x[lost[:64]] @ x[seen].T
        i, j = np.unravel_index(sims.argmax(), sims.shape)
        edges[seen[j]] = np.append(edges[seen[j]], lost[i])
        reached[lost[i]] = True
        wave = [int(lost[i])]


def range_search(own: int, x: np.ndarray, table: np.ndarray, starts: list[int], g: FlatGraph) -> np.ndarray:
    """Rows whose cosine with row own is at least the threshold, as far as the graph leads there."""
    q = x[own]
    seen = np.zeros(len(x) + 1, bool)
    seen[-1] = True  # what pads the table
    seen[starts] = True
    sims = x[starts] @ q
    heap = [(-s, i) for s, i in zip(sims.tolist(), starts)]
    heapq.heapify(heap)
    best = sorted(sims.tolist())[-g.beam :]
    wide = g.threshold - g.slack
    inside = [np.array(starts)[sims >= g.threshold]]
    wave = np.array(starts)[sims >= wide]
    while heap and not len(wave):
        s, i = heapq.heappop(heap)
        if len(best) >= g.beam and -s < best[0]:
            break
        new = table[i][~seen[table[i]]]
        if not len(new):
            continue
        seen[new] = True
        sims = x[new] @ q
        for t, j in zip(sims.tolist(), new.tolist()):
            if len(best) < g.beam or t > best[0]:
                heapq.heappush(heap, (-t, j))
                best.append(t)
        best = sorted(best)[-g.beam :]
        inside.append(new[sims >= g.threshold])
        wave = new[sims >= wide]
    while len(wave) or not seen[own]:  # in range: expand as long as there are new rows near it
        new = np.unique(table[wave]) if len(wave) else np.array([own])
        new = new[~seen[new]]
        seen[new] = True
        sims = x[new] @ q
        inside.append(new[sims >= g.threshold])
        wave = new[sims >= wide]
    return np.concatenate(inside)


# --- tasks ------------------------------------------------------------------------------------

BUILD = ["label", "size", "cluster", "side"]
SEARCH = ["label", "size", "cluster", "first", "second"]


def build_tasks(batches, g: FlatGraph):
    for t in grouped(batches, len(BUILD)):
        ids = t.column("vec_id").to_numpy()
        edges = build_graph(matrix(t.column("unit")), ids, g)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([ids[e] for e in edges], pa.list_(pa.int64()))], ["vec_id", "edges"])


def block_links(x: np.ndarray, side: np.ndarray, table: np.ndarray, starts: list[int], which: np.ndarray, across: bool, g: FlatGraph) -> np.ndarray:
    """Pairs (smaller row * n + larger row) that the search of the rows which finds; across: only of rows of two sides."""
    n, pairs = len(x), [np.zeros(0, np.int64)]
    for at in range(0, len(which), 256) if g.exact else ():
        i, found = np.nonzero(x[which[at : at + 256]] @ x.T >= g.threshold)
        i = which[at + i]
        ok = (found != i) & ((not across) | (side[found] != side[i]))
        pairs.append(np.minimum(found, i)[ok] * n + np.maximum(found, i)[ok])
    for i in which.tolist() if not g.exact else ():
        found = range_search(i, x, table, starts, g)
        found = found[(found != i) & ((not across) | (side[found] != side[i]))]
        if len(found):
            pairs.append(np.minimum(found, i) * n + np.maximum(found, i))
    return np.unique(np.concatenate(pairs))


def audited(x: np.ndarray, side: np.ndarray, ids: np.ndarray, table: np.ndarray, starts: list[int], across: bool, g: FlatGraph) -> FlatGraph:
    """g, or the parameters with which the search loses few links of some of the rows, drawn by a hash of their ids."""
    which = np.sort(np.argsort(mix64(ids.astype(np.uint64) + np.uint64(77)), kind="stable")[: g.task_audit])
    true = block_links(x, side, table, starts, which, across, replace(g, exact=True))
    for _ in range(g.tries):
        if np.isin(true, block_links(x, side, table, starts, which, across, g)).sum() >= g.recall * len(true):
            return g
        g = replace(g, beam=4 * g.beam, slack=2 * g.slack)
    return replace(g, exact=True)


def search_tasks(batches, g: FlatGraph):
    """(vec_id, links, other): the links that a task counts for a vector; and where other is not null, a joining link."""
    for t in grouped(batches, len(SEARCH)):
        n = t.num_rows
        cluster, first, second = (t.column(k)[0].as_py() for k in ("cluster", "first", "second"))
        ids, copies, side = (t.column(k).to_numpy() for k in ("vec_id", "copies", "side"))
        if n < 2 or (first != second and (side == side[0]).all()):
            continue
        x = matrix(t.column("unit"))
        clusters = np.array(t.column("clusters").to_pylist())
        order = np.argsort(ids)
        edges = []
        for es in t.column("edges").to_pylist():
            e = np.array(es, np.int64)
            at = np.minimum(np.searchsorted(ids[order], e), n - 1)
            edges.append(order[at[ids[order][at] == e]])
        table = np.full((n, max(1, max(map(len, edges)))), n)
        for i, e in enumerate(edges):
            table[i, : len(e)] = e
        starts = []
        for s in np.unique(side).tolist():
            mine = np.flatnonzero(side == s)
            starts.append(int(mine[medoid(x[mine])]))
        fit = g if g.exact else audited(x, side, ids, table, starts, first != second, g)
        a, b = np.divmod(block_links(x, side, table, starts, np.arange(n), first != second, fit), n)
        # the pair's task is that of the lowest shard which both share
        common = np.where((clusters[a][:, :, None] == clusters[b][:, None, :]).any(2), clusters[a], np.iinfo(np.int32).max).min(1, initial=np.iinfo(np.int32).max)
        a, b = a[common == cluster], b[common == cluster]
        if not len(a):
            continue
        links = np.bincount(a, weights=copies[b], minlength=n) + np.bincount(b, weights=copies[a], minlength=n)
        parent = list(range(n))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        joins = []
        for i, j in zip(a.tolist(), b.tolist()):
            p, q = root(i), root(j)
            if p != q:
                parent[max(p, q)] = min(p, q)
                joins.append((i, j))
        some = np.flatnonzero(links)
        one, two = (np.array(v, np.int64) for v in zip(*joins))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], ids[one]])), pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(one), np.int64)])), pa.array([None] * len(some) + ids[two].tolist(), pa.int64())], ["vec_id", "links", "other"])


def search_links(members: DataFrame, g: FlatGraph) -> DataFrame:
    """What search_tasks gives for all shards: the graph is built, united by vector, and searched."""
    n = partitions(members.sparkSession)
    blocks = F.ceil(F.col("n") / g.block).cast("int")
    if g.exact:
        united = members.withColumn("edges", F.array().cast("array<bigint>"))
    else:
        built = members.select(*BUILD, "vec_id", "unit").repartition(n, *BUILD).sortWithinPartitions(*BUILD, "vec_id").mapInArrow(trimmed(lambda b: build_tasks(b, g)), "vec_id long, edges array<long>")
        united = members.join(built.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("edges"))).alias("edges")), "vec_id")
    tasks = united.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    tasks = tasks.withColumn("first", F.least("side", "other")).withColumn("second", F.greatest("side", "other")).select(*SEARCH, "side", "vec_id", "copies", "unit", "clusters", "edges")
    return tasks.repartition(n, *SEARCH).sortWithinPartitions(*SEARCH, "vec_id").mapInArrow(trimmed(lambda b: search_tasks(b, g)), "vec_id long, links long, other long")


def audit_recall(rows: DataFrame, counts: DataFrame, g: FlatGraph) -> float | None:
    """Links found over links that exist, of g.audit vectors, and of as many with links, against all rows; none if no link exists."""
    drawn = [F.xxhash64("vec_id", F.lit(6)), F.col("vec_id")]
    columns = ["vec_id", "label", "size", "unit"]
    linked = rows.join(counts.orderBy(*drawn).limit(g.audit).select("vec_id"), "vec_id", "left_semi")
    some = rows.orderBy(*drawn).limit(g.audit).select(*columns).unionAll(linked.select(*columns)).dropDuplicates(["vec_id"]).toArrow()
    ids, label, size = (some.column(k).to_numpy() for k in ("vec_id", "label", "size"))
    queries = {int(s): (np.flatnonzero(size == s), matrix(some.filter(pa.compute.equal(some.column("size"), int(s))).column("unit"))) for s in np.unique(size)}

    def brute(batches):
        true = np.zeros(len(ids), np.int64)
        for b in batches:
            t = pa.Table.from_batches([b])
            for s, (at, q) in queries.items():
                mine = t.filter(pa.compute.equal(t.column("size"), s))
                if not mine.num_rows:
                    continue
                hit = (q @ matrix(mine.column("unit")).T >= g.threshold) & (label[at][:, None] == mine.column("label").to_numpy()) & (ids[at][:, None] != mine.column("vec_id").to_numpy())
                true[at] += hit @ mine.column("copies").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(true)], ["vec_id", "true"])

    true = rows.select("vec_id", "label", "size", "copies", "unit").mapInArrow(brute, "vec_id long, true long").groupBy("vec_id").agg(F.sum("true").alias("true"))
    got = true.join(counts, "vec_id", "left").agg(F.sum(F.least("true", F.coalesce("links", F.lit(0)))), F.sum("true")).first()
    return None if not got[1] else float(got[0] / got[1])


# --- the operator -----------------------------------------------------------------------------


def duplicate_vectors(df: DataFrame, g: FlatGraph = FlatGraph(), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of df."""
    tune(df.sparkSession)
    keep = Scratch(df.sparkSession)
    each = unit_vectors(df, key, vector, label).groupBy("vec_id").agg(F.min(F.struct("label", "size", "unit")).alias("v")).select("vec_id", "v.*")
    valid = keep(each.withColumn("digest", F.sha2("unit", 256)))
    whole = valid.groupBy("label", "digest").agg(F.min(F.struct("vec_id", "size", "unit")).alias("v"), F.count("*").alias("copies"))
    classes = keep(whole.select("digest", "v.vec_id", "label", "v.size", "copies", "v.unit"))
    for turn in range(g.tries):
        rows = keep(sharded(classes.drop("digest"), g))
        found = keep(search_links(block_members(rows, keep, g), g))
        counts = found.where("other IS NULL").groupBy("vec_id").agg(F.sum("links").alias("links"))
        recall = audit_recall(rows, counts, g)
        log.info("no audited vector has a link, so recall is not measured" if recall is None else f"recall {recall:.4f} of the links of the audited vectors")
        if g.exact or recall is None or recall >= g.recall:
            break
        g = replace(g, shards_each=g.shards_each + 1, exact=turn + 2 >= g.tries)
    parts = keep(connected_components(found.where("other IS NOT NULL").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))))
    of_class = classes.select("vec_id", "label", "digest", "copies").join(counts, "vec_id", "left").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    of_class = keep(of_class.select("label", "digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id")))
    linked = keep(valid.select("vec_id", "label", "digest").join(of_class, ["label", "digest"]).select("vec_id", "n_links", "component_id"))
    keep.drop(valid, classes, rows, found, parts, of_class)
    release(df.sparkSession)
    every = df.select(F.col(key).cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    every = every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
