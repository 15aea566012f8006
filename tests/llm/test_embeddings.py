import numpy as np
import pytest

from tonescope.llm import embed_dedup as E
from tonescope.llm.embed_dedup import FlatGraph

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold):
    """vec_id -> (links, smallest reachable id), by comparing all pairs."""
    unit = {}
    for i, v, label in rows:
        x = None if v is None or any(c is None for c in v) else np.array(v, np.float64)
        if i is not None and x is not None and label is not None and len(x) and np.isfinite(x).all() and x.any():
            unit[i] = (label, len(x), x / np.linalg.norm(x))
    ids = sorted(unit)
    parent, links = {i: i for i, *_ in rows}, {i: 0 for i, *_ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if unit[a][:2] == unit[b][:2] and unit[a][2] @ unit[b][2] >= threshold:
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], root(i)) for i in parent}


def vectors(n=600, dim=16, seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n // 3, dim))
    rows = [(i, base[i].tolist(), int(i % 3)) for i in range(len(base))]
    for k in range(n // 3, n):
        of = r.integers(0, 5) if k % 2 else r.integers(0, len(base))
        rows.append((k, (base[of] / np.linalg.norm(base[of]) + r.normal(size=dim) * r.choice([0.0, 0.02, 0.05])).tolist(), int(of % 3)))
    return rows


@pytest.mark.parametrize("g", [FlatGraph(), FlatGraph(block=64, sample=400)])
def test_links(spark, g):
    rows = [(i, np.array(v, np.float32).tolist(), c) for i, v, c in vectors()]
    want = brute(rows, g.threshold)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.duplicate_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), g).collect()}
    assert set(got) == set(want) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.99 * len(want)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1), (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (12, [-1.0, 0.0], 1), (13, [1.0, 0.001], 1), (14, [3e-42, 0.0], 1), (15, [3e38, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 0.98)
    got = E.duplicate_vectors(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and want[1] == (4, 1)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert E.duplicate_vectors(df.where("vec_id > 99")).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)], SCHEMA)
    assert sorted((tuple(r) for r in E.duplicate_vectors(odd).collect()), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]


def test_graph_is_reached_and_pruned():
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 8))
    x[100:300] = x[0] + r.normal(size=(200, 8)) * 1e-3  # one dense group
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = FlatGraph()
    edges = E.build_graph(x, np.arange(500), g)
    seen, wave = {E.medoid(x)}, [E.medoid(x)]
    while wave:
        wave = [j for i in wave for j in edges[i].tolist() if j not in seen and not seen.add(j)]
    assert len(seen) == 500 and np.median([len(e) for e in edges]) <= g.degree + 8
    table = np.full((500, max(map(len, edges))), 500)
    for i, e in enumerate(edges):
        table[i, : len(e)] = e
    found = [len(E.range_search(i, x, table, [E.medoid(x)], g)) for i in range(100, 300)]
    assert np.mean(found) >= 0.98 * 200


@pytest.mark.parametrize("kind, labels", [("double", [1.2, 1.7, 1.2, 0.0, -0.0, None]), ("string", ["a", "b", "a", "", "", None]), ("decimal(5,2)", [1, 2, 1, 3, 3, None])])
def test_labels_are_compared_as_they_are(spark, kind, labels):
    rows = [(i, [1.0, 0.5], None if c is None or kind[0] != "d" or kind == "double" else __import__("decimal").Decimal(c)) if kind.startswith("decimal") else (i, [1.0, 0.5], c) for i, c in enumerate(labels)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in E.duplicate_vectors(spark.createDataFrame(rows, f"vec_id long, embedding array<float>, label {kind}")).collect()}
    assert got == {0: (1, 0), 1: (0, 1), 2: (1, 0), 3: (1, 3), 4: (1, 3), 5: (0, 5)}


def test_rows_that_repeat_an_id_are_one_vector(spark):
    """That with the smallest label and content; each row gets its result."""
    rows = [(1, [0.0, 1.0], 2), (1, [1.0, 0.0], 1), (1, None, 0), (2, [1.0, 0.001], 1), (3, [0.0, 1.0], 2)]
    got = sorted(tuple(r) for r in E.duplicate_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 1, True)] * 3 + [(2, 1, 1, False), (3, 0, 3, True)]


def test_recall_is_not_measured_without_links(spark):
    g = FlatGraph()
    rows = E.sharded(E.unit_vectors(spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.0, 1.0], 1)], SCHEMA), "vec_id", "embedding", "label").selectExpr("vec_id", "label", "size", "1L AS copies", "unit"), g)
    assert E.audit_recall(rows, spark.createDataFrame([], "vec_id long, links long"), g) is None
