import random

import numpy as np
import pytest

from tonescope.llm import minhash
from tonescope.llm.minhash import NearDup


def brute(rows, p):
    """doc_id -> (set size, smallest reachable id), by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        n = min(p.shingle, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= p.percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("p", [NearDup(), NearDup(percent=80, shingle=5, rows=4, bands=32)])
def test_matches_all_pairs(docs, corpus, p):
    want = brute([(i, t) for i, t, *_ in corpus], p)
    rows = minhash.near_duplicates(docs, p).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


@pytest.mark.parametrize("block", [2048, 16])
def test_chains_of_edits(spark, block):
    """A group in which most pairs are not linked directly: stars alone would lose links."""
    r = random.Random(9)
    w = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        if i % 3 == 0:
            w = list(w)
            w[r.randrange(len(w))] = f"n{i}"
        copy = list(w)
        for _ in range(r.choice([0, 1, 2, 3])):
            copy[r.randrange(len(copy))] = f"x{r.randint(0, 10**6)}"
        rows.append((1000 - i, " ".join(copy)))
    p = NearDup(block=block)
    want = brute(rows, p)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), p).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len({v for v in want.values()}) > 1


def test_odd_sketch_estimates():
    r = np.random.default_rng(0)
    p = NearDup()
    a, b = minhash.hash_functions(p.samples)
    for share in (0.6, 0.85, 0.95, 1.0):
        errors = []
        for _ in range(40):
            common = r.integers(0, 2**63, int(400 * share)).astype(np.uint64)
            own = [np.concatenate([common, r.integers(0, 2**63, (400 - len(common)) // 2).astype(np.uint64)]) for _ in range(2)]
            x, y = (np.frombuffer(minhash.odd_sketch(minhash.signature(o, p, a, b), p), np.uint64) for o in own)
            true = len(common) / (len(own[0]) + len(own[1]) - len(common))
            errors.append(minhash.estimate(np.bitwise_count(x ^ y).sum(), p.samples, p.bits) - true)
        assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


@pytest.mark.parametrize("p", [NearDup(), NearDup(percent=80, shingle=5, rows=4, bands=32)])
def test_sketches_lose_less_than_bands(p):
    """Simulated links at the threshold: samples differ by chance, and each throws two bits into the sketches' XOR."""
    r = np.random.default_rng(1)
    bits = np.zeros(1_000_000)
    thrown = 2 * r.binomial(p.samples, 1 - p.percent / 100, len(bits))
    for k in range(thrown.max()):
        bits += np.where(thrown > k, np.where(r.random(len(bits)) * p.bits < bits, -1, 1), 0)
    assert (bits > p.most_apart()).sum() <= 1 and bits.max() > p.most_apart() / 2


def test_edges(spark, nothing):
    assert minhash.near_duplicates(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a b c d"), (None, None), (3, ""), (4, " "), (5, "a b"), (6, "A  B"), (7, "a b c d"), (7, "a b c d"), (8, "b a")], "doc_id long, text string")
    rows = [tuple(r) for r in minhash.near_duplicates(odd).collect()]
    assert sorted(rows, key=str) == sorted([(None, 2, None, True), (None, 0, None, True), (3, 0, 3, True), (4, 0, 4, True), (5, 1, 5, True), (6, 1, 5, False), (7, 2, 7, True), (7, 2, 7, True), (8, 1, 8, True)], key=str)


def test_without_copies_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1), (2, "a b c d e f", 2), (3, None, 3)], "doc_id long, text string, component_id int")
    assert sorted(tuple(r) for r in minhash.without_copies(df).collect()) == [(1, "a b c d e f", 1), (3, None, 3)]


def test_rows_that_repeat_an_id_with_other_texts(spark):
    """They are one document: one of the texts gives its set, the same in each of its rows."""
    one, other = "a b c d e f g h", "p q r s t u"
    df = spark.createDataFrame([(1, one), (1, other), (1, None), (2, one), (3, other)], "doc_id long, text string")
    got = [tuple(r) for r in minhash.near_duplicates(df).collect()]
    mine = {r[1:] for r in got if r[0] == 1}
    assert len(got) == 5 and len(mine) == 1 and (size := mine.pop()[0]) in (6, 4)
    assert {r[0]: r[2] for r in got} == {1: 1, 2: 1 if size == 6 else 2, 3: 1 if size == 4 else 3}
