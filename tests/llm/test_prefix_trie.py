import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tonescope.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string"


def expected(rows, block=20, heads=4):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % heads
        seq = own.get(c - int(np.fmod(c, block)), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, members in nodes.items():
        w = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += kids[p] == 0
            saved[p[:d]] += (len(members) - 1) * w
    digest = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return sorted((m[0], len(p), nodes[p[:-1]][0] if p else -1, len(m), kids[p], leaves[p], saved[p], digest(ends[p])) for p, m in nodes.items())


def result(df, **options):
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in prefix_trie.prefix_trie(df, **options).collect())


def invented(n=260, seed=4):
    r = random.Random(seed)
    say = [f"{w} " * r.randint(0, 4) for w in ("a", "b c", "é", "x\ty\n", "")]
    shared = [("system", "be kind, please"), ("user", "hello there"), ("assistant", "well met")]
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue
        turns = shared[: r.randint(1, 3)] if r.random() < 0.5 else []
        turns = turns + [(r.choice(["user", "assistant"]), r.choice(say)) for _ in range(r.randint(not turns, 5))]
        if c % 7 == 3:
            turns = shared + shared + [("user", "the same to the end")]
        rows += [(c, i if i else None, *t) for i, t in enumerate(turns)]
    rows += [(1000, i, "user", "again") for i in range(60)] + [(1001, i, "user", "again") for i in range(40)]  # long chains
    rows += [(2003, 0, "user", "alone"), (-7, 0, None, None), (-7, 0, "user", "tie b"), (-7, 0, "user", "tie a"), (-20, 1, "u", "negative"), (None, 0, "user", "nobody's"), (2040, 0, "user", "word " * 50_000)]
    return rows + rows[:5]


@pytest.mark.parametrize("most", [prefix_trie.MOST, 40, 3, 1])
def test_like_brute_force(spark, most):
    """With only the root above the shards, with hot beginnings above them, and with shards of a node."""
    rows = invented()
    df = spark.createDataFrame(rows, TURNS).withColumnRenamed("turn", "x").selectExpr("*", "x AS turn", "1 AS depth").repartition(3)
    want = expected(rows)
    assert result(df, most=most) == want and sum(r[1] == 0 for r in want) == 1


def test_edges(spark):
    assert result(spark.createDataFrame([], TURNS)) == []
    lone = [(c, 0, "user", "x") for c in range(1, 40) if zlib.crc32(str(c).encode()) % 4 and c % 20]  # they keep no turn of their own
    assert result(spark.createDataFrame(lone, TURNS)) == expected(lone) and len(expected(lone)) == 1
    rows = invented(40)
    assert result(spark.createDataFrame(rows, TURNS), block=5, heads=3) == expected(rows, 5, 3)


def test_many_ids_end_at_a_node(spark, monkeypatch):
    rows = [(c, 0, "user", "same") for c in range(0, 30_000, 2)]
    assert result(spark.createDataFrame(rows, TURNS).repartition(4), block=1) == expected(rows, 1)


def test_louds():
    """Tries of random trees keep parents, degrees and levels, packed and unpacked; folds are those of plain recursion."""
    r = np.random.default_rng(2)
    for n in (0, 1, 2, 50, 400):
        parent = np.array([-1 if i < 3 else r.integers(0, i) for i in range(n)], np.int64)
        parent.sort()
        trie = prefix_trie.Louds.of(parent, np.arange(2 * n).reshape(n, 2))
        assert len(trie.bits) == 2 * n + 1 and trie.bits.sum() == n
        trie = prefix_trie.Louds.unpacked(n, *trie.packed())
        assert trie.parent().tolist() == parent.tolist() and trie.labels.tolist() == np.arange(2 * n).reshape(n, 2).tolist()
        assert trie.degree().tolist() == [int((parent == i).sum()) for i in range(n)]
        values = r.integers(0, 9, n)
        want, low = values.copy(), values.copy()
        for i in range(n - 1, -1, -1):
            if parent[i] >= 0:
                want[parent[i]] += want[i]
                low[parent[i]] = min(low[parent[i]], low[i])
        assert trie.roll_up(values).tolist() == want.tolist() and trie.roll_up(values, np.minimum).tolist() == low.tolist()


def test_build():
    seqs = [(0, [1, 2, 3]), (1, [1, 2]), (2, [1, 4]), (3, [5])]
    seq, depth, label = (np.array(x) for x in zip(*((s, d, v) for s, path in seqs for d, v in enumerate(path))))
    first = np.where(label == 5, 1, 0)
    trie, node = prefix_trie.build(seq, depth, first, np.stack([label, label], 1))
    assert len(trie) == 5 and trie.parent().tolist() == [-1, -1, 0, 0, 2] and node.tolist() == [0, 2, 4, 0, 2, 0, 3, 1]
