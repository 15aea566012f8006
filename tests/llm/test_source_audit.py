import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tonescope.llm import source_audit

DOCS = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def expected(rows, least=10, top=10):
    counts, in_docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = TERM.findall(low)
        counts[lang or "", source or ""].update(found)
        in_docs[lang or ""].update(set(found))
    out = []
    for lang in in_docs:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= least)
        groups = {s: {t: c[t] for t in kept} for (x, s), c in counts.items() if x == lang}
        whole = {t: sum(g[t] for g in groups.values()) for t in kept}
        p_of = lambda g: {t: 1 + source_audit.SCALE * (c + 2) // (sum(g.values()) + 2 * len(kept)) for t, c in g.items()}  # noqa: B023, E731
        p, q = {s: p_of(g) for s, g in groups.items()}, p_of(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in groups:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in groups if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if groups[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, x, -v, i + 1) for i, (v, _, x) in enumerate(sorted(found)[:most])]
    return sorted(out)


def invented(sources, n=260, langs=("en", "de", None), seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{''.join(r.choices('abcé漢', k=3))}" for _ in range(60)]
    rows = []
    for i in range(n):
        source = "hot" if r.random() < 0.33 else f"s{r.randrange(sources)}"
        words = r.choices(vocabulary[: 20 + 40 * (source == "hot")], k=r.randint(0, 30))
        rows.append((i, r.choice([" ", ", ", "\n", "1", "\x7f"]).join(w.upper() if r.random() < 0.2 else w for w in words), r.choice(langs), source))
    rows += [(None, None, "en", None), (1, "", "xx", "only"), (2, "rare words", "yy", "a"), (2, "", "yy", "b"), (3, "Straße ΣΑΣ " * 40_000, "en", "long")]
    return rows + rows[:9]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumnRenamed("doc_id", "term").repartition(3)


@pytest.mark.parametrize("sources", [4, 90])
def test_like_brute_force(spark, sources):
    rows = invented(sources, 260 if sources < 50 else 700)
    got = sorted(tuple(r) for r in source_audit.source_audit(frame(spark, rows)).collect())
    assert got == expected(rows) and any(r[2] == "term" for r in got)


def test_groups_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "MOST_BYTES", 0)
    rows = invented(4, 120)
    got = sorted(tuple(r) for r in source_audit.source_audit(frame(spark, rows), least=3, top=4).collect())
    assert got == expected(rows, 3, 4)


def test_empty_and_single(spark):
    assert source_audit.source_audit(frame(spark, []).limit(0)).count() == 0
    assert source_audit.source_audit(frame(spark, [(1, "a b", "en", "s")])).count() == 0


def test_shares_are_exact(spark):
    rows = [(0, 0, 1), (5, 9, 4), (8_999_999_999, 10**10, 3), (9 * 10**9, 10**12, 10**6), (10**15, 3 * 10**15 + 1, 10**9), (0, 0, 0)]
    got = spark.createDataFrame(rows, "n long, total long, kept long").selectExpr("n", "total", "kept", source_audit.share("n", "total", "kept") + " AS p").collect()
    for n, total, kept, p in got:
        assert p == (1 + source_audit.SCALE * (n + 2) // (total + 2 * kept) if kept else 0)


def test_tables_are_passed_on(monkeypatch):
    """Full tables of a task, and texts in several pieces, give the same sums."""
    rows = [("en", "s", "ab cd ab " * 50), ("en", "t", "cd é " * 9), ("de", "s", ""), ("en", "s", "x" * 90 + " ab")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["lang", "source", "text"])

    def sums():
        n, docs = Counter(), Counter()
        for b in source_audit._count([batch, batch]):
            for lang, source, term, x, d in zip(*(c.to_pylist() for c in b.columns)):
                n[lang, source, term] += x
                docs[lang, source, term] += d
        return n, docs

    whole = sums()
    assert whole[0]["en", "s", "ab"] == 202 and whole[1]["en", "s", "ab"] == 4
    monkeypatch.setattr(source_audit, "MOST_COUNTS", 1)
    monkeypatch.setattr(source_audit, "CHUNK", 7)
    assert sums() == whole


@pytest.mark.parametrize("most", [1 << 20, 40])
def test_pair_sums(monkeypatch, most):
    monkeypatch.setattr(source_audit, "MOST_PAIRS", most)
    r = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        k = int(r.choice([2, 3, 5, 70]))
        rows.append((str(r.choice(["en", "de"])), int(r.integers(1, 5)), np.sort(r.choice(80, k, replace=False)).tolist(), r.integers(1, 10**9, k).tolist(), r.integers(1, 10**9, k).tolist()))
    kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["lang", "m", "idx", "p", "p0"])
    got, want = Counter(), Counter()
    for b in source_audit._pair_sums([batch.slice(0, 20), batch.slice(20)]):
        for lang, i, j, v in zip(*(c.to_pylist() for c in b.columns)):
            got[lang, i, j] += v
    f = lambda a, b: (a - b) ** 2 // (a + b)
    for lang, m, at, p, p0 in rows:
        for a in range(len(at)):
            for b in range(a + 1, len(at)):
                want[lang, at[a], at[b]] += m * (f(p[a], p[b]) - f(p[a], p0[b]) - f(p0[a], p[b]) + f(p0[a], p0[b]))
    assert got == want
