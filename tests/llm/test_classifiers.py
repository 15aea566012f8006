import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tonescope.llm import quality, toxicity

LABELS = "doc_id long, quality int, toxic int"


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again)


def test_counts(corpus):
    texts = [t for _, t, *_ in corpus] + ["a a a a", "a b c a b c d a b c", "x\nx\nx \n\n\n", "# * <b> \n# * <b> ", "a b c\x1ca b c", "a b a b"]
    codes, words = quality.word_codes(texts)
    assert [quality.counts_of(t, c) for t, c in zip(texts, codes)] == [brute_counts(t) for t in texts]
    wide = np.arange(10) % 3 + (1 << 40 >> 18)
    assert quality.counts_of("x " * 10, wide)[4] == 10


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(5)
    syllables = ["ba", "ke", "lo", "mi", "tu", "ra", "so", "ne"]
    rows, labels = [], []
    for i in range(600):
        words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(60, 150))]
        bad, toxic = i % 5 == 0, i % 4 == 1
        if bad:
            words = [w + r.choice(["%%%", "***", "&&&"]) for w in words]
        if toxic:
            for _ in range(r.randint(2, 4)):
                words.insert(r.randrange(len(words)), r.choice(["dolt", "wretched", "grumpf" + r.choice(syllables), "grumpf" + r.choice(syllables)]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, LABELS).cache(), {i: (q, t) for i, q, t in labels}


def test_quality(spark, labelled, nothing):
    docs, labels, truth = labelled
    model = quality.train_quality(docs, labels, sample=80)
    rows = quality.score_quality(docs, model).collect()
    assert sum(r["kept"] == bool(truth[r["doc_id"]][0]) for r in rows) >= 0.98 * len(rows)
    again = quality.score_quality(docs.repartition(7), quality.train_quality(docs.repartition(3), labels, sample=80), keep=["doc_id"]).collect()
    assert {r["doc_id"]: r["kept"] for r in again} == {r["doc_id"]: r["kept"] for r in rows}
    assert quality.score_quality(nothing, model).count() == 0
    assert quality.train_quality(nothing, labels) is quality.KEEPS_ALL is quality.train_quality(docs, labels.where("quality = 1"))
    odd = spark.createDataFrame([(1, None, True, 3), (2, "w " * 50, False, 4), (3, " ".join(f"w{i}" for i in range(50)), False, 5)], "doc_id long, text string, kept boolean, other int")
    found = {r["doc_id"]: r for r in quality.score_quality(odd, quality.KEEPS_ALL).collect()}
    assert (found[1]["base_failed"], found[1]["kept"], found[2]["base_failed"], found[3]["kept"], found[3]["other"]) == (True, False, True, True, 5)


def test_probabilities_are_calibrated(labelled):
    docs, labels, truth = labelled
    rows = quality.score_quality(docs, quality.train_quality(docs, labels, sample=80)).collect()
    p = np.array([r["quality_score"] for r in rows])
    y = np.array([truth[r["doc_id"]][0] for r in rows])
    assert abs(p.mean() - y.mean()) < 0.1


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_toxicity(spark, labelled, nothing):
    docs, labels, truth = labelled
    model = toxicity.train_toxicity(docs, labels)
    rows = toxicity.score_toxicity(docs, model).collect()
    out = [(r["predicted"], truth[r["doc_id"]][1]) for r in rows if held(r["doc_id"])]
    assert sum(p == y for p, y in out) >= 0.97 * len(out) and not any(p and not y for p, y in out)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in rows)
    assert {"dolt", "wretched", "grumpf-"} <= set(model.terms) and len(model.label_model.weight) == toxicity.VOTERS
    # labels of the held-out fold change nothing
    flipped = spark.createDataFrame([(i, q, 1 - t if held(i) else t) for i, (q, t) in truth.items()], LABELS)
    assert toxicity.train_toxicity(docs.repartition(5), flipped).weights == model.weights
    assert toxicity.score_toxicity(nothing, model).count() == 0
    assert toxicity.train_toxicity(nothing, labels) == toxicity.ToxicityModel() == toxicity.train_toxicity(docs, labels.where("toxic = 0"))
    odd = spark.createDataFrame([(1, None, 9.0), (2, "", 9.0), (3, "you dolt, you wretched grumpfba", 9.0)], "doc_id long, text string, score double")
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(odd, model).collect()}
    assert got[1]["score"] == got[2]["score"] < 0.5 and got[3]["predicted"] == 1
    fold = docs.select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r["h"] == held(r["doc_id"]) for r in fold)


def test_label_model_finds_accuracies_and_correlation():
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    votes = np.zeros((4000, 5), np.int64)
    for j, (hit, false) in enumerate([(0.9, 0.02), (0.7, 0.05), (0.6, 0.01), (0.05, 0.05)]):
        votes[:, j] = np.where(r.random(4000) < np.where(y, hit, false), 1, 0)
    votes[:, 4] = votes[:, 2]  # a copy of a voter
    m = toxicity.fit_label_model(votes, 0.3)
    assert m.table[:4, 2, 1] == pytest.approx([0.9, 0.7, 0.6, 0.05], abs=0.08)
    assert m.correlation[2, 4] > 0.8 > abs(m.correlation[0, 3]) and m.weight[4] < 0.65 < m.weight[0]
    assert ((m.posterior(votes) > 0.5) == y).mean() > 0.95


def test_shouting_is_of_the_whole_text():
    shouts = lambda text: toxicity.votes_of(text, set(), {})[toxicity.LEXICONS + 3]
    assert shouts("quiet words " * 200 + "LOUD WORDS " * 2000) == 1
    assert shouts("LOUD WORDS " * 200 + "quiet words " * 2000) == 0


def test_curve_is_that_of_the_population():
    r = np.random.default_rng(3)
    z = r.normal(size=20_000)
    y = (r.random(len(z)) < 1 / (1 + np.exp(0.4 - 1.7 * z))).astype(float)
    some = (y == 1) | (r.random(len(z)) < 0.5)  # half of class 0, which counts twice
    for at, weight in ((y >= 0, np.ones(len(z))), (some, np.where(y == 1, 1.0, 2.0))):
        assert quality.platt(z[at], y[at], weight[at]) == pytest.approx((1.7, -0.4), abs=0.1)


def test_regression_is_at_the_optimum_of_the_dense_problem():
    r = np.random.default_rng(4)
    n, d = 60, 12
    size = r.integers(0, 6, n)
    col, val = r.integers(0, d, size.sum()).astype(np.int32), r.random(size.sum()).astype(np.float32)
    dense = np.zeros((n, d))
    np.add.at(dense, (np.repeat(np.arange(n), size), col), val)
    y, weight = (r.random(n) < 0.4).astype(float), r.random(n) / n
    w, b = quality._logistic(size, col, val, y, weight, d, penalty=0.01, steps=5000)
    assert quality.products(size, col, val, w) == pytest.approx(dense @ w, abs=1e-6)
    miss = weight * (1 / (1 + np.exp(-(dense @ w + b))) - y)
    assert np.abs(dense.T @ miss + 0.01 * w).max() < 1e-4 and abs(miss.sum()) < 1e-4


def test_calibration_error_on_unseen_rows_with_noisy_labels(spark, labelled):
    docs, _, truth = labelled
    r = random.Random(11)
    noisy = {i: q ^ (r.random() < 0.15) for i, (q, _) in truth.items()}
    labels = spark.createDataFrame([(i, int(q), 0) for i, q in noisy.items()], LABELS)
    seen = {x["doc_id"] for x in quality.labelled_sample(docs, labels, "quality", 150)[0].collect()}
    rows = [x for x in quality.score_quality(docs, quality.train_quality(docs, labels, sample=150)).collect() if x["doc_id"] not in seen]
    p, y = np.array([x["quality_score"] for x in rows]), np.array([noisy[x["doc_id"]] for x in rows], float)
    bins = np.minimum((p * 5).astype(int), 4)
    error = sum(abs(p[bins == b].sum() - y[bins == b].sum()) for b in range(5)) / len(p)
    assert len(rows) > 200 and error < 0.15


def plain_telling(of, p, least):
    """By the table of four cells, a feature at a time."""
    out, n, all_ = {}, len(of), float(sum(p))
    for f in {f for fs in of for f in fs}:
        has = [q for fs, q in zip(of, p) if f in fs]
        if len(has) < toxicity.LEAST_TEXTS:
            continue
        a, b = sum(has), len(has) - sum(has)
        g = 2 * sum(x * np.log(x / (len(has) * share)) for x, share in ((a, all_ / n), (b, 1 - all_ / n)) if x > 1e-9)
        if g >= least:
            out[f] = (a > len(has) * all_ / n, g)
    return out


def test_telling_and_linear_equal_plain_versions():
    r = np.random.default_rng(9)
    names = [f"f{i}" for i in range(12)]
    y = (r.random(300) < 0.3).astype(float)
    of = [[f for i, f in enumerate(names) if r.random() < (0.05 + 0.06 * i if q else 0.3)] for q in y]
    got, want = toxicity.telling(of, y, 5.0), plain_telling(of, y, 5.0)
    assert set(got) == set(want) and len(got) >= 4
    assert all(got[f][0] == want[f][0] and abs(got[f][1] - want[f][1]) < 1e-9 for f in got)
    weights, bias = toxicity._linear(of, y, names, 0.5)
    x = np.array([[f in fs for f in names] for fs in of], float)
    weight = 0.5 * y / y.sum() + 0.5 * (1 - y) / (1 - y).sum()
    w, b = np.zeros(12), 0.0
    for _ in range(200):  # whole Newton steps over dense rows
        z = 1 / (1 + np.exp(-(x @ w + b)))
        a = np.concatenate([x, np.ones((len(x), 1))], 1)
        step = np.linalg.solve((a * (weight * z * (1 - z))[:, None]).T @ a + 1e-9 * np.eye(13), a.T @ (weight * (z - y)))
        w, b = w - step[:12], b - step[12]
    assert np.abs(x @ np.array([weights.get(f, 0.0) for f in names]) + bias - (x @ w + b)).max() < 0.05


def test_stems_that_several_words_share():
    got = toxicity.text_features({"bomenteco", "bomenterr", "otro", "bomb"})
    assert {"bome+", "bomen+", "boment+", "bomenteco", "bome-"} <= got and "otro+" not in got and "bomb+" not in got
    terms = {"bome+": toxicity._part("bome+"), "trash": toxicity._part("trash")}
    votes = toxicity.votes_of(None, toxicity.text_features({"bomenteco", "bomenterr"}), terms)
    assert votes[terms["bome+"]] == 1 and votes[toxicity.LEXICONS] == 1
    assert toxicity.votes_of(None, toxicity.text_features({"bomenteco"}), terms)[toxicity.LEXICONS] == -1
    model = toxicity.ToxicityModel({"bome+": 9.0, "trash": 9.0}, -5.0, terms)
    score = toxicity.Scorer(model).score
    assert score("bomenteco bomenteco") < 0.5 < score("Bomenteco y bomenterr") and score("trash") > 0.5
