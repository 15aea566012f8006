import itertools
import math
import pickle
import random
import time
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tonescope.operators import boosting, features, isotonic, linear, models, stats
from tonescope.operators.store import stored


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def bait(spark, n=6 * 40):
    names = ["mayor", "baker", "port", "school", "river", "choir"]
    return frame(spark, [(i, f"Guess what the {names[i % 6]} did" if i % 2 else f"Board reports on {names[i % 6]} {i % 4}", i % 2) for i in range(n)], "doc_id int, headline string, bait int")


# --- terms ------------------------------------------------------------------------------------------


def test_idf_table_is_whole(spark):
    table = {r["term"]: (r["df"], r["idf"]) for r in features.idf_table(frame(spark, [("Café news today",), ("cafe news",), ("x",)], "headline string")).collect()}
    assert {t: n for t, (n, _) in table.items()} == {"cafe": 2, "news": 2, "today": 1, "cafe news": 2, "news today": 1}
    assert table["today"][1] == pytest.approx(math.log(4 / 2) + 1)


def test_long_texts_take_linear_time(spark):
    def seconds(words):
        df = frame(spark, [(" ".join(f"w{i % 997}" for i in range(words)),)], "headline string")
        began = time.time()
        features.idf_table(df).write.format("noop").mode("overwrite").save()
        return time.time() - began

    seconds(100)
    assert seconds(40_000) < 4 * seconds(10_000) + 2  # a quadratic way takes 16 times as long, and minutes


def test_words_are_the_same_in_both_engines(spark):
    texts = ["it's a test_case x2 Ünïcode", "漢字 テスト かな", "a\u200db c\u0301d e\u20dd f", "١٢٣ ½ ²³ x\u203fy", "one", "", "tab\tnew\nline\x1cfs\u00a0nb", "\U0001d54f\U0001d550 ok ok", "ªº µm ⅷⅸ ⓐⓑ"]
    got = frame(spark, [(t,) for t in texts], "t string").select("t", features.word_grams(features.strip_accents(F.col("t"))).alias("g")).collect()
    for r in got:
        assert r["g"] == features.grams_of(r["t"]), r["t"]


def test_short_words_count_once():
    assert sorted(features.chars_of("a bc")) == sorted([" a ", " bc", "bc ", " bc "])


def test_tfidf_weighs_what_all_rows_hold(spark):
    rows = frame(spark, [("news café",), ("news cafe bar",), (None,)], "t string").where("t IS NOT NULL")
    found = features.TextFeatures.fit(rows, "t")
    assert set(found.terms["grams"]) == {"news", "cafe", "bar", "news cafe", "cafe bar"}
    common, rare = 1.0, math.log(3 / 2) + 1
    idx, val, ends = found.encoded(["news café", "news cafe bar", None])
    for i, length in enumerate((math.sqrt(3), math.sqrt(3 + 2 * rare**2))):
        got = {found.terms["grams"][j]: v for j, v in zip(idx[ends[i] : ends[i + 1]], val[ends[i] : ends[i + 1]]) if j < len(found.terms["grams"])}
        assert got["news"] == pytest.approx(common / length) and got.get("bar", rare / length) == pytest.approx(rare / length)
    assert ends[3] == ends[2]
    assert features.TextFeatures.fit(rows, "t", max_features=2).terms["grams"] == ["cafe", "news"]


@pytest.mark.parametrize("most", [200_000, 60])
def test_rows_are_encoded_as_term_by_term(most):
    """Words never seen, words cut by the vocabulary's end, letters that it lacks, empty texts; some texts at a time."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdé漢\U0001d54f", k=r.randint(1, 7))) for _ in range(80)]
    texts = [" ".join(r.choices(words, k=r.randint(0, 40))) for _ in range(50)]
    terms, idf = {}, {}
    for kind, split in (("grams", features.grams_of), ("chars", features.chars_of)):
        count = Counter(t for x in texts[:30] for t in split(x))
        terms[kind] = sorted(count, key=lambda t: (-count[t], t))[:most]
        idf[kind] = np.array([1 + r.random() for _ in terms[kind]])
    texts += [None, "", " ", "a", "zzz Ωmega " + words[0], words[1] + "  " + words[2]]
    found = features.TextFeatures(terms, idf)
    blocks = list(found.encoder().blocks(texts, chars=100))
    assert len(blocks) > 5 and [b[0] for b in blocks] == [0, *[b[1] for b in blocks[:-1]]] and blocks[-1][1] == len(texts)
    for parts in (blocks, [(0, len(texts), *found.encoded(texts))]):
        for begin, end, idx, val, ends in parts:
            for i in range(begin, end):
                want = {}
                for kind, split, shift in (("grams", features.grams_of, 0), ("chars", features.chars_of, len(terms["grams"]))):
                    at = {t: j for j, t in enumerate(terms[kind])}
                    n = Counter(at[t] for t in split(texts[i] or "") if t in at)
                    length = math.sqrt(sum((c * idf[kind][j]) ** 2 for j, c in n.items()))
                    want |= {j + shift: c * idf[kind][j] / length for j, c in n.items()}
                mine = slice(ends[i - begin], ends[i - begin + 1])
                assert idx[mine].tolist() == sorted(want) and val[mine] == pytest.approx([want[j] for j in sorted(want)])
    nothing = features.TextFeatures({"grams": [], "chars": []}, {"grams": np.zeros(0), "chars": np.zeros(0)})
    assert nothing.encoded(["a b", None])[2].tolist() == [0, 0, 0]


def test_executors_get_no_table_of_terms():
    """Of terms only their words are strings there, and a text's new words leave nothing behind."""
    words = ["".join(w) for w in itertools.product("abcdefgh", repeat=4)]
    terms = {"grams": words + [f"{a} {b}" for a, b in zip(words, words[1:])], "chars": words}
    encoder = features.TextFeatures(terms, {k: np.ones(len(t)) for k, t in terms.items()}).encoder()
    assert sorted(encoder.words) == sorted(words)
    before = len(pickle.dumps(encoder))
    encoder.encoded([" ".join(f"new{i}" for i in range(5000))])
    assert len(pickle.dumps(encoder)) == before


def test_a_scorer_takes_one_python_step(spark):
    """Regression, trees and calibration run in one worker of a task, and as the parts do one by one."""
    df = bait(spark)
    scorer = models.fit_scorer(df.where("doc_id < 160"), df, "bait", trees=5)
    found = scorer.predict(df)
    assert found._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    parts = models.with_stack(scorer.stack, models.with_logistic(scorer.logistic, df))
    want = {r["doc_id"]: r["calibrated"] for r in scorer.calibrator.transform(parts, "gbt_prob").collect()}
    assert {r["doc_id"]: r["probability"] for r in found.collect()} == pytest.approx(want)
    raw = {r["doc_id"]: r["probability"] for r in scorer.predict(df, calibrated=False).collect()}
    assert raw == pytest.approx({r["doc_id"]: r["gbt_prob"] for r in parts.collect()})


def test_tables_of_terms_are_passed_on(monkeypatch):
    import pyarrow as pa

    def sums():
        out = {}
        for b in features._count_terms([pa.RecordBatch.from_arrays([pa.array(["ab ab cd", None, "cd"])], ["t"])] * 2):
            for kind, term, tf, df in zip(*(c.to_pylist() for c in b.columns)):
                x = out.setdefault((kind, term), [0, 0])
                x[0] += tf
                x[1] += df
        return out

    whole = sums()
    assert whole["grams", "ab"] == [4, 2] and whole["grams", "cd"] == [4, 4]
    monkeypatch.setattr(features, "MOST_TERMS", 1)
    assert sums() == whole


# --- linear heads -----------------------------------------------------------------------------------


def dense_newton(x, y, penalty):
    """The plain solver: whole Newton steps over dense rows; the last weight is the intercept."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    ridge = penalty * np.diag([1.0] * (x.shape[1] - 1) + [0.0])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge, x.T @ (p - y) / len(x) + ridge @ w)
        w -= step
    return w


def sparse_frame(spark, x, targets):
    rows = [(np.flatnonzero(r).tolist(), r[np.flatnonzero(r)].tolist(), [float(v) for v in t]) for r, t in zip(x, targets)]
    return stored(frame(spark, rows, "idx array<int>, val array<double>, targets array<double>").repartition(3))


def test_optimum_equals_a_dense_solvers(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 12)) * (r.random((60, 12)) < 0.4)
    y = (r.random(60) < 1 / (1 + np.exp(-x[:, 0] * 2 + 0.5))).astype(float)
    want = dense_newton(x, y, 1 / 60)
    df = sparse_frame(spark, x, y[:, None])
    assert linear.fit_heads(df, 12, [linear.logistic], 1 / 60, tolerance=1e-8)[0] == pytest.approx(want, abs=1e-5)
    monkeypatch.setattr(linear, "TASK_ROWS", 10)  # several tasks, whose gradients are added in pieces
    monkeypatch.setattr(linear, "PIECE", 5)
    assert linear.fit_heads(df, 12, [linear.logistic], 1 / 60, tolerance=1e-8)[0] == pytest.approx(want, abs=1e-5)


def test_steps_are_dealt_by_entries(spark, monkeypatch):
    """A few long rows are several tasks' work, whose gradients the driver or executors add up alike."""
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 12)) * (r.random((60, 12)) < 0.4)
    y = (r.random(60) < 1 / (1 + np.exp(-x[:, 0] * 2 + 0.5))).astype(float)
    df, want, plain, seen = sparse_frame(spark, x, y[:, None]), dense_newton(x, y, 1 / 60), linear._gradient, set()
    monkeypatch.setattr(linear, "_gradient", lambda rows, w, losses, by: seen.add((rows.rdd.getNumPartitions(), by)) or plain(rows, w, losses, by))
    monkeypatch.setattr(linear, "TASK_ENTRIES", 100)
    monkeypatch.setattr(linear, "PIECE", 5)
    for most, by in ((linear.DIRECT, 1), (0, 3)):
        monkeypatch.setattr(linear, "DIRECT", most)
        seen.clear()
        assert linear.fit_heads(df, 12, [linear.logistic], 1 / 60, tolerance=1e-8)[0] == pytest.approx(want, abs=1e-5)
        assert seen == {(3, by)}


def test_blocks_hold_rows_as_they_are():
    ends, idx, targets = np.array([0, 2, 2, 3]), np.array([1, 7, 0]), np.array([[1.0, np.nan], [0.0, 2.0], [3.0, 4.0]])
    for val in (np.array([0.5, 0.1, 2.0]), np.array([0.5, 0.1, 2.0], np.float32)):
        (got,) = linear.unpacked(linear.block(idx, val, ends, targets))
        assert got[1].dtype == val.dtype and all(np.array_equal(g, w, equal_nan=True) for g, w in zip(got, (idx, val, ends, targets.ravel())))
    (got,) = linear.unpacked(linear.block(idx[:0], np.zeros(0), np.array([0, 0]), targets[:1]))
    assert [len(g) for g in got] == [0, 0, 2, 2]


def test_terms_are_counted_once(spark, monkeypatch):
    """Both kinds' vocabularies come of one pass over the texts."""
    passes, plain = spark.sparkContext.accumulator(0), features._count_terms

    def counted(batches):
        passes.add(1)
        yield from plain(batches)

    rows = stored(frame(spark, [("one two",), ("two three",)], "text string").coalesce(1))
    monkeypatch.setattr(features, "_count_terms", counted)
    assert set(features.TextFeatures.fit(rows, "text").terms["grams"]) == {"one", "two", "three", "one two", "two three"}
    assert passes.value == 1


def test_fitting_draws_the_same_sample_from_ids(spark, monkeypatch):
    from tonescope.operators import split
    from tonescope.plans import queries

    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("headline"), F.lit(1).alias("label"), F.when(F.col("id") % 4 < 3, "train").otherwise("test").alias("split"))
    for most in (50, 500):
        monkeypatch.setattr(queries, "FIT_ROWS", most)
        got = queries.fitting(rows, "train")
        assert got.columns == rows.columns and got.rdd.getNumPartitions() > 1
        assert sorted(got.collect()) == sorted(split.at_most(rows.where("split = 'train'"), most).collect())


def test_rows_are_taken_some_at_a_time(monkeypatch):
    monkeypatch.setattr(linear, "ENTRIES", 5)
    ends = np.array([0, 0, 3, 5, 5, 17, 18, 19])
    found = list(linear._row_ranges(ends))
    assert [b for b, _ in found] == [0, *[e for _, e in found[:-1]]] and found[-1][1] == 7
    assert all(e - b == 1 or ends[e] - ends[b] <= 5 for b, e in found) and list(linear._row_ranges(np.array([0]))) == []


def test_heads_of_several_losses(spark):
    """Each head's slope is its loss's; missing targets don't count; squared heads have a closed form."""
    r = np.random.default_rng(5)
    for loss in (linear.logistic, linear.squared, linear.tempered(2.0)):
        z, t, h = r.normal(size=20) * 3, r.random(20), 1e-6
        assert loss(z, t)[1] == pytest.approx((loss(z + h, t)[0] - loss(z - h, t)[0]) / (2 * h), abs=1e-4)
    assert linear.tempered(2.0)(np.array([1.5]), np.array([1.5]))[0] == pytest.approx(0.0)
    x, t = r.normal(size=(40, 3)), r.normal(size=40)
    t[:9] = np.nan
    df = sparse_frame(spark, x, np.stack([t, (t > 0).astype(float)], 1))
    w = linear.fit_heads(df, 3, [linear.squared, linear.logistic], 0.1, tolerance=1e-9)
    a = np.concatenate([x[9:], np.ones((31, 1))], 1)
    want = np.linalg.solve(2 * a.T @ a / 40 + 0.1 * np.diag([1, 1, 1, 0]), 2 * a.T @ t[9:] / 40)
    assert w[0] == pytest.approx(want, abs=1e-6)
    assert linear.fit_heads(df.limit(0), 3, [linear.squared], 0.1).tolist() == [[0.0] * 4]


def test_quasi_newton_on_a_bent_valley():
    """A badly scaled quadratic, to its least point, in far fewer steps than gradients alone would take."""
    scale = 10.0 ** np.arange(-2, 4)
    x, steps = linear.quasi_newton(lambda w: (float((scale * (w - 1) ** 2).sum() / 2), scale * (w - 1)), np.zeros(6), 500, 1e-10)
    assert x == pytest.approx(np.ones(6), abs=1e-6) and steps < 100


# --- boosted trees ----------------------------------------------------------------------------------


def plain_trees(bins, y, trees, rate, leaves):
    """One row at a time: leaf by leaf, each cut tried in turn."""
    n, width = bins.shape
    score = np.full(n, math.log(y.mean() / (1 - y.mean())))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, p * (1 - p)

        def best(rows):
            whole = grad[rows].sum() ** 2 / hess[rows].sum()
            out = (1e-12, None)
            for f in range(width):
                for b in range(bins[:, f].max()):
                    low, high = rows[bins[rows, f] <= b], rows[bins[rows, f] > b]
                    if min(len(low), len(high)) >= boosting.LEAST_ROWS and min(hess[low].sum(), hess[high].sum()) >= boosting.LEAST_WEIGHT:
                        gain = grad[low].sum() ** 2 / hess[low].sum() + grad[high].sum() ** 2 / hess[high].sum() - whole
                        if gain > out[0] + 1e-12:
                            out = (gain, (low, high))
            return out

        open_ = [(np.arange(n), best(np.arange(n)))]
        while len(open_) < leaves and any(cut for _, (_, cut) in open_):
            at = max(range(len(open_)), key=lambda i: open_[i][1][0] if open_[i][1][1] else -1)
            low, high = open_[at][1][1]
            open_[at : at + 1] = [(low, best(low)), (high, best(high))]
        for rows, _ in open_:
            score[rows] -= rate * grad[rows].sum() / hess[rows].sum()
    return score


@pytest.mark.parametrize("tasks", [1, 3])
def test_trees_equal_plain_ones(spark, monkeypatch, tasks):
    r = np.random.default_rng(7)
    x = np.stack([r.integers(0, 4, 300), np.round(r.normal(size=300), 1), r.random(300) < 0.3], 1).astype(float)
    y = (x[:, 0] + x[:, 1] + r.normal(size=300) > 1.5).astype(int)
    df = frame(spark, [(*map(float, a), int(b)) for a, b in zip(x, y)], "a double, b double, c double, y int").repartition(4)
    if tasks > 1:
        monkeypatch.setattr(boosting, "TASK_ROWS", 50)
    model = boosting.fit_trees(df, ["a", "b", "c"], "y", trees=6, rate=0.3, leaves=6)
    assert len(model.roots) == 6 and (model.table.groupby("tree").node.count() <= 11).all()
    want = plain_trees(boosting.binned(x, model.edges), y.astype(float), 6, 0.3, 6)
    assert model.margin(x) == pytest.approx(want, abs=1e-9)


def test_trees_of_missing_values_and_their_table(spark, tmp_path):
    rows = [(float(i % 10) if i % 7 else None, i % 2, i % 3 == 0) for i in range(400)] + [(1.0, None, True)]
    df = frame(spark, rows, "a double, y int, b boolean")
    model = boosting.fit_trees(df, ["a", "b"], "y", trees=5)
    model.save(spark, str(tmp_path))
    again = boosting.Trees.load(spark, str(tmp_path))
    one, two = (sorted(r["gbt_prob"] for r in m.predict(df).collect()) for m in (model, again))
    assert one == two and all(0 < p < 1 for p in one)
    constant = boosting.fit_trees(df.withColumn("y", F.lit(1)), ["a"], "y", trees=3)
    assert constant.predict(df.limit(1)).first()["gbt_prob"] == pytest.approx(1.0)


def test_edges_are_quantiles(spark):
    few = boosting.bin_edges(frame(spark, [(float(i % 3),) for i in range(90)], "a double"), ["a"])[0]
    assert boosting.binned(np.array([[0.0], [1.0], [2.0], [np.nan]]), [few])[:, 0].tolist() == [0, 1, 2, 0]
    many = boosting.bin_edges(spark.range(10_000).selectExpr("double(id) AS a"), ["a"])[0]
    counts = np.bincount(boosting.binned(np.arange(10_000.0)[:, None], [many])[:, 0])
    assert len(counts) <= 255 and counts.max() < 100


# --- calibration ------------------------------------------------------------------------------------


def test_isotonic_equals_plain_pooling(spark):
    r = np.random.default_rng(11)
    p = np.round(r.random(3000), 3)
    y = (r.random(3000) < p**2).astype(int)
    df = frame(spark, [(int(a), float(b)) for a, b in zip(y, p)] + [(None, 0.5), (1, None)], "y int, p double").repartition(5)
    curve = isotonic.Isotonic.fit(df, "y", "p")
    mean = pd.Series(y).groupby(p).mean()
    n = pd.Series(y).groupby(p).size()
    x = mean.index.to_numpy()
    least = lambda i: max(min(np.average(mean.iloc[a : b + 1], weights=n.iloc[a : b + 1]) for b in range(i, len(x))) for a in range(i + 1))
    for i in (0, 1, 17, 250, 500, 777, len(x) - 1):
        assert np.interp(x[i], curve.x, curve.y) == pytest.approx(least(i))
    assert (np.diff(curve.y) >= 0).all() and (np.diff(curve.x) > 0).all()
    out = {r["p"]: r["c"] for r in curve.transform(frame(spark, [(-5.0,), (5.0,), (None,)], "p double"), "p", "c").collect()}
    assert out[-5.0] == curve.y[0] and out[5.0] == curve.y[-1] and out[None] is None
    assert isotonic.Isotonic.fit(df.limit(0), "y", "p").transform(df.limit(1), "p", "c").first()["c"] is None


def test_isotonic_of_many_values_keeps_few_blocks(spark):
    """400,000 different scores leave no more than a few times n^(2/3) blocks."""
    df = spark.range(400_000).select(F.rand(3).alias("p"), F.rand(4).alias("u")).select("p", (F.col("u") < F.col("p")).cast("int").alias("y"))
    curve = isotonic.Isotonic.fit(df, "y", "p")
    assert len(curve.x) < 3 * 400_000 ** (2 / 3) and np.abs(curve.y - curve.x)[1000:-1000].max(initial=0) < 0.1


# --- whole models -----------------------------------------------------------------------------------


def test_models_learn(spark):
    df = bait(spark)
    model = models.fit_logistic(df.where("doc_id < 160"), "bait")
    scored = models.with_logistic(model, df.where("doc_id >= 160"))
    assert stats.ranking(scored, [], "bait", "lr_prob").first()["roc_auc"] == 1.0
    swap = frame(spark, [(1, "Guess what Biden did"), (2, "Guess what Trump did")], "doc_id int, headline string")
    assert len({r["lr_prob"] for r in models.with_logistic(model, swap).select("lr_prob").collect()}) == 1
    calibrated = models.Calibrator(scored, "bait", "lr_prob")
    got = [r["calibrated"] for r in calibrated.transform(scored.select("lr_prob", "bait"), "lr_prob").collect()]
    assert calibrated.method == "sigmoid" and all(0 <= p <= 1 for p in got)


def test_scorer_masks_entities_and_is_saved_whole(spark, tmp_path):
    rows = [(i, f"{'Guess what happens next to' if i % 2 else 'Council reviews the plan of'} {w} {i}", i % 2) for i, w in enumerate(["roads", "schools", "harbour", "budget", "parks"] * 60)]
    df = spark.createDataFrame(rows, "id int, headline string, label_clickbait int")
    scorer = models.fit_scorer(df.where("id < 90"), df.where("id >= 90"), "label_clickbait", trees=3)
    assert scorer.calibrator.method == "isotonic"
    scorer.save(spark, str(tmp_path / "m"))
    again = models.Scorer.load(spark, str(tmp_path / "m"))
    pairs = spark.createDataFrame([(0, "Biden visits NEW bridge"), (0, "TRUMP visits NEW bridge"), (1, "Guess what the left said"), (1, "Guess what Republicans said")], "k int, headline string")
    found = again.predict(pairs).collect()
    assert all(len({r["probability"] for r in found if r["k"] == k}) == 1 for k in (0, 1))
    assert sorted(r["probability"] for r in found) == sorted(r["probability"] for r in scorer.predict(pairs).collect())
    few = models.fit_scorer(df.where("id < 90"), df.where("id BETWEEN 90 AND 150"), "label_clickbait", trees=2, iterations=5)
    few.save(spark, str(tmp_path / "few"))
    assert models.Scorer.load(spark, str(tmp_path / "few")).calibrator.method == "sigmoid" == few.calibrator.method


def test_a_student_follows_its_teacher(spark):
    from tonescope.operators import distill, split

    openings = ["Guess what: ", "Senator slams rival: ", "Deadly storm: ", "Heartbreaking news: ", "MUST READ NOW: ", ""]
    rows = [(i, f"{openings[i % 6]}the {w} of {i % 5} towns", i % 6 in (0, 4)) for i, w in enumerate(["roads", "schools", "harbour", "budget", "parks"] * 80)]
    df = frame(spark, rows, "doc_id int, headline string, y boolean").withColumn("y", F.col("y").cast("int"))
    scorer = models.fit_scorer(df.where("doc_id < 150"), df.where("doc_id BETWEEN 150 AND 399 AND doc_id % 2 = 0"), "y", trees=20)
    taught = stored(distill.teacher_logits(scorer, df.withColumn("label", F.col("y"))))
    student = distill.fit_student(taught.where("doc_id < 250"), max_features=400)
    assert student.features.size <= 800 and len(student.names) == 8
    found = {r["head"]: r for r in distill.compared(student, taught.where("doc_id >= 250"), "label").collect()}
    assert found["binary"]["roc_auc"] > 0.99 and found["outrage"]["roc_auc"] > 0.99 and found["intensity"]["spearman"] > 0.8
    assert found["student_label"]["roc_auc"] > 0.99 and found["teacher_label"]["n"] == 150
    none = taught.where("doc_id < 250").withColumn("teacher_fear", F.lit(None).cast("double"))
    assert distill.fit_student(none, max_features=400, iterations=2).weights[distill.HEADS.index("fear")].tolist() == [0.0] * (student.features.size + 1)
    assert split.at_most(df, 70).count() == 70 and split.at_most(df, 700).count() == 400


# --- whole jobs -------------------------------------------------------------------------------------


def seen_by_fits(monkeypatch, spark, name, fit):
    """Ids of each set that a query's fit gets, of 400 rows and a bound of 20 for the queries that have one."""
    from tonescope.plans import queries

    class Fitted(Exception):
        pass

    def stop(*sets, **_):
        raise Fitted(*[sorted(r["doc_id"] for r in s.select("doc_id").collect()) for s in sets if not isinstance(s, str)])

    split = F.when(F.col("id") % 4 < 2, "train").when(F.col("id") % 4 == 2, "val").otherwise("test")
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("headline"), F.lit(1).alias("label"), split.alias("split"))
    monkeypatch.setattr(queries, "model_rows", lambda *_: rows)
    monkeypatch.setattr(queries, "FIT_ROWS", 20)
    monkeypatch.setattr(queries.models, fit, stop)
    with pytest.raises(Fitted) as found:
        queries.QUERIES[name](spark, "")
    return found.value.args


def test_gbt_stack_learns_from_all_training_rows(spark, monkeypatch):
    assert seen_by_fits(monkeypatch, spark, "gbt_stack", "fit_logistic") == ([i for i in range(400) if i % 4 < 2],)


def test_trained_scores_learns_and_calibrates_from_all_rows(spark, monkeypatch):
    train, val = seen_by_fits(monkeypatch, spark, "trained_scores", "fit_scorer")
    assert train == [i for i in range(400) if i % 4 < 2] and val == [i for i in range(400) if i % 4 == 2]


def test_steps_drop_what_none_reads_again(spark, monkeypatch):
    """Of a fit's tables none is left: neither texts nor all their terms nor sparse rows."""
    from tonescope.operators import store

    before = set(store._tables.values())
    model = models.fit_logistic(bait(spark), "bait")
    assert model.features.size and set(store._tables.values()) <= before


def test_rows_without_terms_score_the_intercept():
    idx, val, w = np.array([0, 2, 1], np.int32), np.array([1.0, 2.0, 3.0]), np.array([[1.0, 10.0, 100.0, 0.5], [0.0, 0.0, 1.0, -1.0]])
    assert linear.scores(idx, val, np.array([0, 0, 2, 2, 3, 3]), w).tolist() == [[0.5, -1.0], [201.5, 1.0], [0.5, -1.0], [30.5, -1.0], [0.5, -1.0]]
    assert linear.scores(idx[:0], val[:0], np.array([0, 0]), w).tolist() == [[0.5, -1.0]]
