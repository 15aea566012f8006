import gzip
import json
import os
import random
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests import slot_models
from tonescope.operators import contracts, dedup, delivery, labels, split
from tonescope.functions.lexicon import DIMENSIONS
from tonescope.sources import io
from tonescope.streaming import feedback

RAW = "headline string, label_clickbait int, source string, outlet string"


def test_contract(spark):
    good = spark.createDataFrame([("A fine headline", 1, "s", None), ("Another one", 0, "s", "o")], RAW)
    assert contracts.validated(good, contracts.RAW).count() == 2
    for bad in (("", 1, "s", None), ("x", 5, "s", None), ("x", 1, None, None)):
        with pytest.raises(contracts.ContractError):
            contracts.validated(good.unionAll(spark.createDataFrame([bad], RAW)), contracts.RAW)
    text = good.withColumn("label_clickbait", F.lit("1")).withColumn("extra", F.lit(3))
    assert dict(contracts.validated(text, contracts.RAW).dtypes)["label_clickbait"] == "int"
    with pytest.raises(contracts.ContractError):
        contracts.validated(good.withColumn("dup_group", F.lit(1)).withColumn("split", F.lit("holdout")), contracts.SPLIT)
    with pytest.raises(contracts.ContractError):
        contracts.validated(good, contracts.DEDUPED)


def test_requests(spark):
    rows = spark.createDataFrame([("h", "agree", None), ("h" * 1000, "agree", None), ("", "agree", None), ("h", "maybe", None), ("h", "too_low", "c" * 1001)], "headline string, user_verdict string, comment string")
    assert [r["valid"] for r in contracts.with_validity(rows, "feedback").collect()] == [True, False, False, False, False]
    batch = spark.createDataFrame([(1, "a"), (1, ""), (2, "x" * 501)] + [(3, "b")] * 101, "batch int, headline string")
    assert {r["batch"] for r in contracts.valid_batches(batch, "batch").collect()} == {1}


def test_label_coercion(spark):
    raw = spark.createDataFrame([("7",), ("1",), (None,), ("x",), ("1.5",), ("0.5",), ("-2",), ("NaN",), ("Infinity",)], "v string")
    assert [r[0] for r in raw.select(contracts.coerce_label(F.col("v"))).collect()] == [2, 1, 0, 0, 2, 0, 0, 0, 0]


def groups(spark, headlines, links=None):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(headlines)], "doc_id long, headline string")
    found = dedup.with_groups(df, (links or dedup.jaccard_pairs)(dedup.texts(df)))
    return [r["dup_group"] for r in found.orderBy("doc_id").collect()]


def test_near_duplicates(spark):
    lines = ["Council votes to repair the old stone bridge", "Council votes — to repair the old stone bridge!", "Rain is expected along the coast", "", "ab", "!!", "Council votes to repair the old stone bridges"]
    assert groups(spark, lines) == [0, 0, 1, 2, 3, 2, 0]
    assert groups(spark, lines, lambda t: dedup.lsh_links(t, verify=False))[:3] == [0, 0, 1]


def test_lsh_finds_close_pairs(spark):
    base = "the quick survey of " + " ".join(f"word{i}" for i in range(40))
    lines = [base, base + " x", base + " yz", "something else entirely that shares nothing with it"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(lines)], "doc_id long, headline string")
    exact = {(r["a"], r["b"]) for r in dedup.jaccard_pairs(dedup.texts(df)).collect()}
    assert exact == {(r["a"], r["b"]) for r in dedup.lsh_links(dedup.texts(df)).collect()} == {(0, 1), (0, 2), (1, 2)}


def test_pairs_match_brute_force(spark):
    import random

    r = random.Random(3)
    base = ["".join(r.choices("abcde ", k=r.randint(1, 60))) for _ in range(40)]
    lines = base + [b[: len(b) - 1] + r.choice("abc") for b in base] + [b + r.choice("xyz") for b in base]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(lines)], "doc_id long, headline string")
    rows = dedup.texts(df).collect()
    sets = {x["rep"]: {x["norm"]} if len(x["norm"]) <= 3 else {x["norm"][i : i + 3] for i in range(len(x["norm"]) - 2)} for x in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(x["a"], x["b"]) for x in dedup.jaccard_pairs(dedup.texts(df)).collect()} == want


@pytest.mark.parametrize("block, hot", [(dedup.BLOCK, dedup.HOT), (40, 100), (7, 1)])
def test_verified_links_equal_brute_force(spark, block, hot):
    """Also where a third of all texts share their buckets, whose members meet in blocks."""
    r = random.Random(3)
    base = "the quick brown fox jumps over the lazy dog and runs far away from here today"
    same = [base + (f" {i}" if i % 3 else f" {'xyzw'[i % 4]}{i}") for i in range(150)]
    other = [" ".join("".join(r.choices("abcde", k=4)) for _ in range(6)) for _ in range(200)]
    near = [t[:-1] + "q" for t in other[:60]]
    texts = list(dict.fromkeys(same + other + near))
    distinct = spark.createDataFrame(list(enumerate(texts)), "rep long, norm string").repartition(4)
    signed = {x["rep"]: x["signature"] for x in dedup.minhash(distinct).collect()}
    grams = {i: {t[j : j + 3] for j in range(len(t) - 2)} for i, t in enumerate(texts)}
    want = set()
    for b in range(dedup.BANDS):
        by = {}
        for i, sig in signed.items():
            by.setdefault(tuple(sig[b * dedup.ROWS : (b + 1) * dedup.ROWS]), []).append(i)
        want |= {(x, y) for m in by.values() for x in m for y in m if x < y and len(grams[x] & grams[y]) >= 0.8 * len(grams[x] | grams[y])}
    got = [tuple(x) for x in dedup.lsh_links(distinct, block=block, hot=hot).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    tasks = dedup.dealt(dedup.bucket_rows(dedup.minhash(distinct)), block, hot).groupBy("bucket", "first", "second").count().agg(F.max("count")).first()[0]
    assert tasks <= 4 * block + 20


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.95])
def test_similar_sets_share_a_part(spark, threshold):
    """At the very threshold too, and for sets of one hash; the longer set by a key of its own class of lengths."""
    r = random.Random(9)
    sets, pairs = [], []
    for n in [*range(1, 40), 64, 100, 333]:
        base = [r.getrandbits(63) for _ in range(n)]
        for less in range(n):
            for more in range(n):
                if n - less >= threshold * (n + more) - 1e-9 and (less == n - 1 or n - less - 1 < threshold * (n + more)):  # the last that still reaches it
                    pairs.append((len(sets), len(sets) + 1))
                    sets += [base, base[less:] + [r.getrandbits(63) for _ in range(more)]]
    df = spark.createDataFrame(list(enumerate(sets)) + [(len(sets), [])], "i int, set array<long>").repartition(3)
    rows = df.select("i", dedup.part_keys(threshold)("set").alias("keys"), F.size("set").alias("n")).select("i", "keys", dedup.parts_of("n", threshold).alias("own"))
    keys = {x["i"]: (set(x["keys"][: x["own"]]), set(x["keys"])) for x in rows.where("size(keys) > 0").collect()}
    for i, j in pairs:
        long, short = (i, j) if len(sets[i]) >= len(sets[j]) else (j, i)
        assert keys[long][0] & keys[short][1], (sets[i], sets[j])
    assert len(pairs) >= 80 and rows.where("size(keys) = 0").count() == 1


def test_a_shared_rare_word_makes_no_candidates(spark):
    """Texts that only share one rare word don't meet, where the prefixes of their sets all did."""
    r = random.Random(4)
    lines = [f"{''.join(r.choices('abcdefgh ', k=60))} zqjx {''.join(r.choices('abcdefgh ', k=20))}" for _ in range(1000)]
    df = spark.createDataFrame(list(enumerate(lines)), "rep long, norm string")
    keys = dedup.hashed_sets(df).select("rep", F.explode(dedup.part_keys(0.8)("set")).alias("key"))
    counts = keys.groupBy("key").count()
    assert counts.agg(F.sum(F.expr("count * (count - 1) / 2"))).first()[0] < 0.1 * 1000 * 999 / 2
    assert dedup.jaccard_pairs(df).count() == 0


@pytest.mark.parametrize("most", [dedup.MOST_HASHES, 5])
def test_sets_are_in_one_order(spark, monkeypatch, most):
    """Rarest hashes first, whether their counts are broadcast or joined."""
    monkeypatch.setattr(dedup, "MOST_HASHES", most)
    r = random.Random(6)
    sets = {i: r.sample(range(-20, 20), r.randint(0, 12)) for i in range(60)}
    got = dedup.rarest_first(spark.createDataFrame(list(sets.items()), "rep int, set array<long>").repartition(3)).collect()
    df = Counter(h for s in sets.values() for h in s)
    assert {x["rep"]: list(x["set"]) for x in got if x["set"]} == {i: sorted(s, key=lambda h: (df[h], h)) for i, s in sets.items() if s}


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "a long, b long")
    assert {(r["rep"], r["component"]) for r in dedup.components(links).collect()} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}


def test_split(spark):
    df = spark.range(2000).select((F.col("id") % 1000).alias("dup_group"), (F.col("id") % 2).cast("int").alias("label_clickbait"))
    out = split.grouped_stratified_split(df)
    split.check_no_leakage(out)
    shares = {r["split"]: r for r in split.balance(out).collect()}
    assert abs(shares["test"]["n"] / 2000 - 0.15) <= 0.03 and abs(shares["val"]["n"] / 2000 - 0.15) <= 0.03 and all(abs(r["positive_share"] - 0.5) <= 0.05 for r in shares.values())
    assert sorted(out.collect()) == sorted(split.grouped_stratified_split(df).collect())
    two = split.grouped_stratified_split(df.where("dup_group < 2"))
    assert {r["split"] for r in two.collect()} == {"train"}
    with pytest.raises(split.LeakageError):
        split.check_no_leakage(spark.range(20).select((F.col("id") % 10).alias("dup_group"), F.when(F.col("id") < 10, "train").otherwise("test").alias("split")))


def test_labels(spark):
    heads = spark.createDataFrame([(1, "Coach slams referee"), (2, "Quiet day"), (3, "Deadly storm, a disaster")], "doc_id long, headline string")
    dry = {r["doc_id"]: r.asDict() for r in labels.rule_labels(heads).collect()}
    assert dry[1]["outrage"] == 1 and dry[3]["fear"] == 2 and all(dry[2][d] == 0 for d in DIMENSIONS) and dry[1]["out_of_scope"] is False
    zero = {d: 0 for d in DIMENSIONS}
    cache = spark.createDataFrame([("m|cb1|Quiet day", *zero.values(), False, 1), ("m|cb1|Quiet day", *(zero | {"fear": 2}).values(), False, 2)], "key string, " + ", ".join(f"{d} int" for d in DIMENSIONS) + ", out_of_scope boolean, line_no long")
    got = {r["headline"]: r for r in labels.label(heads, cache, "m").collect()}
    assert got["Quiet day"]["fear"] == 2 and got["Coach slams referee"]["outrage"] == 1 and len(got) == 3
    assert labels.label(heads, cache, "m", limit=1).count() == 1
    votes = spark.createDataFrame([(1, v, v == 2) for v in (0, 1, 2, 2)], "doc_id int, v int, out_of_scope boolean").select("doc_id", *[F.col("v").alias(d) for d in DIMENSIONS], "out_of_scope")
    assert labels.votes(votes, ["doc_id"]).first().asDict() == {"doc_id": 1, **{d: 1 for d in DIMENSIONS}, "out_of_scope": False, "n_samples": 4}
    costs = spark.createDataFrame([(i, 2.0) for i in range(10)], "doc_id long, usd double")
    assert sorted(r["doc_id"] for r in labels.within_budget(costs, 5.0).collect()) == [0, 1, 2]
    usd = spark.range(1).select(labels.request_cost(F.lit(1000), F.lit(100), F.lit(200), F.lit(10))).first()[0]
    assert usd == pytest.approx((1145 * 5 + 250) / 1e6)


def test_targets_use_usable_labels_only(spark):
    heads = spark.createDataFrame([(1, "Coach slams referee"), (2, "Coach slams fans")], "doc_id long, headline string")
    known = spark.createDataFrame([("Coach slams referee", 2, 2, False, 1), ("Coach slams fans", 2, 2, True, 1)], "headline string, outrage int, fear int, out_of_scope boolean, line_no int")
    known = known.withColumns({d: F.lit(1) for d in DIMENSIONS if d not in ("outrage", "fear")})
    rows = {r["doc_id"]: r for r in labels.targets(heads, known, ["outrage"]).collect()}
    assert (rows[1]["target_outrage"], rows[1]["target_fear"], rows[2]["target_outrage"]) == (1.0, 0.0, 0.6)
    assert labels.targets(heads, known, []).first()["target_outrage"] == 0.6


def test_delivery(spark):
    pairs = [(0.7, 0.9), (0.1, 0.6), (0.1, 0.2), (0.4, 0.2), (0.1, 0.1)]
    got = [r[0] for r in spark.createDataFrame(pairs, "d double, c double").select(delivery.verdict("d", "c")).collect()]
    assert got == ["delivered", "overpromises", "overpromises", "partially_supported", "not_directly_supported"]
    df = spark.createDataFrame([(1, "Bridge repair begins", "The bridge repair begins today. More later."), (2, "Bridge", ""), (3, "Bridge", None)], "doc_id int, headline string, body string")
    rows = {r["doc_id"]: r for r in delivery.delivery_gap(df).collect()}
    assert rows[1]["verdict"] == "delivered" and rows[1]["gap_score"] == 0.0 and rows[2]["error"] == "empty body" and rows[3]["error"] == "empty body"


def test_sources(spark, tmp_path):
    with gzip.open(tmp_path / "a.txt.gz", "wt") as f:
        f.write("First line \n\n  Second\n")
    assert [r["headline"] for r in io.read_lines(spark, str(tmp_path / "a.txt.gz"), 1, "s").collect()] == ["First line", "Second"]
    posts = [{"id": "1", "postText": [" Big ", "news here"], "targetTitle": None, "targetParagraphs": [" a ", "", "b"]}, {"id": "2", "postText": ["lost"], "targetParagraphs": []}, {"id": "3", "postText": ["tiny"], "targetParagraphs": ["x" * 5000]}]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/instances.jsonl", "\n".join(json.dumps(p) for p in posts))
        z.writestr("in/truth.jsonl", "\n".join(json.dumps(t) for t in ({"id": "1", "truthMean": 0.2, "truthClass": "no"}, {"id": "1", "truthMean": 0.8, "truthClass": "clickbait"}, {"id": "3", "truthMean": 0.1, "truthClass": "no"})))
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.posts.link./in", f"file://{tmp_path}")  # a path that only Spark's readers open
    read = lambda s, schema: io.read_jsonl_from_zip(spark, "viewfs://posts/in/z.zip", s, schema)
    with pytest.raises(Exception, match="no member"):
        read("missing.jsonl", io.TRUTH).count()
    rows = io.graded_posts(read("instances.jsonl", io.INSTANCE), read("truth.jsonl", io.TRUTH)).collect()
    assert [(r["id"], r["headline"], r["target_title"], r["body"], r["intensity"], r["label_clickbait"]) for r in rows] == [("1", "Big  news here", "", "a b", 0.8, 1)]
    (tmp_path / "gold.csv").write_text("headline," + ",".join(DIMENSIONS) + '\n"One, two ""three""",0,1,2,0,0,0\n')
    assert io.read_gold(spark, str(tmp_path / "gold.csv")).first()[:3] == ('One, two "three"', 0, 1)
    assert io.sample_headlines(spark).count() == 500 and io.sample_posts(spark).count() == 240
    io.write_stage(spark.createDataFrame([(1, "train"), (2, "val")], "i int, split string"), str(tmp_path / "t"), by_split=True)
    assert spark.read.parquet(str(tmp_path / "t/split=train")).count() == 1


def test_models_of_any_label_order_give_equal_verdicts(spark):
    body = "The bridge opens today. It was not easy. " * 9
    df = spark.createDataFrame([(i, h, b) for i, (h, b) in enumerate([("Bridge opens today", body), ("Bridge never opens", body), ("Nothing", "x."), (None, body), ("Bridge", None)] * 30)], "doc_id int, headline string, body string")
    rows = [sorted(map(tuple, delivery.delivery_gap(df, s).collect()), key=str) for s in (delivery.overlap_scorer, delivery.model_scorer(delivery.shared_words_model), delivery.model_scorer(slot_models.permuted, batch=7))]
    assert rows[1] == rows[2]
    same = lambda rs: [r for r in rs if r[1] is not None]
    assert same(rows[0]) == same(rows[1]) and {r[5] for r in rows[1]} >= {"delivered", "not_directly_supported"}
    assert {r["max_contradiction"] for r in delivery.delivery_gap(df, delivery.model_scorer(slot_models.two_labels)).where("max_contradiction IS NOT NULL").collect()} == {0.0}
    assert delivery.label_places({0: "LABEL_entailment", 1: "x"}) == (0, None) and delivery.label_places({0: "contradiction", 2: "Entailment"}) == (2, 0)
    with pytest.raises(ValueError):
        delivery.label_places({0: "a", 1: "b"})


def test_streams_with_state(spark, tmp_path):
    """Repeats within the watermark are dropped, late events are too, sessions end when their gap has passed."""
    from tonescope.streaming import sessions

    hour = 3600.0
    first = [("a", 0.0, "u"), ("b", 0.2, "u"), ("a", 0.1, "u"), ("c", 5.0, "u"), ("d", 5.1, "v")]
    second = [("b", 0.3, "u"), ("e", 40.0, "u"), ("f", 40.1, "v")]
    third, fourth = [("h", 80.0, "w"), ("e", 40.2, "u")], [("g", 1.0, "u")]  # g comes too late: after a batch that knew of 40 hours
    (tmp_path / "in").mkdir()
    schema = "id string, at double, user string"
    frames = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds(F.col("at") * hour))
    for i, events in enumerate((first, second, third, fourth)):
        (tmp_path / f"in/{i}.json").write_text("\n".join(json.dumps(dict(zip(("id", "at", "user"), e))) for e in events))
        os.utime(tmp_path / f"in/{i}.json", (i + 1, i + 1))

    def run(df, name, mode="append"):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    once = [r["id"] for r in run(sessions.without_repeats(frames(), ["id"], "ts", late="10 hours"), "once")]
    assert sorted(once) == ["a", "b", "c", "d", "e", "f", "h"]
    ended = sorted((r["user"], r["n"], r["top"]) for r in run(sessions.sessions(frames(), "ts", "user", "2 hours", late="10 hours", measures={"top": F.max("at")}), "ended"))
    assert ended == [("u", 1, 5.0), ("u", 2, 40.2), ("u", 4, 0.3), ("v", 1, 5.1), ("v", 1, 40.1)]
    batch = spark.read.schema(schema).json(str(tmp_path / "in")).withColumn("ts", F.timestamp_seconds(F.col("at") * hour))
    assert sorted(r["id"] for r in sessions.without_repeats(batch, ["id"], "ts").collect()) == list("abcdefgh")
    assert {(r["user"], r["n"]) for r in sessions.sessions(batch, "ts", "user", "2 hours").collect()} == {("u", 5), ("u", 1), ("u", 2), ("v", 1), ("w", 1)}
    slid = {(r["window_start"].hour, r["n"]) for r in sessions.sliding_counts(batch.where("at < 3"), "ts", "user", "2 hours", "1 hour").collect()}
    assert slid == {(23, 4), (0, 5), (1, 1)}


def test_functions_of_sql(spark):
    from tonescope.functions import sql

    assert "technique_spans" in sql.register(spark)
    spark.createDataFrame([(1, "MUST READ: Guess what the FBI did!!"), (2, ""), (3, None)], "i int, h string").createOrReplaceTempView("_heads")
    rows = spark.sql("SELECT i, s.* FROM _heads, LATERAL technique_span_rows(h) s").collect()
    assert {(r["dimension"], r["text"]) for r in rows} == {("curiosity_gap", "Guess what"), ("sensational_formatting", "MUST"), ("sensational_formatting", "READ"), ("sensational_formatting", "!!")}
    one = spark.sql("SELECT mask_entities('Biden waits') AS m, normalize_headline(' A-b C ') AS n, intensity_band(0.5) AS b, body_windows('A. B. C.', 2, 1) AS w").first()
    assert one["m"].endswith("waits") and one["n"] == "ab c" and one["b"] == "moderate" and [x["window"] for x in one["w"]] == ["A. B."]


def test_clean(spark):
    df = spark.createDataFrame([(2, " A long headline "), (1, "A long headline"), (3, "short"), (4, "x" * 301), (5, "a long headline")], "row_id long, headline string")
    assert sorted(r["row_id"] for r in io.clean(df).collect()) == [1, 5]


def test_feedback_stream(spark, tmp_path):
    events = [{"headline": "h", "user_verdict": "agree", "ts": 86400.0 * d} for d in range(3)] + [{"headline": "", "user_verdict": "agree", "ts": 0.0}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, events)))
    for _ in range(2):  # the second run finds nothing new
        feedback.append_feedback(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 3
    batch = feedback.verdict_windows(feedback.read_feedback(spark, str(tmp_path / "in"), streaming=False), "ts", "user_verdict")
    stream = feedback.verdict_windows(feedback.read_feedback(spark, str(tmp_path / "in")), "ts", "user_verdict")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("windows").collect()) == sorted(batch.collect())


def test_labelling_run_ends_with_the_budget(spark):
    from tonescope.functions.text import cache_key

    heads = spark.createDataFrame([(i, f"headline {i % 12}") for i in range(20)], "doc_id long, headline string")
    none = spark.createDataFrame([], "key string, " + ", ".join(f"{x} int" for x in DIMENSIONS) + ", out_of_scope boolean, line_no long")
    known = heads.where("doc_id IN (1, 2)").select(cache_key("m", "1", "headline").alias("key"), *[F.lit(2).alias(x) for x in DIMENSIONS], F.lit(True).alias("out_of_scope"), F.col("doc_id").alias("line_no"))
    seen = []

    def annotate(rows, n):
        seen.append(n)
        return rows.select("key", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("k")).select("key", *[F.col("k").alias(x) for x in DIMENSIONS], (F.col("k") > 0).alias("out_of_scope"))

    found, fresh = labels.labelling_run(heads, none.unionByName(known), "m", annotate, F.lit(1.0), n_samples=3, budget=10.0)
    rows = {r["doc_id"]: r for r in found.collect()}
    # 0, 3, 4 and 5 cost three each; 6 would be asked with 12 of 10 spent
    assert sorted(rows) == list(range(6)) and {i for i in rows if rows[i]["asked"]} == {0, 3, 4, 5} and seen == [3]
    assert rows[1]["outrage"] == 2 and rows[0]["outrage"] == 1 and rows[0]["out_of_scope"] and fresh.count() == 4
    assert labels.labelling_run(heads, none, "m", annotate, F.lit(0.0), limit=15)[0].count() == 15
    assert tuple(labels.coverage(heads, heads.where("doc_id < 3")).first()) == (20, 6)


def test_gate_needs_labels_and_report(spark):
    heads = spark.createDataFrame([("You won't believe it",)], "headline string")
    known = spark.createDataFrame([("You won't believe it", *[2] * 6, 1)], "headline string, " + ", ".join(f"{x} int" for x in DIMENSIONS) + ", line_no int")
    report = spark.createDataFrame([("fear", True), ("outrage", False)], "dimension string, usable boolean")
    weak = labels.gated_targets(heads, None, report).first()
    assert weak["target_fear"] == 0.0 and labels.gated_targets(heads, known, None).first() == weak == labels.gated_targets(heads, known, report.where("NOT usable")).first()
    strong = labels.gated_targets(heads, known, report).first()
    assert strong["target_fear"] == 1.0 and strong["target_outrage"] == 0.0


def test_exact_sample(spark):
    import hashlib

    for n, share in ((0, 0.5), (1, 0.15), (37, 0.5), (500, 0.15), (500, 1.0)):
        rows = split.exact_sample(spark.range(n).withColumnRenamed("id", "doc_id"), share).collect()
        order = sorted(range(n), key=lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i))
        assert {r["doc_id"] for r in rows if r["sampled"]} == set(order[: round(n * share)]) and len(rows) == n


def test_queue_is_counted_and_stamped(spark, tmp_path):
    assert feedback.queue_count(spark, str(tmp_path / "none")) == 0
    rows = feedback.stamped(spark.createDataFrame([("a", None), ("b", 5.0)], "headline string, ts double"))
    rows.write.json(str(tmp_path / "queue"))
    assert feedback.queue_count(spark, str(tmp_path / "queue")) == 2 and {r["headline"]: r["ts"] > 1e9 for r in rows.collect()} == {"a": True, "b": False}
