"""Named queries: each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as X
from ..functions import rules, sql, text, tokenizer
from ..functions.lexicon import DIMENSIONS as DIMS
from ..operators import contracts, dedup, delivery, distill, labels, models, split, stats
from ..operators.store import new_path, stored
from ..sources import headlines, io
from ..streaming import feedback, sessions
from .oracle import DEVICES, OPENINGS, PIECES, RESPONSES, SIDES
from .probe import labelled, probe

BUDGET = 20_000


def six(c, name: str):
    return F.round(c, 6).alias(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_scores(probe(spark, sf_dir))


def technique_summary(spark, d):
    """Rows and mean score by language and intensity band: the flagship."""
    rows = scored(spark, d).withColumn("score", rules.rules_score())
    return rows.groupBy("lang", text.band("score").alias("band")).agg(F.count("*").alias("n"), six(F.avg("score"), "avg_score"))


def technique_scores(spark, d):
    return scored(spark, d).select("doc_id", *rules.SCORES, six(rules.rules_score(), "manipulation_score"))


def technique_spans(spark, d):
    rows = rules.span_rows(probe(spark, d))
    return rows.select("doc_id", "dimension", F.col("start").cast("bigint").alias("span_start"), F.col("end").cast("bigint").alias("span_end"), F.col("text").alias("span_text"))


def feature_vectors(spark, d):
    rows = rules.with_features(probe(spark, d))
    return rows.select("doc_id", *[F.round(f, 6).alias(f) if f == "allcaps_ratio" else f for f in rules.FEATURES])


def intensity_bands(spark, d):
    rows = scored(spark, d).withColumn("score", rules.rules_score())
    return rows.groupBy(text.band("score").alias("band")).agg(F.count("*").alias("n"), six(F.min("score"), "low"), six(F.max("score"), "high"))


def detected_techniques(spark, d):
    names = rules.detected()
    return scored(spark, d).select("doc_id", F.size(names).cast("bigint").alias("n_detected"), F.array_join(names, ",").alias("detected"))


def entity_mask(spark, d):
    n = F.size(text.matches("headline", "(?iU)" + X.alternation(X.ENTITIES))).cast("bigint")
    return probe(spark, d).select("doc_id", n.alias("n_entities"), F.length(rules.mask_entities("headline")).cast("bigint").alias("masked_length"))


def highlight_spans(spark, d):
    """Spans to mark: overlapping ones resolved."""
    found = F.array_distinct(F.flatten(F.array(*[text.spans("headline", "(?iU)" + X.alternation(ts)) for ts in X.LEXICONS.values()], text.spans("headline", X.MARKS))))
    marked = rules.mark_spans(found)
    return probe(spark, d).select("doc_id", F.size(found).cast("bigint").alias("n_spans"), F.size(marked).cast("bigint").alias("n_marks"), F.to_json(marked).alias("marks"))


def clean_headlines(spark, d):
    return io.clean(probe(spark, d).select("doc_id", "headline"), "doc_id").select("doc_id", "headline")


def contract_violations(spark, d):
    i = F.col("doc_id")
    rows = probe(spark, d).select(
        F.when(i % 11 == 0, "").when(i % 13 == 0, None).otherwise(F.col("headline")).alias("headline"), F.when(i % 17 == 0, "x").otherwise((i % 4).cast("string")).alias("label_clickbait"),
        F.when(i % 19 == 0, None).otherwise("docs").alias("source"), F.lit(None).cast("string").alias("outlet"), i.alias("dup_group"),
        F.when(i % 5 == 0, "train").when(i % 5 == 1, "val").when(i % 5 == 2, "test").otherwise("holdout").alias("split"),
    )
    return contracts.violations(rows, contracts.SPLIT)


def exact_dedup(spark, d):
    return probe(spark, d).groupBy("headline").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "copies")


def shingle_counts(spark, d):
    return dedup.texts(probe(spark, d)).select("rep", F.size(text.shingles("norm", 3)).cast("bigint").alias("n"))


def near_dup_pairs_exact(spark, d):
    return dedup.jaccard_pairs(dedup.texts(probe(spark, d))).select("a", "b", six(F.col("jaccard"), "jaccard"))


def near_dup_groups(spark, d):
    rows = stored(probe(spark, d).select("doc_id", "headline"))
    return dedup.with_groups(rows, dedup.jaccard_pairs(dedup.texts(rows))).select("doc_id", "group_min", "dup_group")


def near_dup_lsh(spark, d):
    return dedup.lsh_links(dedup.texts(probe(spark, d)))


def near_dup_lsh_candidates(spark, d):
    return dedup.lsh_links(dedup.texts(probe(spark, d)), verify=False)


def grouped(rows: DataFrame) -> DataFrame:
    named = rows.withColumn("norm", text.normalize("headline"))
    return named.join(dedup.texts(rows).withColumnRenamed("rep", "dup_group"), "norm").drop("norm")


def group_split(spark, d):
    rows = grouped(labelled(spark, d).select("doc_id", "headline", "label"))
    return split.grouped_stratified_split(rows, label="label").select("doc_id", "dup_group", "split", "label")


def split_balance(spark, d):
    return split.balance(group_split(spark, d), "label").select("split", "n", six(F.col("positive_share"), "positive_share"))


def leakage_check(spark, d):
    rows = grouped(probe(spark, d).select("doc_id", "headline")).withColumn("split", F.col("doc_id") % 3)
    return split.straddling(rows)


def graded_posts(spark, d):
    rows = labelled(spark, d)
    instances = rows.select(F.col("doc_id").cast("string").alias("id"), F.array("headline").alias("postText"), F.lit(None).cast("string").alias("targetTitle"), F.split("body", "\n").alias("targetParagraphs"))
    truth = rows.select(F.col("doc_id").cast("string").alias("id"), F.col("intensity").alias("truthMean"), F.when(F.col("label") == 1, "clickbait").otherwise("no-clickbait").alias("truthClass"))
    posts = io.graded_posts(instances, truth)
    return posts.select(F.col("id").cast("bigint").alias("id"), F.length("headline").cast("bigint").alias("headline_length"), F.length("body").cast("bigint").alias("body_length"), F.md5("body").alias("body_md5"), "intensity", "label_clickbait")


def dry_run_labels(spark, d):
    return labels.rule_labels(probe(spark, d)).select("doc_id", *DIMS)


def label_cache_reuse(spark, d):
    rows = probe(spark, d).withColumn("headline", F.concat_ws(" ", "headline", F.col("doc_id").cast("string")))
    known = rows.where("doc_id % 3 = 0").withColumn("key", text.cache_key("model", "1", "headline"))
    write = lambda line, value: known.select("key", value.cast("int").alias("outrage"), F.lit(line).alias("line_no"))
    cache = write(1, F.lit(9)).unionAll(write(2, F.col("doc_id") % 2))
    hits, misses = labels.cache_split(rows, cache, "model")
    fresh = misses.select("doc_id", F.lit(False).alias("hit"))
    outrage = rules.with_scores(probe(spark, d)).select("doc_id", rules.ordinal(F.col("s_outrage")).alias("outrage"))
    return hits.select("doc_id", F.lit(True).alias("hit"), "outrage").unionAll(fresh.join(outrage, "doc_id").select("doc_id", "hit", "outrage"))


def label_median_vote(spark, d):
    turns = F.explode(F.sequence(F.lit(1), (3 + F.col("doc_id") % 2).cast("int"))).alias("k")
    rows = probe(spark, d).select("doc_id", turns)
    samples = rows.select("doc_id", *[((F.col("doc_id") * 7 + F.col("k") * 3 + i) % 3).cast("int").alias(n) for i, n in enumerate(DIMS)], ((F.col("doc_id") + F.col("k")) % 3 == 0).alias("out_of_scope"))
    return labels.votes(samples, ["doc_id"]).drop("n_samples")


def budget_cutoff(spark, d):
    rows = probe(spark, d).select("doc_id", F.length("headline").cast("double").alias("tokens"))
    return labels.within_budget(rows, BUDGET, cost="tokens").select("doc_id", F.col("tokens").cast("bigint").alias("tokens"), F.col("spent").cast("bigint").alias("spent"))


def request_cost(spark, d):
    usd = labels.request_cost(F.length("headline"), F.col("doc_id") % 5, F.col("doc_id") % 7, F.lit(40))
    return probe(spark, d).select("doc_id", six(usd * 1e6, "micro_usd"))


def agreement_alpha(spark, d):
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("a"), F.col("toxic").cast("double").alias("b"))
    both = stats.agreement(rows, [], "doc_id", "a", "b")
    nominal = stats.alpha_terms(rows.select("doc_id", F.explode(F.array("a", "b")).alias("v")), [], "doc_id", "v", "nominal").select("alpha")
    interval = both.select(F.lit("interval").alias("metric"), "alpha", "exact_agreement", "n_units")
    other = both.drop("alpha").crossJoin(nominal).select(F.lit("nominal").alias("metric"), "alpha", "exact_agreement", "n_units")  # one row each
    return interval.unionAll(other).select("metric", six(F.col("alpha"), "alpha"), six(F.col("exact_agreement"), "exact_agreement"), "n_units")


def gold_gate(spark, d):
    found = labels.rule_labels(probe(spark, d)).groupBy("headline").agg(F.min("doc_id").alias("doc_id"), *[F.min(x).alias(x) for x in DIMS])
    gold = found.select("headline", *[F.when(F.col("doc_id") % (5 + i) == 0, F.least(F.lit(2), F.col(x) + 1)).otherwise(F.col(x)).alias(x) for i, x in enumerate(DIMS)])
    return labels.gold_gate(gold, found).select("dimension", six(F.col("alpha"), "alpha"), six(F.col("exact_agreement"), "exact_agreement"), "n_units", "usable")


def label_override(spark, d):
    rows = probe(spark, d).withColumn("own", F.concat_ws(" ", "headline", F.col("doc_id").cast("string")))
    known = rows.where("doc_id % 4 = 0").select(F.col("own").alias("headline"), *[(F.col("doc_id") % 3).cast("int").alias(x) for x in DIMS], (F.col("doc_id") % 8 == 0).alias("out_of_scope"), F.lit(1).alias("line_no"))
    targets = labels.targets(rows.select("doc_id", F.col("own").alias("headline")), known, ["outrage", "fear"])
    return targets.select("doc_id", *[f"target_{x}" for x in DIMS])


def evaluated(spark, d) -> DataFrame:
    return rules.with_scores(labelled(spark, d)).withColumn("p", rules.rules_baseline())


def ece(spark, d):
    return stats.calibration_error(evaluated(spark, d), ["lang"], "label", "p").select("lang", six(F.col("ece"), "ece"))


def roc_auc(spark, d):
    return stats.ranking(evaluated(spark, d), ["lang"], "label", "p").where("roc_auc IS NOT NULL").select("lang", six(F.col("roc_auc"), "roc_auc"))


def average_precision(spark, d):
    return stats.ranking(evaluated(spark, d), ["lang"], "label", "p").where("n_pos > 0").select("lang", six(F.col("average_precision"), "average_precision"))


def f1_report(spark, d):
    return stats.thresholded(evaluated(spark, d), ["lang"], "label", "p", 0.2).select("lang", six(F.col("f1"), "f1"), six(F.col("positive_rate"), "positive_rate"), "n")


def spearman_mae(spark, d):
    return stats.spearman(evaluated(spark, d), ["lang"], "intensity", "p").where("n >= 8").select("lang", six(F.col("spearman"), "spearman"), six(F.col("mae"), "mae"), "n")


def multitask_eval_loss(spark, d):
    i, p = F.col("doc_id"), F.col("p")
    rows = evaluated(spark, d).select(
        (4 * p - 1).alias("intensity_logit"), F.when(i % 3 != 0, F.col("intensity")).alias("intensity"), (6 * p - 2).alias("binary_logit"), F.when(i % 5 != 0, F.col("label").cast("double")).alias("label"),
        (2 * p - 1).alias("zo"), F.col("s_outrage").alias("to"), (1 - 3 * p).alias("zf"), F.col("s_fear").alias("tf"),
    )
    return stats.multitask_loss(rows, [("zo", "to"), ("zf", "tf")]).select(six(F.col("loss"), "loss"))


def rule_baseline_eval(spark, d):
    r = stats.report(evaluated(spark, d), [], "label", "p")
    return r.select(*[six(F.col(c), c) for c in ("roc_auc", "average_precision", "f1", "ece", "positive_rate")], "n")


def body_windows(spark, d):
    rows = delivery.body_window_rows(probe(spark, d))
    return rows.select("doc_id", F.col("n_windows").cast("bigint").alias("n_windows"), F.col("idx").cast("bigint").alias("idx"), F.length("window").cast("bigint").alias("n_chars"), F.md5("window").alias("window_md5"))


def delivery_verdict(spark, d):
    rows = delivery.overlap_scorer(delivery.body_window_rows(probe(spark, d)))
    best = rows.groupBy("doc_id").agg(F.max("entail").alias("d"), F.max("contradict").alias("c"), F.max("n_windows").alias("n_windows"))
    joined = probe(spark, d).select("doc_id").join(best, "doc_id", "left")
    return joined.select("doc_id", six(F.col("d"), "delivery"), six(F.col("c"), "contradiction"), F.when(F.col("d").isNotNull(), delivery.verdict("d", "c")).alias("verdict"), F.col("n_windows").cast("bigint").alias("n_windows"), F.when(F.col("d").isNull(), "empty body").alias("error"))


def delivery_gap(spark, d):
    return delivery.delivery_gap(probe(spark, d).select("doc_id", "headline", "body"))


def delivery_by_model(spark, d):
    """Verdicts by a model in the inference slot."""
    found = delivery.delivery_gap(probe(spark, d).select("doc_id", "headline", "body"), delivery.model_scorer(delivery.shared_words_model))
    return found.select("doc_id", "verdict", "n_windows", "error")


def html_headlines(spark, d):
    return headlines.page_headlines(table(spark, d, "pages"))


def page_scores(spark, d):
    """Headlines of pages, masked and scored: what the browser does."""
    rows = rules.with_scores(html_headlines(spark, d))
    return rows.select("page_id", "place", rules.mask_entities("headline").alias("masked"), six(rules.rules_score(), "score"), text.badge_colour(rules.rules_score()).alias("colour"))


def entity_swap_invariance(spark, d):
    """Each document's headline with an entity of either side in front: masked, both score alike."""
    sides = F.element_at(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SIDES]), (F.col("doc_id") % len(SIDES) + 1).cast("int"))
    out = probe(spark, d).select("doc_id", F.col("headline").alias("plain"), sides.alias("side"))
    for s in "ab":
        masked = rules.with_scores(out.withColumn("headline", rules.mask_entities(F.concat(f"side.{s}", F.lit(" on this: "), "plain"))))
        out = masked.withColumn(f"score_{s}", F.round(rules.rules_score(), 6)).drop("headline", *rules.SCORES)
    return out.select("doc_id", "score_a", "score_b", (F.abs(F.col("score_a") - F.col("score_b")) <= 0.10).alias("holds"))


def directional_lift(spark, d):
    """How much each of two devices lifts the score of each document's headline."""
    rows = probe(spark, d).select("doc_id", F.col("headline").alias("plain"), F.posexplode(F.array(*[F.replace(F.lit(v), F.lit("{b}"), F.col("headline")) for v in DEVICES])).alias("device", "hyped"))
    for c in ("plain", "hyped"):
        rows = rules.with_scores(rows, c).withColumn(f"x_{c}", rules.rules_score()).drop(*rules.SCORES)
    lift = F.col("x_hyped") - F.col("x_plain")
    return rows.select("doc_id", "device", six(lift, "lift"), (F.round(lift, 6) >= 0.05).alias("holds"))


def ensemble_blend(spark, d):
    x = models.blend("p", "intensity")
    return evaluated(spark, d).select("doc_id", six(x, "blend"), text.badge_colour(x).alias("colour"))


def tfidf_idf_table(spark, d):
    return models.idf_table(probe(spark, d)).select("term", "df", six(F.col("idf"), "idf"))


def model_rows(spark, d, text: str = "body") -> DataFrame:
    """(doc_id, headline, label, split): labelled documents, their whole texts to learn the label toxic from, in three sets
    by a hash."""
    rows = labelled(spark, d).select("doc_id", F.col(text).alias("headline"), "label")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(10))
    return rows.withColumn("split", F.when(part < 7, "train").when(part < 8, "val").otherwise("test"))


#: Labelled rows from which the queries fit a model, and as many to calibrate it, at most; all others are scored.
FIT_ROWS = 5_000


def fitting(rows: DataFrame, name: str) -> DataFrame:
    """A set's rows, or FIT_ROWS of them, in even parts: the sample is drawn from ids, and texts are read once."""
    rows = rows.where(F.col("split") == name)
    ids = stored(split.at_most(rows.select("doc_id"), FIT_ROWS))
    some = rows.join(F.broadcast(ids), "doc_id", "left_semi")  # FIT_ROWS ids
    return stored(some.repartition(rows.sparkSession.sparkContext.defaultParallelism))


def whole_set(rows: DataFrame, name: str) -> DataFrame:
    """All of a set's rows, in even parts; texts are read once."""
    return stored(rows.where(F.col("split") == name).repartition(rows.sparkSession.sparkContext.defaultParallelism))


def tfidf_logreg(spark, d):
    rows = model_rows(spark, d)
    model = models.fit_logistic(fitting(rows, "train"), "label")
    return stats.report(models.with_logistic(model, rows.where("split <> 'train'")), ["split"], "label", "lr_prob")


def gbt_stack(spark, d):
    rows = model_rows(spark, d)
    train = whole_set(rows, "train")
    logistic = models.fit_logistic(train, "label")
    stack = models.fit_stack(models.stacked(logistic, train, "label"), "label")
    found = models.Scorer(logistic, stack).predict(rows.where("split <> 'train'"))
    return stats.report(found, ["split"], "label", "probability")


def isotonic_calibration(spark, d):
    rows = evaluated(spark, d)
    fitted = models.Calibrator(rows, "label", "p", least=1)
    return fitted.transform(rows.select("doc_id", "label", "p"), "p").select("doc_id", "label", six(F.col("p"), "p"), six(F.col("calibrated"), "calibrated"))


def basic_tokens(spark, d):
    tokens = tokenizer.basic_tokens(rules.mask_entities("headline"))
    return probe(spark, d).select("doc_id", F.size(tokens).cast("bigint").alias("n_tokens"), F.array_join(tokens, " ").alias("tokens"))


def word_pieces(spark, d):
    """Ids of fixed length by a vocabulary of letters, word parts, and the lexicons' words."""
    rows = probe(spark, d).select("doc_id", tokenizer.basic_tokens(rules.mask_entities("headline")).alias("tokens"))
    ids, mask = tokenizer.encode(F.col("piece_ids"), 64, 2, 3, 0)
    return tokenizer.word_piece_ids(rows, "tokens", PIECES).select("doc_id", F.array_join(ids, " ").alias("input_ids"), F.array_join(mask, " ").alias("attention_mask"))


def coerced_labels(spark, d):
    raw = F.array(*[F.lit(v) for v in ("7", "1", None, "abc", "1.5", "2.5", "-3", "NaN")])
    return table(spark, d, "documents").select("doc_id", contracts.coerce_label(F.element_at(raw, (F.col("doc_id") % 8 + 1).cast("int"))).alias("label"))


def feedback_rows(spark, d) -> DataFrame:
    verdicts = F.array(*[F.lit(v) for v in ("agree", "too_high", "bad", None)])
    return probe(spark, d).withColumn("user_verdict", F.element_at(verdicts, (F.col("doc_id") % 4 + 1).cast("int"))).withColumn("comment", F.when(F.col("doc_id") % 6 != 0, F.col("body")))


def request_validation(spark, d):
    rows = feedback_rows(spark, d)
    counts = lambda k: contracts.with_validity(rows, k).agg(F.sum(F.col("valid").cast("bigint")).alias("accepted"), F.sum((~F.col("valid")).cast("bigint")).alias("rejected")).select(F.lit(k).alias("kind"), "accepted", "rejected")
    return counts("score").unionAll(counts("delivery_gap")).unionAll(counts("feedback"))


def feedback_windows(spark, d):
    events = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return feedback.verdict_windows(events, "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n")


def latency_percentiles(spark, d):
    q = stats.quantiles(table(spark, d, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})
    return q.select("event_type", six(F.col("p50"), "p50"), six(F.col("p95"), "p95"), "n")


def max_abs_difference(spark, d):
    return evaluated(spark, d).groupBy("lang").agg(six(F.max(F.abs(F.col("p") - F.col("intensity"))), "max_diff"), F.count("*").alias("n"))


def union_frames(spark, d):
    graded = labelled(spark, d).select("headline", "intensity", F.col("label").cast("double").alias("label"))
    binary = probe(spark, d).select("headline", (F.col("doc_id") % 2).cast("double").alias("label"))
    both = graded.unionByName(binary, allowMissingColumns=True).na.drop(subset=["headline"])
    return both.agg(F.count("*").alias("n"), F.count("intensity").alias("with_intensity"), F.count("label").alias("with_label"), six(F.avg("intensity"), "mean_intensity"), six(F.avg("label"), "mean_label"))


def hash_sample(spark, d):
    """An exact share of the rows, by a hash: the sampling operator."""
    return split.exact_sample(probe(spark, d).select("doc_id"), 0.15).where("sampled").select("doc_id")


def validation_remainder(spark, d):
    """A validation sample, and the training rows that are left."""
    rows = split.exact_sample(probe(spark, d).select("doc_id"), 0.15)
    return rows.select("doc_id", F.when(F.col("sampled"), "val").otherwise("train").alias("part"))


def guarded_auc(spark, d):
    """The area under the curve of groups that have at least eight rows and both classes."""
    rows = evaluated(spark, d).withColumn("part", F.col("doc_id") % 40)
    return stats.ranking(rows, ["part"], "label", "p", least=8).where("roc_auc IS NOT NULL").select("part", six(F.col("roc_auc"), "roc_auc"))


def label_schema_check(spark, d):
    responses = F.array(*[F.lit(r) for r in RESPONSES])
    rows = table(spark, d, "documents").select("doc_id", F.element_at(responses, (F.col("doc_id") % len(RESPONSES) + 1).cast("int")).alias("response"))
    return rows.select("doc_id", contracts.meets_label_schema(F.col("response")).alias("valid"))


def labelling_loop(spark, d):
    """A run of an annotator that answers by a headline's length: cache, votes of three samples, and a budget."""
    rows = probe(spark, d).select("doc_id", "headline")
    known = rows.where("doc_id % 3 = 0").select(text.cache_key("model", "1", "headline").alias("key"), *[((F.col("doc_id") + i) % 3).cast("int").alias(x) for i, x in enumerate(DIMS)], (F.col("doc_id") % 2 == 0).alias("out_of_scope"), F.col("doc_id").alias("line_no"))

    def annotate(asked: DataFrame, n: int) -> DataFrame:
        each = asked.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n))))
        size = F.length("headline")
        return each.select("key", *[((size * 7 + F.col("k") * (i + 2) + i) % 3).cast("int").alias(x) for i, x in enumerate(DIMS)], ((size + F.col("k")) % 2 == 0).alias("out_of_scope"))

    found, _ = labels.labelling_run(rows, known, "model", annotate, F.length("headline"), budget=BUDGET)
    return found.select("doc_id", "asked", F.col("spent").cast("bigint").alias("spent"), *DIMS, "out_of_scope")


def labels_present(spark, d):
    rows = probe(spark, d)
    return labels.coverage(rows, rows.where("doc_id % 4 = 0"))


def gated_targets(spark, d):
    """Targets by labels in the dimensions that the gold labels confirm."""
    rows = probe(spark, d).withColumn("own", F.concat_ws(" ", "headline", F.col("doc_id").cast("string")))
    known = rows.where("doc_id % 4 = 0").select(F.col("own").alias("headline"), *[(F.col("doc_id") % 3).cast("int").alias(x) for x in DIMS], (F.col("doc_id") % 8 == 0).alias("out_of_scope"), F.lit(1).alias("line_no"))
    found = labels.gated_targets(rows.select("doc_id", F.col("own").alias("headline")), known, gold_gate(spark, d))
    return found.select("doc_id", *[f"target_{x}" for x in DIMS])


def score_records(spark, d):
    rows = rules.with_score_record(probe(spark, d))
    return rows.select("doc_id", "manipulation_score", "intensity", F.array_join("detected_techniques", ",").alias("detected"), "model")


def trained_scores(spark, d):
    """Scoring records by a model that was trained, saved and loaded again."""
    rows = model_rows(spark, d)
    folder = new_path(spark, "scorer")
    models.fit_scorer(whole_set(rows, "train"), whole_set(rows, "val"), "label").save(spark, folder)
    found = rules.with_score_record(models.Scorer.load(spark, folder).predict(rows.where("split = 'test'")), probability="probability")
    return found.select("doc_id", "label", "manipulation_score", "intensity", F.array_join("detected_techniques", ",").alias("detected"), "model")


def distilled_student(spark, d):
    """A student that learnt a trained scorer's and the rules' answers to all headlines, compared with its teacher, and
    both with the label, on rows that the student has not seen."""
    rows = model_rows(spark, d, "headline")
    scorer = models.fit_scorer(fitting(rows, "train"), fitting(rows, "val"), "label")
    every = probe(spark, d).select("doc_id", "headline")
    held = rows.where("split = 'test'").select("doc_id", "label")
    taught = stored(distill.teacher_logits(scorer, every.join(held, "doc_id", "left")))
    student = distill.fit_student(split.at_most(taught.where("label IS NULL"), 4 * FIT_ROWS))
    found = distill.compared(student, taught.where("label IS NOT NULL"), "label")
    return found.select("head", *[six(F.col(c), c) for c in ("roc_auc", "average_precision", "f1", "ece", "spearman", "mae")], "n")


def sql_spans(spark, d):
    """The techniques' spans by the functions of SQL."""
    sql.register(spark)
    probe(spark, d).createOrReplaceTempView("_probe")
    return spark.sql("SELECT doc_id, dimension, CAST(start AS BIGINT) AS span_start, CAST(`end` AS BIGINT) AS span_end, text AS span_text FROM (SELECT doc_id, technique_spans(headline) AS s FROM _probe) LATERAL VIEW inline(s) t")


def sql_windows(spark, d):
    """Windows of bodies by the functions of SQL."""
    sql.register(spark)
    probe(spark, d).createOrReplaceTempView("_probe")
    return spark.sql("SELECT doc_id, CAST(size(w) AS BIGINT) AS n_windows, CAST(idx AS BIGINT) AS idx, CAST(length(window) AS BIGINT) AS n_chars, md5(window) AS window_md5 FROM (SELECT doc_id, body_windows(body) AS w FROM _probe) LATERAL VIEW inline(w) t")


def timed_events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def feedback_sliding(spark, d):
    """Events of each kind in windows of two days that begin each day, without those that came twice."""
    events = timed_events(spark, d)
    again = events.where("event_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    once = sessions.without_repeats(events.unionAll(again), ["event_id"], "ts")
    return sessions.sliding_counts(once, "ts", "event_type").select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "event_type", "n")


def feedback_sessions(spark, d):
    """Sessions of users with less than eight hours from one event to the next."""
    found = sessions.sessions(timed_events(spark, d), "ts", "user_id", "8 hours", measures={"total": F.sum("value")})
    stamp = lambda c: F.unix_micros(c)
    return found.select("user_id", stamp("session_start").alias("begin_us"), (stamp("session_end") - 8 * 3600 * 1_000_000).alias("end_us"), "n", six(F.col("total"), "total"))


def archetype_order(spark, d):
    """Each document's headline as it is and with ever shriller openings: scores in range, none below the one before."""
    openings = F.array(*[F.concat(F.lit(o), F.col("headline")) for o in OPENINGS])
    rows = probe(spark, d).select("doc_id", F.posexplode(openings).alias("place", "headline"))
    found = rules.with_scores(rows).withColumn("score", F.round(rules.rules_score(), 6))
    before = F.lag("score").over(Window.partitionBy("doc_id").orderBy("place"))  # three rows each
    return found.select("doc_id", "place", "score", F.col("score").between(0, 1).alias("in_range"), F.coalesce(F.col("score") >= before, F.lit(True)).alias("above"))


def feedback_queue(spark, d):
    """Events that the queue takes, each with the time at which it came in, and those that it refuses."""
    taken, refused = feedback.valid_feedback(feedback_rows(spark, d))
    counts = feedback.stamped(taken).agg(F.count("*").alias("queued"), F.count("ts").alias("stamped"))
    return counts.crossJoin(refused.agg(F.count("*").alias("refused")))  # one row each


def label_counts(spark, d):
    return labelled(spark, d).groupBy("label").agg(F.count("*").alias("n"), six(F.avg("intensity"), "mean_intensity"), six(F.avg((F.length("body") > 0).cast("double")), "with_body"))


def sample_tables(spark, d):
    """Variants of labelled headlines, as the sample generator makes them: near copies in known numbers."""
    rows = io.variants(labelled(spark, d).select("headline", F.col("label").alias("label_clickbait")), 25)
    return rows.groupBy("label_clickbait").agg(F.count("*").alias("n"), F.countDistinct("headline").alias("n_distinct"), F.sum(F.length("headline").cast("long")).alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        technique_summary, technique_scores, technique_spans, feature_vectors, intensity_bands, detected_techniques, entity_mask, highlight_spans, clean_headlines, contract_violations, exact_dedup,
        near_dup_pairs_exact, near_dup_groups, near_dup_lsh, near_dup_lsh_candidates, group_split, split_balance, leakage_check, graded_posts, dry_run_labels, label_cache_reuse, label_median_vote, budget_cutoff, request_cost,
        agreement_alpha, gold_gate, label_override, ece, roc_auc, average_precision, f1_report, spearman_mae, multitask_eval_loss, rule_baseline_eval, body_windows, delivery_verdict, delivery_gap, delivery_by_model, html_headlines, page_scores,
        entity_swap_invariance, directional_lift, ensemble_blend, tfidf_idf_table, tfidf_logreg, gbt_stack, isotonic_calibration, basic_tokens, word_pieces, coerced_labels, request_validation, feedback_windows,
        latency_percentiles, max_abs_difference, union_frames, hash_sample, label_counts, sample_tables, validation_remainder, guarded_auc, label_schema_check, labelling_loop, labels_present, gated_targets,
        score_records, trained_scores, distilled_student, archetype_order, feedback_queue, sql_spans, sql_windows, feedback_sliding, feedback_sessions,
    )
} | {"shingles": shingle_counts}
QUERIES["group_split"] = lambda spark, d: group_split(spark, d).select("doc_id", "dup_group", "split")
