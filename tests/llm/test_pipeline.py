import zlib

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from pyspark.sql import functions as F  # noqa: E402

from tonescope.llm import quality, queries, toxicity  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    """Documents of the test corpus with labels, and copies of some of them under other ids."""
    path = str(tmp_path_factory.mktemp("tables"))
    extra = docs.where("doc_id < 40").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" dolt wretched dolt")).alias("text"), "lang", "source", "n_chars")
    more = docs.where("doc_id BETWEEN 40 AND 79").select((F.col("doc_id") + 1000).alias("doc_id"), F.regexp_replace("text", " ", "%%% ").alias("text"), "lang", "source", "n_chars")
    clash = docs.unionAll(extra).unionAll(more).withColumn("kept", F.lit("x")).withColumn("score", F.lit("y"))
    clash.write.parquet(f"{path}/documents.parquet")
    labels = clash.where("doc_id < 120 OR doc_id >= 1000").select("doc_id", F.when(F.col("doc_id").between(1040, 1079), 0).otherwise(1).alias("quality"), F.when(F.col("doc_id").between(1000, 1039), 1).otherwise(0).alias("toxic"))
    labels.write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_match_their_operators(spark, folder, tmp_path):
    docs = queries.documents(spark, folder)
    columns = docs.columns
    labels = queries.labels(spark, folder)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in out.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
            break
        assert out.columns == columns
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.train_toxicity(docs, labels)
            scorer = toxicity.Scorer(model)
            want = {r["doc_id"] for r in docs.collect() if scorer.score(r["text"]) < 0.5}
            assert not kept & set(range(1000, 1040)) and len(kept) >= docs.count() - 40
        elif name == "quality_rules":
            want = {r["doc_id"] for r in quality.score_quality(docs, quality.train_quality(docs, labels), prefix="p_").where("p_kept").collect()}
        else:
            from test_minhash import brute

            found = brute([(r["doc_id"], r["text"]) for r in docs.collect()], corpus_pipeline.COPIES)
            want = {i for i, (_, c) in found.items() if i == c}
            assert len(want) < len(found)
        assert kept == want
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) and all(r["offset"] + r["length"] <= 2048 for r in rows)


@pytest.mark.parametrize("k", range(4))
def test_stages_on_odd_tables(spark, folder, nothing, k):
    stage = corpus_pipeline.STAGES[k][1]
    assert stage(spark, nothing, folder).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None), (None, "a b", None, None, None), (2, "", "", "", 0), (2, "", "", "", 0)], nothing.schema)
    assert stage(spark, nulls, folder).count() == (4, 0, 4, 4)[k]  # quality_rules drops short texts, the others keep what is no text


@pytest.mark.parametrize("k", range(3))
def test_stages_keep_columns_of_their_own_names(spark, folder, k):
    """Columns that are called as a stage's own keep their values."""
    docs = queries.documents(spark, folder).where("length(text) > 400 AND doc_id BETWEEN 80 AND 119")
    own = ["_toxic_score", "_toxic_predicted", "_quality_kept", "_quality_n_words", "component_id", "kept"]
    marked = docs.drop("kept").withColumns({c: F.lit("mine") for c in own})
    out = corpus_pipeline.STAGES[k][1](spark, marked, folder)
    assert out.columns == marked.columns
    rows = out.collect()
    assert rows and all(r[c] == "mine" for r in rows for c in own)


def test_fold(spark):
    assert zlib.crc32(b"5") % 5 == spark.range(1).select(F.crc32(F.lit("5")) % 5).first()[0]
