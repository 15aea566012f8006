import random
import zlib

import pytest
from pyspark.sql import functions as F

from tonescope.llm import queries, sharding


def check(rows, n, sizes):
    """Slots are gapless, keys ascend over shards and slots, and no shard is further from its share than one row."""
    total, seen = sum(sizes.values()), []
    for s in range(n):
        mine = sorted((r["slot"], r["doc_id"]) for r in rows if r["shard"] == s)
        assert [k for k, _ in mine] == list(range(len(mine)))
        seen += [i for _, i in mine]
    assert seen == sorted(seen, key=lambda i: (i is not None, i)) and len(seen) == len(rows)
    before = 0
    for i in sorted(sizes):
        assert {r["shard"] for r in rows if r["doc_id"] == i} == {before * n // total}
        before += sizes[i]


@pytest.mark.parametrize("n", [1, 3, 8])
def test_matches_running_sums(docs, corpus, n):
    rows = sharding.histogram_shards(docs, n).collect()
    check(rows, n, {i: len((t or "").encode()) + 1 for i, t, *_ in corpus})
    assert set(docs.columns) <= set(rows[0].asDict())


def test_skewed_keys(spark):
    r = random.Random(1)
    keys = sorted({r.choice([r.randint(0, 50), r.randint(0, 10**6), r.randint(-(2**62), 2**62)]) for _ in range(500)})
    df = spark.createDataFrame([(k, r.randint(1, 9) if i % 50 else 5000) for i, k in enumerate(keys)], "doc_id long, size long")
    sizes = {x["doc_id"]: x["size"] for x in df.collect()}
    check(sharding.histogram_shards(df, 8, size=F.col("size"), per_shard=4).collect(), 8, sizes)
    rows = sharding.histogram_shards(df, 8, law="rows").groupBy("shard").count().collect()
    assert max(x["count"] for x in rows) - min(x["count"] for x in rows) <= 1


def test_tolerance_saves_rounds(spark):
    df = spark.range(1, 20_001).select(F.col("id").alias("key"), F.lit(10).cast("long").alias("size")).cache()
    exact, loose = sharding.find_splitters(df, 4, 2, 0.0, 0.25, 64), sharding.find_splitters(df, 4, 2, 0.05, 0.25, 64)
    assert loose.rounds < exact.rounds and all(abs(b - 200_000 * k / 4) <= 0.05 * 50_000 for k, b in enumerate(loose.bytes[loose.shard], 1))


def test_edges(spark, nothing):
    assert sharding.histogram_shards(nothing, 8).count() == 0
    same = spark.createDataFrame([(5, "ab", 1)] * 9 + [(None, None, 2)], "doc_id long, text string, shard int")
    rows = sharding.histogram_shards(same, 3).collect()
    total = sum(3 if r["text"] else 1 for r in rows)
    by = {s: sum(3 if r["text"] else 1 for r in rows if r["shard"] == s) for s in range(3)}
    assert len(rows) == 10 and all(abs(b - total / 3) < 3 for b in by.values())
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in range(3))


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_hot_key(spark, law):
    """One id holds a third of the rows, some of them equal, and null another part; clashing names stay."""
    r = random.Random(3)
    rows = [(9, "same" if i % 3 else "x" * r.randint(0, 30)) for i in range(400)] + [(None, None)] * 300 + [(i, "y" * r.randint(0, 30)) for i in range(20, 520)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_key", F.lit("k")).withColumn("_slot", F.lit("s")).withColumn("slot", F.lit("z")).repartition(5)
    out = sharding.histogram_shards(df, 8, law=law, per_shard=4).cache()
    assert set(out.columns) == {"doc_id", "text", "_key", "_slot", "shard", "slot"} and out.where("_key <> 'k' OR _slot <> 's'").count() == 0
    found = out.collect()
    assert sorted((str(x["doc_id"]), str(x["text"])) for x in found) == sorted((str(i), str(t)) for i, t in rows)
    size = (lambda x: 1) if law == "rows" else lambda x: len(x["text"] or "") + 1
    by = {s: [x for x in found if x["shard"] == s] for s in range(8)}
    share = sum(map(size, found)) / 8
    assert all(abs(sum(map(size, v)) - share) <= (1 if law == "rows" else 31) for v in by.values())
    order = []
    for s in range(8):
        mine = sorted(by[s], key=lambda x: x["slot"])
        assert [x["slot"] for x in mine] == list(range(len(mine)))
        order += [-1 if x["doc_id"] is None else x["doc_id"] for x in mine]
    assert order == sorted(order)


def test_query_columns(spark, docs, corpus, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op1_histogram_shards(spark, str(tmp_path)).collect()}
    for i, t, *_ in corpus:
        raw = (t or "").encode()
        assert (rows[i]["size"], rows[i]["text_crc32"], rows[i]["law"], rows[i]["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)


def test_shards_are_written(spark, docs, tmp_path):
    sharding.write_shards(sharding.histogram_shards(docs, 4), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()
