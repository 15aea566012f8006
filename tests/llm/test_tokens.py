import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonescope.llm import packing, token_orc
from tonescope.llm.common import ChunkEncoder, tokenizer_path

WORD, BYTE = "word_bpe_49k.json", "byte_bpe_50k.json"


def plain(name, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(name))
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize(("name", "spaced"), [(WORD, False), (BYTE, True)])
def test_chunks_give_the_library_s_ids(corpus, name, spaced):
    r = random.Random(4)
    alphabet = ["a", "B", "é", "Σ", "İ", "1", "½", ".", ",", "'", "'s", " ", " ", "  ", "\n", "\t", "\r\n", " ", " ", "\x1c", "́", "漢", "😀", "0", "-", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|ENDOFTEXT|>"]
    texts = [t for _, t, *_ in corpus] + ["a<|endoftext|>b", "<|endoftext|>", "x <|startoftext|><|endoftext|> y"] + ["".join(r.choices(alphabet, k=r.randint(0, 40))) for _ in range(3000)]
    encoder = ChunkEncoder(tokenizer_path(name), spaced, most=500)
    for at in range(0, len(texts), 700):
        flat, counts = encoder.encode(texts[at : at + 700])
        got = np.split(flat, np.cumsum(counts)[:-1])
        assert [g.tolist() for g in got] == plain(name, texts[at : at + 700])


def test_orc_round_trip(spark, docs, corpus, tmp_path):
    path = str(tmp_path / "t")
    token_orc.write_tokens(docs, path, tokenizer_path(WORD), 1, ranges=6)
    rows = {r["doc_id"]: r for r in token_orc.token_digest(token_orc.read_tokens(spark, path)).collect()}
    start = 0
    for (i, *_), ids in zip(corpus, plain(WORD, [t for _, t, *_ in corpus])):
        ids = [*ids, 1]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    parts = token_orc.read_tokens(spark, path).groupBy("part").agg({"doc_id": "min"}).orderBy("part").collect()
    assert [p[1] for p in parts] == sorted(p[1] for p in parts)
    assert {r["doc_id"] for r in token_orc.read_tokens(spark, path, [3, 77]).collect()} == {3, 77}
    from pyarrow import orc

    meta = orc.ORCFile(next((tmp_path / "t").glob("*.orc")))
    assert meta.row_index_stride == 1000 and meta.compression == "ZSTD"


def test_orc_edges(spark, nothing):
    assert token_orc.tokens_by_orc(nothing, tokenizer_path(WORD), 1).count() == 0
    odd = spark.createDataFrame([(None, None), (2, "b"), (2, "a"), (2, "a")], "doc_id long, text string")
    rows = token_orc.tokens_by_orc(odd, tokenizer_path(WORD), 1).orderBy("start").collect()
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in rows] == [(None, 0, 1), (2, 1, 2), (2, 3, 2), (2, 5, 2)]


def check_packing(rows, length):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append(r)
    for members in by.values():
        at = 0
        for r in sorted(members, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
    return len(by)


def test_packing(spark, docs, corpus):
    pieces = packing.token_pieces(docs, tokenizer_path(BYTE), 0, 256, with_ids=True).cache()
    rows = packing.pack(pieces, 256, group=60).collect()
    ids = {i: [*x, 0] for (i, *_), x in zip(corpus, plain(BYTE, [t for _, t, *_ in corpus]))}
    for i, want in ids.items():
        mine = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [x for r in mine for x in r["ids"]] == want and [r["piece"] for r in mine] == list(range(len(mine)))
        assert all(r["length"] == 256 for r in mine[1:]) and (len(mine) == 1 or mine[0]["length"] <= 256)
        assert all(r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and r["start"] == sum(x["length"] for x in mine[: r["piece"]]) for r in mine)
    n = check_packing(rows, 256)
    groups = -(-len(rows) // 60)
    assert n <= -(-sum(map(len, ids.values())) // 256) + 2 * groups + 1


def test_packing_edges(spark, nothing):
    empty = packing.token_pieces(nothing, tokenizer_path(BYTE), 0, 16)
    assert packing.pack(empty, 16).count() == 0
    same = packing.token_pieces(spark.createDataFrame([(1, "x")] * 40 + [(None, None)], "doc_id long, text string"), tokenizer_path(BYTE), 0, 16)
    rows = packing.pack(same, 16).collect()
    assert len(rows) == 41 and check_packing(rows, 16) == -(-81 // 16)


def test_packing_keeps_columns_of_other_names(spark):
    rows = [(i, 0, 5 + i % 7, "x", 9, -1, "g") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, _group string, sequence_id int, offset int, _group_ string")
    out = packing.pack(df, length=20)
    assert out.columns == ["doc_id", "piece", "length", "_group", "_group_", "sequence_id", "offset"]
    got = out.collect()
    assert {r["_group"] for r in got} == {"x"} and {r["_group_"] for r in got} == {"g"} and len(got) == 40
    fill = {}
    for r in got:
        fill[r["sequence_id"]] = fill.get(r["sequence_id"], 0) + r["length"]
    assert max(fill.values()) <= 20 and all(r["offset"] + r["length"] <= 20 for r in got)


def test_hot_id(spark):
    """A third of the rows have one id, and some of them one text: ranges and groups part them, and nothing is lost."""
    rows = [(7, f"w{i % 40}" if i % 2 else "same text") for i in range(200)] + [(None, "x")] * 200 + [(i, f"t{i} of many") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    pieces = packing.token_pieces(df, tokenizer_path(BYTE), 0, 32).cache()
    packed = packing.pack(pieces, 32, group=50)
    assert check_packing(packed.collect(), 32) and packed.count() == 600
    assert packed.where("doc_id = 7").select((F.col("sequence_id") / (1 << 24)).cast("int")).distinct().count() == 12
    parts = token_orc.write_tokens(df, path := token_orc.new_path(spark, "hot"), tokenizer_path(WORD), 1, ranges=6)
    assert parts is None
    read = token_orc.read_tokens(spark, path)
    assert read.where("doc_id = 7").select("part").distinct().count() > 1 and read.groupBy("part").count().agg({"count": "max"}).first()[0] < 200
    digest = sorted(token_orc.token_digest(read).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in digest]
    assert ids == sorted(ids) and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(digest, digest[1:]))


def test_searched_sequences_are_as_few_as_can_be(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.token_pieces(docs, tokenizer_path(BYTE), 0, 2048).collect()
    size = np.array([r["length"] for r in rows])
    bin_of, steps = packing.pack_items(size, 2048)
    assert steps > 50 and bin_of.max() + 1 == -(-size.sum() // 2048) and np.bincount(bin_of, weights=size).max() <= 2048


@pytest.mark.parametrize("seed", range(6))
def test_search_only_helps(seed):
    r = np.random.default_rng(seed)
    size = r.integers(1, 100, 300) if seed % 2 else r.choice([34, 35, 33, 51, 49], 200)
    largest_first = packing.best_fit(size, 100, np.argsort(-size, kind="stable"))
    # a poor start gives the search something to do
    poor = np.arange(len(size)) // 2 if (np.add.reduceat(size, np.arange(0, len(size), 2)) <= 100).all() else largest_first
    for b in (packing.best_fit(size, 100), largest_first, poor, np.arange(len(size))):
        out, _ = packing.search(size, b, 100)
        fill, before = np.bincount(out, weights=size), np.bincount(b, weights=size)
        assert fill.max() <= 100 and (fill > 0).all() and len(fill) <= (before > 0).sum() and (fill**2).sum() >= (before**2).sum()
    assert packing.search(size, np.arange(len(size)), 100)[0].max() + 1 <= 1.12 * (largest_first.max() + 1)
    assert packing.pack_items(size, 100)[0].max() <= largest_first.max()


def test_steps_raise_squared_fill():
    r = np.random.default_rng(2)
    size = r.integers(1, 60, 80)
    bin_of = packing.best_fit(size, 100)
    fill = np.bincount(bin_of, weights=size).astype(np.int64)
    kinds = set()
    for donor in np.argsort(fill, kind="stable").tolist():
        while 0 < fill[donor] < 100 and (step := packing._step(size, bin_of, fill, np.arange(80), donor, 100)):
            out, back, to = step
            before = (fill**2).sum()
            bin_of[out] = to
            if back is not None:
                bin_of[back] = donor
            fill = np.bincount(bin_of, weights=size, minlength=len(fill)).astype(np.int64)
            assert (fill**2).sum() > before and fill.max() <= 100
            kinds.add((len(out), back is not None))
    assert {(1, True), (2, True)} <= kinds


def test_exchanges_are_needed():
    # 60 + 40 | 50 + 50 | 30 + 30 + 40 need exchanges from this start
    size = np.array([60, 50, 50, 40, 30, 30, 40])
    out, steps = packing.search(size, np.array([0, 1, 2, 1, 0, 3, 2]), 100)
    assert len(np.unique(out)) == 3 and steps
