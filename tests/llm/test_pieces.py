import math
import random
from collections import Counter

import numpy as np

from tonescope.llm import piece_sampling as S
from tonescope.llm.common import tokenizer_path

MODEL = tokenizer_path("piece_bpe_32k.model")


def split(ids, n):
    return [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]


def test_lossless(corpus):
    r = random.Random(2)
    alphabet = ["a", "the", "é", "▁", " ", "  ", "\n", "\t", "漢", "😀", "\x00", " ", "1", "<0x41>", "<s>", ".", "ſ"]
    texts = [t for _, t, *_ in corpus] + ["".join(r.choices(alphabet, k=r.randint(0, 30))) for _ in range(2000)] + ["a" * 3000, "x" * 97, "x" * 96]
    sampler = S.PieceSampler(MODEL)
    ids, n = sampler.sample(texts, np.arange(len(texts)), 5)
    for t, x in zip(texts, split(ids, n)):
        assert sampler.decode(np.array(x, np.int64)).decode() == (t or "")


def test_library_decodes_the_same():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sampler = S.PieceSampler(MODEL)
    texts = [" hello there, wörld", " some more words 漢字 here"]
    ids, n = sampler.sample(texts, np.arange(2), 0)
    assert [model.decode(x) for x in split(ids, n)] == [t[1:] for t in texts]


def test_draws_follow_the_weights():
    sampler = S.PieceSampler(MODEL, alpha=0.4)
    word, k = "things", 30_000

    def all_paths(t):
        if not t:
            yield (), 0.0
        for m in range(1, len(t) + 1):
            if t[:m] in sampler.pieces:
                i = sampler.pieces[t[:m]]
                for rest, w in all_paths(t[m:]):
                    yield (i, *rest), w + sampler.log_weight[i]

    paths = dict(all_paths(word))
    whole = sum(map(math.exp, paths.values()))
    ids, n = sampler.sample([word] * k, np.arange(k), 1)
    seen = Counter(map(tuple, split(ids, n)))
    assert set(seen) <= set(paths) and all(abs(seen[p] / k - math.exp(w) / whole) < 0.01 for p, w in paths.items())


def test_long_units_follow_them_too(monkeypatch):
    short = S.PieceSampler(MODEL)
    monkeypatch.setattr(S.PieceSampler, "SHORT", 0)
    long = S.PieceSampler(MODEL)
    texts = ["reproducible segmentation"] * 50
    a, b = (s.sample(texts, np.arange(50), 3) for s in (short, long))
    assert a[0].tolist() == b[0].tolist()


def test_reproducible_by_key_alone(spark, docs, corpus, nothing):
    one = {r["doc_id"]: r["ids"] for r in S.sample_pieces(docs, MODEL, seed=4).collect()}
    two = {r["doc_id"]: r["ids"] for r in S.sample_pieces(docs.repartition(11).orderBy("text"), MODEL, seed=4).collect()}
    other = {r["doc_id"]: r["ids"] for r in S.sample_pieces(docs, MODEL, seed=5).collect()}
    assert one == two and one != other and one[0] != one[150]  # equal texts, different keys
    texts = {r["doc_id"]: r["text"] for r in S.decode_pieces(S.sample_pieces(docs, MODEL, seed=4), MODEL).collect()}
    assert texts == {i: t or "" for i, t, *_ in corpus}
    rows = S.sample_pieces(docs, MODEL, seed=4, digest=True).collect()
    assert all(r["lossless"] and r["n_pieces"] == len(one[r["doc_id"]]) for r in rows)
    assert S.sample_pieces(nothing, MODEL).count() == 0
    odd = S.sample_pieces(spark.createDataFrame([(None, None), (None, "a")], "doc_id long, text string"), MODEL, digest=True).collect()
    assert sorted(r["n_chars"] for r in odd) == [0, 1]
