import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n, letters="abcdefghij"):
    return ["".join(r.choices(letters, k=r.randint(2, 7))) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Texts with nulls, empty and blank ones, one very long, copies, near copies, odd white space, and other scripts."""
    r = random.Random(7)
    texts = [" ".join(words(r, r.randint(1, 300))) for _ in range(120)]
    for k in range(30):
        w = texts[k].split(" ")
        w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    texts += [texts[0]] * 25 + [texts[3].upper(), texts[4].replace(" ", "\n"), None, "", "   \n ", "one", "two words", "ONE", " ".join(words(r, 30_000)), "漢字テスト " * 40, "a b \t c  d\r\n\r\n", "it's ΣΑΣ <|endoftext|> 12,345 ½ 😀", "▁ ▁▁x"]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
