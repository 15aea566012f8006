import pytest
from pyspark.sql import functions as F

from tonescope.functions import lexicon, rules, text, tokenizer
from tonescope.functions.lexicon import DIMENSIONS


def score(spark, *headlines):
    rows = rules.with_score_record(spark.createDataFrame([(i, h) for i, h in enumerate(headlines)], "i int, headline string")).orderBy("i").collect()
    return [r.asDict() for r in rows]


def test_neutral_headline_scores_nothing(spark):
    (r,) = score(spark, "Harbour board publishes its yearly figures")
    assert all(r[s] == 0 for s in rules.SCORES) and r["manipulation_score"] == 0 and r["intensity"] == "low" and r["detected_techniques"] == []


@pytest.mark.parametrize(
    ("headline", "dimension", "value"),
    [
        ("Guess what the baker sold", "curiosity_gap", 0.6),
        ("Guess what: here's why bread rises", "curiosity_gap", 1.0),
        ("These shoes are what your feet need", "curiosity_gap", 0.4),
        ("Coach slams referee", "outrage", 0.6),
        ("Coach SLAMS referee after meltdown", "outrage", 1.0),
        ("Deadly outbreak on the farm", "fear", 1.0),
        ("Old letter proves the date", "false_certainty", 0.6),
        ("An absolutely amazing pie", "emotional_framing", 1.0),
        ("LOUD words here", "sensational_formatting", 0.5),
        ("NASA and FBI meet", "sensational_formatting", 0.0),
        ("Really?", "sensational_formatting", 0.0),
        ("Really!", "sensational_formatting", 0.25),
        ("Really?!", "sensational_formatting", 0.5),
        ("7 ways to fold paper!!", "sensational_formatting", 1.0),
        ("Look at #9", "sensational_formatting", 0.5),
        ("Élan SLAMSÉ nothing", "outrage", 0.0),
    ],
)
def test_dimension(spark, headline, dimension, value):
    assert score(spark, headline)[0][f"s_{dimension}"] == pytest.approx(value)


def test_null_and_empty(spark):
    null, empty = score(spark, None, "")
    assert null["s_fear"] is None and empty["s_fear"] == 0.0


def test_bands_and_order_of_detected(spark):
    (r,) = score(spark, "Guess what: deadly storm, a disaster, slams coast")
    assert r["detected_techniques"] == ["fear", "curiosity_gap", "outrage"]
    bands = spark.createDataFrame([(0.34,), (0.35,), (0.65,), (1.0,)], "p double").select(text.band("p")).collect()
    assert [b[0] for b in bands] == ["low", "moderate", "high", "high"]


def test_spans_slice_back(spark):
    headline = "😀 12 things: YOU WON'T believe this deadly, DEADLY storm?! number 4"
    df = spark.createDataFrame([(1, headline)], "doc_id int, headline string")
    rows = rules.span_rows(df).collect()
    assert rows and all(headline[r["start"] : r["end"]] == r["text"] for r in rows)
    assert [r["text"] for r in rows if r["dimension"] == "fear"] == ["deadly", "DEADLY"]
    assert {"YOU", "WON", "DEADLY", "?!", "number 4"} <= {r["text"] for r in rows if r["dimension"] == "sensational_formatting"}


def test_overlapping_spans_are_marked_once(spark):
    found = F.expr("array(struct(5 as start, 9 as end), struct(0 as start, 4 as end), struct(0 as start, 7 as end), struct(9 as start, 10 as end))")
    (marks,) = spark.range(1).select(rules.mark_spans(found)).first()
    assert [(m["start"], m["end"]) for m in marks] == [(0, 7), (9, 10)]


def test_features(spark):
    df = spark.createDataFrame([("3 BIG tips for your garden? Yes!",)], "headline string")
    r = rules.with_features(df).first().asDict()
    assert {k: r[k] for k in ("n_chars", "n_words", "second_person", "starts_with_number", "question_mark", "exclamation")} == {"n_chars": 32.0, "n_words": 7.0, "second_person": 1.0, "starts_with_number": 1.0, "question_mark": 1.0, "exclamation": 1.0}
    assert r["allcaps_ratio"] == pytest.approx(1 / 7) and len(rules.FEATURES) == 13 and set(rules.FEATURES) <= set(r)


def test_masking(spark):
    texts = ["Donald Trump and the LEFT meet", "Trumpet solo by a liberal player", "entitytoken stays", "biden's plan"]
    out = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(rules.mask_entities("t")).collect()]
    assert out == ["entitytoken and entitytoken meet", "Trumpet solo by a entitytoken player", "entitytoken stays", "entitytoken's plan"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("  Café-Bar \t no. 5! ",)], "t string")
    assert df.select(text.strip("t"), text.collapse("t"), text.normalize("t")).first()[:] == ("Café-Bar \t no. 5!", "Café-Bar no. 5!", "cafbar  no 5")
    rows = spark.createDataFrame([("ab",), ("",), ("abcabc",)], "t string").select(text.shingles("t", 3)).collect()
    assert [sorted(r[0]) for r in rows] == [["ab"], [""], ["abc", "bca", "cab"]]


def test_windows(spark):
    body = " ".join(f"Sentence {i}." for i in range(9))
    df = spark.createDataFrame([(body,), (" ".join("Go!" for _ in range(100)),), ("",), ("   ",)], "body string")
    nine, many, empty, blank = [r[0] for r in df.select(text.windows("body", 4, 6)).collect()]
    assert len(nine) == 3 and nine[2] == "Sentence 8." and len(many) == 6 and empty == [] and blank == []


def test_tokenizer(spark):
    df = spark.createDataFrame([("Café—costs $1.2T, née #9",)], "t string").select(tokenizer.basic_tokens(F.col("t")).alias("tokens"))
    assert df.first()["tokens"] == ["cafe", "—", "costs", "$", "1", ".", "2t", ",", "nee", "#", "9"]
    known = {p: i for i, p in enumerate(["[PAD]", "[UNK]", "un", "##do", "##ing"])}
    assert tokenizer.pieces_of("undoing", known) == ["un", "##do", "##ing"] and tokenizer.pieces_of("undone", known) == ["[UNK]"] and tokenizer.pieces_of("u" * 101, known) == ["[UNK]"]
    ids, mask = tokenizer.encode(F.expr("array(7, 8, 9, 10, 11)"), 5, 1, 2, 0)
    assert spark.range(1).select(ids, mask).first()[:] == ([1, 7, 8, 9, 2], [1, 1, 1, 1, 1])


def test_lexicon_file(spark, tmp_path):
    (tmp_path / "l.txt").write_text("# note\n  Big Deal \n\nslams\n")
    assert lexicon.read_terms(spark, str(tmp_path / "l.txt")) == ("big deal", "slams") and lexicon.lexicon_table(spark).count() == sum(len(lexicon.LEXICONS[d]) for d in DIMENSIONS[:5])


def test_patterns_that_look_at_first_characters_find_the_same(spark):
    """Unicode's cases and boundaries too: a long s, a Kelvin sign, dotted and dotless i, joiners, letters before a term."""
    texts = ["\u017flams rival", "\u212aILLER killer", "\u0130nsane \u0131nsane INSANE", "xslams _slams slams", "\u00c0BC ABC\u00c0 ABC", "the left-wing, GOP", "e\u0301pic epic", "deadly\u200dstorm DEADLY", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for terms in (*lexicon.LEXICONS.values(), lexicon.ENTITIES):
        plain, led = "(?iU)" + lexicon.alternation(terms), rules._any_of(terms)
        assert plain != led and df.where(~text.matches("t", plain).eqNullSafe(text.matches("t", led))).count() == 0
    assert df.where(~text.matches("t", "(?U)" + lexicon.CAPS).eqNullSafe(text.matches("t", rules.CAPS))).count() == 0
