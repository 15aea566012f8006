"""Technique rules: scores, spans and features of a headline column, inside whole-stage code where Spark allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as X
from .text import band, col, matches, spans, words

SCORES = tuple(f"s_{d}" for d in X.DIMENSIONS)
FEATURES = tuple(sorted([f"lf_{d}" for d in X.DIMENSIONS] + ["n_chars", "n_words", "second_person", "starts_with_number", "question_mark", "exclamation", "allcaps_ratio"]))


def _led(first: str, pattern: str) -> str:
    """A pattern whose matches begin with one of so many characters: that is looked at before Unicode's word boundaries,
    which take far longer."""
    return f"(?=[{first}]){pattern}"


def _any_of(terms: tuple[str, ...]) -> str:
    return "(?iU)" + _led("".join(sorted({t[0] for t in terms})), X.alternation(terms))


def _pattern(dimension: str) -> str:
    return _any_of(X.LEXICONS[dimension])


CAPS = "(?U)" + _led("A-Z", X.CAPS)


def lexicon_score(headline: Column | str, dimension: str) -> Column:
    """0, 0.6 or 1 for no, one, or more hits."""
    n = F.size(matches(headline, _pattern(dimension)))
    return F.when(n == 0, F.lit(0.0)).when(n == 1, F.lit(0.6)).otherwise(F.lit(1.0))


def formatting_score(headline: Column | str) -> Column:
    h = col(headline)
    caps = F.size(F.filter(matches(h, CAPS), lambda w: ~w.isin(*X.ACRONYMS)))
    marks = F.aggregate(matches(h, X.MARKS), F.lit(0.0), lambda a, m: a + F.when(F.length(m) > 1, F.lit(1.0)).otherwise(F.lit(0.5)))
    flags = h.rlike("(?iU)" + X.LISTICLE).cast("double") + h.rlike("(?iU)" + _led("#n", X.NUMBER_TEASE)).cast("double")
    return F.least(F.lit(1.0), (caps + marks + flags) * 0.5)


def second_person(headline: Column | str) -> Column:
    return col(headline).rlike("(?iU)" + _led("y", X.SECOND_PERSON))


def with_scores(df: DataFrame, headline: str = "headline") -> DataFrame:
    """df with a column of SCORES for each dimension; a null headline scores null."""
    h = F.col(headline)
    curiosity = lexicon_score(h, "curiosity_gap")
    boosted = F.when((curiosity < 0.6) & h.rlike("(?iU)" + _led("t", X.FORWARD_REFERENCE)) & second_person(h), F.greatest(curiosity, F.lit(0.4))).otherwise(curiosity)
    scores = {"s_curiosity_gap": boosted} | {f"s_{d}": lexicon_score(h, d) for d in X.DIMENSIONS[1:5]} | {"s_sensational_formatting": formatting_score(h)}
    return df.withColumns({k: F.when(h.isNotNull(), v) for k, v in scores.items()})


def total() -> Column:
    """Sum of SCORES in the dimensions' order."""
    out = F.col(SCORES[0])
    for s in SCORES[1:]:
        out = out + F.col(s)
    return out


def rules_score() -> Column:
    """The score that serves without a model: twice the mean, at most 1."""
    return F.least(F.lit(1.0), total() / 6 * 2)


def rules_baseline() -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total() / 6))


def detected() -> Column:
    """Dimensions that score 0.6 or more, highest first, in the dimensions' order among equals."""
    every = F.array(*[F.struct((-F.col(s)).alias("minus"), F.lit(i).alias("i"), F.lit(d).alias("name")) for i, (s, d) in enumerate(zip(SCORES, X.DIMENSIONS))])
    return F.transform(F.array_sort(F.filter(every, lambda e: e["minus"] <= -0.6)), lambda e: e["name"])


def with_score_record(df: DataFrame, headline: str = "headline", probability: str | None = None) -> DataFrame:
    """df with manipulation_score, intensity, detected_techniques, model: what scoring answers for each headline.

    probability: a column with a trained model's answer; without one the rules' score serves.
    """
    score = rules_score() if probability is None else F.col(probability)
    scored = with_scores(df, headline).withColumn("manipulation_score", F.round(score, 3))
    name = "rules-fallback" if probability is None else "boosted-calibrated"
    return scored.withColumns({"intensity": band(score), "detected_techniques": detected(), "model": F.lit(name)})


def with_features(df: DataFrame, headline: str = "headline") -> DataFrame:
    """df with the FEATURES as doubles."""
    h = F.col(headline)
    w = words(h)
    shouted = F.filter(w, lambda x: (x == F.upper(x)) & (x != F.lower(x)) & (F.length(x) >= 3) & ~x.isin(*X.ACRONYMS))
    scored = with_scores(df, headline)
    values = {f"lf_{d}": F.col(s) for d, s in zip(X.DIMENSIONS, SCORES)} | {
        "n_chars": F.length(h).cast("double"),
        "n_words": F.size(w).cast("double"),
        "second_person": second_person(h).cast("double"),
        "starts_with_number": h.rlike(r"(?U)^\s*\d").cast("double"),
        "question_mark": h.contains("?").cast("double"),
        "exclamation": h.contains("!").cast("double"),
        "allcaps_ratio": F.size(shouted) / F.greatest(F.lit(1), F.size(w)),
    }
    return scored.withColumns(values).drop(*SCORES)


def span_rows(df: DataFrame, headline: str = "headline", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., dimension, start, end, text): a row for each span; text is the headline from start to end."""
    h = F.col(headline)
    first = lambda p: F.slice(spans(h, p), 1, 1)
    caps = F.filter(spans(h, CAPS), lambda s: ~s["text"].isin(*X.ACRONYMS))
    form = F.concat(caps, spans(h, X.MARKS), first("(?iU)" + X.LISTICLE), first("(?iU)" + X.NUMBER_TEASE))
    found = F.array(*[F.struct(F.lit(d).alias("dimension"), spans(h, _pattern(d)).alias("spans")) for d in X.DIMENSIONS[:5]], F.struct(F.lit(X.DIMENSIONS[5]).alias("dimension"), form.alias("spans")))
    rows = df.select(*keep, F.explode(found).alias("f")).select(*keep, "f.dimension", F.explode("f.spans").alias("s"))
    return rows.select(*keep, "dimension", "s.start", "s.end", "s.text")


def mark_spans(found: Column) -> Column:
    """Of array<struct<start, end, ...>> those to highlight: by start, longest first, each that begins before the last one's end left out."""
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("minus_end"))))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int>>").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        taken = F.struct((-s["minus_end"]).alias("pos"), F.concat(acc["kept"], F.array(F.struct(s["start"].alias("start"), (-s["minus_end"]).alias("end")))).alias("kept"))
        return F.when(s["start"] >= acc["pos"], taken).otherwise(acc)

    return F.aggregate(ordered, start, step, lambda acc: acc["kept"])


def mask_entities(c: Column | str) -> Column:
    return F.regexp_replace(col(c), _any_of(X.ENTITIES), X.MASK)


def ordinal(score: Column) -> Column:
    """A rule's score on the 0 to 2 scale."""
    return F.when(score < 0.3, 0).when(score < 0.8, 1).otherwise(2)
