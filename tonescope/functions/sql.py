"""The text functions under names of SQL: ``register(spark)`` makes them known to a session's spark.sql().

They are SQL functions, so Catalyst sees their bodies, and no row leaves the JVM. Functions of several rows give arrays;
``(SELECT ..., technique_spans(headline) AS s ...) LATERAL VIEW inline(s) t`` makes rows of them in place. ``technique_span_rows`` and
``body_window_rows`` are the same as table functions; Spark joins their rows back by the text.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import PARAMS
from . import lexicon as X

SPAN = "STRUCT<dimension: STRING, start: INT, `end`: INT, text: STRING>"
WINDOW = "STRUCT<idx: INT, window: STRING>"


def raw(pattern: str) -> str:
    """A literal in which backslashes stand for themselves."""
    if '"' in pattern:
        raise ValueError("a pattern with a double quote")
    return f'r"{pattern}"'


def _bodies() -> list[tuple[str, str, str]]:
    """(name with parameters, type, body)."""
    lexical = ", ".join(f"transform(text_spans(h, {raw('(?iU)' + X.alternation(X.LEXICONS[d]))}), s -> named_struct('dimension', '{d}', 'start', s.start, 'end', s.end, 'text', s.text))" for d in X.DIMENSIONS[:5])
    stop = ", ".join(f"'{a}'" for a in X.ACRONYMS)
    form = f"""concat(filter(text_spans(h, {raw('(?U)' + X.CAPS)}), s -> s.text NOT IN ({stop})), text_spans(h, {raw(X.MARKS)}),
        slice(text_spans(h, {raw('(?iU)' + X.LISTICLE)}), 1, 1), slice(text_spans(h, {raw('(?iU)' + X.NUMBER_TEASE)}), 1, 1))"""
    length = "(a, x) -> a + length(x)"
    ends = raw("(?U)^" + chr(92) + "s+|" + chr(92) + "s+$")
    strip = f"regexp_replace(s, {ends}, '')"  # a function of SQL takes no lambda's variable
    sentences = f"filter(transform(slice(split(body, {raw('(?U)(?<=[.!?])' + chr(92) + 's+')}, size * most + 1), 1, size * most), s -> {strip}), s -> s <> '')"
    return [
        ("strip_space(t STRING)", "STRING", f"regexp_replace(t, {ends}, '')"),
        ("normalize_headline(t STRING)", "STRING", "trim(regexp_replace(lower(t), '[^a-z0-9 ]+', ''))"),
        ("mask_entities(t STRING)", "STRING", f"regexp_replace(t, {raw('(?iU)' + X.alternation(X.ENTITIES))}, '{X.MASK}')"),
        ("intensity_band(score DOUBLE)", "STRING", "CASE WHEN score < 0.35 THEN 'low' WHEN score < 0.65 THEN 'moderate' ELSE 'high' END"),
        (
            "text_spans(t STRING, pattern STRING)",
            "ARRAY<STRUCT<start: INT, `end`: INT, text: STRING>>",
            f"""transform(array(named_struct('m', regexp_extract_all(t, pattern, 0), 's', split(t, pattern, -1))), f -> transform(
                transform(f.m, (x, i) -> named_struct('start', aggregate(slice(f.s, 1, i + 1), 0, {length}) + aggregate(slice(f.m, 1, i), 0, {length}), 'text', x)),
                x -> named_struct('start', x.start, 'end', x.start + length(x.text), 'text', x.text)))[0]""",
        ),
        ("technique_spans(h STRING)", f"ARRAY<{SPAN}>", f"concat({lexical}, transform({form}, s -> named_struct('dimension', '{X.DIMENSIONS[5]}', 'start', s.start, 'end', s.end, 'text', s.text)))"),
        (
            f"body_windows(body STRING, size INT DEFAULT {PARAMS.body_window_sents}, most INT DEFAULT {PARAMS.max_windows})",
            f"ARRAY<{WINDOW}>",
            f"""transform(array({sentences}), s -> CASE WHEN size(s) > 0 THEN transform(sequence(0, size(s) - 1, size), (i, k) -> named_struct('idx', k, 'window', array_join(slice(s, i + 1, size), ' ')))
                ELSE CAST(array() AS ARRAY<{WINDOW}>) END)[0]""",
        ),
    ]


TABLES = (
    ("technique_span_rows(h STRING)", "dimension STRING, start INT, `end` INT, text STRING", "SELECT inline(s) FROM (SELECT technique_spans(h) AS s)"),
    ("body_window_rows(body STRING)", "idx INT, window STRING", "SELECT inline(w) FROM (SELECT body_windows(body) AS w)"),
)


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session; their names."""
    for head, kind, body in _bodies():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    for head, columns, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS TABLE ({columns}) RETURN {body}")
    return [head.split("(")[0] for head, *_ in (*_bodies(), *TABLES)]
