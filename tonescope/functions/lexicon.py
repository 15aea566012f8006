"""Terms of the technique lexicons and the political entities, and the patterns that they make."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DIMENSIONS = ("curiosity_gap", "outrage", "fear", "false_certainty", "emotional_framing", "sensational_formatting")

# The terms decide which texts are flagged.
LEXICONS: dict[str, tuple[str, ...]] = {
    "curiosity_gap": (
        "you won't believe", "you wont believe", "you need to see", "you need to know", "what happened next", "what happens next",
        "the reason will", "will shock you", "will surprise you", "will blow your mind", "this one trick", "one weird trick",
        "doctors don't want you to know", "this simple trick", "here's what", "heres what", "here's why", "heres why",
        "the surprising reason", "the shocking reason", "find out", "wait until you see", "guess what", "you'll never guess",
        "can't stop watching",
    ),
    "outrage": (
        "slams", "slammed", "destroys", "destroyed", "blasts", "blasted", "eviscerates", "eviscerated", "humiliates", "humiliated",
        "shreds", "shredded", "torches", "torched", "rips", "ripped", "lashes out", "takedown", "epic fail", "disgrace", "disgraceful",
        "outrage", "outrageous", "furious", "fury", "enraged", "backlash", "meltdown", "unhinged", "pathetic", "whiny",
    ),
    "fear": (
        "terrifying", "terrified", "horrifying", "horrific", "deadly", "lethal", "killer", "silent killer", "crisis", "catastrophe",
        "catastrophic", "disaster", "disastrous", "nightmare", "dangerous", "danger", "warning", "alarm", "alarming", "threat",
        "threatens", "at risk", "epidemic", "outbreak", "toxic", "poisonous", "could kill", "destroying your", "ruining your",
    ),
    "false_certainty": (
        "proves", "proven", "proof", "confirms", "confirmed", "the truth about", "the real reason", "what they aren't telling you",
        "what they don't want you to know", "scientists prove", "definitive", "undeniable", "guaranteed", "always works", "never fails",
        "the only way", "everything you know is wrong", "debunked once and for all", "settled",
    ),
    "emotional_framing": (
        "heartbreaking", "heartwarming", "devastating", "devastated", "stunning", "incredible", "unbelievable", "amazing", "jaw-dropping",
        "breathtaking", "tearful", "tear-jerking", "beloved", "adorable", "gut-wrenching", "inspiring", "magical", "miraculous", "epic",
        "insane", "mind-blowing", "wild", "crazy", "absolutely", "literally",
    ),
}

ENTITIES: tuple[str, ...] = (
    "joe biden", "donald trump", "kamala harris", "barack obama", "hillary clinton", "bernie sanders", "biden", "trump", "obama", "harris",
    "clinton", "sanders", "pelosi", "mcconnell", "schumer", "desantis", "newsom", "democrats", "democrat", "democratic party", "republicans",
    "republican", "gop", "the left", "the right", "left-wing", "right-wing", "leftist", "leftists", "liberals", "liberal", "conservatives",
    "conservative", "progressives", "progressive", "maga", "socialists", "socialist", "libertarians", "libertarian", "labour", "tories", "tory",
)

MASK = "entitytoken"

#: Words in capitals that are no shouting.
ACRONYMS = ("CEO", "USA", "NASA", "FBI", "CIA", "GOP", "NFL", "NBA", "MLB", "CDC", "WHO", "EU", "UK", "US", "TV", "AI", "GDP", "IPO", "DNA", "PSA")

CAPS = r"\b[A-Z]{3,}\b"
MARKS = r"[!?]{2,}|!"
LISTICLE = r"^\s*\d{1,3}\s+\w|\b\d{1,3}\s+(?:things|ways|reasons|facts|tricks|signs|photos|times)\b"
NUMBER_TEASE = r"#\d+\b|\bnumber\s+\d+\b"
SECOND_PERSON = r"\b(?:you|your|you're|youre)\b"
FORWARD_REFERENCE = r"\b(?:this|these)\s+(?:one\s+)?\w+"


def alternation(terms: tuple[str, ...]) -> str:
    """Whole-word pattern of terms; where several begin at one place, the longest wins."""
    return r"\b(?:" + "|".join(re.escape(t).replace("\\ ", " ").replace("\\-", "-") for t in sorted(terms, key=len, reverse=True)) + r")\b"


def read_terms(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Terms of a lexicon file: one a line, lower case; blank lines and those that begin with # are left out."""
    rows = spark.read.text(path).selectExpr("lower(regexp_replace(value, '(?U)^\\\\s+|\\\\s+$', '')) AS term", "value").where("term <> '' AND NOT startswith(value, '#')")
    return tuple(r["term"] for r in rows.collect())  # a lexicon has some dozen lines


def lexicon_table(spark: SparkSession) -> DataFrame:
    """(dimension, term), the lexicons as a table."""
    return spark.createDataFrame([(d, t) for d, ts in LEXICONS.items() for t in ts], "dimension string, term string")
