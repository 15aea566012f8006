"""Column builders for text. Lengths and offsets count code points; white space is Unicode's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


def collapse(c: Column | str) -> Column:
    """Ends trimmed, white space inside as one space."""
    return F.regexp_replace(strip(c), r"(?U)\s+", " ")


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), r"(?U)\s+"), lambda w: w != "")


def normalize(c: Column | str) -> Column:
    """Lower case; everything but a-z, 0-9 and spaces is deleted, so words may fuse."""
    return F.trim(F.regexp_replace(F.lower(col(c)), "[^a-z0-9 ]+", ""))


def shingles(c: Column | str, k: int) -> Column:
    """Distinct runs of k characters; a text of at most k characters is its one shingle."""
    t = col(c)
    n = F.length(t)
    runs = F.regexp_extract_all(t, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))  # one pass; substring() would count from the start each time
    return F.when(n <= k, F.array(t)).otherwise(F.array_distinct(runs))


def sentences(c: Column | str) -> Column:
    """Parts between white space that follows a full stop, exclamation or question mark."""
    return F.filter(F.transform(F.split(col(c), r"(?U)(?<=[.!?])\s+"), strip), lambda s: s != "")


def let(value: Column, body) -> Column:
    """body of value, which is evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows(c: Column | str, size: int, most: int) -> Column:
    """Sentences in groups of size, joined by a space; the first ``most`` groups. The text behind them is not split."""
    parts = F.split(col(c), r"(?U)(?<=[.!?])\s+", size * most + 1)
    first = F.filter(F.transform(F.slice(parts, 1, size * most), strip), lambda s: s != "")

    def groups(s: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(s) - 1, F.lit(0)), F.lit(size))
        return F.when(F.size(s) > 0, F.transform(starts, lambda i: F.array_join(F.slice(s, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))

    return let(first, groups)


def matches(c: Column | str, pattern: str) -> Column:
    return F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0))


def spans(c: Column | str, pattern: str) -> Column:
    """array<struct<start, end, text>> of a pattern's matches: each starts after all parts and matches before it."""
    found = F.struct(matches(c, pattern).alias("m"), F.split(col(c), pattern, -1).alias("s"))

    def total(parts: Column) -> Column:
        return F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p))

    def place(f: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            start = total(F.slice(f["s"], 1, i + 1)) + total(F.slice(f["m"], 1, i))
            return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), x.alias("text"))

        return F.transform(f["m"], one)

    return let(found, place)


def cache_key(model: str, version: str, headline: Column | str) -> Column:
    return F.concat_ws("|", F.lit(model), F.lit(f"cb{version}"), col(headline))


def band(score: Column | str) -> Column:
    s = col(score)
    return F.when(s < 0.35, "low").when(s < 0.65, "moderate").otherwise("high")


def badge_colour(score: Column | str) -> Column:
    s = col(score)
    return F.when(s >= 0.65, "red").when(s >= 0.35, "amber").otherwise("green")
