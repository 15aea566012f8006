"""Source divergence audit: how far the sources of a language are apart in the terms they use.

Terms with the same sparse vector of source counts are one count column: each distinct vector meets every pair of its
sources once, times the number of its terms. For a source that a term is absent from, all such terms have one value; so
what pairs with an absent side add follows from each source's distinct counts, each once, too. Terms are ranked by
themselves.

For a language with V kept terms and a group (a source of it, or the whole of it) with N occurrences of kept terms, a
term that occurs c times there has p = 1 + floor(SCALE (c + 2) / (N + 2 V)); two groups differ by
f(p, q) = floor((p - q)^2 / (p + q)) in it. All arithmetic is of whole numbers and exact.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, attach, trimmed, tune

SCALE = 1_000_000_000
#: Letters A-Z become small, other letters and all signs beyond ASCII stay, the rest parts terms. Bytes of UTF-8.
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Entries of a task's tables of counts and of pair sums, at which it passes them on; bytes of text at a time.
MOST_COUNTS, MOST_PAIRS, CHUNK = 400_000, 1 << 20, 4 << 20
#: Bytes of the groups' table up to which it is broadcast; beyond it is joined by (group, salt).
MOST_BYTES = 8 << 20

COUNTS = "lang string, source string, term string, n long, docs long"
PAIRS = "lang string, i int, j int, value long"


def _chunks(raw: bytes):
    """The terms of a text, in lists of bounded size."""
    begin = 0
    while begin < len(raw):
        end = min(begin + CHUNK, len(raw))
        while end < len(raw) and _TERM_BYTES[raw[end]] != 32:  # not within a term
            end += 1
        yield raw[begin:end].translate(_TERM_BYTES).split()
        begin = end


def _count(batches):
    """A task's occurrences and documents of (lang, source, term), passed on whenever its table is full."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def passed_on():
        for (lang, source), (n, docs) in counts.items():
            if n:
                at = pa.array(np.zeros(len(n), np.int32))
                columns = [pa.array([lang]).take(at), pa.array([source]).take(at), pa.array(list(n), pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
        counts.clear()

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            seen: set[bytes] = set()
            for terms in _chunks(texts[i].as_py()):
                n, docs = counts[key]
                before = len(n)
                n.update(terms)
                fresh = set(terms) - seen
                docs.update(fresh)
                seen |= fresh
                size += len(n) - before
                if size >= MOST_COUNTS:
                    yield from passed_on()
                    size = 0
    yield from passed_on()


def named(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each source of each language, and documents with it.

    Tasks count first, so that a common term is a row for each task and source when rows meet.
    """
    tune(docs.sparkSession)
    return named(docs, "lang", "source", "text").mapInArrow(trimmed(_count), COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> str:
    """p as SQL, exact: by decimals where the product is too long for a long; 0 where a language keeps no term."""
    short, whole = f"({n} + 2) * {SCALE}L div ({total} + 2 * {kept})", f"(CAST({n} + 2 AS DECIMAL(19, 0)) * CAST({SCALE} AS DECIMAL(10, 0))) div ({total} + 2 * {kept})"
    return f"CASE WHEN {kept} = 0 THEN 0L WHEN {n} < 9000000000 THEN 1 + {short} ELSE 1 + {whole} END"


def apart(p: str, q: str) -> str:
    """f as SQL; p and q are at most SCALE + 1."""
    return f"(({p} - {q}) * ({p} - {q})) div greatest(1L, {p} + {q})"


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // np.maximum(p + q, 1)


def _extra(p, q, p0, q0) -> np.ndarray:
    """What a term in both sources adds to what it would add if either were absent in turn."""
    return _apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)


def _summed(codes: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, values = codes[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
    return codes[cuts], np.add.reduceat(values, cuts) if len(cuts) else values


def _pair_sums(batches):
    """Sums over distinct vectors of (lang, m, index array, p array, p0 array) by pair of indexes i < j."""
    held: dict[str, list] = defaultdict(list)
    size: Counter = Counter()

    def passed_on(lang):
        codes, values = held.pop(lang)[0]
        at = pa.array(np.zeros(len(codes), np.int32))
        return pa.RecordBatch.from_arrays([pa.array([lang]).take(at), pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(values)], ["lang", "i", "j", "value"])

    def add(lang, i, j, values):
        held[lang].append(((i.astype(np.int64) << 32 | j).ravel(), values.ravel()))
        size[lang] += values.size
        if size[lang] > MOST_PAIRS:
            held[lang] = [_summed(*map(np.concatenate, zip(*held[lang])))]
            size[lang] = len(held[lang][0][0])
        if size[lang] > MOST_PAIRS // 2 and len(held[lang]) == 1:
            size.pop(lang)
            yield passed_on(lang)

    for batch in batches:
        langs, m = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
        ends = batch.column(2).offsets.to_numpy()
        index, p, p0 = (batch.column(c).values.to_numpy() for c in (2, 3, 4))
        width = np.diff(ends)
        for lang in set(langs.tolist()):
            for k in np.unique(width[langs == lang]).tolist():
                rows = np.flatnonzero((langs == lang) & (width == k))
                if k <= 64:  # many rows at once
                    i, j = np.triu_indices(k, 1)
                    step = max(1, (MOST_PAIRS // 4) // len(i))
                    for some in (rows[b : b + step] for b in range(0, len(rows), step)):
                        at = ends[some][:, None] + np.arange(k)
                        x, y, z = index[at], p[at], p0[at]
                        yield from add(lang, x[:, i], x[:, j], _extra(y[:, i], y[:, j], z[:, i], z[:, j]) * m[some][:, None])
                else:  # an entry with all behind it
                    for r in rows.tolist():
                        for a in range(ends[r], ends[r + 1] - 1):
                            b = slice(a + 1, ends[r + 1])
                            yield from add(lang, np.full(ends[r + 1] - a - 1, index[a]), index[b], _extra(p[a], p[b], p0[a], p0[b]) * m[r])
    for lang in list(held):
        held[lang] = [_summed(*map(np.concatenate, zip(*held[lang])))]
        yield passed_on(lang)


class Audit:
    """The tables of an audit of docs (lang, source, text), and its two reports.

    Null lang, source and text are empty ones; groups without terms, repeated rows and ties are as the formulas have them:
    each row counts, equal values are ranked by the UTF-8 bytes of the item. An empty table gives no rows. Texts of any
    length are read whole, other columns not at all. What grows with a group's terms is never in one task: terms are
    counted by tasks first, cut to the ``top`` of each task before they are ranked; a vector is as long as its language
    has sources, and pairs of sources are the result itself.
    """

    def __init__(self, docs: DataFrame, least: int = 10):
        """least: documents of a language that a term must be in to be kept."""
        self.keep = keep = Scratch(docs.sparkSession)
        counts = keep(term_counts(docs))
        vector = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vector")
        terms = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), vector).where(F.col("docs") >= least)
        #: Kept terms with their occurrences in the language and in each source that has them.
        self.terms = keep(terms.select("lang", "term", "n", "vector"))
        keep.drop(counts)
        #: Distinct vectors; ``first`` names one within its language, m terms have it.
        self.vectors = keep(self.terms.groupBy("lang", "vector").agg(F.count("*").alias("m"), F.min("term").alias("first")))
        self.entries = self.vectors.select("lang", "first", "m", F.explode("vector").alias("e")).select("lang", "first", "m", "e.source", "e.n")
        totals = self.entries.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("total"))
        langs = self.vectors.groupBy("lang").agg(F.sum("m").alias("kept"))
        whole = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"))
        zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("total", "kept", "lang_total")}
        groups = named(docs, "lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs.join(whole, "lang"), "lang", "left").withColumns(zero)
        number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))  # a row for each source; pairs of them are the result
        #: (lang, source) groups, numbered within their language.
        self.groups = keep(groups.select("lang", "source", number.alias("idx"), "total", "kept", "lang_total", F.expr(share("0L", "total", "kept")).alias("p0")))
        size = self.groups.agg(F.coalesce(F.sum(F.octet_length("lang") + F.octet_length("source") + 48), F.lit(0))).first()[0]
        self.small = size <= MOST_BYTES

    def met(self, left: DataFrame, right: DataFrame, keys: list[str], spread: str) -> DataFrame:
        """Join with groups, or with a part of their columns."""
        if self.small:
            return left.join(F.broadcast(right), keys)
        key = F.struct(*keys)
        return attach(left.withColumn("_key", key), right.withColumn("_key", key).drop(*keys), "_key", spread).drop("_key")

    def pair_values(self) -> DataFrame:
        """(lang, i, j, value): f summed over all kept terms, for numbers i < j of sources."""
        sides = self.groups.select("lang", "source", "idx", "total", "kept", "p0")
        priced = self.keep(self.met(self.entries, sides, ["lang", "source"], "first").select("lang", "first", "m", "idx", F.expr(share("n", "total", "kept")).alias("p"), "p0"))
        parts = F.array_sort(F.collect_list(F.struct("idx", "p", "p0")))
        columns = priced.groupBy("lang", "first").agg(F.min("m").alias("m"), parts.alias("v")).where(F.size("v") > 1).select("lang", "m", *[F.col("v")[c].alias(c) for c in ("idx", "p", "p0")])
        both = columns.mapInArrow(trimmed(_pair_sums), PAIRS)
        alone = priced.groupBy("lang", "idx", "p", "p0").agg(F.sum("m").alias("m"))
        others = self.groups.select("lang", F.col("idx").alias("other"), F.col("p0").alias("q0"), "kept")
        order = [F.least("idx", "other").alias("i"), F.greatest("idx", "other").alias("j")]
        side = self.met(alone, others.drop("kept"), ["lang"], "p").where("idx <> other").select("lang", *order, F.expr(f"m * ({apart('p', 'q0')} - {apart('p0', 'q0')})").alias("value"))
        base = self.met(self.groups.select("lang", "idx", "p0"), others, ["lang"], "idx").where("idx < other").select("lang", *order, F.expr(f"kept * ({apart('p0', 'q0')})").alias("value"))
        return base.unionAll(side).unionAll(both).groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))

    def pairs(self) -> DataFrame:
        """(lang, source, part, item, value, rank): each source against each other one of its language."""
        ways = F.explode(F.array(F.struct(F.col("i").alias("idx"), F.col("j").alias("other")), F.struct(F.col("j").alias("idx"), F.col("i").alias("other")))).alias("w")
        found = self.pair_values().select("lang", ways, "value").select("lang", "w.idx", "w.other", "value")
        found = self.met(found, self.groups.select("lang", "idx", "source"), ["lang", "idx"], "other")
        found = self.met(found, self.groups.select("lang", F.col("idx").alias("other"), F.col("source").alias("item")), ["lang", "other"], "idx")
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return found.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))

    def top_terms(self, top: int = 10) -> DataFrame:
        """(lang, source, part, item, value, rank): the terms by which a source is furthest above its language."""
        rows = self.terms.select("lang", "term", F.col("n").alias("lang_n"), F.explode("vector").alias("e")).select("lang", "term", "lang_n", "e.source", "e.n")
        rows = self.met(rows, self.groups.select("lang", "source", "total", "kept", "lang_total"), ["lang", "source"], "term")
        rows = rows.select("lang", "source", "term", F.expr(share("n", "total", "kept")).alias("p"), F.expr(share("lang_n", "lang_total", "kept")).alias("q")).where("p > q")
        rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
        rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
        return rows.withColumn("rank", rank).where(F.col("rank") <= top)  # Spark cuts to the top within each task first


def source_audit(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): both reports of an ``Audit``."""
    audit = Audit(docs, least)
    return audit.pairs().unionAll(audit.top_terms(top))
