"""SQL twins of the queries, for an engine that reads the same tables."""

from __future__ import annotations

from ..functions import lexicon as X
from ..operators.stats import EDGES
from .probe import LABELLED_SQL, LATIN, PROBE_SQL, quoted

DIMS = X.DIMENSIONS
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
NORM = "trim(regexp_replace(lower(headline), '[^a-z0-9 ]+', '', 'g'), ' ')"


def count(pattern: str, text: str = "t") -> str:
    return f"len(regexp_extract_all({text}, {quoted(pattern)}))"


def real(x: float) -> str:
    return f"CAST({x!r} AS DOUBLE)"


def scored(source: str, name: str = "scored") -> str:
    """CTEs that add t and the six scores to source, which has a headline."""
    counts = ", ".join(f"{count('(?i)' + X.alternation(X.LEXICONS[d]))} AS n_{d}" for d in DIMS[:5])
    stop = ", ".join(map(quoted, X.ACRONYMS))
    lexical = ", ".join(f"CASE n_{d} WHEN 0 THEN {real(0.0)} WHEN 1 THEN {real(0.6)} ELSE {real(1.0)} END AS s_{d}" for d in DIMS[1:5])
    return f"""{name}_t AS (SELECT *, regexp_replace(headline, {quoted(LATIN)}, 'x', 'g') AS t FROM {source}),
{name}_n AS (
    SELECT *, {counts},
        len(list_filter(regexp_extract_all(t, {quoted(X.CAPS)}), lambda w: w NOT IN ({stop}))) AS n_caps,
        coalesce(list_sum(list_transform(regexp_extract_all(headline, {quoted(X.MARKS)}), lambda m: CASE WHEN length(m) > 1 THEN {real(1.0)} ELSE {real(0.5)} END)), 0) AS n_marks,
        CAST(regexp_matches(t, {quoted("(?i)" + X.LISTICLE)}) AS INTEGER) AS is_list, CAST(regexp_matches(t, {quoted("(?i)" + X.NUMBER_TEASE)}) AS INTEGER) AS is_tease,
        regexp_matches(t, {quoted("(?i)" + X.SECOND_PERSON)}) AS is_you, regexp_matches(t, {quoted("(?i)" + X.FORWARD_REFERENCE)}) AS is_this
    FROM {name}_t
),
{name} AS (
    SELECT *, CASE WHEN n_curiosity_gap = 1 THEN {real(0.6)} WHEN n_curiosity_gap > 1 THEN {real(1.0)} WHEN is_you AND is_this THEN {real(0.4)} ELSE {real(0.0)} END AS s_curiosity_gap,
        {lexical}, least({real(1.0)}, (n_caps + n_marks + is_list + is_tease) * {real(0.5)}) AS s_sensational_formatting
    FROM {name}_n
)"""


SUM = "(" + " + ".join(f"s_{d}" for d in DIMS) + ")"
SCORE = f"least({real(1.0)}, {SUM} / 6 * 2)"
BASE = f"greatest({real(0.0)}, least({real(1.0)}, {SUM} / 6))"
BAND = f"CASE WHEN {SCORE} < {real(0.35)} THEN 'low' WHEN {SCORE} < {real(0.65)} THEN 'moderate' ELSE 'high' END"
ORDINAL = lambda d: f"CASE WHEN s_{d} < {real(0.3)} THEN 0 WHEN s_{d} < {real(0.8)} THEN 1 ELSE 2 END"
SCORED = f"WITH {PROBE_SQL}, {scored('probe')}"
EVAL = f"WITH {LABELLED_SQL}, {scored('labelled')}, e AS (SELECT doc_id, lang, label, intensity, {BASE} AS p FROM scored)"
WORDS = "list_filter(regexp_split_to_array(headline, '\\s+'), lambda w: w <> '')"


def span_part(dimension: str, pattern: str, first: bool = False, keep: str = "true") -> str:
    """Rows of a pattern's matches: where each starts follows from the parts between them and the matches before."""
    return f"""SELECT doc_id, '{dimension}' AS dimension, start AS span_start, start + length(m[k]) AS span_end, substr(headline, CAST(start + 1 AS BIGINT), CAST(length(m[k]) AS BIGINT)) AS span_text FROM (
        SELECT *, coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start
        FROM (SELECT doc_id, headline, regexp_extract_all(t, {quoted(pattern)}) AS m, regexp_split_to_array(t, {quoted(pattern)}) AS p, unnest(range(1, {"2" if first else f"len(regexp_extract_all(t, {quoted(pattern)})) + 1"})) AS k FROM t)
    ) WHERE k <= len(m) AND {keep}"""


SPANS = "\nUNION ALL ".join(
    [span_part(d, "(?i)" + X.alternation(X.LEXICONS[d])) for d in DIMS[:5]]
    + [span_part(DIMS[5], X.CAPS, keep=f"m[k] NOT IN ({', '.join(map(quoted, X.ACRONYMS))})"), span_part(DIMS[5], X.MARKS), span_part(DIMS[5], "(?i)" + X.LISTICLE, True), span_part(DIMS[5], "(?i)" + X.NUMBER_TEASE, True)]
)

MASKED = f"masked AS (SELECT doc_id, regexp_replace(headline, {quoted('(?i)' + X.alternation(X.ENTITIES))}, 'entitytoken', 'g') AS h FROM probe)"
#: All rows of ``found`` of one document, in order, each kept that begins at or behind the end of the last one kept.
MARKED = """marked AS (
    SELECT doc_id, list_reduce(list([{'start': span_start, 'end': span_end}] ORDER BY span_start, span_end DESC), lambda kept, x: CASE WHEN x[1].start >= kept[len(kept)]."end" THEN list_concat(kept, x) ELSE kept END) AS marks, count(*) AS n
    FROM found GROUP BY doc_id
)"""
ALL_SPANS = "\nUNION ALL ".join([span_part("", "(?i)" + X.alternation(ts)) for ts in X.LEXICONS.values()] + [span_part("", X.MARKS)])

TEXTS = f"WITH RECURSIVE {PROBE_SQL}, named AS (SELECT doc_id, {NORM} AS norm FROM probe), texts AS (SELECT norm, min(doc_id) AS rep FROM named GROUP BY norm)"
SHINGLED = "sh AS (SELECT rep, unnest(CASE WHEN length(norm) <= 3 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm) - 1), lambda i: substr(norm, i, 3))) END) AS s FROM texts), sz AS (SELECT rep, count(*) AS n FROM sh GROUP BY rep)"
PAIRS = """pairs AS (
    SELECT a, b, c / CAST(za.n + zb.n - c AS DOUBLE) AS jaccard
    FROM (SELECT x.rep AS a, y.rep AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.rep < y.rep GROUP BY ALL) JOIN sz za ON za.rep = a JOIN sz zb ON zb.rep = b
    WHERE c / CAST(za.n + zb.n - c AS DOUBLE) >= 0.8
)"""
GROUPS = """link AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(rep, m) AS (SELECT rep, rep FROM texts UNION SELECT l.b, r.m FROM reach r JOIN link l ON l.a = r.rep WHERE r.m < l.b),
component AS (SELECT rep, min(m) AS group_min FROM reach GROUP BY rep)"""
SPLIT = f"""WITH {LABELLED_SQL}, g AS (SELECT doc_id, label, min(doc_id) OVER (PARTITION BY {NORM}) AS dup_group FROM labelled),
gl AS (SELECT dup_group, CAST(avg(label) >= 0.5 AS INTEGER) AS y FROM g GROUP BY dup_group),
gr AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || dup_group), dup_group) AS k, count(*) OVER (PARTITION BY y) AS n FROM gl),
gs AS (
    SELECT dup_group, CASE WHEN k <= take THEN 'test' WHEN k <= 2 * take THEN 'val' ELSE 'train' END AS split
    FROM (SELECT *, CASE WHEN n > 2 THEN greatest(1, CAST(round_even(n * {real(0.15)}, 0) AS BIGINT)) ELSE 0 END AS take FROM gr)
), split AS (SELECT doc_id, label, dup_group, split FROM g JOIN gs USING (dup_group))"""
ECE = f"least(9, greatest(0, {' + '.join(f'CAST(p >= {real(e)} AS INTEGER)' for e in EDGES)} - 1))"
SENTENCES = """list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"""
WINDOWS = f"""s AS (SELECT doc_id, headline, {SENTENCES} AS s FROM probe),
w AS (SELECT doc_id, headline, s, unnest(range(0, least(6, CAST(ceil(len(s) / 4.0) AS BIGINT)))) AS idx, least(6, CAST(ceil(len(s) / 4.0) AS BIGINT)) AS n_windows FROM s),
win AS (SELECT doc_id, headline, n_windows, idx, array_to_string(s[idx * 4 + 1 : idx * 4 + 4], ' ') AS w FROM w)"""
HEAD_WORDS = lambda c: f"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(lower({c}), '[^a-z0-9 ]+', '', 'g'), ' '), '\\s+'), lambda x: x <> ''))"
SIDES = (("Biden", "Trump"), ("Democrats", "Republicans"), ("the left", "the right"), ("liberal", "conservative"))
DEVICES = ("You won't believe this: {b}", "SHOCKING: {b} — what happened next will surprise you")
OPENINGS = ("", "Guess what: ", "SHOCKING: you won't believe this heartbreaking secret!!! ")
_FULL = lambda v, last="false", more="": "{" + ", ".join(f'"{d}": {v}' for d in DIMS) + f', "out_of_scope": {last}' + more + "}"
RESPONSES = (_FULL(0), _FULL(2, "true"), _FULL(3), _FULL('"1"'), _FULL(1, "0"), _FULL(1, more=', "note": 1'), "{}", "no object", "[1]", None, _FULL(1.5), _FULL("null"))
VOTE = "(doc_id * 7 + k * 3 + {i}) % 3"
LABEL_TEXT = "['7', '1', NULL, 'abc', '1.5', '2.5', '-3', 'NaN']"

#: Elements of a kind, each to its own end tag, and where they start: by the texts between them and the elements before.
ELEMENTS = lambda t: f"""SELECT page_id, '{t}' AS tag, m[k] AS e, coalesce(list_sum(list_transform(s[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS start FROM (
            SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?is)<{t}\\b[^>]*>.*?</{t}>') AS m, regexp_split_to_array(html, '(?is)<{t}\\b[^>]*>.*?</{t}>') AS s FROM x))"""  # noqa: E731
#: References that the tables' headings hold; the sign itself comes last.
DECODED = lambda c: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({c}, '&quot;?', '\"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')"

#: Special tokens, letters, letters inside a word, and the words of the lexicons, in the order of their ids.
PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *map(chr, range(ord("a"), ord("z") + 1)), *[f"##{chr(c)}" for c in range(ord("a"), ord("z") + 1)], *sorted({w for ts in X.LEXICONS.values() for t in ts for w in t.split() if w.isalpha()} | {X.MASK})]

ORACLE: dict[str, str] = {
    "technique_summary": f"{SCORED} SELECT lang, {BAND} AS band, count(*) AS n, round(avg({SCORE}), 6) AS avg_score FROM scored GROUP BY ALL",
    "technique_scores": f"{SCORED} SELECT doc_id, {', '.join(f's_{d}' for d in DIMS)}, round({SCORE}, 6) AS manipulation_score FROM scored",
    "technique_spans": f"WITH {PROBE_SQL}, t AS (SELECT doc_id, headline, regexp_replace(headline, {quoted(LATIN)}, 'x', 'g') AS t FROM probe) SELECT doc_id, dimension, CAST(span_start AS BIGINT) AS span_start, CAST(span_end AS BIGINT) AS span_end, span_text FROM ({SPANS})",
    "feature_vectors": f"""{SCORED} SELECT doc_id, {', '.join(f's_{d} AS lf_{d}' for d in DIMS)}, CAST(length(headline) AS DOUBLE) AS n_chars, CAST(len({WORDS}) AS DOUBLE) AS n_words, CAST(is_you AS DOUBLE) AS second_person,
        CAST(regexp_matches(headline, '^\\s*\\d') AS DOUBLE) AS starts_with_number, CAST(contains(headline, '?') AS DOUBLE) AS question_mark, CAST(contains(headline, '!') AS DOUBLE) AS exclamation,
        round(len(list_filter({WORDS}, lambda w: w = upper(w) AND w <> lower(w) AND length(w) >= 3 AND w NOT IN ({', '.join(map(quoted, X.ACRONYMS))}))) / CAST(greatest(1, len({WORDS})) AS DOUBLE), 6) AS allcaps_ratio FROM scored""",
    "intensity_bands": f"{SCORED} SELECT {BAND} AS band, count(*) AS n, round(min({SCORE}), 6) AS low, round(max({SCORE}), 6) AS high FROM scored GROUP BY ALL",
    "detected_techniques": f"""{SCORED}, d AS (SELECT doc_id, unnest([{', '.join(f"{{'s': s_{d}, 'i': {i}, 'd': '{d}'}}" for i, d in enumerate(DIMS))}]) AS e FROM scored)
        SELECT doc_id, count(*) FILTER (e.s >= {real(0.6)}) AS n_detected, coalesce(string_agg(e.d, ',' ORDER BY e.s DESC, e.i) FILTER (e.s >= {real(0.6)}), '') AS detected FROM d GROUP BY doc_id""",
    "highlight_spans": f"""WITH {PROBE_SQL}, t AS (SELECT doc_id, headline, regexp_replace(headline, {quoted(LATIN)}, 'x', 'g') AS t FROM probe),
        found AS (SELECT DISTINCT doc_id, CAST(span_start AS BIGINT) AS span_start, CAST(span_end AS BIGINT) AS span_end, span_text FROM ({ALL_SPANS})), {MARKED}
        SELECT doc_id, coalesce(n, 0) AS n_spans, coalesce(len(marks), 0) AS n_marks, coalesce(CAST(to_json(marks) AS VARCHAR), '[]') AS marks FROM probe LEFT JOIN marked USING (doc_id)""",
    "entity_mask": f"""WITH {PROBE_SQL}, t AS (SELECT doc_id, headline, regexp_extract_all(regexp_replace(headline, {quoted(LATIN)}, 'x', 'g'), {quoted('(?i)' + X.alternation(X.ENTITIES))}) AS m FROM probe)
        SELECT doc_id, CAST(len(m) AS BIGINT) AS n_entities, CAST(length(headline) - coalesce(list_sum(list_transform(m, lambda x: length(x))), 0) + 11 * len(m) AS BIGINT) AS masked_length FROM t""",
    "clean_headlines": f"WITH {PROBE_SQL}, s AS (SELECT doc_id, trim(headline, {BLANK}) AS headline FROM probe) SELECT min(doc_id) AS doc_id, headline FROM s WHERE length(headline) BETWEEN 12 AND 300 GROUP BY headline",
    "contract_violations": f"""WITH {PROBE_SQL}, r AS (SELECT CASE WHEN doc_id % 11 = 0 THEN '' WHEN doc_id % 13 = 0 THEN NULL ELSE headline END AS h, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE CAST(doc_id % 4 AS VARCHAR) END AS l, CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'docs' END AS s, CASE doc_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'holdout' END AS sp FROM probe)
        SELECT unnest(['type:headline', 'type:label_clickbait', 'type:source', 'type:outlet', 'type:dup_group', 'type:split', 'null:headline', 'null:label_clickbait', 'null:source', 'null:dup_group', 'null:split', 'rule:headline_length', 'rule:label_domain', 'rule:split_domain']) AS rule,
            unnest([0, count(*) FILTER (l = 'x'), 0, 0, 0, 0, count(*) FILTER (h IS NULL), 0, count(*) FILTER (s IS NULL), 0, 0, count(*) FILTER (h = ''), count(*) FILTER (l IN ('2', '3')), count(*) FILTER (sp = 'holdout')]) AS violations FROM r""",
    "exact_dedup": f"WITH {PROBE_SQL} SELECT min(doc_id) AS doc_id, count(*) AS copies FROM probe GROUP BY headline",
    "shingles": f"{TEXTS}, {SHINGLED} SELECT rep, n FROM sz",
    "near_dup_pairs_exact": f"{TEXTS}, {SHINGLED}, {PAIRS} SELECT a, b, round(jaccard, 6) AS jaccard FROM pairs",
    "near_dup_groups": f"{TEXTS}, {SHINGLED}, {PAIRS}, {GROUPS} SELECT doc_id, group_min, dense_rank() OVER (ORDER BY group_min) - 1 AS dup_group FROM named JOIN texts USING (norm) JOIN component USING (rep)",
    "group_split": f"{SPLIT} SELECT doc_id, dup_group, split FROM split",
    "split_balance": f"{SPLIT} SELECT split, count(*) AS n, round(avg(CAST(label AS DOUBLE)), 6) AS positive_share FROM split GROUP BY split",
    "leakage_check": f"WITH {PROBE_SQL}, g AS (SELECT doc_id % 3 AS s, min(doc_id) OVER (PARTITION BY {NORM}) AS dup_group FROM probe) SELECT dup_group, count(DISTINCT s) AS n_splits FROM g GROUP BY dup_group HAVING count(DISTINCT s) > 1",
    "graded_posts": f"""WITH {LABELLED_SQL}, q AS (SELECT doc_id, trim(headline, {BLANK}) AS headline, substr(array_to_string(list_filter(list_transform(string_split(body, chr(10)), lambda p: trim(p, {BLANK})), lambda p: p <> ''), ' '), 1, 4000) AS body, intensity, label FROM labelled)
        SELECT doc_id AS id, CAST(length(headline) AS BIGINT) AS headline_length, CAST(length(body) AS BIGINT) AS body_length, md5(body) AS body_md5, intensity, label AS label_clickbait FROM q WHERE length(headline) >= 5""",
    "dry_run_labels": f"{SCORED} SELECT doc_id, {', '.join(f'{ORDINAL(d)} AS {d}' for d in DIMS)} FROM scored",
    "label_cache_reuse": f"{SCORED} SELECT doc_id, doc_id % 3 = 0 AS hit, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 2 AS INTEGER) ELSE {ORDINAL('outrage')} END AS outrage FROM scored",
    "label_median_vote": f"WITH {PROBE_SQL}, v AS (SELECT doc_id, k, {', '.join(f'{VOTE.format(i=i)} AS {d}' for i, d in enumerate(DIMS))}, (doc_id + k) % 3 = 0 AS oos FROM probe, range(1, 5) r(k) WHERE k <= 3 + doc_id % 2) SELECT doc_id, {', '.join(f'CAST(floor(quantile_cont({d}, 0.5)) AS INTEGER) AS {d}' for d in DIMS)}, sum(CAST(oos AS INTEGER)) > count(*) / 2.0 AS out_of_scope FROM v GROUP BY doc_id",
    "budget_cutoff": f"WITH {PROBE_SQL}, c AS (SELECT doc_id, length(headline) AS tokens, coalesce(sum(length(headline)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM probe) SELECT doc_id, CAST(tokens AS BIGINT) AS tokens, CAST(spent AS BIGINT) AS spent FROM c WHERE spent < 20000",
    "request_cost": f"WITH {PROBE_SQL} SELECT doc_id, round((length(headline) + {real(1.25)} * (doc_id % 5) + {real(0.1)} * (doc_id % 7)) * {real(5.0)} + 40 * {real(25.0)}, 6) AS micro_usd FROM probe",
    "agreement_alpha": """WITH u AS (SELECT doc_id, unnest([quality, toxic]) AS v FROM labels), k AS (SELECT doc_id, count(v) AS m, CAST(sum(v) AS DOUBLE) AS s, CAST(sum(v * v) AS DOUBLE) AS q FROM u WHERE v IS NOT NULL GROUP BY doc_id HAVING count(v) > 1),
        t AS (SELECT sum(2 * (m * q - s * s) / (m - 1)) AS o, CAST(sum(m) AS DOUBLE) AS n, sum(s) AS s, sum(q) AS q FROM k),
        c AS (SELECT CAST(sum(v) AS DOUBLE) AS ones, CAST(count(*) - sum(v) AS DOUBLE) AS zeros FROM u JOIN k USING (doc_id)),
        d AS (SELECT sum(CASE WHEN s IN (0, 2) THEN 0 ELSE 2 END) AS o FROM k),
        x AS (SELECT avg(CAST(quality = toxic AS DOUBLE)) AS exact_agreement, count(*) AS n_units FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)
        SELECT 'interval' AS metric, round(1 - o / (2 * (n * q - s * s) / (n - 1)), 6) AS alpha, round(exact_agreement, 6) AS exact_agreement, n_units FROM t, x
        UNION ALL SELECT 'nominal', round(1 - o / (((ones + zeros) * (ones + zeros) - ones * ones - zeros * zeros) / (ones + zeros - 1)), 6), round(exact_agreement, 6), n_units FROM c, d, x""",
    "gold_gate": f"""{SCORED}, one AS (SELECT headline, min(doc_id) AS doc_id, {', '.join(f'min({ORDINAL(d)}) AS {d}' for d in DIMS)} FROM scored GROUP BY headline),
        l AS (SELECT unnest([{', '.join(quoted(d) for d in DIMS)}]) AS dimension, doc_id, CAST(unnest([{', '.join(DIMS)}]) AS DOUBLE) AS b, unnest([{', '.join(f'CASE WHEN doc_id % {5 + i} = 0 THEN least(2, {d} + 1) ELSE {d} END' for i, d in enumerate(DIMS))}]) AS g FROM one),
        u AS (SELECT dimension, doc_id, CAST(g AS DOUBLE) + b AS s, CAST(g AS DOUBLE) * g + b * b AS q, CAST(g = b AS DOUBLE) AS e FROM l)
        SELECT dimension, round(1 - sum(2 * (2 * q - s * s)) / (2 * (2 * count(*) * sum(q) - sum(s) * sum(s)) / (2.0 * count(*) - 1)), 6) AS alpha, round(avg(e), 6) AS exact_agreement, count(*) AS n_units,
            1 - sum(2 * (2 * q - s * s)) / (2 * (2 * count(*) * sum(q) - sum(s) * sum(s)) / (2.0 * count(*) - 1)) >= 0.6 AS usable FROM u GROUP BY dimension""",
    "label_override": f"{SCORED} SELECT doc_id, {', '.join(f'CASE WHEN doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN (doc_id % 3) / {real(2.0)} ELSE s_{d} END AS target_{d}' if d in ('outrage', 'fear') else f's_{d} AS target_{d}' for d in DIMS)} FROM scored",
    "ece": f"{EVAL}, b AS (SELECT lang, {ECE} AS bin, count(*) AS n, avg(p) AS conf, avg(CAST(label AS DOUBLE)) AS acc FROM e GROUP BY ALL) SELECT lang, round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM b GROUP BY lang",
    "roc_auc": f"{EVAL} SELECT a.lang, round(sum(CASE WHEN a.p > b.p THEN {real(1.0)} WHEN a.p = b.p THEN {real(0.5)} ELSE {real(0.0)} END) / count(*), 6) AS roc_auc FROM e a JOIN e b ON a.lang = b.lang AND a.label = 1 AND b.label = 0 GROUP BY a.lang",
    "average_precision": f"""{EVAL}, t AS (SELECT lang, p, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM t WINDOW w AS (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING))
        SELECT lang, round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM c GROUP BY lang HAVING sum(pos) > 0""",
    "f1_report": f"{EVAL} SELECT lang, round(coalesce(2 * sum(CAST(p >= 0.2 AS INTEGER) * label) / nullif(CAST(sum(CAST(p >= 0.2 AS INTEGER)) + sum(label) AS DOUBLE), 0), 0), 6) AS f1, round(avg(CAST(p >= 0.2 AS DOUBLE)), 6) AS positive_rate, count(*) AS n FROM e GROUP BY lang",
    "spearman_mae": f"""{EVAL}, r AS (SELECT lang, intensity, p, rank() OVER (PARTITION BY lang ORDER BY intensity) + (count(*) OVER (PARTITION BY lang, intensity) - 1) / 2.0 AS a, rank() OVER (PARTITION BY lang ORDER BY p) + (count(*) OVER (PARTITION BY lang, p) - 1) / 2.0 AS b FROM e)
        SELECT lang, round(corr(a, b), 6) AS spearman, round(avg(abs(intensity - p)), 6) AS mae, count(*) AS n FROM r GROUP BY lang HAVING count(*) >= 8""",
    "multitask_eval_loss": f"""{EVAL.replace("e AS (SELECT doc_id, lang, label, intensity,", f"e AS (SELECT doc_id, s_outrage, s_fear, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE label END AS label, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE intensity END AS intensity,")},
        z AS (SELECT *, 4 * p - 1 AS iz, 6 * p - 2 AS bz, 2 * p - 1 AS oz, 1 - 3 * p AS fz FROM e),
        l AS (SELECT avg((1 / (1 + exp(-iz)) - intensity) ** 2) AS i, sum(greatest(oz, 0) - oz * s_outrage + ln(1 + exp(-abs(oz))) + greatest(fz, 0) - fz * s_fear + ln(1 + exp(-abs(fz)))) / (2.0 * count(*)) AS t, avg(greatest(bz, 0) - bz * label + ln(1 + exp(-abs(bz)))) AS b FROM z)
        SELECT round(i + 0.5 * t + 0.5 * b, 6) AS loss FROM l""",
    "rule_baseline_eval": f"""{EVAL}, a AS (SELECT sum(CASE WHEN x.p > y.p THEN {real(1.0)} WHEN x.p = y.p THEN {real(0.5)} ELSE {real(0.0)} END) / count(*) AS roc_auc FROM e x JOIN e y ON x.label = 1 AND y.label = 0),
        t AS (SELECT p, CAST(sum(label) AS DOUBLE) AS pos, CAST(count(*) AS DOUBLE) AS n FROM e GROUP BY ALL), c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM t WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), ap AS (SELECT sum(pos * tp / seen) / sum(pos) AS average_precision FROM c),
        b AS (SELECT {ECE} AS bin, count(*) AS n, avg(p) AS conf, avg(CAST(label AS DOUBLE)) AS acc FROM e GROUP BY ALL), ec AS (SELECT sum(n * abs(conf - acc)) / sum(n) AS ece FROM b),
        f AS (SELECT coalesce(2 * sum(CAST(p >= 0.5 AS INTEGER) * label) / nullif(CAST(sum(CAST(p >= 0.5 AS INTEGER)) + sum(label) AS DOUBLE), 0), 0) AS f1, avg(CAST(p >= 0.5 AS DOUBLE)) AS positive_rate, count(*) AS n FROM e)
        SELECT round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision, round(f1, 6) AS f1, round(ece, 6) AS ece, round(positive_rate, 6) AS positive_rate, n FROM a, ap, ec, f""",
    "body_windows": f"WITH {PROBE_SQL}, {WINDOWS} SELECT doc_id, n_windows, idx, CAST(length(w) AS BIGINT) AS n_chars, md5(w) AS window_md5 FROM win",
    "delivery_verdict": f"""WITH {PROBE_SQL}, {WINDOWS}, o AS (SELECT doc_id, n_windows, len(list_intersect(h, b)) / CAST(greatest(1, len(h)) AS DOUBLE) AS e, len(list_intersect(b, ['not', 'no', 'never', 'none'])) > 0 AS neg FROM (SELECT doc_id, n_windows, {HEAD_WORDS('headline')} AS h, {HEAD_WORDS('w')} AS b FROM win)),
        m AS (SELECT doc_id, max(n_windows) AS n_windows, max(e) AS d, max(CASE WHEN neg THEN (1 - e) / 2 ELSE 0 END) AS c FROM o GROUP BY doc_id)
        SELECT p.doc_id, round(d, 6) AS delivery, round(c, 6) AS contradiction, CASE WHEN d IS NULL THEN NULL WHEN d >= 0.6 THEN 'delivered' WHEN c >= 0.5 OR (d < 0.3 AND c >= 0.15) THEN 'overpromises' WHEN d >= 0.3 THEN 'partially_supported' ELSE 'not_directly_supported' END AS verdict, CAST(n_windows AS BIGINT) AS n_windows, CASE WHEN d IS NULL THEN 'empty body' END AS error FROM probe p LEFT JOIN m USING (doc_id)""",
    "html_headlines": f"""WITH x AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<(?:script|style|title)\\b[^>]*>.*?</(?:script|style|title)>', '', 'g'), '(?s)<!--.*?-->', '', 'g') AS html FROM pages),
        e AS ({' UNION ALL '.join(ELEMENTS(t) for t in ('h1', 'h2', 'h3', 'a'))}),
        h AS (SELECT page_id, start, tag, trim(regexp_replace({DECODED("regexp_replace(regexp_replace(e, '(?is)<(?:br|p|div|li|h[1-6])\\b[^>]*>', ' ', 'g'), '(?s)<[^>]*>', '', 'g')")}, '\\s+', ' ', 'g'), ' ') AS headline FROM e),
        n AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY start) - 1 AS place FROM h WHERE length(headline) BETWEEN 25 AND 200 AND (tag <> 'a' OR len(string_split(headline, ' ')) >= 5))
        SELECT page_id, tag, headline, place FROM n WHERE place < 40""",
    "ensemble_blend": f"{EVAL}, z AS (SELECT doc_id, {real(0.5)} * p + {real(0.5)} * intensity AS x FROM e) SELECT doc_id, round(x, 6) AS blend, CASE WHEN x >= {real(0.65)} THEN 'red' WHEN x >= {real(0.35)} THEN 'amber' ELSE 'green' END AS colour FROM z",
    "tfidf_idf_table": f"""WITH {PROBE_SQL}, {MASKED}, w AS (SELECT doc_id, list_filter(regexp_extract_all(strip_accents(lower(h)), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: length(x) >= 2) AS w FROM masked),
        g AS (SELECT DISTINCT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w)
        SELECT term, count(*) AS df, round(ln((1 + (SELECT count(*) FROM probe)) / CAST(1 + count(*) AS DOUBLE)) + 1, 6) AS idf FROM g GROUP BY term""",
    "basic_tokens": f"""WITH {PROBE_SQL}, {MASKED}, t AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(h)), '[\\p{{P}}\\p{{S}}]|[^\\s\\p{{Z}}\\p{{P}}\\p{{S}}]+') AS t FROM masked)
        SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM t""",
    "isotonic_calibration": f"""{EVAL}, x AS (SELECT p, count(*) AS n, sum(label) AS s FROM e GROUP BY p),
        c AS (SELECT p, row_number() OVER w AS i, sum(n) OVER w AS n, sum(s) OVER w AS s FROM x WINDOW w AS (ORDER BY p)),
        run AS (SELECT a.i AS i, b.i AS j, (b.s - coalesce(z.s, 0)) / CAST(b.n - coalesce(z.n, 0) AS DOUBLE) AS mean FROM c a JOIN c b ON b.i >= a.i LEFT JOIN c z ON z.i = a.i - 1),
        low AS (SELECT i, j, min(mean) OVER (PARTITION BY i ORDER BY j DESC) AS least FROM run),
        fit AS (SELECT j AS i, max(least) AS calibrated FROM low GROUP BY j)
        SELECT doc_id, label, round(e.p, 6) AS p, round(calibrated, 6) AS calibrated FROM e JOIN c ON c.p = e.p JOIN fit USING (i)""",
    "coerced_labels": f"""WITH r AS (SELECT doc_id, list_extract({LABEL_TEXT}, CAST(doc_id % 8 + 1 AS INTEGER)) AS raw FROM documents), n AS (SELECT doc_id, raw, TRY_CAST(raw AS DOUBLE) AS x FROM r)
        SELECT doc_id, CAST(CASE WHEN x IS NULL OR isnan(x) THEN 0 ELSE greatest(0, least(2, round_even(x, 0))) END AS INTEGER) AS label FROM n""",
    "request_validation": f"""WITH {PROBE_SQL}, r AS (SELECT headline, body, list_extract(['agree', 'too_high', 'bad', NULL], CAST(doc_id % 4 + 1 AS INTEGER)) AS v, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE body END AS c FROM probe)
        SELECT 'score' AS kind, count(*) FILTER (length(headline) BETWEEN 1 AND 500) AS accepted, count(*) FILTER (NOT coalesce(length(headline) BETWEEN 1 AND 500, false)) AS rejected FROM r
        UNION ALL SELECT 'delivery_gap', count(*) FILTER (length(headline) BETWEEN 1 AND 500 AND length(body) BETWEEN 1 AND 20000), count(*) - count(*) FILTER (length(headline) BETWEEN 1 AND 500 AND length(body) BETWEEN 1 AND 20000) FROM r
        UNION ALL SELECT 'feedback', count(*) FILTER (length(headline) BETWEEN 1 AND 500 AND v IN ('agree', 'too_high', 'too_low') AND (c IS NULL OR length(c) <= 1000)), count(*) - count(*) FILTER (length(headline) BETWEEN 1 AND 500 AND v IN ('agree', 'too_high', 'too_low') AND (c IS NULL OR length(c) <= 1000)) FROM r""",
    "feedback_windows": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "latency_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, count(value) AS n FROM events GROUP BY event_type",
    "max_abs_difference": f"{EVAL} SELECT lang, round(max(abs(p - intensity)), 6) AS max_diff, count(*) AS n FROM e GROUP BY lang",
    "union_frames": f"WITH {LABELLED_SQL}, f AS (SELECT headline, intensity, CAST(label AS DOUBLE) AS label FROM labelled UNION ALL SELECT headline, NULL, CAST(doc_id % 2 AS DOUBLE) FROM probe) SELECT count(*) AS n, count(intensity) AS with_intensity, count(label) AS with_label, round(avg(intensity), 6) AS mean_intensity, round(avg(label), 6) AS mean_label FROM f WHERE headline IS NOT NULL",
    "hash_sample": f"WITH {PROBE_SQL}, o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM probe) SELECT doc_id FROM o WHERE k <= round_even(n * {real(0.15)}, 0)",
    "label_counts": f"WITH {LABELLED_SQL} SELECT label, count(*) AS n, round(avg(intensity), 6) AS mean_intensity, round(avg(CAST(length(body) > 0 AS DOUBLE)), 6) AS with_body FROM labelled GROUP BY label",
}

_PAGES = f"hh AS ({ORACLE['html_headlines']})"
_SAMPLED = "o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || doc_id), doc_id) AS k, count(*) OVER () AS n FROM probe)"
_MIDDLE = lambda i: "list_sort([" + ", ".join(f"(length(headline) * 7 + {k} * {i + 2} + {i}) % 3" for k in (1, 2, 3)) + "])[2]"

ORACLE |= {
    "page_scores": f"WITH {_PAGES}, {scored('hh')} SELECT page_id, place, regexp_replace(headline, {quoted('(?i)' + X.alternation(X.ENTITIES))}, '{X.MASK}', 'g') AS masked, round({SCORE}, 6) AS score, CASE WHEN {SCORE} >= {real(0.65)} THEN 'red' WHEN {SCORE} >= {real(0.35)} THEN 'amber' ELSE 'green' END AS colour FROM scored",
    "delivery_gap": f"""WITH {PROBE_SQL}, {WINDOWS}, o AS (SELECT doc_id, n_windows, idx, w, len(list_intersect(h, b)) / CAST(greatest(1, len(h)) AS DOUBLE) AS e, len(list_intersect(b, ['not', 'no', 'never', 'none'])) > 0 AS neg FROM (SELECT doc_id, n_windows, idx, w, {HEAD_WORDS('headline')} AS h, {HEAD_WORDS('w')} AS b FROM win)),
        m AS (SELECT doc_id, max(n_windows) AS n_windows, max(e) AS d, max(CASE WHEN neg THEN (1 - e) / 2 ELSE 0 END) AS c FROM o GROUP BY doc_id),
        x AS (SELECT doc_id, w FROM (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY e DESC, idx) AS k FROM o) WHERE k = 1)
        SELECT p.doc_id, p.headline, round(d, 3) AS delivery_score, round(1 - d, 3) AS gap_score, round(c, 3) AS max_contradiction, CASE WHEN d IS NULL THEN NULL WHEN d >= 0.6 THEN 'delivered' WHEN c >= 0.5 OR (d < 0.3 AND c >= 0.15) THEN 'overpromises' WHEN d >= 0.3 THEN 'partially_supported' ELSE 'not_directly_supported' END AS verdict,
            substr(x.w, 1, 280) AS best_window, CAST(n_windows AS BIGINT) AS n_windows, CASE WHEN d IS NULL THEN 'empty body' END AS error FROM probe p LEFT JOIN m USING (doc_id) LEFT JOIN x USING (doc_id)""",
    "validation_remainder": f"WITH {PROBE_SQL}, {_SAMPLED} SELECT doc_id, CASE WHEN k <= round_even(n * {real(0.15)}, 0) THEN 'val' ELSE 'train' END AS part FROM o",
    "guarded_auc": f"""{EVAL}, g AS (SELECT *, doc_id % 40 AS part FROM e), k AS (SELECT part FROM g GROUP BY part HAVING count(*) >= 8)
        SELECT a.part, round(sum(CASE WHEN a.p > b.p THEN {real(1.0)} WHEN a.p = b.p THEN {real(0.5)} ELSE {real(0.0)} END) / count(*), 6) AS roc_auc FROM g a JOIN g b ON a.part = b.part AND a.label = 1 AND b.label = 0 JOIN k ON k.part = a.part GROUP BY a.part""",
    "label_schema_check": f"""WITH r AS (SELECT doc_id, list_extract([{', '.join('NULL' if r is None else quoted(r) for r in RESPONSES)}], CAST(doc_id % {len(RESPONSES)} + 1 AS INTEGER)) AS r FROM documents)
        SELECT doc_id, coalesce(CASE WHEN json_valid(r) THEN json_type(r) = 'OBJECT' AND list_sort(json_keys(r)) = [{', '.join(map(quoted, sorted((*DIMS, 'out_of_scope'))))}] AND json_type(r, '$.out_of_scope') = 'BOOLEAN' AND {' AND '.join(f"json_type(r, '$.{d}') IN ('UBIGINT', 'BIGINT') AND json_extract_string(r, '$.{d}') IN ('0', '1', '2')" for d in DIMS)} END, false) AS valid FROM r""",
    "labelling_loop": f"""WITH {PROBE_SQL}, r AS (SELECT doc_id, headline FROM probe ORDER BY doc_id LIMIT 500), c AS (SELECT headline, max(doc_id) AS last FROM probe WHERE doc_id % 3 = 0 GROUP BY headline),
        a AS (SELECT r.doc_id, headline, last, last IS NULL AND r.doc_id = min(r.doc_id) OVER (PARTITION BY headline) AS asked FROM r LEFT JOIN c USING (headline)),
        s AS (SELECT *, coalesce(sum(CASE WHEN asked THEN 3 * length(headline) ELSE 0 END) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM a),
        run AS (SELECT * FROM s WHERE doc_id < coalesce((SELECT min(doc_id) FROM s WHERE asked AND spent >= 20000), 9223372036854775807))
        SELECT doc_id, asked, CAST(spent AS BIGINT) AS spent, {', '.join(f'CAST(CASE WHEN last IS NULL THEN {_MIDDLE(i)} ELSE (last + {i}) % 3 END AS INTEGER) AS {d}' for i, d in enumerate(DIMS))}, CASE WHEN last IS NULL THEN length(headline) % 2 = 1 ELSE last % 2 = 0 END AS out_of_scope FROM run""",
    "labels_present": f"WITH {PROBE_SQL} SELECT count(*) AS n, count(*) FILTER (headline IN (SELECT headline FROM probe WHERE doc_id % 4 = 0)) AS n_labelled FROM probe",
    "gated_targets": f"""WITH gate AS ({ORACLE['gold_gate']}), {SCORED.removeprefix('WITH ')}
        SELECT doc_id, {', '.join(f"CASE WHEN (SELECT usable FROM gate WHERE dimension = '{d}') AND doc_id % 4 = 0 AND doc_id % 8 <> 0 THEN (doc_id % 3) / {real(2.0)} ELSE s_{d} END AS target_{d}" for d in DIMS)} FROM scored""",
    "score_records": f"""{SCORED}, d AS (SELECT doc_id, {SCORE} AS score, {BAND} AS band, unnest([{', '.join(f"{{'s': s_{d}, 'i': {i}, 'd': '{d}'}}" for i, d in enumerate(DIMS))}]) AS e FROM scored)
        SELECT doc_id, round(any_value(score), 3) AS manipulation_score, any_value(band) AS intensity, coalesce(string_agg(e.d, ',' ORDER BY e.s DESC, e.i) FILTER (e.s >= {real(0.6)}), '') AS detected, 'rules-fallback' AS model FROM d GROUP BY doc_id""",
    "feedback_queue": f"""WITH {PROBE_SQL}, r AS (SELECT headline, list_extract(['agree', 'too_high', 'bad', NULL], CAST(doc_id % 4 + 1 AS INTEGER)) AS v, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE body END AS c FROM probe),
        x AS (SELECT coalesce(length(headline) BETWEEN 1 AND 500 AND v IN ('agree', 'too_high', 'too_low') AND (c IS NULL OR length(c) <= 1000), false) AS ok FROM r)
        SELECT count(*) FILTER (ok) AS queued, count(*) FILTER (ok) AS stamped, count(*) FILTER (NOT ok) AS refused FROM x""",
}

ORACLE |= {
    "word_pieces": f"""WITH RECURSIVE tok AS (SELECT doc_id, string_split(tokens, ' ') AS t, n_tokens FROM ({ORACLE["basic_tokens"]})),
        piece AS (SELECT id, p LIKE '##%' AS inside, CASE WHEN p LIKE '##%' THEN p[3:] ELSE p END AS body FROM (SELECT unnest([{", ".join(map(quoted, PIECES))}]) AS p, unnest(range({len(PIECES)})) AS id)),
        word AS (SELECT DISTINCT unnest(t) AS w FROM tok WHERE n_tokens > 0),
        cut(w, k, ids) AS (
            SELECT w, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM word WHERE length(w) <= 100
            UNION ALL SELECT w, k + max(length(body)), list_append(any_value(ids), arg_max(id, length(body))) FROM cut JOIN piece ON inside = (k > 0) AND starts_with(substr(w, k + 1), body) WHERE k < length(w) GROUP BY w, k
        ),
        coded AS (SELECT word.w, coalesce(ids, [1]) AS ids FROM word LEFT JOIN (SELECT w, ids FROM cut WHERE k = length(w)) c ON c.w = word.w),
        place AS (SELECT doc_id, unnest(t) AS w, unnest(range(len(t))) AS k FROM tok WHERE n_tokens > 0),
        flat AS (SELECT doc_id, flatten(list(ids ORDER BY k))[1:62] AS ids FROM place JOIN coded USING (w) GROUP BY doc_id),
        ends AS (SELECT doc_id, [2] || coalesce(flat.ids, []) || [3] AS ids FROM tok LEFT JOIN flat USING (doc_id))
        SELECT doc_id, array_to_string(ids || list_transform(range(64 - len(ids)), lambda i: 0), ' ') AS input_ids, array_to_string(list_transform(range(64), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ' ') AS attention_mask FROM ends""",
    "delivery_by_model": f"SELECT doc_id, verdict, n_windows, error FROM ({ORACLE['delivery_verdict']})",
    "sql_spans": ORACLE["technique_spans"],
    "sql_windows": ORACLE["body_windows"],
    "feedback_sliding": "SELECT strftime(date_trunc('day', ts) - to_days(k), '%Y-%m-%d') AS window_start, event_type, count(*) AS n FROM events, range(2) r(k) GROUP BY ALL",
    "feedback_sessions": """WITH g AS (SELECT *, coalesce(CAST(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 8 HOUR AS INTEGER), 0) AS cut FROM events), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
        SELECT user_id, epoch_us(min(ts)) AS begin_us, epoch_us(max(ts)) AS end_us, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""",
}

_SIDE = lambda k: f"regexp_replace(list_extract([{', '.join(quoted(x[k]) for x in SIDES)}], CAST(doc_id % {len(SIDES)} + 1 AS INTEGER)) || ' on this: ' || headline, {quoted('(?i)' + X.alternation(X.ENTITIES))}, '{X.MASK}', 'g')"

ORACLE |= {
    "entity_swap_invariance": f"""WITH {PROBE_SQL}, pa AS (SELECT doc_id, {_SIDE(0)} AS headline FROM probe), pb AS (SELECT doc_id, {_SIDE(1)} AS headline FROM probe), {scored('pa', 'sa')}, {scored('pb', 'sb')},
        x AS (SELECT doc_id, round({SCORE}, 6) AS score_a FROM sa), y AS (SELECT doc_id, round({SCORE}, 6) AS score_b FROM sb)
        SELECT doc_id, score_a, score_b, abs(score_a - score_b) <= 0.10 AS holds FROM x JOIN y USING (doc_id)""",
    "directional_lift": f"""WITH {PROBE_SQL}, hyped AS (SELECT doc_id, k AS device, replace(list_extract([{', '.join(map(quoted, DEVICES))}], k + 1), '{{b}}', headline) AS headline FROM probe, range({len(DEVICES)}) r(k)), {scored('probe', 'sp')}, {scored('hyped', 'sh')},
        x AS (SELECT doc_id, {SCORE} AS x FROM sp), y AS (SELECT doc_id, device, {SCORE} AS y FROM sh)
        SELECT doc_id, CAST(device AS INTEGER) AS device, round(y - x, 6) AS lift, round(y - x, 6) >= 0.05 AS holds FROM x JOIN y USING (doc_id)""",
    "archetype_order": f"""WITH {PROBE_SQL}, src AS (SELECT doc_id, k AS place, list_extract([{', '.join(map(quoted, OPENINGS))}], k + 1) || headline AS headline FROM probe, range({len(OPENINGS)}) r(k)), {scored('src')}, z AS (SELECT doc_id, place, round({SCORE}, 6) AS score FROM scored)
        SELECT doc_id, CAST(place AS INTEGER) AS place, score, score BETWEEN 0 AND 1 AS in_range, coalesce(score >= lag(score) OVER (PARTITION BY doc_id ORDER BY place), true) AS above FROM z""",
    "sample_tables": f"""WITH {LABELLED_SQL}, v AS (SELECT label, CASE WHEN i = 0 THEN headline ELSE headline || ' — report ' || i END AS headline FROM labelled, range(25) r(i))
        SELECT label AS label_clickbait, count(*) AS n, count(DISTINCT headline) AS n_distinct, CAST(sum(length(headline)) AS BIGINT) AS n_chars FROM v GROUP BY label""",
}
