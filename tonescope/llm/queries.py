"""The operators' queries over the driver's tables, with production parameters, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embed_dedup, html_extract, minhash, packing, piece_sampling, prefix_trie, quality, sharding, source_audit, token_orc, toxicity, url_rules, warc
from .common import Scratch, tokenizer_path

SHARDS = 8


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard and place, by exact splitters over doc_id (a null text: size 1, crc32 of nothing)."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.histogram_shards(rows, SHARDS, size=F.col("size"), tie=[F.col("size"), F.col("text_crc32")])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc.tokens_by_orc(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op2_html_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_extract.extract_main_text(pages(spark, sf_dir), keep=["page_id", "url"])
    return rows.withColumn("n_chars", F.length("text").cast("long"))


def op3_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_pieces(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), digest=True)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = quality.score_quality(docs, quality.train_quality(docs, labels(spark, sf_dir)), keep=["doc_id"])
    return rows.select("doc_id", *quality.COUNTS, "base_failed", "kept", "quality_score")


def op6_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), minhash.NearDup(percent=85, shingle=3))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and base rules of op4_quality_rules alone, which SQL can express."""
    rows = quality.score_quality(documents(spark, sf_dir), quality.KEEPS_ALL, keep=["doc_id"])
    return rows.select("doc_id", *quality.COUNTS, "base_failed")


def packed(docs: DataFrame) -> DataFrame:
    pieces = Scratch(docs.sparkSession)(packing.token_pieces(docs, tokenizer_path("byte_bpe_50k.json"), end_id=0, length=2048))
    return packing.pack(pieces, length=2048).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(pages(spark, sf_dir), min_bytes=0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train_toxicity(docs, labels(spark, sf_dir))
    rows = toxicity.score_toxicity(docs, model, keep=["doc_id"])
    return rows.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op10_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), embed_dedup.FlatGraph(threshold=0.98))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_audit(documents(spark, sf_dir))


#: What the query blocks and allows.
URL_RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame([url_rules.parse_rule(*r) for r in URL_RULES], url_rules.RULES)
    return url_rules.judge_urls(pages(spark, sf_dir), rules, keep=["page_id"])


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {
    "op1_histogram_shards": op1_histogram_shards,
    "op2_html_boosted": op2_html_boosted,
    "op3_sampled_pieces": op3_sampled_pieces,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_orc": op5_token_orc,
    "op6_minhash_odd_sketch": op6_minhash_odd_sketch,
    "op7_pack_sequences": op7_pack_sequences,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_flat_graph": op10_flat_graph,
    "op11_source_divergence": op11_source_divergence,
    "op12_url_filters": op12_url_filters,
    "op13_prefix_trie": op13_prefix_trie,
    "quality_counts": quality_counts,
}

WORD = r"[^\x20\x09-\x0D]+"
#: From link (a, b), a < b, and node (id): the smallest id that each reaches.
REACHED = """both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
        reach(id, m) AS (SELECT id, id FROM node UNION SELECT l.b, r.m FROM reach r JOIN both_ways l ON l.a = r.id WHERE r.m < l.b),
        component AS (SELECT id, min(m) AS component_id FROM reach GROUP BY id)"""

SQL: dict[str, str] = {
    "op6_minhash_odd_sketch": f"""
        WITH RECURSIVE t AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
        sh AS (
            SELECT id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END) AS s
            FROM t
        ),
        node AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
        pair AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY ALL),
        link AS (SELECT a, b FROM pair JOIN node x ON x.id = a JOIN node y ON y.id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        {REACHED}
        SELECT t.id AS doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, t.id) AS component_id, coalesce(component_id, t.id) = t.id AS kept
        FROM t LEFT JOIN node USING (id) LEFT JOIN component USING (id)
    """,
    "op10_flat_graph": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        node AS (SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v WHERE len(list_filter(e, lambda x: x <> 0)) > 0),
        link AS (SELECT x.id AS a, y.id AS b FROM node x JOIN node y ON x.label = y.label AND len(x.e) = len(y.e) AND x.id < y.id WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.98),
        {REACHED},
        degree AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
        SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
        FROM embeddings LEFT JOIN component ON component.id = vec_id LEFT JOIN degree ON degree.id = vec_id
    """,
    "quality_counts": f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
        l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l FROM t),
        g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
        c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS k FROM g),
        p AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM c, range(3) r(d) WHERE k > 1 GROUP BY doc_id),
        n AS (
            SELECT t.doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words
            FROM t JOIN l USING (doc_id) LEFT JOIN p USING (doc_id)
        )
        SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM n
    """,
    "op11_source_divergence": r"""
        WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM w GROUP BY ALL HAVING count(DISTINCT id) >= 10),
        v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, sum(n) AS n FROM kept GROUP BY lang),
        c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        grp AS (SELECT DISTINCT lang, source FROM d),
        tot AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM grp LEFT JOIN c USING (lang, source) GROUP BY ALL),
        p AS (
            SELECT lang, source, kept.term, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (tot.n + 2 * v.v) AS p, coalesce(c.n, 0) AS n
            FROM tot JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
        ),
        q AS (SELECT lang, term, 1 + (1000000000 * (kept.n + 2)) // (v.n + 2 * v.v) AS q FROM kept JOIN v USING (lang)),
        pair AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
        every AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value FROM grp x JOIN grp y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pair ON pair.lang = x.lang AND pair.source = x.source AND pair.item = y.source),
        term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM every UNION ALL FROM term))
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
    "op12_url_filters": f"""
        WITH u AS (SELECT page_id, coalesce(url, '') AS url, strpos(coalesce(url, ''), '://') AS k FROM pages),
        p AS (
            SELECT page_id, CASE WHEN k > 0 THEN translate(regexp_extract(substr(url, k + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
                CASE WHEN k > 0 THEN regexp_extract(regexp_replace(substr(url, k + 3), '^[^/?#]*', ''), '^[^?#]*') ELSE '' END AS path
            FROM u
        ),
        r(h, x, v) AS (VALUES {", ".join(f"('{h}', '/{x}', '{v}')" for h, x, v in ((*r.split("/", 1), v) for r, v in URL_RULES))}),
        m AS (SELECT page_id, arg_max(h || x, length(h) * 1000 + length(x)) AS rule, arg_max(v, length(h) * 1000 + length(x)) AS verdict FROM p JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, x) GROUP BY page_id)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
    """,
    "op13_prefix_trie": f"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL),
        crc AS (
            SELECT DISTINCT conv_id, (4294967295 - list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT))), lambda crc, d:
                list_reduce(list_prepend(xor(crc, d), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h FROM t
        ),
        o AS (SELECT conv_id, list(t ORDER BY place) AS l FROM t GROUP BY conv_id),
        seq AS (SELECT c.conv_id, coalesce(b.l[1 : h], []) || o.l[h + 1 :] AS l FROM crc c JOIN o USING (conv_id) LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
        m AS (SELECT conv_id, d, l[1 : d] AS p, len(l) = d AS ends FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM seq)),
        node AS (
            SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
                CASE WHEN d > 0 THEN len(regexp_extract_all(p[d].x, '{WORD}')) ELSE 0 END AS w FROM m GROUP BY d, p
        ),
        kids AS (SELECT d - 1 AS d, p[1 : d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
        up AS (SELECT k AS d, node.p[1 : k] AS p, CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * w AS saved FROM node LEFT JOIN kids USING (d, p), range(100) r(k) WHERE k <= node.d),
        roll AS (SELECT d, p, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM up GROUP BY ALL)
        SELECT x.conv_id, x.d AS depth, a.conv_id AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
        FROM node x JOIN roll USING (d, p) LEFT JOIN kids USING (d, p) LEFT JOIN node a ON a.d = x.d - 1 AND a.p = x.p[1 : x.d - 1]
    """,
    "op8_warc": """
        WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
        d AS (
            SELECT page_id, payload_bytes,
                array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                    1 + ((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31), 1)), '') AS payload_digest
            FROM p
        ),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> first THEN first END AS refers_to
        FROM f
    """,
}
