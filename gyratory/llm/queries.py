"""Registered queries of the operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gyratory.llm import decontaminate, exact_copies, golay_simhash, jaccard_join, kd_shards, line_index, passage_quality, raking, samples, severity, source_audit, token_alignment, token_spans, url_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: URL rules: host, path, action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    "op4_exact_copies",
    f"""
    WITH d AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_copies(table(spark, sf_dir, "documents"))


@query(
    "op6_url_rules",
    r"""
    WITH p AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages),
    r(h, p, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow'))
    SELECT page_id, host, path,
      (SELECT arg_max(h || r.p, length(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)) AS rule,
      coalesce((SELECT arg_max(action, length(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)), 'allow') AS verdict
    FROM p
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


@query("op8_golay_simhash")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = golay_simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query(
    "op9_line_index",
    f"""
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
        unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS no FROM documents),
    k AS (SELECT *, trim({_LOWER.replace("text", "line")}, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
    f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
    SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
      sha256(coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (f.key IS NULL), '')) AS kept_sha256
    FROM k LEFT JOIN f USING (key) GROUP BY doc_id
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_index.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_length=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    "op10_phrase_index",
    f"""
    WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ')
        FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS phrase FROM b WHERE len(w) > 0),
    d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    g AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest([array_to_string(w[i:i + n - 1], ' ') FOR i IN range(1, len(w) - n + 2)]) AS phrase
        FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
    hit AS (SELECT doc_id, i, n, item_id FROM g JOIN win USING (n, phrase)),
    wordhit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY doc_id),
    item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN wordhit USING (doc_id) LEFT JOIN item USING (doc_id)
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_phrases(docs, table(spark, sf_dir, "benchmark"), size=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


@query("op1_section_tokens")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_spans.section_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "section", "start", "end", F.col("tokens").cast("long").alias("tokens"), "crossing", "doc_tokens")


@query("op2_kd_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Shares of the mixture: sources by a flattened natural share, languages and topics by name.
MIX = {"source": 0.7, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, "topic": {"legal": 0.1, "contact": 0.05}}
TOPICS = {"legal": ["icensed under", "All rights reserved", "opyright"], "contact": ["@"], "tabular": [" | "], "markup": ["</", "{", "}"]}


@query("op3_raking")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = raking.mix_documents(table(spark, sf_dir, "documents"), MIX, fraction=0.5, topic=raking.topic_of(F.col("text"), TOPICS))
    return mixed.withColumn("probability", F.round("probability", 6))


@query("op5_passage_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = passage_quality.quality(passage_quality.fit_quality(docs, table(spark, sf_dir, "labels")), spark)
    scored = docs.select("doc_id", samples.held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op7_severity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    score = severity.severity(severity.fit_severity(docs, table(spark, sf_dir, "labels")), spark)
    scored = docs.select("doc_id", samples.held_out(F.col("doc_id")).alias("held_out"), score("text").alias("s"))
    return scored.select("doc_id", "held_out", "s.severity", "s.toxicity", "s.grade", (F.col("s.toxicity") >= severity.REJECT).alias("toxic"))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_tokens(table(spark, sf_dir, "documents"))


_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query(
    "op12_source_divergence",
    f"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_TERMS} AS w FROM documents),
    t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
    cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, v
        FROM g JOIN k ON g.lang = k.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    p AS (SELECT lang, source, term, n, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM cell),
    l AS (SELECT lang, term, v, sum(n) AS n FROM cell GROUP BY ALL),
    q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM l),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
        FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source
        LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
    term AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
    WHERE part = 'pair' OR rank <= 50
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.source_divergence(table(spark, sf_dir, "documents"))


@query("op13_jaccard_join")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))
