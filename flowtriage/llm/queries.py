"""The operators of this folder over the given tables, with the same result in SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from flowtriage.llm import bpe, decisionlist, divergence, exactdedup, hmm, langid, linecrf, linededup, mixing, simhash, substrings, urlfilter, variants
from flowtriage.llm.common import crc_mod, documents, tokenizer_path

QUERIES, ORACLES = {"pipeline": corpus_pipeline.run}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS body, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS words FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS weight FROM s),
o AS (
  SELECT *, sum(words) OVER () AS all_words,
         coalesce(sum(words) OVER (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS words_before,
         sum(weight) OVER (ORDER BY words / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left
  FROM w),
f AS (SELECT *, 4 * words * weight_left < weight * (3 * all_words - 4 * words_before) AS stops FROM o),
l AS (
  SELECT (1.5::DOUBLE * max(all_words)::DOUBLE - 2.0::DOUBLE * coalesce(sum(words) FILTER (stops), 0)::DOUBLE)
         / coalesce(sum(weight) FILTER (NOT stops), 0)::DOUBLE AS level
  FROM f),
t AS (SELECT source, words::BIGINT AS source_size, least(words::DOUBLE * 2.0::DOUBLE, weight::DOUBLE * level) AS target FROM f, l),
r AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '') || '|' || body), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS drawn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


@query(MIX_SQL)
def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix of all sources takes of each document."""
    planned = mixing.mix_plan(documents(spark, sf_dir))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


LINES_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT doc_id, r, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS holder FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT r) >= 3),
m AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.holder AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


@query(LINES_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without lines that three or more documents share."""
    cleaned = linededup.drop_common_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER (PARTITION BY body ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(body) AS text_sha256
FROM n
"""


@query(EXACT_SQL)
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one of its equals that stays."""
    return exactdedup.exact_groups(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_groups(documents(spark, sf_dir))


@query()
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text encoded and decoded again."""
    path = tokenizer_path()
    ids = bpe.encode(documents(spark, sf_dir).select("doc_id", "text"), path).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text and the verdict of base and learned rules."""
    docs = documents(spark, sf_dir)
    rules = decisionlist.learned_rules(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return decisionlist.judge(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query()
def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels of four ids in five."""
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = linecrf.learned_field(docs, labels.filter(crc_mod(F.col("doc_id"), 5) != 0))
    return linecrf.quality(docs, field).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


@query()
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two ids in three."""
    docs = documents(spark, sf_dir)
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    identifier = langid.learn(docs.filter(~held_out))
    return langid.identify(docs, identifier).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


@query()
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urlfilter.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query()
def op6_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document, learned from six ids in seven."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = crc_mod(F.col("doc_id"), 7) == 2
    language = hmm.learn(docs.filter(~held_out))
    return hmm.score(docs, language).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query()
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, some with a letter lost, with the more frequent words that are one edit away."""
    return variants.variants(variants.word_counts(documents(spark, sf_dir), slip=31))


SUBSTRING_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
w AS (SELECT r, k, unnest(words) AS word, generate_subscripts(words, 1) AS pos, words FROM d),
s AS (SELECT r, k, pos, array_to_string(list_slice(words, pos, pos + 12), ' ') AS win FROM w WHERE pos + 12 <= len(words)),
f AS (SELECT win, min(k) AS least FROM s GROUP BY win),
h AS (SELECT r, pos FROM s JOIN f USING (win) WHERE least < k),
c AS (
  SELECT w.r, w.word, w.pos,
         coalesce(max(h.pos) OVER (PARTITION BY w.r ORDER BY w.pos ROWS BETWEEN 12 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM w LEFT JOIN h ON w.r = h.r AND w.pos = h.pos),
g AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS kept
  FROM c GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""


@query(SUBSTRING_SQL)
def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without passages that a document of smaller id has."""
    cleaned = substrings.drop_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT lang, source, r, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n_lang FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
v AS (SELECT lang, count(*) AS terms, sum(n_lang) AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT s.lang, s.source, coalesce(any_value(v.terms), 0) AS terms, coalesce(any_value(v.total), 0) AS lang_total, coalesce(sum(c.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) s LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY s.lang, s.source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.terms)::HUGEINT AS p,
         1 + 1000000000::HUGEINT * (k.n_lang + 2) // (g.lang_total + 2 * g.terms)::HUGEINT AS q
  FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON a.lang = s.lang AND a.source = s.source AND b.source = s.item
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value,
       (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM f QUALIFY part = 'pair' OR rank <= 10
"""


@query(DIVERGENCE_SQL)
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source of a language is from the others, and the terms that set it apart."""
    return divergence.audit(documents(spark, sf_dir))
