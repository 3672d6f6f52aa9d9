"""Queries of the URL filter, the quality rules and the mixing of sources, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import mixing, quality, url_filter
from .common import table
from .registry import query

RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
#: Words in the names of hosts whose URLs are listed.
LISTED_HOSTS = "(casino-win|ads-track|free-bets|spam-farm|cheap-pills|adult-x)"

_RULE_ROWS = ", ".join(f"('{r}', '{v}')" for r, v in RULES)
URL_SQL = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule, verdict) AS (VALUES {_RULE_ROWS}),
split AS (SELECT rule, verdict, substr(rule, 1, instr(rule, '/') - 1) AS rh, substr(rule, instr(rule, '/')) AS rp FROM rules),
urls AS (SELECT DISTINCT host, path FROM hp),
fits AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM urls, split
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed
FROM (SELECT hp.*, regexp_matches(host, '{LISTED_HOSTS}') AS listed FROM hp) LEFT JOIN fits USING (host, path)
"""


@query("op1_url_filter", URL_SQL)
def op1(spark, sf_dir):
    """All pages against the five rules; listed are the canonical URLs seen on hosts of known bad names."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.url_parts(F.col("url"))
    listed = pages.select(host.alias("host"), path.alias("path")).where(F.col("host").rlike(LISTED_HOSTS))
    listed = listed.select(url_filter.canonical(F.col("host"), F.col("path")).alias("key"))
    rules = spark.createDataFrame(RULES, "rule string, verdict string")
    return url_filter.filter_urls(pages, rules, listed).drop("url")


ITERATIONS = 12


def quality_sql() -> str:
    """The same in SQL; the iterations follow each other as common table expressions."""
    names = list(quality.RULES)
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    vote = ", ".join(f"{sql} AS vote_{n}" for n, sql in quality.RULES.items())
    steps = ["m0 AS (SELECT " + ", ".join([f"{quality.START['prior']}::DOUBLE AS prior", *[f"{quality.START['accuracy']}::DOUBLE AS a_{n}" for n in names]]) + ")"]
    post = quality.posterior_sql("prior", {n: f"a_{n}" for n in names})
    new = quality.maximise_sql(names)
    for i in range(ITERATIONS):
        agg = ", ".join(f"{sql} AS {k if k == 'prior' else 'a_' + k}" for k, sql in new.items())
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT {agg} FROM (SELECT patterns.*, {post} AS q FROM patterns, m{i}))")
    return rf"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
base AS MATERIALIZED (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (
  SELECT rid, i, array_to_string(words[i:i + 4], ' ') AS w FROM (SELECT rid, words, unnest(range(1, len(words) - 3)) AS i FROM base)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM again, range(5) AS r(k) GROUP BY rid),
feats AS (
  SELECT b.rid, doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
         length(text) - length(translate(text, '{quality.SYMBOLS}', '')) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines, len(regexp_extract_all(text, '[.!?](\n|\z)|[.!?] '))::BIGINT AS n_sentences,
         length(text) - length(translate(text, '{upper}', '')) AS n_capitals, length(text) - length(translate(text, '{upper + upper.lower()}', '')) AS n_letters,
         len(list_distinct(list_intersect(words, [{stops}])))::BIGINT AS n_stop_words, length(text) - length(translate(text, '!', '')) AS n_shouts
  FROM base b LEFT JOIN rep USING (rid)),
voted AS MATERIALIZED (SELECT *, {vote} FROM feats),
patterns AS MATERIALIZED (SELECT {", ".join("vote_" + n for n in names)}, count(*)::DOUBLE AS n FROM voted GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {quality.BASE_FAILED} AS base_failed,
       NOT ({quality.BASE_FAILED}) AND {post} >= 0.5 AS kept, round({post}, 5) AS posterior
FROM voted, m{ITERATIONS}
"""


@query("op5_quality_rules", quality_sql())
def op5(spark, sf_dir):
    """Nine rules over every document; the model's verdict where the base rule holds."""
    out = quality.judge(table(spark, sf_dir, "documents"), iterations=ITERATIONS)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 5).alias("posterior"))


MIX_SQL = """
WITH sizes AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
rates AS (
  SELECT source, (pow(n_docs::DOUBLE, 0.5) / (SELECT sum(pow(n_docs::DOUBLE, 0.5)) FROM sizes)) * (SELECT sum(n_docs) FROM sizes) / n_docs AS rate FROM sizes),
terms AS (
  SELECT source, rate, k, CASE WHEN k = 0 THEN exp(-rate) ELSE exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate / k) END) OVER (PARTITION BY source ORDER BY k)) END AS p
  FROM (SELECT source, rate, unnest(range(0, (ceil(rate + 12 * sqrt(rate) + 30) + 1)::BIGINT)) AS k FROM rates)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
drawn AS (SELECT *, ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM documents),
copies AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, c.k + 1 AS copy FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND c.c <= d.u)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy,
       ('0x' || substr(md5('mix-1|order|' || coalesce(doc_id::VARCHAR, '') || '|' || copy), 1, 15))::BIGINT AS shuffle_key
FROM copies
"""


@query("op10_source_mixing", MIX_SQL)
def op10(spark, sf_dir):
    """All documents, sources weighted by the square root of their size, in the order of a global shuffle."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.target_rates(docs)).drop("u", "rate")
