"""Queries of the two passage operators, with their SQL."""

from __future__ import annotations

from . import substrings, suffixes
from .common import table
from .registry import query

WORDS_SQL = r"""
WITH base AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (SELECT rid, doc_id, i, array_to_string(words[i:i + 12], ' ') AS w FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM base)),
marked AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY w) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT rid, i + k AS p FROM marked, range(13) AS r(k)),
units AS (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM base),
kept AS (SELECT rid, string_agg(word, ' ' ORDER BY p) AS text FROM units u ANTI JOIN gone g USING (rid, p) GROUP BY rid),
counts AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM base LEFT JOIN counts c USING (rid) LEFT JOIN kept k USING (rid)
"""

BYTES_SQL = """
WITH base AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT rid, i, md5(substr(h, 2 * i + 1, 800)) AS w FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 399)) AS i FROM base)),
marked AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY w) AS n FROM starts) WHERE n > 1),
runs AS (
  SELECT rid, min(i) AS a, max(i) + 400 AS z FROM (
    SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM (
      SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 400 THEN 0 ELSE 1 END AS new FROM marked)) GROUP BY rid, run),
shorter AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY w) AS n FROM (
  SELECT rid, i, md5(substr(h, 2 * i + 1, 400)) AS w FROM (SELECT rid, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM base))) WHERE n > 1),
longest AS (SELECT rid, max(size) AS longest FROM (SELECT rid, max(i) + 200 - min(i) AS size FROM (
  SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS run FROM (
    SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM shorter)) GROUP BY rid, run) GROUP BY rid),
edges AS (SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before, lead(a) OVER (PARTITION BY rid ORDER BY a) AS following FROM runs),
kept AS (
  SELECT e.rid, string_agg(substr(h, 2 * before + 1, 2 * (a - before)) || CASE WHEN following IS NULL THEN substr(h, 2 * z + 1) ELSE '' END, '' ORDER BY a) AS rest,
         sum(z - a) AS removed, count(*) AS n FROM edges e JOIN base USING (rid) GROUP BY e.rid)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256, coalesce(longest, 0)::BIGINT AS longest_repeat
FROM base LEFT JOIN kept USING (rid) LEFT JOIN longest USING (rid)
"""


@query("op4_substring_dedup", WORDS_SQL)
def op4(spark, sf_dir):
    """Windows of 13 words over all documents."""
    return substrings.remove_repeated_words(table(spark, sf_dir, "documents"))


@query("op7_suffix_array_dedup", BYTES_SQL)
def op7(spark, sf_dir):
    """Strings of 400 bytes over all documents; every copy goes. Repeats of 200 bytes or more, as the pipeline removes, are measured beside."""
    return suffixes.remove_repeated_bytes(table(spark, sf_dir, "documents"), keep_first=False, least=200)
