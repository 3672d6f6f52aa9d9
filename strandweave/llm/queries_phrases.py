"""Query of phrase mining, with its SQL."""

from __future__ import annotations

from . import phrases
from .common import table
from .registry import query

PHRASES_SQL = r"""
WITH pieces AS MATERIALIZED (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS MATERIALIZED (
  SELECT lang, k, w[i:i + k - 1] AS g, count(*) AS f FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) AS r(k)) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, g, f AS a FROM grams WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.lang, c.k, c.g, c.a, cut, x.f AS l, y.f AS r, 2000000 * c.a // (x.f + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand) c
  JOIN grams x ON x.lang = c.lang AND x.g = c.g[1:cut] JOIN grams y ON y.lang = c.lang AND y.g = c.g[cut + 1:]),
best AS (SELECT lang, k, g, a, arg_min(l, (score, cut)) AS l, arg_min(r, (score, cut)) AS r, min(score) AS score FROM cuts GROUP BY ALL),
inner_parts AS (SELECT lang, a, unnest([g[s:s + m - 1] FOR s IN range(1, k - m + 2)]) AS g FROM (SELECT *, unnest(range(2, k)) AS m FROM cand)),
kept AS (SELECT b.* FROM best b WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.lang = b.lang AND i.g = b.g AND 100 * i.a >= 80 * b.a)),
ranked AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op11_phrase_mining", PHRASES_SQL)
def op11(spark, sf_dir):
    """The first 2000 phrases of each language."""
    found, totals = phrases.collocations(table(spark, sf_dir, "documents"))
    return phrases.top_phrases(found, totals)
