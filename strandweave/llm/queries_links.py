"""Queries of the two operators on links, with their SQL."""

from __future__ import annotations

from . import covertree, minhash
from .common import table
from .registry import query

_COMPONENTS = """
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (SELECT DISTINCT a, a FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON r.other = e.a),
comp AS (SELECT node, min(other) AS c FROM reach GROUP BY node)
"""

MINHASH_SQL = rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_sets AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS MATERIALIZED (
  SELECT a, b FROM both_sets JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
{_COMPONENTS}
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id, coalesce(c, w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN comp ON node = w.doc_id
"""


@query("op9_minhash_near_dedup", MINHASH_SQL)
def op9(spark, sf_dir):
    """Documents linked at a similarity of 0.85 of their sets of five words."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


VECTOR_SQL = f"""
WITH RECURSIVE v AS MATERIALIZED (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)
  WHERE label IS NOT NULL AND e IS NOT NULL AND list_dot_product(e, e) > 0),
links AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id
  WHERE list_dot_product(x.e, y.e) / (x.norm * y.norm) >= 0.93),
{_COMPONENTS},
degree AS (SELECT a, count(*) AS n FROM edges GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN comp ON node = vec_id LEFT JOIN degree ON degree.a = vec_id
"""


@query("op2_embedding_near_dedup", VECTOR_SQL)
def op2(spark, sf_dir):
    """All vectors of equal labels with a cosine of 0.93."""
    return covertree.link_vectors(table(spark, sf_dir, "embeddings"))
