"""Queries of the byte-level encoder and of vector codes; no SQL encodes bytes, so a test compares the former with a tokenizer library."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import bytepair, pivots
from .common import table
from .registry import query


@query("op12_byte_bpe")
def op12(spark, sf_dir):
    """Every document encoded, and decoded from its ids."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bytepair.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    out = bytepair.decode(encoded, ranks, carry=("doc_id", "ids"))
    digest = F.sha2(F.array_join("ids", " "), 256)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _round(k: int) -> str:
    """One assignment to the entries c{k} and the entries after it."""
    return f"""
a{k} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM (
  SELECT x.r, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c ON c.part = x.part AND c.place = x.place GROUP BY ALL) GROUP BY r, part),
c{k + 1} AS MATERIALIZED (SELECT part, entry, place, coalesce(n.v, c.v) AS v FROM c{k} c LEFT JOIN (
  SELECT part, entry, place, ((sum(x.v) - ((sum(x.v) % count(*)) + count(*)) % count(*)) // count(*)) AS v FROM x JOIN a{k} USING (r, part) GROUP BY ALL) n USING (part, entry, place))"""


VECTORS_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding, len(embedding) // 16 AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (
  SELECT r, i // w AS part, i % w AS place, floor(256 * embedding[i + 1]::DOUBLE)::HUGEINT AS v FROM (SELECT r, embedding, w, unnest(range(len(embedding))) AS i FROM kept)),
c0 AS MATERIALIZED (SELECT part, r AS entry, place, v FROM x WHERE r < 64),
{_round(0)},
{_round(1)},
{_round(2)},
book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, place)) AS h FROM c2),
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM kept JOIN coded USING (r) CROSS JOIN book
"""


@query("op13_vector_codes", VECTORS_SQL)
def op13(spark, sf_dir):
    """Codes of all vectors, their errors and those of their labels."""
    coded, books = pivots.compress(table(spark, sf_dir, "embeddings"))
    out = pivots.with_label_errors(coded)
    digest = F.lit(books.digest if books else None).cast("string")
    return out.select("vec_id", pivots.code(F.col("indexes")).alias("code"), "error", "label_error", digest.alias("codebooks_sha256"))
