"""URL filter: a blocked Bloom filter of listed keys lets possible hits through to an exact hash join.

Rules and listed URLs form one list of keys ``host || path``. Each (host, path) yields the keys that could be
listed: every suffix of the host at a dot, with the path cut to every length that a rule's path has, and its own
canonical form. Only keys that pass the Bloom filter are shuffled to the exact join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, land, small

WORDS, WORD_BITS = 8, 32


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty when ``url`` is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Key of one URL for listing: no ``www.``, no default port, no trailing slashes; a space keeps it apart from rules."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    return F.concat(F.lit("= "), bare, F.regexp_replace(path, r"/+$", ""))


def _bits(key: Column) -> list[Column]:
    """One bit in each of the eight words of a block."""
    h = F.xxhash64(key, F.lit(17))
    places = [F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1), at).alias(f"w{i}") for i, at in enumerate(places)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def bloom(keys: DataFrame, bits_per_key: int = 16, max_blocks: int = 1_000_000) -> tuple[DataFrame, int]:
    """(filter, number of blocks) for the column ``key``: a row for each block that has bits.

    ``max_blocks`` bounds what is broadcast (40 bytes a block). A list too long for it makes the filter let more
    through, which costs time in the exact join and changes no result."""
    n = keys.count()
    blocks = max(1, min(max_blocks, -(-n * bits_per_key // (WORDS * WORD_BITS))))
    got = keys.select(_block(F.col("key"), blocks).alias("block"), *_bits(F.col("key")))
    return got.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)]), blocks


def possible(keys: DataFrame, filter_rows: DataFrame, blocks: int) -> DataFrame:
    """Rows of ``keys`` whose ``key`` may be listed. The filter's size is bounded by its number of blocks."""
    mine = [f"__b{i}" for i in range(WORDS)]
    probe = keys.withColumn("__block", _block(F.col("key"), blocks))
    probe = probe.select("*", *[b.alias(m) for b, m in zip(_bits(F.col("key")), mine, strict=True)])
    f = F.broadcast(filter_rows.withColumnRenamed("block", "__block"))
    hit = F.lit(True)
    for i, m in enumerate(mine):
        hit = hit & (F.col(f"w{i}").bitwiseAND(F.col(m)) == F.col(m))
    return probe.join(f, "__block").where(hit).drop("__block", *mine, *[f"w{i}" for i in range(WORDS)])


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame, url: str = "url",
                bits_per_key: int = 16, max_blocks: int = 1_000_000, small_rows: int = 10_000) -> DataFrame:
    """``pages`` with host, path, rule, verdict and listed.

    rules: (rule, verdict), a rule being a host followed by a path that starts with ``/``; it fits the host and all
    subdomains when the path starts with its own; the longest wins. A URL that no rule fits is blocked when its canonical
    form is in ``listed`` (column ``key``, see :func:`canonical`), else allowed.

    Null URLs and URLs without ``://`` have an empty host and path; no rule fits them and they are allowed. Repeated URLs
    are judged once and all get the verdict; repeated rules keep the smallest verdict. Empty ``pages``, ``rules`` or
    ``listed`` are fine. Columns of ``pages`` called host, path, rule, verdict or listed are replaced.
    """
    host, path = url_parts(F.col(url))
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "listed")]
    with_parts = pages.select(*kept, host.alias("host"), path.alias("path"))
    rules = rules.groupBy(F.col("rule").alias("key")).agg(F.min("verdict").alias("verdict"))
    listed = listed.where(F.col("key").isNotNull()).select("key", F.lit(None).cast("string").alias("verdict")).distinct()
    entries = land(rules.unionByName(listed), "url-list")
    filter_rows, blocks = bloom(entries, bits_per_key, max_blocks)
    # The different lengths of the rules' paths: at most the length of a URL.
    lengths = sorted(r[0] for r in rules.select(F.length(F.regexp_extract("key", r"^[^/]*(.*)$", 1)).alias("n")).distinct().collect() if r[0])

    seen = with_parts.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    cuts = [F.substring("path", 1, n) for n in lengths]
    keys = F.flatten(F.transform(tails, lambda t: F.array(*[F.when(F.length("path") >= n, F.concat(t, c)) for n, c in zip(lengths, cuts, strict=True)]))) if lengths else F.array().cast("array<string>")
    asked = seen.select("host", "path", F.explode(F.array_append(keys, canonical(F.col("host"), F.col("path")))).alias("key")).where("key is not null")
    hits = possible(asked, filter_rows, blocks).join(small(entries, small_rows), "key")
    is_rule = F.col("verdict").isNotNull()
    judged = hits.groupBy("host", "path").agg(
        F.max(F.when(is_rule, F.struct(F.length("key").alias("n"), "key", "verdict"))).alias("best"), F.max(~is_rule).alias("listed"))
    out = with_parts.join(judged, ["host", "path"], "left")
    listed = F.coalesce(F.col("listed"), F.lit(False))
    return out.select(*kept, "host", "path", F.col("best.key").alias("rule"),
                      F.coalesce(F.col("best.verdict"), F.when(listed, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                      listed.alias("listed"))
