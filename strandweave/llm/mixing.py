"""Poisson replication: copies of a document follow a Poisson distribution whose mean is its source's target rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, unit_interval


def target_rates(docs: DataFrame, temperature: float = 0.5, scale: float = 1.0) -> DataFrame:
    """(source, n_docs, rate): mean copies of a document of each source.

    A source's share of the output is proportional to its number of documents to the power ``temperature``; the output
    has ``scale`` times the documents in all. Null is a source of its own."""
    sizes = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"))
    totals = sizes.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.pow(F.col("n_docs").cast("double"), F.lit(temperature))).alias("mass"))
    share = F.pow(F.col("n_docs").cast("double"), F.lit(temperature)) / F.col("mass")
    one = sizes.join(F.broadcast(totals), F.lit(True))  # the totals are a single row
    return one.select("source", "n_docs", (share * F.col("all_docs") * F.lit(scale) / F.col("n_docs")).alias("rate"))


def thresholds(rates: DataFrame) -> DataFrame:
    """(source, rate, cdf): the distribution function at 0, 1, 2, ... until what is above it is below 2**-53.

    Terms are built from logarithms, so that a large mean does not underflow at zero."""
    last = F.ceil(F.col("rate") + 12 * F.sqrt(F.col("rate")) + 30).cast("int")
    step = lambda s, k: F.struct((s["log_p"] + F.ln(F.col("rate") / k)).alias("log_p"))
    start = F.struct((-F.col("rate")).alias("log_p"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def grow(s, k):
        log_p = step(s, k)["log_p"]
        return F.struct(log_p.alias("log_p"), F.array_append(s["cdf"], F.element_at(s["cdf"], -1) + F.exp(log_p)).alias("cdf"))

    return rates.select("source", "rate", F.aggregate(F.sequence(F.lit(1), last), start, grow)["cdf"].alias("cdf"))


def mix(docs: DataFrame, rates: DataFrame, seed: str = "mix-1", max_small: int = 20_000, partitions: int | None = None) -> DataFrame:
    """``docs`` replicated and shuffled: copy (from 1), rate, u, shuffle_key; rows are in order of shuffle_key.

    A document's u in [0, 1) comes from the MD5 of seed and doc_id; its copies are the number of values of the distribution
    function that do not exceed u. The order is that of another hash of seed, doc_id and copy, made total by a range
    partitioning, so that it does not depend on the number of partitions.

    rates: (source, rate); sources without a rate, or with a rate of null or zero, get no copies. A null doc_id counts as an
    empty one; repeated rows get equal draws, and their copies stand next to each other. Null and empty texts pass through.
    An empty table gives an empty one. Columns copy, rate, u and shuffle_key of ``docs`` are replaced."""
    own = ("copy", "rate", "u", "shuffle_key")
    kept = [c for c in docs.columns if c not in own]
    table = small(thresholds(rates.where("rate > 0")).withColumnRenamed("source", "__source"), max_small)
    who = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    drawn = docs.select(*kept, unit_interval(F.concat_ws("|", F.lit(seed), who)).alias("u"))
    drawn = drawn.join(table, drawn["source"].eqNullSafe(table["__source"])).drop("__source")
    n = F.size(F.filter("cdf", lambda c: c <= F.col("u")))
    out = drawn.withColumn("__n", n).where("__n > 0").select(*kept, "u", "rate", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n").cast("long"))).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), who, F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    out = out.withColumn("shuffle_key", key)
    dealt = out.repartitionByRange(partitions, "shuffle_key") if partitions else out.repartitionByRange("shuffle_key")
    return dealt.sortWithinPartitions("shuffle_key")
