"""First-per-group, ordinals and shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import measured_join
from .running import ordinal

#: Ranges of values that an order is cut into.
RANGES = 256


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in ``order``; end the order with an ordinal to settle ties.

    ``row_number() = 1`` lets Spark keep one row per group in each map task before the shuffle
    (WindowGroupLimit), so a hot group ships one row per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def share_of_total(df: DataFrame, count: str, name: str = "percent", by: list[str] | None = None,
                   digits: int | None = None) -> DataFrame:
    """Percent of the group total, or without groups of the total of all rows, which is a scalar subquery: no task sees all rows."""
    total = F.sum(count).over(Window.partitionBy(*by)) if by else df.agg(F.sum(count)).scalar()
    pct = 100.0 * F.col(count) / total
    return df.withColumn(name, F.round(pct, digits) if digits is not None else pct)


def evenly_spaced(df: DataFrame, keys: list[str], value: str, tie: str, n: int, tie_width: int = 1_000_000) -> DataFrame:
    """Per group, ``n`` rows evenly spread over the order of ``value`` (all rows when fewer).

    Picks ranks ``round_half_even(1 + i*(N-1)/(n-1))``. Ranks come from the bucketed ordinal: buckets are ranges between
    approximate quantiles of the group, and a value that is such a quantile is cut further by ``tie``. So neither many
    distinct values nor one frequent value sort a large group in one task.
    """
    live = df.filter(F.col(value).isNotNull())
    points = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    cuts = live.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(value, points, F.lit(10 * RANGES))).alias("_cuts"))
    at_cut = F.array_contains("_cuts", F.col(value))
    below = F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    live = measured_join(live, cuts, keys).withColumn("_b", F.struct(below.alias("i"), at_cut.alias("cut"), F.when(at_cut, F.floor(F.col(tie) / tie_width)).otherwise(0).alias("t"))).drop("_cuts")
    ranked = ordinal(live, keys, "_b", [value, tie], "rank")
    sizes = live.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    if n == 1:
        ranks = F.array(F.lit(1).cast("long"))
    else:
        ranks = F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)),
            lambda i: F.bround(F.lit(1) + i * (F.col("_n") - 1) / (n - 1), 0).cast("long"),
        )
    picked = F.when(F.col("_n") <= n, F.lit(True)).otherwise(F.array_contains(ranks, F.col("rank").cast("long")))
    return measured_join(ranked, sizes, keys).filter(picked).drop("_b", "_n")


def _least_rows(df: DataFrame, bucket: Column, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows in ``order``, whose first key ``bucket`` (a few thousand values at most) does not contradict.

    Buckets are counted first; those before the one that reaches ``n`` are taken whole, and only the rows of that one are
    sorted, so no task merges ``n`` rows of every split. To the driver come one bucket and one count."""
    counts = df.groupBy(bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(F.asc_nulls_first("_b"))  # over counts of buckets
    cut = counts.select("_b", "_n", F.sum("_n").over(w).alias("_upto")).where(F.col("_upto") >= n).orderBy("_upto").first()
    if cut is None:
        return df
    at = F.lit(cut["_b"])
    edge = df.where(bucket.eqNullSafe(at)).orderBy(*order).limit(n - (cut["_upto"] - cut["_n"]))
    if cut["_b"] is None:
        return edge
    return df.where(bucket.isNull() | (bucket < at)).unionByName(edge)


def first_rows(df: DataFrame, key: str, n: int, ties: list[str] | None = None) -> DataFrame:
    """A pilot: the first ``n`` rows in the order of the number ``key`` (nulls first) and ``ties``; all rows when fewer."""
    ends = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
    width = ((ends["hi"] or 0) - (ends["lo"] or 0)) / 4096 or 1
    bucket = F.floor((F.col(key) - F.lit(ends["lo"] or 0)) / F.lit(float(width)))
    return _least_rows(df, bucket, [F.asc_nulls_first(c) for c in [key, *(ties or [])]], n)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """A reproducible uniform sample of ``n`` rows: those of least MD5 of seed and row key; all rows when fewer."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    return _least_rows(df, F.substring(digest, 1, 3), [digest, F.col(key)], n)


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Linear-interpolation (type 7) quantiles from value counts.

    Equal values are counted map-side, so the final step holds one entry per distinct value. Meant
    for scores, lengths and depths, whose distinct values are bounded.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    names = [f"p{int(round(p * 100)):02d}" for p in probs]
    q = counts.groupBy(*keys).agg(F.percentile(value, F.array(*[F.lit(float(p)) for p in probs]), F.col("_n")).alias("_q"))
    return q.select(*keys, *[F.col("_q")[i].alias(nm) for i, nm in enumerate(names)])
