"""Running aggregates that survive a hot key.

``Window.partitionBy(key)`` sorts each key in one task. A key that holds a third of the rows would
then be one task's work. Here the order is cut into buckets: rows are scanned inside
``(key, bucket)``, bucket totals are scanned per key, and the total of all earlier buckets is
added to the local value. The result equals the plain window for any monotone bucket expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_FN = {"sum": F.sum, "max": F.max, "min": F.min}


def running(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str, fn: str, value: Column,
            inclusive: bool = True) -> DataFrame:
    """Add ``name``: ``fn`` of ``value`` over all rows of the key up to this one.

    ``bucket`` is a column that never decreases along ``order`` within a key. Keys and bucket must
    not be null. ``inclusive=False`` leaves the current row out (null, or 0 for sums, on the first).
    """
    agg = _FN[fn]
    end = Window.currentRow if inclusive else -1
    local = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, end)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    valued = df.withColumn("_v", value)
    carry = (
        valued.groupBy(*keys, bucket)
        .agg(agg("_v").alias("_t"))
        .select(*keys, bucket, agg("_t").over(earlier).alias("_carry"))
    )
    out = valued.withColumn("_l", agg("_v").over(local)).join(carry, [*keys, bucket], "left")
    if fn == "sum":
        combined = F.coalesce(F.col("_l"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0))
    elif fn == "max":
        combined = F.greatest("_l", "_carry")
    else:
        combined = F.least("_l", "_carry")
    return out.withColumn(name, combined).drop("_v", "_l", "_carry")


def ordinal(df: DataFrame, keys: list[str], bucket: str, order: list[str], name: str) -> DataFrame:
    """1-based row number per key, without one task per key. ``order`` should be unique in the key."""
    local = Window.partitionBy(*keys, bucket).orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        df.groupBy(*keys, bucket)
        .agg(F.count(F.lit(1)).alias("_t"))
        .select(*keys, bucket, F.sum("_t").over(earlier).alias("_carry"))
    )
    return (
        df.withColumn("_l", F.row_number().over(local))
        .join(carry, [*keys, bucket], "left")
        .withColumn(name, F.col("_l") + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_l", "_carry")
    )
