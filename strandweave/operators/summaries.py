"""Counts, shares, crosstabs, checks and report lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import share_of_total


def class_counts(df: DataFrame, by: list[str], count: str = "n", digits: int = 1) -> DataFrame:
    """Count per class and percent of all rows."""
    return share_of_total(df.groupBy(*by).agg(F.count(F.lit(1)).alias(count)), count, digits=digits)


def conditional_sums(df: DataFrame, flags: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*[F.count_if(c).alias(k) for k, c in flags.items()])


def crosstab(df: DataFrame, row: str, column: str, count: str = "n") -> DataFrame:
    """Two-way counts in long form; null is a level of its own."""
    return df.groupBy(row, column).agg(F.count(F.lit(1)).alias(count))


def joined_classes(df: DataFrame, key: str, value: str, order: Column, sep: str = ";") -> DataFrame:
    """Distinct values per key, joined in order of first appearance (one entry per distinct value)."""
    first = df.groupBy(key, value).agg(F.min(order).alias("_o"))
    rows = F.array_sort(F.collect_list(F.struct("_o", value)))
    return first.groupBy(key).agg(F.array_join(F.transform(rows, lambda r: r[value]), sep).alias("classes"))


def value_lists(df: DataFrame, by: list[str], values: dict[str, str], sep: str = "/") -> DataFrame:
    """Row count, and sorted distinct value lists, per group."""
    first = df.groupBy(*by, *values).agg(F.count(F.lit(1)).alias("_n"))
    return first.groupBy(*by).agg(
        F.sum("_n").alias("n"),
        *[F.array_join(F.array_sort(F.collect_set(c)), sep).alias(a) for c, a in values.items()],
    )


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def metric_lines(metrics: DataFrame, width: int = 40) -> DataFrame:
    """(section, metric, value) rows -> text lines for a report."""
    return metrics.select(
        F.concat(F.lit("["), "section", F.lit("] "), F.rpad("metric", width, "."), F.lit(" "), F.col("value").cast("string")).alias("value")
    )
