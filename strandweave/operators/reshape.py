"""Long/wide reshaping, spines, packed coordinate lists, unions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def positional_explode(df: DataFrame, keys: list[str], seq: str, start: str, position: str = "position",
                       residue: str = "aa") -> DataFrame:
    """One row per residue with its absolute position."""
    return df.select(*keys, F.col(start).alias("_st"), F.posexplode(F.split(F.col(seq), "")).alias("_i", residue)).select(
        *keys, (F.col("_st") + F.col("_i")).alias(position), residue
    )


def mismatch_explode(df: DataFrame, keys: list[str], a: str, b: str, start: str | None = None) -> DataFrame:
    """One row per differing character of two equal-length strings."""
    rows = F.posexplode(F.arrays_zip(F.split(F.col(a), "").alias("x"), F.split(F.col(b), "").alias("y")))
    first = F.col(start) if start else F.lit(1)
    return (
        df.filter(F.length(a) == F.length(b))
        .select(*keys, first.alias("_st"), rows.alias("_i", "_p"))
        .select(
            *keys,
            (F.col("_i") + 1).alias("index"),
            (F.col("_st") + F.col("_i")).alias("position"),
            F.col("_p.x").alias("residue_a"),
            F.col("_p.y").alias("residue_b"),
        )
        .filter(F.col("residue_a") != F.col("residue_b"))
    )


def pivot_positions(df: DataFrame, keys: list[str], position: str, value: str, positions: list[int], prefix: str = "pos_",
                    order: str | None = None) -> DataFrame:
    """Wide matrix of the first value per position; columns are listed, so no extra job finds them."""
    pick = lambda p: (
        F.min_by(F.when(F.col(position) == p, F.col(value)), F.when(F.col(position) == p, F.col(order)))
        if order
        else F.min(F.when(F.col(position) == p, F.col(value)))
    )
    return df.groupBy(*keys).agg(*[pick(p).alias(f"{prefix}{p}") for p in positions])


def spine(df: DataFrame, keys: list[str], low: Column, high: Column, position: str = "position") -> DataFrame:
    """Every position low..high for each key row."""
    return df.select(*keys, F.explode(F.sequence(low, high)).alias(position))


def with_levels(spark, levels: list, name: str, counts: DataFrame, count: str) -> DataFrame:
    """Counts for every level of a fixed list, 0 where absent. Levels are parameters, hence tiny."""
    base = spark.range(1).select(F.posexplode(F.array(*[F.lit(v) for v in levels])).alias("level_order", name))
    return base.join(counts, name, "left").withColumn(count, F.coalesce(F.col(count), F.lit(0)))


def pack(segments: Column, field: str, sep: str = ";") -> Column:
    """Array of structs -> text list, for CSV only."""
    return F.array_join(F.transform(segments, lambda s: s[field].cast("string")), sep)


def unpack(text, sep: str = ";") -> Column:
    """Text list -> integer array; entries that are no numbers are dropped."""
    t = text if isinstance(text, Column) else F.col(text)
    ints = F.transform(F.split(t, sep), lambda x: F.trim(x).try_cast("int"))
    return F.filter(ints, lambda x: x.isNotNull())


def union_all(frames: list[DataFrame], allow_missing: bool = False) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), frames)
