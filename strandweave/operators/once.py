"""Evaluate costly expressions once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``withColumns`` for higher-order or otherwise costly expressions.

    The optimizer copies a projected expression into every filter that is pushed below it and into
    every later reference it inlines. Going through a one-element generator makes the results plain
    attributes, so each is computed once.
    """
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
