"""Query registry. A query names its output columns and types once; the same list casts the Spark
result and wraps the SQL, so both sides agree on names and types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _spark_col(name: str, kind: str):
    c = F.col(name)
    if kind == "s":
        return c.cast("string").alias(name)
    if kind == "i":
        return c.cast("long").alias(name)
    if kind == "b":
        return c.cast("boolean").alias(name)
    return F.round(c.cast("double"), int(kind[1:] or 4)).alias(name)


def _sql_col(name: str, kind: str) -> str:
    if kind == "s":
        return f"CAST({name} AS VARCHAR) AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "b":
        return f"CAST({name} AS BOOLEAN) AS {name}"
    return f"round(CAST({name} AS DOUBLE), {int(kind[1:] or 4)}) AS {name}"


def parse(cols: str) -> list[tuple[str, str]]:
    """``"pair_id s, n i, pct d2"`` -> [(name, kind)]; kinds: s text, i integer, b boolean, dN double."""
    return [tuple(c.split()) for c in cols.split(",")]


def query(name: str, cols: str, sql: str | None = None):
    """Register the decorated (spark, sf_dir) -> DataFrame under ``name``."""
    spec = parse(cols)

    def wrap(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark, sf_dir).select(*[_spark_col(n, k) for n, k in spec])
        if sql is not None:
            ORACLES[name] = f"SELECT {', '.join(_sql_col(n, k) for n, k in spec)} FROM (\n{sql.strip()}\n) AS result"
        return fn

    return wrap
