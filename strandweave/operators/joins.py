"""Equi-joins of many rows with few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a side that is broadcast; with rows of some hundred bytes, tens of MB.
BROADCAST_ROWS = 200_000
#: Parts over which each key is dealt where the small side is larger than that.
PARTS = 32


def measured_join(many: DataFrame, few: DataFrame, on: list[str], how: str = "inner", most: int = BROADCAST_ROWS, parts: int = PARTS) -> DataFrame:
    """``many`` joined with ``few`` (one row a key, or a few) without shuffling the rows of ``many`` on the bare key.

    ``few`` is counted up to ``most``. If it is not larger it is broadcast. Otherwise both sides meet on the key and a part: the
    rows of a key are dealt over the parts by a hash of the whole row, and ``few`` is there once for each part, so a key with
    a third of all rows is many tasks' work. ``how`` is inner, left, left_semi or left_anti.
    """
    if few.limit(most + 1).count() <= most:
        return many.join(F.broadcast(few), on, how)
    plain = [f.name for f in many.schema.fields if f.dataType.typeName() != "map"]
    dealt = many.withColumn("_part", F.pmod(F.xxhash64(*plain), F.lit(parts)).cast("int"))
    copies = few.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(copies, [*on, "_part"], how).drop("_part")
