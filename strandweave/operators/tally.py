"""Characters counted inside tasks: a task adds up what it sees and sends on one row a slot, never one row a character."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Slots of all totals that a task holds before it sends them on.
HELD_SLOTS = 1 << 22
#: Characters that are counted at once, or those of one text: a character takes some thirty bytes on the way.
HELD_CHARACTERS = 1 << 20


def _characters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the number of characters of each text; null is empty."""
    column = column.fill_null("")
    codes = np.frombuffer("".join(column.to_pylist()).encode("utf-32-le"), np.uint32)
    return codes, pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of a part have at most HELD_CHARACTERS characters, or are one text."""
    for batch in batches:
        ends = np.cumsum(pc.utf8_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(ends):
            hi = max(int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + HELD_CHARACTERS, side="right")), lo + 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. within each text."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def cycle_totals(df: DataFrame, key: str, text: str) -> DataFrame:
    """(``key``, cycle, reads, code_sum): for each 1-based place of ``text`` how many rows reach it and the sum of its code points.

    Texts of any length take part where they have a character; null and empty ones nowhere. The totals of a task are vectors
    that grow with the longest text; they are summed once more over tasks."""
    kind = df.schema[key].dataType

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        arrow = pa.null()

        def flush():
            for value, sums in held.items():
                n = sums.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([value] * n, arrow), pa.array(np.arange(1, n + 1)), *[pa.array(x) for x in sums]],
                                                 names=[key, "cycle", "reads", "code_sum"])
            held.clear()

        for batch in _parts(batches, 1):
            arrow = batch.column(0).type
            named = batch.column(0).dictionary_encode(null_encoding="encode")
            own = named.indices.to_numpy(zero_copy_only=False)
            codes, sizes = _characters(batch.column(1))
            place, group = _within(sizes), np.repeat(own, sizes)
            for i, value in enumerate(named.dictionary.to_pylist()):
                on = group == i
                if not on.any():
                    continue
                reads = np.bincount(place[on])
                sums = np.stack([reads, np.bincount(place[on], weights=codes[on]).astype(np.int64)])
                before = held.get(value)
                if before is not None:
                    long, short = (before, sums) if before.shape[1] >= sums.shape[1] else (sums, before)
                    long[:, :short.shape[1]] += short
                    sums = long
                held[value] = sums
            if sum(v.shape[1] for v in held.values()) > HELD_SLOTS:
                yield from flush()
        yield from flush()

    schema = T.StructType([T.StructField(key, kind), *[T.StructField(c, T.LongType()) for c in ("cycle", "reads", "code_sum")]])
    per_task = df.select(key, text).mapInArrow(kernel, schema)
    return per_task.groupBy(key, "cycle").agg(F.sum("reads").alias("reads"), F.sum("code_sum").alias("code_sum"))


def character_counts(df: DataFrame, keys: list[str], text: str, name: str = "character", count: str = "n") -> DataFrame:
    """(keys, ``name``, ``count``): how often each character stands in the texts of a key. A text gives one row for each
    different character it has; null and empty texts give none."""
    fields = [T.StructField(k, df.schema[k].dataType) for k in keys]
    schema = T.StructType([*fields, T.StructField(name, T.StringType()), T.StructField(count, T.LongType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches, len(keys)):
            codes, sizes = _characters(batch.column(len(keys)))
            both = (np.repeat(np.arange(len(sizes)), sizes) << 21) | codes
            seen, n = np.unique(both, return_counts=True)
            row = pa.array(seen >> 21)
            letters = pa.array([chr(c) for c in (seen & ((1 << 21) - 1)).tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(row) for i in range(len(keys))], letters, pa.array(n.astype(np.int64))], names=schema.names)

    per_text = df.select(*keys, text).mapInArrow(kernel, schema)
    return per_text.groupBy(*keys, name).agg(F.sum(count).alias(count))
