"""Product codes of vectors, nearest entries found by LAESA pivots.

Each component x becomes floor(256 x); a vector is cut into 16 parts and each part position has a codebook of 64 entries, at
first the parts of the least 64 kept ids. A few fixed pivots per position, entries far from each other, are chosen once, and the
distance of every part to them is computed once and kept with the vector. In each round the distances of pivots to entries
give, by the triangle inequality, a lower bound of the distance of a part to each entry: entries are taken in the order of
their bounds and left out where the bound passes the least exact distance so far. Distances that decide are integers.

Sums of a round are added in tasks and by Spark, so that only a codebook comes to the driver.

Handling. Rows whose vector is null or holds null or non-finite components are dropped. Rows whose vector has another length
than that of the least kept id, or one that 16 does not divide, keep their place with a null code and error; so does the error
of a vector (and the sum of its label) that passes 64 bits. Repeated ids are rows of their own, in the order of the id, then
the vector; null ids come last. With fewer than 64 kept rows there are fewer entries; an empty table gives an empty result.
Other columns do not matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land

PARTS, ENTRIES, ROUNDS, PIVOTS = 16, 64, 2, 3
#: Components up to this size leave squared distances of parts of up to 2**14 components within 64 bits.
NARROW = 1 << 23
LIMB = 40
#: Labels whose sums are broadcast, a few MB; beyond it they are joined by the key.
LABELS = 200_000
ROWS = 2048


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 x) as integers, as Python integers where 64 bits might not do."""
    y = np.floor(x.astype(np.float64) * 256.0)
    if not y.size or np.abs(y).max() <= NARROW:
        return y.astype(np.int64)
    # A product that passes the range of doubles is formed with integers instead.
    exact = [int(v) if np.isfinite(v) else int(u) * 256 for v, u in zip(y.ravel(), x.ravel().tolist(), strict=True)]
    return np.array(exact, object).reshape(x.shape)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def doubles(d: np.ndarray) -> np.ndarray:
    """Integers as doubles; those beyond 2**1000 become infinite."""
    if d.dtype != object:
        return d.astype(np.float64)
    return np.array([float(v) if v < 1 << 1000 else np.inf for v in d.ravel()], np.float64).reshape(d.shape)


def roots(d: np.ndarray) -> np.ndarray:
    """Distances as floats, right to one part in 2**23."""
    with np.errstate(over="ignore"):
        return np.sqrt(doubles(d)).astype(np.float32)


def spread_out(entries: np.ndarray, n: int) -> list[int]:
    """Indexes of n entries: the first, then always the one farthest from those chosen."""
    if not len(entries):
        return []
    chosen, far = [0], squared(entries, entries[0])
    while len(chosen) < min(n, len(entries)):
        k = max(range(len(entries)), key=lambda i: (far[i], -i))
        chosen.append(k)
        far = np.minimum(far, squared(entries, entries[k]))
    return chosen


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each part, the lower index among equals.

    A bound is lowered by the rounding it may hold; an entry is left out only if its bound is above the best distance, so none
    of equal distance is lost.
    """
    n = len(parts)
    between = roots(squared(pivots[:, None, :], entries[None, :, :]))
    bound = np.zeros((n, len(entries)))
    for p in range(len(pivots)):
        one, other = to_pivots[:, p:p + 1].astype(np.float64), between[p].astype(np.float64)
        with np.errstate(invalid="ignore"):  # infinite distances bound nothing
            np.fmax(bound, np.abs(one - other) - (one + other) * 2.0**-22, out=bound)
    bound = bound * bound
    order = np.argsort(bound, axis=1, kind="stable")
    best = squared(parts, entries[order[:, 0]])
    index, rows = order[:, 0].copy(), np.arange(n)
    for k in range(1, len(entries)):
        entry = order[rows, k]
        rows = rows[bound[rows, entry] <= doubles(best[rows]) * (1 + 2.0**-48)]
        if not len(rows):
            break
        entry = order[rows, k]
        d = squared(parts[rows], entries[entry])
        better = (d < best[rows]) | ((d == best[rows]) & (entry < index[rows]))
        best[rows[better]], index[rows[better]] = d[better], entry[better]
    return index, best


@dataclass(frozen=True)
class Codebooks:
    """entries[part] is a matrix of integers; pivots[part] are some of the first entries, the same in all rounds."""

    entries: tuple[np.ndarray, ...]
    pivots: tuple[np.ndarray, ...]

    @property
    def digest(self) -> str:
        return sha256(",".join(str(int(v)) for e in self.entries for v in e.ravel()).encode()).hexdigest()

    def updated(self, sums: dict[tuple[int, int, int], int], counts: dict[tuple[int, int], int]) -> Codebooks:
        out = []
        for part, old in enumerate(self.entries):
            rows = [[sums[part, e, i] // counts[part, e] for i in range(old.shape[1])] if (part, e) in counts else old[e].tolist() for e in range(len(old))]
            narrow = all(abs(int(v)) <= NARROW for r in rows for v in r)
            out.append(np.array(rows, np.int64 if narrow else object).reshape(old.shape))
        return Codebooks(tuple(out), self.pivots)


def start(vectors: list[list[float]], parts: int = PARTS, pivots: int = PIVOTS) -> Codebooks:
    x = whole(np.array(vectors, np.float64))
    cut = tuple(x.reshape(len(vectors), parts, -1).transpose(1, 0, 2))
    return Codebooks(cut, tuple(c[spread_out(c, pivots)] for c in cut))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), width)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def assign(rows: DataFrame, books: Codebooks) -> DataFrame:
    """indexes array<int> and error (null where it passes 64 bits) added to rows of embedding and to_pivots."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def kernel(batches):
        own = shared.value
        parts, width = len(own.entries), own.entries[0].shape[1]
        for batch in _batches(batches):
            n = batch.num_rows
            x = whole(_matrix(batch.column("embedding"), parts * width)).reshape(n, parts, width)
            far = _matrix(batch.column("to_pivots"), parts * len(own.pivots[0])).reshape(n, parts, -1)
            found = [nearest(x[:, p], far[:, p], own.entries[p], own.pivots[p]) for p in range(parts)]
            index = np.stack([f[0] for f in found], axis=1).astype(np.int32)
            total = [sum(int(d) for d in row) for row in zip(*(f[1] for f in found), strict=True)]
            error = pa.array([t if t < 1 << 63 else None for t in total], pa.int64())
            at = pa.array(np.arange(n + 1) * parts, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(index.ravel())), error], names=[*batch.schema.names, "indexes", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(kernel, f"{schema}, indexes array<int>, error long")


def part_sums(rows: DataFrame, books: Codebooks) -> tuple[dict, dict]:
    """Sums of components and counts of parts by part and nearest entry.

    A task adds up what it reads and emits its sums in limbs of 40 bits, so that Spark's sums of longs are exact; the driver
    gets one row for each component of a codebook and limb.
    """
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def kernel(batches):
        own = shared.value
        parts, (size, width) = len(own.entries), own.entries[0].shape
        sums = np.zeros((parts, size, width), object)
        counts = np.zeros((parts, size), np.int64)
        for batch in _batches(batches):
            n = batch.num_rows
            x = whole(_matrix(batch.column("embedding"), parts * width)).reshape(n, parts, width)
            far = _matrix(batch.column("to_pivots"), parts * len(own.pivots[0])).reshape(n, parts, -1)
            for p in range(parts):
                index, _ = nearest(x[:, p], far[:, p], own.entries[p], own.pivots[p])
                added = np.zeros((size, width), x.dtype)
                np.add.at(added, index, x[:, p])
                sums[p] += added
                counts[p] += np.bincount(index, minlength=size)
        out = [(p, e, -1, 0, int(counts[p, e])) for p, e in zip(*np.nonzero(counts), strict=True)]
        for p, e, i in zip(*np.nonzero(sums), strict=True):
            v = int(sums[p, e, i])
            sign, v, limb = (1, v, 0) if v > 0 else (-1, -v, 0)
            while v:
                out.append((p, e, i, limb, sign * (v & (1 << LIMB) - 1)))
                v, limb = v >> LIMB, limb + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([int(r[k]) for r in out], pa.int64()) for k in range(5)], names=["part", "entry", "place", "limb", "v"])

    schema = "part long, entry long, place long, limb long, v long"
    got = rows.mapInArrow(kernel, schema).groupBy("part", "entry", "place", "limb").agg(F.sum("v").alias("v")).collect()
    counts = {(r.part, r.entry): r.v for r in got if r.place < 0}
    width = books.entries[0].shape[1]
    sums = {(p, e, i): 0 for p, e in counts for i in range(width)}
    for r in got:
        if r.place >= 0:
            sums[r.part, r.entry, r.place] += r.v << LIMB * r.limb
    return sums, counts


def finite(embedding: str = "embedding"):
    """True for vectors without a null or non-finite component."""
    x = F.col(embedding)
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return x.isNotNull() & ~F.coalesce(F.exists(x, bad), F.lit(False))


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS) -> tuple[DataFrame, Codebooks | None]:
    """vec_id, label, indexes, error of every kept row, and the final codebooks (None for an empty table).

    The columns vec_id, label and embedding of ``vectors`` are read.
    """
    kept = vectors.where(finite()).select("vec_id", "label", "embedding")
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").collect()
    width = len(first[0][0]) if first else 0
    if not width or width % parts:
        return kept.select("vec_id", "label", F.lit(None).cast("array<int>").alias("indexes"), F.lit(None).cast("long").alias("error")), None
    books = start([r[0] for r in first if len(r[0]) == width], parts, pivots)
    shared = kept.sparkSession.sparkContext.broadcast(books)

    def distances(batches):
        own = shared.value
        wide = own.entries[0].shape[1]
        for batch in _batches(batches):
            n = batch.num_rows
            cut = whole(_matrix(batch.column("embedding"), parts * wide)).reshape(n, parts, wide)
            far = np.stack([roots(squared(cut[:, p, None, :], own.pivots[p][None])) for p in range(parts)], axis=1)
            at = pa.array(np.arange(n + 1) * (far.size // n), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(at, pa.array(far.ravel()))], names=[*batch.schema.names, "to_pivots"])

    fits = kept.where(F.size("embedding") == width)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fits.schema)
    measured = land(fits.mapInArrow(distances, f"{schema}, to_pivots array<float>"), "pivots")
    for _ in range(rounds):
        books = books.updated(*part_sums(measured, books))
    out = assign(measured, books).select("vec_id", "label", "indexes", "error")
    odd = kept.where(F.size("embedding") != width).select("vec_id", "label", F.lit(None).cast("array<int>").alias("indexes"), F.lit(None).cast("long").alias("error"))
    return out.unionByName(odd), books


def with_label_errors(coded: DataFrame) -> DataFrame:
    """label_error added: errors of equal labels, nulls together.

    Errors are added up before anything is shuffled. The sums are broadcast if they have been counted to be few; else the rows
    of frequent labels, which are few labels by their count, still get theirs by a broadcast and only the rest are joined by key.
    """
    coded = land(coded, "coded")
    totals = land(coded.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.when(F.count("error") == F.count(F.lit(1)), F.expr("try_sum(error)")).alias("label_error")), "label_errors")
    there = F.col("label").eqNullSafe(F.col("__label"))
    named = totals.withColumnRenamed("label", "__label")
    if totals.limit(LABELS + 1).count() <= LABELS:
        return coded.join(F.broadcast(named.drop("rows")), there, "left").drop("__label")
    cut = named.agg((F.sum("rows") / LABELS).alias("c")).first()["c"]
    hot = named.where((F.col("rows") > cut) | F.col("__label").isNull()).drop("rows")
    rest = named.where((F.col("rows") <= cut) & F.col("__label").isNotNull()).drop("rows")
    common = coded.join(F.broadcast(hot), there, "inner").drop("__label")
    others = coded.join(F.broadcast(hot.select("__label")), there, "left_anti")
    return common.unionByName(others.join(rest, F.col("label") == F.col("__label"), "left").drop("__label"))


def code(indexes: Column) -> Column:
    """Two hexadecimal digits of each index, in lower case."""
    return F.lower(F.array_join(F.transform(indexes, lambda i: F.lpad(F.hex(i), 2, "0")), ""))
