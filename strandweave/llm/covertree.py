"""Exact pairs of similar vectors by dual traversal of cover trees.

On unit vectors a cosine is a distance. A cover tree has nested levels: the centres of a node's children are apart by more
than half the node's radius and cover its vectors within it. Two nodes whose centres are farther apart than their radii and
the threshold together hold no link; if they are near enough, all their pairs are links and are counted, not listed.

Large labels are first dealt to cells around pivots, level by level, in Spark; pairs of cells are pruned by the same bound,
and each pair that is left is a task of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import land
from .components import connected_components

EPS, LEAF = 1e-9, 8


def distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ y.T)))


class CoverTree:
    """Nodes over the rows of ``x`` (unit vectors): centre, radius, members, children."""

    def __init__(self, x: np.ndarray):
        self.x, self.centre, self.radius, self.members, self.children = x, [], [], [], []
        todo = [self._node(0, np.arange(len(x)))]
        while todo:
            todo += self._split(todo.pop())
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)

    def _node(self, centre: int, members: np.ndarray) -> int:
        self.centre.append(centre)
        self.radius.append(float(distance(self.x[members], self.x[centre:centre + 1]).max()))
        self.members.append(members)
        self.children.append(np.zeros(0, np.int64))
        return len(self.centre) - 1

    def _split(self, node: int) -> list[int]:
        members, half = self.members[node], self.radius[node] / 2
        if len(members) <= LEAF or half <= EPS:
            return []
        rest = np.concatenate([[self.centre[node]], members[members != self.centre[node]]])
        made = []
        while len(rest):
            picks = rest[:64]
            near = distance(self.x[picks], self.x[rest]) <= half
            free = np.ones(len(rest), bool)
            for i in range(len(picks)):
                if free[i]:
                    own = near[i] & free
                    own[i] = True
                    made.append(self._node(int(picks[i]), rest[own]))
                    free &= ~own
            rest = rest[free]
        self.children[node] = np.array(made)
        return made

    def parts(self, node: int) -> np.ndarray:
        return self.children[node] if len(self.children[node]) else np.array([node])


class Links:
    """Weighted number of links of each row and a forest of them."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.count, self.root = weight, np.zeros(len(weight), np.int64), np.arange(len(weight))

    def union(self, i: np.ndarray, j: np.ndarray):
        while True:
            a, b = self.root[i], self.root[j]
            on = a != b
            if not on.any():
                return
            np.minimum.at(self.root, np.maximum(a[on], b[on]), np.minimum(a[on], b[on]))
            while not np.array_equal(self.root, self.root[self.root]):
                self.root = self.root[self.root]

    def pairs(self, i: np.ndarray, j: np.ndarray):
        np.add.at(self.count, i, self.weight[j])
        np.add.at(self.count, j, self.weight[i])
        self.union(i, j)

    def every(self, i: np.ndarray, j: np.ndarray, same: bool):
        """All pairs of i and j, or all pairs in i if ``same``."""
        self.count[i] += self.weight[j].sum() - (self.weight[i] if same else 0)
        if not same:
            self.count[j] += self.weight[i].sum()
        self.union(i, np.full(len(i), j[0]))
        self.union(j, np.full(len(j), i[0]))


def dual_traversal(raw: np.ndarray, left: np.ndarray, right: np.ndarray | None, weight: np.ndarray, threshold: float) -> Links:
    """Links between the rows ``left`` and ``right`` of ``raw``, or within ``left`` if ``right`` is None."""
    raw = raw.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
    unit = raw / norm[:, None]
    t = float(np.sqrt(2.0 - 2.0 * threshold))
    out = Links(weight)
    a = CoverTree(unit[left])
    b, rows_b = (a, left) if right is None else (CoverTree(unit[right]), right)

    def compare(i: np.ndarray, j: np.ndarray, same: bool):
        p, q = np.repeat(i, len(j)), np.tile(j, len(i))
        if same:
            p, q = p[p < q], q[p < q]
        ok = np.einsum("ij,ij->i", raw[p], raw[q]) / (norm[p] * norm[q]) >= threshold
        out.pairs(p[ok], q[ok])

    todo = [(0, 0)]
    while todo:
        m, n = todo.pop()
        same = right is None and m == n
        gap = 0.0 if same else float(np.linalg.norm(a.x[a.centre[m]] - b.x[b.centre[n]]))
        if gap + a.radius[m] + b.radius[n] <= t - EPS and not (same and a.radius[m] * 2 > t - EPS):
            out.every(left[a.members[m]], rows_b[b.members[n]], same)
            continue
        ca, cb = a.parts(m), b.parts(n)
        if len(ca) == 1 and ca[0] == m and len(cb) == 1 and cb[0] == n:
            compare(left[a.members[m]], rows_b[b.members[n]], same)
            continue
        for k in range(0, len(ca), 512):
            part = ca[k:k + 512]
            near = distance(a.x[a.centre[part]], b.x[b.centre[cb]]) <= a.radius[part][:, None] + b.radius[cb][None, :] + t + 1e-7
            if same:
                near &= np.arange(k, k + len(part))[:, None] <= np.arange(len(cb))[None, :]
            i, j = np.nonzero(near)
            todo += zip(part[i].tolist(), cb[j].tolist(), strict=True)
    return out


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of equal first column; rows are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        key = batch.column(0).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            if held and held[-1].column(0)[0].as_py() != key[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def deal_to_cells(vectors: DataFrame, cell_rows: int, fan: int = 16, levels: int = 8, portion: int = 50_000) -> DataFrame:
    """(rep, weight, x, cell, space, centre, radius) from (rep, weight, x, space): cells of at most ``cell_rows`` vectors.

    Each level splits the cells that are too large around up to ``fan`` pivots, those of least hash; a vector goes to the nearest.
    A cell too large for many levels (vectors that hardly differ) is cut by hash; its parts have the same centre and radius."""
    kind_of_x = vectors.schema["x"].dataType.simpleString()
    now = vectors.select("rep", "weight", "x", "space", F.xxhash64("space").alias("cell"), F.lit(None).cast("array<float>").alias("centre"), F.lit(2.0).alias("d"))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, pivots = None, None
        for batch in batches:
            # cell, salt, kind, rep, weight, space, x
            key = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            kind = batch.column(2).to_numpy()
            cuts = [0, *[i for i in range(1, len(key)) if key[i] != key[i - 1]], len(key)]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if a == z:
                    continue
                part = batch.slice(a, z - a)
                lead = int((kind[a:z] == 0).sum())
                if key[a] != group:
                    group, pivots = key[a], None
                if lead:
                    new = _rows(part.column(6).slice(0, lead))
                    pivots = new if pivots is None else np.concatenate([pivots, new])
                rest = part.slice(lead)
                if rest.num_rows:
                    unit = pivots / np.linalg.norm(pivots, axis=1, keepdims=True)
                    x = _rows(rest.column(6))
                    d = distance(x / np.linalg.norm(x, axis=1, keepdims=True), unit)
                    i = d.argmin(axis=1)
                    centre = pa.array(list(pivots[i].astype(np.float32)), pa.list_(pa.float32()))
                    yield pa.RecordBatch.from_arrays([rest.column(3), rest.column(4), rest.column(6), rest.column(5), rest.column(0), pa.array(i), centre, pa.array(d[np.arange(len(i)), i])],
                                                     names=["rep", "weight", "x", "space", "parent", "nth", "centre", "d"])

    for _ in range(levels):
        sizes = now.groupBy("cell").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > cell_rows)
        sizes = land(sizes, "cell-sizes")
        if sizes.isEmpty():
            break
        large = now.join(sizes, "cell")
        pick = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("rep"), "rep"))
        # The group limit that Spark puts before this window keeps at most ``fan`` rows of a cell in each task.
        pivots = large.withColumn("nth", pick).where(F.col("nth") <= fan).select("cell", "size", "rep", "weight", "space", "x")
        salts = F.ceil(F.col("size") / portion).cast("int")
        sides = large.select("cell", F.pmod(F.xxhash64("rep"), salts).cast("int").alias("salt"), F.lit(1).alias("kind"), "rep", "weight", "space", "x").unionByName(
            pivots.select("cell", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("kind"), "rep", "weight", "space", "x"))
        split = sides.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "kind", "rep").mapInArrow(
            nearest, f"rep long, weight long, x {kind_of_x}, space string, parent long, nth long, centre array<float>, d double")
        split = split.select("rep", "weight", "x", "space", F.xxhash64("parent", "nth").alias("cell"), "centre", "d")
        now = land(now.join(sizes, "cell", "left_anti").unionByName(split), "cells")
    sized = now.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.max("d").alias("radius"))
    piece = F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / cell_rows)).cast("int")
    return now.join(sized, "cell").withColumn("cell", F.xxhash64("cell", piece)).select("rep", "weight", "x", "space", "cell", "centre", "radius")


def link_vectors(vectors: DataFrame, threshold: float = 0.93, cell_rows: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding, label).

    Vectors are linked when label and number of components are equal and the cosine, in double precision, is ``threshold`` or
    more. Null labels, and vectors that are null, empty, zero or hold null or non-finite components, link with nothing. Equal
    vectors of a label are one class, compared once and counted by its vec_ids; repeated rows of one vec_id and vector count
    once. A null vec_id is no vector: no links, a null component, kept. An empty table gives an empty one; other columns are
    not read."""
    precise = vectors.schema["embedding"].dataType.simpleString() != "array<float>"
    x = F.col("embedding").cast("array<double>") if precise else F.col("embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"), F.col("label").cast("string").alias("label"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0), F.lit(False))
    space = F.concat_ws("|", F.size("x").cast("string"), "label")
    good = rows.where(valid).select("vec_id", "x", space.alias("space"))
    classes = land(good.distinct().groupBy("space", "x").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight")), "vector-classes")
    cells = land(deal_to_cells(classes, cell_rows), "cells")

    nodes = cells.groupBy("space", "cell").agg(F.first("centre").alias("c"), F.max("radius").alias("r"))
    other = nodes.select("space", F.col("cell").alias("cell2"), F.col("c").alias("c2"), F.col("r").alias("r2"))
    dot = F.aggregate(F.zip_with("c", "c2", lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda c: F.sqrt(F.aggregate(F.transform(c, lambda p: p.cast("double") * p.cast("double")), F.lit(0.0), lambda s, v: s + v))
    gap = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * dot / (norm("c") * norm("c2"))))
    t = float(np.sqrt(2.0 - 2.0 * threshold))
    # Pairs of cells, each of thousands of vectors, within one label.
    pairs = nodes.join(other, "space").where("cell <= cell2").where((F.col("cell") == F.col("cell2")) | (gap <= F.col("r") + F.col("r2") + t + 1e-6))
    pairs = land(pairs.select("cell", "cell2"), "cell-pairs")
    task = F.xxhash64("cell", "cell2")
    ends = pairs.select(task.alias("task"), F.lit(0).alias("side"), "cell", (F.col("cell") == F.col("cell2")).alias("own")).unionByName(
        pairs.where("cell <> cell2").select(task.alias("task"), F.lit(1).alias("side"), F.col("cell2").alias("cell"), F.lit(False).alias("own")))
    dealt = cells.select("rep", "weight", "x", "cell").join(ends, "cell").select("task", "side", "own", "rep", "weight", "x")
    dealt = dealt.repartition("task").sortWithinPartitions("task", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            rep, side = group["rep"].to_numpy(), group["side"].to_numpy()
            right = None if group["own"][0].as_py() else np.flatnonzero(side == 1)
            links = dual_traversal(_rows(group["x"].combine_chunks()), np.flatnonzero(side == 0), right, group["weight"].to_numpy(), threshold)
            on = links.count > 0
            yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(links.count[on]), pa.array(rep[links.root[on]])], names=["rep", "n", "root"])

    found = land(dealt.mapInArrow(run, "rep long, n long, root long"), "vector-links")
    component = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = classes.join(counts, "rep", "left").join(component.withColumnRenamed("node", "rep"), "rep", "left").select(
        "space", "x", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.where(valid).select("vec_id", "x", space.alias("space")).join(known, ["space", "x"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
