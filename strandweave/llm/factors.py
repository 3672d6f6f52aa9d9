"""Longest previous and next factors: how far the string at a place also stands at an earlier, or a later, place.

Suffixes are taken at the starts of windows of ``window`` bytes, dealt by the anchors of :mod:`.repeats`: equal windows have equal
anchor grams, so all suffixes that agree in a window or more meet in one group. Within a group the contexts are sorted once to
the right of the anchor and once to the left. For each distance of a start to its anchor, the contexts that agree to the left
are runs of the suffix array, and common prefixes to the right are minima over ranges of its array of common prefixes.

The longest previous factor of a place is then found at its previous or next smaller value: going up or down the suffix order,
the first suffix of a smaller position has the longest common prefix of all smaller ones on that side. The same with greater
positions gives the longest next factor. A place whose factor has ``length`` bytes or more begins a repeated string; factors of
``window`` bytes or more, which may be shorter, are reported beside it.

A group whose contexts pass a bound is not brought together: its windows are counted by hashes of 128 bits of the whole window,
with partial aggregation, which says whether the factor reaches the window and the length. Both ways give the same spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land
from .kernels import byte_values, mix, prefix, ranges, span_hash, take_spans
from .repeats import CONTEXTS, NO_ID, Unit, aligned, grams_of_documents, resolve, runs_at, suffix_order, wanted_anchors

#: Starts of windows in a row of the hash way that are merged to runs at a time.
STRETCH = 4096
SPANS = "kind int, dk long, th long, start long, stop long"
WINDOWS = "kind int, h1 long, h2 long, dk long, th long, start long"


@dataclass(frozen=True)
class Bytes(Unit):
    """A unit of bytes whose windows carry ``length`` bytes from their start, where the document has them."""

    length: int = 0


def bytes_unit(window: int, length: int, gram: int, keep_first: bool) -> Bytes:
    return Bytes(window, gram, keep_first, length)


def with_text_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with dk (doc_id, or the least long for null) and th (64 bits of a hash of the text): together they name a text."""
    return docs.withColumn("dk", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("th", F.xxhash64("text"))


def contexts(unit: Bytes):
    """(dk, th, text, grams) -> CONTEXTS: the bytes from an anchor's first window to ``length`` bytes after its last start.

    Equal contexts of one text are one row with all their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part, grams, bounds, doc, anchor, first, last in wanted_anchors(batch, unit):
                end = np.minimum(last + unit.length, bounds[doc + 1])
                left, windows = anchor - first, last - first + 1
                same = span_hash(prefix(byte_values()[part]), first, end)
                order = np.lexsort((anchor, windows, left, same, doc))
                keys = [v[order] for v in (doc, same, left, windows)]
                new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(order)).astype(np.int32)), pa.array((anchor - bounds[doc])[order]))
                pick = order[new]
                row = pa.array(lo + doc[pick])
                yield pa.RecordBatch.from_arrays([
                    pa.array(grams[anchor[pick]].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), places, pa.array(left[pick].astype(np.int32)),
                    pa.array(windows[pick].astype(np.int32)), take_spans(part, first[pick], end[pick])], names=["gram", "dk", "th", "places", "left", "windows", "context"])

    return run


def hashed_windows(unit: Bytes):
    """(dk, th, text, grams) -> WINDOWS: each start by a hash of its window (kind 0) and of its ``length`` bytes (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part, _, bounds, doc, _, first, last in wanted_anchors(batch, unit):
                n = last - first + 1
                w, d = ranges(first, n), np.repeat(doc, n)
                for kind, size in ((0, unit.window), (1, unit.length)):
                    fits = w + size <= bounds[d + 1]
                    start, own = w[fits], d[fits]
                    h1, h2 = (span_hash(prefix(mix(byte_values() + np.uint64(k))[part]), start, start + size) for k in (1, 2))
                    row = pa.array(lo + own)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), kind, np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                                                      batch.column(0).take(row), batch.column(1).take(row), pa.array(start - bounds[own])], names=["kind", "h1", "h2", "dk", "th", "start"])

    return run


class RangeMin:
    """Minimum of any range of an array, from minima of ranges of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Minimum of values[lo:hi]; hi > lo."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), self.levels[0].dtype)
        for k in np.unique(level):
            on = level == k
            out[on] = np.minimum(self.levels[k][lo[on]], self.levels[k][hi[on] - (1 << k)])
        return out


def smaller_neighbours(position: np.ndarray, link: np.ndarray, least: int) -> np.ndarray:
    """Common prefix of each suffix with the previous one of smaller position in suffix order, 0 where it is below ``least``.

    ``link``: common prefix with the suffix before. Pointers go to the suffix before and then, as long as that has no smaller
    position, to where its own pointer goes; all suffixes jump at once, so runs are crossed in logarithmically many steps.
    """
    n = len(position)
    at, common = np.arange(n) - 1, np.where(link >= least, link, 0)
    if n:
        common[0] = 0
    open_ = np.flatnonzero((common > 0) & (position[at] >= position))
    while len(open_):
        to = at[open_]
        at[open_], common[open_] = at[to], np.minimum(common[open_], common[to])
        open_ = open_[(common[open_] > 0) & (position[at[open_]] >= position[open_])]
    return common


def factors(position: np.ndarray, link: np.ndarray, least: int) -> np.ndarray:
    """Longest previous factor of each suffix, 0 below ``least``: the longer one of the previous and the next smaller value."""
    back = smaller_neighbours(position, link, least)
    ahead = smaller_neighbours(position[::-1], np.concatenate([[0], link[:0:-1]]), least)[::-1] if len(link) else back
    return np.maximum(back, ahead)


def solve(table: pa.Table, unit: Bytes) -> pa.RecordBatch:
    """Whole groups of contexts -> SPANS: what repeated windows (kind 0) and repeated strings of ``length`` (kind 1) cover."""
    dk, th = table["dk"].to_numpy(), table["th"].to_numpy()
    left, windows = table["left"].to_numpy().astype(np.int64), table["windows"].to_numpy().astype(np.int64)
    lists = table["places"].combine_chunks()
    flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    place, copies = flat[at[:-1]], np.diff(at)
    context = table["context"].combine_chunks()
    size = np.diff(np.frombuffer(context.buffers()[1], np.int32)[context.offset:context.offset + len(context) + 1]).astype(np.int64)
    beyond = size - left  # bytes from the anchor on
    right_m, left_m = aligned(context, left, Unit(unit.length, unit.length - unit.reach, False))
    order, lcp = suffix_order(right_m)
    before, before_lcp = suffix_order(left_m)
    del right_m, left_m
    rank, shared = np.empty(len(order), np.int64), RangeMin(lcp)
    rank[order] = np.arange(len(order))
    # Text order. Repeated rows of one text and place are one place where the first stays, else different ones.
    text = np.lexsort((place, th, dk))
    same = (dk[text][1:] == dk[text][:-1]) & (th[text][1:] == th[text][:-1]) & (place[text][1:] == place[text][:-1])
    position = np.empty(len(dk), np.int64)
    position[text] = np.cumsum(np.concatenate([[0], ~same if unit.keep_first else np.ones(len(same), bool)]))
    low, high = left - windows + 1, left  # distances of the anchor to the starts of its windows
    reached = {kind: (np.full(len(dk), 1 << 30), np.full(len(dk), -1)) for kind in (0, 1)}
    for k in range(unit.reach + 1):
        on = np.flatnonzero((low <= k) & (k <= high))
        if len(on) < 2:
            continue
        node = runs_at(before, before_lcp, k)
        on = on[np.lexsort((rank[on], node[on]))]
        r = rank[on]
        link = np.zeros(len(on), np.int64)
        pair = np.flatnonzero(node[on][1:] == node[on][:-1]) + 1
        link[pair] = k + np.minimum(shared.of(r[pair - 1] + 1, r[pair] + 1), np.minimum(beyond[on[pair - 1]], beyond[on[pair]]))
        live = link >= unit.window
        live[:-1] |= live[1:]
        on, link = on[live], link[live]
        if not len(on):
            continue
        found = factors(position[on], link, unit.window)
        if not unit.keep_first:
            found = np.maximum(found, factors(-position[on], link, unit.window))
        for kind, size in ((0, unit.window), (1, unit.length)):
            rows = on[found >= size]
            least, most = reached[kind]
            least[rows], most[rows] = np.minimum(least[rows], k), np.maximum(most[rows], k)
    row = np.repeat(np.arange(len(dk)), copies)
    head = np.zeros(len(flat), bool)
    head[at[:-1]] = True
    out = []
    for kind, size in ((0, unit.window), (1, unit.length)):
        least, most = reached[kind]
        # Equal contexts of one text repeat each other as far as they go: all but the first, or all of them.
        own_low = np.maximum(low, size - beyond)
        again = (copies > 1) & (own_low <= high)
        if not unit.keep_first:
            least, most = np.where(again, np.minimum(least, own_low), least), np.where(again, high, most)
        a = np.where(head | (not unit.keep_first), most[row], np.where(again, high, -1)[row])
        z = np.where(head | (not unit.keep_first), least[row], own_low[row])
        keep = a >= 0
        out.append((np.full(keep.sum(), kind, np.int32), dk[row[keep]], th[row[keep]], flat[keep] - a[keep], flat[keep] - z[keep] + size))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["kind", "dk", "th", "start", "stop"])


def runs_of_starts(unit: Bytes):
    """Sorted lists of starts of a stretch -> SPANS, one for each run of overlapping windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column(0).to_numpy()
            starts = batch.column(3)
            flat, n = starts.flatten().to_numpy(), starts.value_lengths().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            size = np.where(kind[row] == 0, unit.window, unit.length)
            new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (flat[1:] - flat[:-1] > size[1:])])) if len(flat) else np.zeros(0, np.int64)
            last = np.append(new[1:], len(flat))[:len(new)] - 1
            pick = pa.array(row[new])
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pick) for c in range(3)], pa.array(flat[new]), pa.array(flat[last] + size[last])], names=["kind", "dk", "th", "start", "stop"])

    return run


def repeated_spans(base: DataFrame, unit: Bytes, group_rows: int = 20_000, flush_rows: int = 4_000, context_bytes: int = 48 << 20) -> DataFrame:
    """(dk, th, spans): spans of bytes (kind, start, stop) from 0 in the document that repeated windows and strings cover.

    base: dk, th, text and others. group_rows: places of one gram in all texts that a task may hold; more go by hashes."""
    found = land(base.select("dk", "th", "text").mapInArrow(grams_of_documents(unit), "gram long, dk long, th long, n long"), "anchor-grams")
    again = land(found.groupBy("gram").agg(F.sum("n").alias("rows")).where("rows > 1"), "repeated-grams")
    size = again.agg(F.sum("rows").alias("rows"), F.max("rows").alias("most")).first()
    session = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(session, -(-int(size["rows"] or 0) * 2 * unit.length // context_bytes))

    def listed(grams: DataFrame) -> DataFrame:
        lists = found.join(grams.select("gram"), "gram").groupBy("dk", "th").agg(F.collect_list("gram").alias("grams"))
        # All columns of base pass, so that this is the shuffle of texts that the caller's join of the spans reads again.
        return base.join(lists, ["dk", "th"], "left").select("dk", "th", "text", "grams", *(c for c in base.columns if c not in ("dk", "th", "text")))

    rows = listed(again.where(F.col("rows") <= group_rows)).mapInArrow(contexts(unit), CONTEXTS)
    out = rows.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(resolve(flush_rows, lambda t: solve(t, unit)), SPANS)
    if (size["most"] or 0) > group_rows:
        starts = listed(again.where(F.col("rows") > group_rows)).mapInArrow(hashed_windows(unit), WINDOWS)
        place = F.struct("dk", "th", "start")
        whole = starts.groupBy("kind", "h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("all")).where(F.col("all") > 1)
        hit = F.col("first") < place if unit.keep_first else F.lit(True)
        back = starts.join(whole, ["kind", "h1", "h2"]).where(hit).groupBy("kind", "dk", "th", F.floor(F.col("start") / STRETCH).alias("_s")).agg(F.array_sort(F.collect_set("start")).alias("starts"))
        out = out.unionByName(back.select("kind", "dk", "th", "starts").mapInArrow(runs_of_starts(unit), SPANS))
    return out.groupBy("dk", "th").agg(F.collect_list(F.struct("kind", "start", "stop")).alias("spans"))
