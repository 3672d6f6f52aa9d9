"""Parts of the two passage operators: anchors and contexts of windows of bytes (:mod:`.factors`), suffix order of aligned
contexts, and the flow of whole groups through a task, which :mod:`.trees` shares.

The anchor of a window is its least gram, by hash. It depends on the window's content alone, so equal windows have equal anchors
at equal places, and contexts that may hold equal windows meet in the group of one gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import BASE, byte_values, chunks, mix, prefix, ranges, sliding_min, span_hash, text_buffer

NO_ID = -(1 << 63)
#: Contexts whose bytes are placed in the matrices at once.
ALIGN_ROWS = 1000


@dataclass(frozen=True)
class Unit:
    """window and gram in bytes; keep_first: windows without an earlier equal one stay."""

    window: int
    gram: int
    keep_first: bool

    @property
    def reach(self) -> int:
        return self.window - self.gram


def units_of(raw: np.ndarray, at: np.ndarray, unit: Unit):
    """(hash of each gram, first byte of each document and the end)."""
    i = np.arange(max(0, len(raw) - unit.gram + 1))
    return (span_hash(prefix(byte_values()[raw]), i, i + unit.gram) if len(i) else np.zeros(0, np.uint64)), at


def anchors_of(grams: np.ndarray, bounds: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, anchor, first window, last window) in bytes of the chunk; windows lie within documents."""
    w, span = unit.window, unit.reach + 1
    none = np.zeros(0, np.int64)
    if len(grams) < span:
        return none, none, none, none
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    best = (sliding_min(key, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    n = np.maximum(np.diff(bounds) - w + 1, 0)
    window = ranges(bounds[:-1], n)
    if not len(window):
        return none, none, none, none
    doc = np.repeat(np.arange(len(n)), n)
    anchor = best[window]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(window)) - 1
    return doc[new], anchor[new], window[new], window[last]


def grams_of_documents(unit: Unit):
    """(dk, th, text) -> (gram, dk, th, n): the anchors' grams of each document and how often they occur in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(2))
            for lo, hi, part, at in chunks(raw, offsets):
                grams, bounds = units_of(part, at, unit)
                doc, anchor, _, _ = anchors_of(grams, bounds, unit)
                if not len(doc):
                    continue
                g = grams[anchor]
                order = np.lexsort((g, doc))
                g, doc = g[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]))
                n = np.diff(np.append(new, len(g)))
                row = pa.array(lo + doc[new])
                yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(n)], names=["gram", "dk", "th", "n"])

    return run


CONTEXTS = "gram long, dk long, th long, places array<long>, left int, windows int, context binary"


def wanted_anchors(batch: pa.RecordBatch, unit: Unit):
    """Anchors of a batch of (dk, th, text, grams) whose gram is listed for their document."""
    raw, offsets = text_buffer(batch.column(2))
    lists = batch.column(3)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    size = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])
    for lo, hi, part, at in chunks(raw, offsets):
        if begin[hi] == begin[lo]:
            continue
        grams, bounds = units_of(part, at, unit)
        doc, anchor, first, last = anchors_of(grams, bounds, unit)
        listed = np.unique(mix(flat[begin[lo]:begin[hi]] + np.repeat(np.arange(hi - lo, dtype=np.uint64), size[lo:hi]) * np.uint64(BASE)))
        mine = mix(grams[anchor] + doc.astype(np.uint64) * np.uint64(BASE))
        on = listed[np.minimum(np.searchsorted(listed, mine), len(listed) - 1)] == mine
        if on.any():
            yield lo, part, grams, bounds, doc[on], anchor[on], first[on], last[on]


def aligned(context: pa.Array, left: np.ndarray, unit: Unit) -> tuple[np.ndarray, np.ndarray]:
    """(right, left) matrices of bytes: from the anchor on, and from the unit before it backwards; 0 where there is none."""
    raw, at = text_buffer(context.cast(pa.binary()).view(pa.string()) if not pa.types.is_string(context.type) else context)
    values, bounds = raw.astype(np.uint16) + np.uint16(1), at
    # In blocks of rows: the places of all bytes at once would be many times as large as the matrices.
    count = len(bounds) - 1
    right, before = np.zeros((count, unit.window), values.dtype), np.zeros((count, max(unit.reach, 1)), values.dtype)
    for lo in range(0, count, ALIGN_ROWS):
        hi = min(lo + ALIGN_ROWS, count)
        n, own = np.diff(bounds[lo:hi + 1]), values[bounds[lo]:bounds[hi]]
        row = np.repeat(np.arange(lo, hi), n)
        col = np.arange(len(own)) - np.repeat(bounds[lo:hi] - bounds[lo] + left[lo:hi], n)
        for m, on, c in ((right, col >= 0, col), (before, col < 0, -1 - col)):
            m[row[on], c[on]] = own[on]
    return right, before


def suffix_order(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows in lexicographic order, common prefix of each with the one before)."""
    big = np.ascontiguousarray(m.astype(m.dtype.newbyteorder(">")))
    keys = [k.tobytes() for k in big]
    del big
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
    del keys
    s = m[order]
    differ = s[1:] != s[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), m.shape[1])
    return order, np.concatenate([[0], lcp])


def runs_at(order: np.ndarray, lcp: np.ndarray, depth: int) -> np.ndarray:
    """Node of each row at ``depth``: rows of one run of the order with common prefixes of at least that length."""
    node = np.empty(len(order), np.int64)
    node[order] = np.cumsum(lcp < depth)
    return node


def resolve(flush_rows: int, solve):
    """Contexts, sorted by gram (the first column) -> what ``solve`` makes of whole groups, as soon as enough rows have come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            gram = batch.column(0).to_numpy()
            if held and rows >= flush_rows:
                cut = int(np.searchsorted(gram != held[-1].column(0)[-1].as_py(), True))
                done = pa.Table.from_batches([*held, batch.slice(0, cut)])
                if cut < len(gram):
                    yield solve(done)
                    held, rows, batch = [], 0, batch.slice(cut)
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
        if rows:
            yield solve(pa.Table.from_batches(held))

    return run


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], s[1]))
        else:
            out.append(s)
    return out


def with_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with dk (doc_id, or the least long for null) and th (32 bits of a hash of the text, which rows of one doc_id differ in): together they name a text."""
    return docs.withColumn("dk", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("th", F.hash("text").cast("long"))
