"""Prefix-partitioned suffix trees over words: windows of words that occur again in another document.

1. Anchors. The anchor of a window is its least gram, by hash. It depends on the window's content alone, so equal windows have
   equal anchors at equal places. A gram of one document only rules out all windows anchored on it.
2. Subtrees. Each document sends, for each anchor, the words of the windows anchored there. A task sorts the suffixes that
   start with these windows by prefix doubling, finds common prefixes of neighbours, and forms the internal nodes of the
   suffix tree from them. A deep node (a window or more) is a repeat as long as possible; a suffix below it repeats an
   earlier document if the node has a suffix of a smaller doc_id, and the deepest such node says how far.
3. Prefixes of variable length. Grams of the first length (5 words) partition the suffixes. A gram with more contexts than a
   task may hold is not brought together: equal contexts become one first, which keeps its smallest doc_id, and these are
   anchored again on the least gram of the next length (7, 9, 11 words), and so on, until their group fits. Equal windows are
   dealt alike at each length, so they always meet. Documents get the smallest doc_id of each window back by their context.
4. One window in more contexts than a task may hold is a single node of the tree. Only then are whole windows combined by
   hash, with partial aggregation, and joined back.

All windows of an anchor overlap, so what is found for one anchor of one document is a single interval.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, small
from .kernels import BASE, byte_values, chunks, gram_hash, mix, prefix, ranges, sliding_min, space_table, span_hash, take_spans, text_buffer, word_spans
from .repeats import resolve

GRAMS = "gram long, dk long, th long, n long"
CONTEXTS = "gram long, dk long, th long, places array<long>, windows int, context binary"
INTERVALS = "dk long, th long, start long, stop long"
MEMBERS = "h1 long, h2 long, chunk long, dk array<long>, th array<long>, place array<long>, least long, context binary"
COVERED = "chunk long, found array<struct<dk: long, th: long, start: long, stop: long>>"
PARTS = "gram long, h1 long, h2 long, dk long, first int, windows int, context binary"
LEAST = "h1 long, h2 long, first int, least array<long>"
WHOLE = "w1 long, w2 long, h1 long, h2 long, dk long, first int"


#: Different contexts whose results are broadcast to the documents; more are joined by shuffle.
BROADCAST_ROWS = 100_000
#: Frequent grams that every task gets as a list of its own; more are joined to the documents that have them.
LISTED_GRAMS = 100_000


class Listed:
    """Lists of grams of the documents of a batch; null lists are empty."""

    def __init__(self, column: pa.Array):
        self.flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        size = np.where(valid, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(size)])

    def has(self, lo: int, hi: int, doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """Whether each gram is in the list of its document; ``doc`` counts from ``lo``."""
        own, size = self.flat[self.begin[lo]:self.begin[hi]], np.diff(self.begin[lo:hi + 1])
        if not len(own):
            return np.zeros(len(doc), bool)
        keys = np.unique(mix(own + np.repeat(np.arange(hi - lo, dtype=np.uint64), size) * np.uint64(BASE)))
        mine = mix(gram + doc.astype(np.uint64) * np.uint64(BASE))
        return keys[np.minimum(np.searchsorted(keys, mine), len(keys) - 1)] == mine


class Few:
    """One short list of grams for all documents."""

    def __init__(self, grams: np.ndarray):
        self.grams = np.sort(grams.view(np.uint64))

    def has(self, lo: int, hi: int, doc: np.ndarray, gram: np.ndarray) -> np.ndarray:
        return self.grams[np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)] == gram


def anchored(texts: pa.Array, window: int, gram: int, wanted: Listed | Few | None = None):
    """Runs of windows with the same anchor of ``gram`` words, ``wanted`` ones only, a chunk of texts at a time."""
    raw, offsets = text_buffer(texts)
    for lo, hi, part, at in chunks(raw, offsets):
        start, end, bounds = word_spans(part, at, space_table())
        n = np.maximum(np.diff(bounds) - window + 1, 0)
        if not n.any():
            continue
        w, doc = ranges(bounds[:-1], n), np.repeat(np.arange(len(n)), n)
        words = span_hash(prefix(byte_values()[part]), start, end)
        grams = gram_hash(words, gram)
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        anchor = (sliding_min(key, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)[w]
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])]))
        last = w[np.append(new[1:], len(w)) - 1]
        first, doc, found = w[new], doc[new], grams[anchor[new]]
        if wanted is not None:
            on = wanted.has(lo, hi, doc, found)
            first, last, doc, found = first[on], last[on], doc[on], found[on]
        if len(first):
            yield lo, part, words, bounds, start, end, doc, found, first, last


def grams_of_documents(window: int, gram: int):
    """(dk, th, text) -> GRAMS: the anchors' grams of each document and their contexts in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, _, _, _, _, doc, g, _, _ in anchored(batch.column(2), window, gram):
                order = np.lexsort((g, doc))
                g, doc = g[order], doc[order]
                new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])]))
                row = pa.array(lo + doc[new])
                n = pa.array(np.diff(np.append(new, len(g))))
                yield pa.RecordBatch.from_arrays([pa.array(g[new].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), n], names=["gram", "dk", "th", "n"])

    return run


def contexts_of_documents(window: int, gram: int):
    """(dk, th, text, grams) -> CONTEXTS; equal contexts of one document are one row with all their places.

    places: first words of the first windows. Equal words between different white space make rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part, _, bounds, start, end, doc, g, first, last in anchored(batch.column(2), window, gram, Listed(batch.column(3))):
                a, z, count = start[first], end[last + window - 1], last - first + 1
                same = span_hash(prefix(byte_values()[part]), a, z)
                order = np.lexsort((first, count, same, doc))
                keys = [v[order] for v in (doc, same, count, g)]
                new = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
                places = pa.ListArray.from_arrays(pa.array(np.append(new, len(order)).astype(np.int32)), pa.array((first - bounds[doc])[order]))
                pick = order[new]
                row = pa.array(lo + doc[pick])
                yield pa.RecordBatch.from_arrays([
                    pa.array(g[pick].view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), places,
                    pa.array(count[pick].astype(np.int32)), take_spans(part, a[pick], z[pick])], names=["gram", "dk", "th", "places", "windows", "context"])

    return run


def members_of_documents(window: int, gram: int, few: Few | None = None):
    """(dk, th, text[, grams]) -> MEMBERS of the grams listed, or of ``few``: each context by a hash of 128 bits of its words.

    Equal ones in a chunk are one row with all their places, so copies do not make rows of their own. least: the smallest dk of
    these. chunk: a number that rows of one chunk share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, part, words, bounds, start, end, doc, _, first, last in anchored(batch.column(2), window, gram, few or Listed(batch.column(3))):
                h1, h2 = (span_hash(prefix(mix(words + np.uint64(k))), first, last + window) for k in (1, 2))
                order = np.lexsort((keys[lo + doc], h2, h1))
                h1, h2, doc, first, last = (v[order] for v in (h1, h2, doc, first, last))
                head = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
                at = pa.array(np.append(head, len(h1)).astype(np.int32))
                dk, th = keys[lo + doc], hashes[lo + doc]
                names = slice(lo, lo + len(bounds) - 1)
                chunk = mix(mix(keys[names].view(np.uint64)) + hashes[names].view(np.uint64)).sum(keepdims=True).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h1[head].view(np.int64)), pa.array(h2[head].view(np.int64)), pa.array(np.repeat(chunk, len(head))),
                    *[pa.ListArray.from_arrays(at, pa.array(v)) for v in (dk, th, first - bounds[doc])], pa.array(dk[head]),
                    take_spans(part, start[first[head]], end[last[head] + window - 1])], names=["h1", "h2", "chunk", "dk", "th", "place", "least", "context"])

    return run


def covered_members(window: int):
    """(chunk, dk, th, place, at, least) -> COVERED: members of each context with windows that also start in a smaller document.

    at, least: windows of the context, from 0, and the smallest dk of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dk, th, place, at, least = (batch.column(i).flatten().to_numpy() for i in range(1, 6))
            many, windows = (batch.column(i).value_lengths().to_numpy().astype(np.int64) for i in (1, 4))
            row = np.repeat(np.arange(len(many)), many)
            size, begin = windows[row], (np.cumsum(windows) - windows)[row]
            member, w = np.repeat(np.arange(len(dk)), size), ranges(begin, size)
            on = least[w] < dk[member]
            member, w = member[on], w[on]
            low, high = np.full(len(dk), 1 << 40), np.full(len(dk), -1)
            np.minimum.at(low, member, at[w])
            np.maximum.at(high, member, at[w])
            hit = np.flatnonzero(high >= 0)
            found = pa.StructArray.from_arrays([pa.array(v) for v in (dk[hit], th[hit], place[hit] + low[hit], place[hit] + high[hit] + window)], names=["dk", "th", "start", "stop"])
            count = np.bincount(row[hit], minlength=len(many))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["chunk", "found"]).filter(pa.array(count > 0))

    return run


def joined_intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(found: lists of lists) of whole chunks -> INTERVALS, those of one document that touch as one."""
    for batch in batches:
        lists = batch.column(0)
        flat = lists.flatten()
        size = np.diff(np.concatenate([[0], np.cumsum(flat.value_lengths().to_numpy().astype(np.int64))])[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])])
        found = flat.flatten()
        dk, th, start, stop = (found.field(i).to_numpy() for i in range(4))
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((start, th, dk, row))
        dk, th, start, stop, row = (v[order] for v in (dk, th, start, stop, row))
        if not len(dk):
            continue
        other = np.concatenate([[True], (dk[1:] != dk[:-1]) | (th[1:] != th[:-1]) | (row[1:] != row[:-1])])
        step = np.cumsum(other) * (1 << 40)  # words of a document are fewer
        reach = np.maximum.accumulate(stop + step)
        new = np.flatnonzero(other | np.concatenate([[True], (start + step)[1:] > reach[:-1]]))
        last = np.append(new[1:], len(dk)) - 1
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (dk[new], th[new], start[new], reach[last] - step[last])], names=["dk", "th", "start", "stop"])


def parts_of_contexts(window: int, gram: int):
    """(h1, h2, dk, first, context) -> PARTS: the runs of windows of each context with the same longer anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            for lo, part, _, bounds, start, end, row, g, first, last in anchored(batch.column(4).view(pa.string()), window, gram):
                take = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([
                    pa.array(g.view(np.int64)), *[batch.column(c).take(take) for c in range(3)], pa.array((at[lo + row] + first - bounds[row]).astype(np.int32)),
                    pa.array((last - first + 1).astype(np.int32)), take_spans(part, start[first], end[last + window - 1])],
                    names=["gram", "h1", "h2", "dk", "first", "windows", "context"])

    return run


def whole_windows(window: int):
    """(h1, h2, dk, first, context) -> WHOLE: each window of a context by a hash of 128 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(3).to_numpy()
            for lo, _, words, bounds, _, _, row, _, first, last in anchored(batch.column(4).view(pa.string()), window, window):
                w1, w2 = (gram_hash(mix(words + np.uint64(k)), window)[first] for k in (1, 2))
                take = pa.array(lo + row)
                yield pa.RecordBatch.from_arrays([pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), *[batch.column(c).take(take) for c in range(3)],
                                                  pa.array((at[lo + row] + first - bounds[row]).astype(np.int32))], names=["w1", "w2", "h1", "h2", "dk", "first"])

    return run


def ranked(words: np.ndarray, rest: np.ndarray, longest: int) -> list[np.ndarray]:
    """Ranks of the strings of 1, 2, 4, ... words from each word on, by prefix doubling, up to over half of ``longest``.

    rest: words from here to the end of the context, where strings end; an end sorts first."""
    out = [np.unique(words, return_inverse=True)[1].astype(np.int64) + 1]
    while 2 << len(out) - 1 <= longest:
        size, last = 1 << len(out) - 1, out[-1]
        after = np.zeros(len(last), np.int64)
        on = np.flatnonzero(rest > size)
        after[on] = last[on + size]
        out.append(np.unique(last * (len(last) + 2) + after, return_inverse=True)[1].astype(np.int64) + 1)
    return out


def suffix_array(words: np.ndarray, rest: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the suffixes ``leaves`` in order, common prefix of each with the one before)."""
    if not len(leaves):
        return leaves, np.zeros(0, np.int64)
    ranks = ranked(words, rest, int(rest[leaves].max()))
    size = 1 << len(ranks) - 1
    after = np.where(rest[leaves] > size, ranks[-1][np.minimum(leaves + size, len(words) - 1)], 0)
    order = leaves[np.lexsort((after, ranks[-1][leaves]))]
    a, b = order[:-1], order[1:]
    least, common = np.minimum(rest[a], rest[b]), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        on = np.flatnonzero(common < least)
        same = ranks[k][a[on] + common[on]] == ranks[k][b[on] + common[on]]
        common[on[same]] += 1 << k
    return order, np.concatenate([[0], np.minimum(common, least)])


def internal_nodes(lcp: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(depth, first leaf, leaf after the last) of the internal nodes of at least ``least`` units, parents before children.

    A node of depth d is a run of leaves whose neighbours share d units or more, some of them no more than d."""
    depth, lo, hi = [], [], []
    for d in np.unique(lcp[lcp >= least]).tolist():
        deep = np.concatenate([[False], lcp >= d, [False]])
        first, stop = np.flatnonzero(deep[1:] & ~deep[:-1]), np.flatnonzero(deep[:-1] & ~deep[1:])
        exact = np.concatenate([[0], np.cumsum(lcp == d)])
        on = exact[stop] > exact[first]
        lo.append(first[on] - 1)
        hi.append(stop[on])
        depth.append(np.full(int(on.sum()), d))
    none = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(v or none) for v in (depth, lo, hi))


def repeated_depth(lcp: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """Depth of the deepest node above each leaf that also has a leaf of a smaller owner; 0 where none reaches ``least``."""
    out = np.zeros(len(owner), np.int64)
    depth, lo, hi = internal_nodes(lcp, least)
    for d in np.unique(depth):
        on = depth == d
        size = (hi - lo)[on]
        leaf = ranges(lo[on], size)
        smallest = np.minimum.reduceat(owner[leaf], np.cumsum(size) - size)
        out[leaf[owner[leaf] > np.repeat(smallest, size)]] = d
    return out


def subtree(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, window in its context, in suffix order, common prefixes, first window of each row) of whole groups of contexts."""
    windows = table["windows"].to_numpy().astype(np.int64)
    raw, at = text_buffer(table["context"].combine_chunks().view(pa.string()))
    start, end, bounds = word_spans(raw, at, space_table())
    words = span_hash(prefix(byte_values()[raw]), start, end)
    rest = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(words))
    order, lcp = suffix_array(words, rest, ranges(bounds[:-1], windows))
    row = np.searchsorted(bounds, order, "right") - 1
    return row, order - bounds[row], lcp, np.cumsum(windows) - windows, windows


def solve(table: pa.Table, window: int) -> pa.RecordBatch:
    """Whole groups of contexts -> INTERVALS that windows of smaller documents cover."""
    dk, th = table["dk"].to_numpy(), table["th"].to_numpy()
    lists = table["places"].combine_chunks()
    flat, many = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
    row, at, lcp, _, _ = subtree(table)
    reach = repeated_depth(lcp, dk[row], window)
    hit = np.flatnonzero(reach)
    first, last = np.full(len(dk), 1 << 40), np.full(len(dk), -1)
    np.minimum.at(first, row[hit], at[hit])
    np.maximum.at(last, row[hit], at[hit] + reach[hit])
    place = np.repeat(np.arange(len(dk)), many)
    on = last[place] > 0
    place, flat = place[on], flat[on]
    return pa.RecordBatch.from_arrays([pa.array(dk[place]), pa.array(th[place]), pa.array(flat + first[place]), pa.array(flat + last[place])], names=["dk", "th", "start", "stop"])


def solve_least(table: pa.Table, window: int) -> pa.RecordBatch:
    """Whole groups of PARTS -> LEAST: the smallest dk below the uppermost deep node above each window, or its own."""
    row, at, lcp, begin, windows = subtree(table)
    owner = table["dk"].to_numpy()[row]
    node = np.cumsum(lcp < window)
    smallest = np.minimum.reduceat(owner, np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))) if len(owner) else owner
    least = np.empty(len(owner), np.int64)
    if len(owner):
        least[begin[row] + at] = smallest[node - node[0]]
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(least)).astype(np.int32)), pa.array(least))
    return pa.RecordBatch.from_arrays([*[table[c].combine_chunks() for c in ("h1", "h2", "first")], lists], names=["h1", "h2", "first", "least"])


def frequent_intervals(members: DataFrame, window: int, longer: tuple[int, ...], group_rows: int, flush_rows: int, parts_of: int) -> DataFrame:
    """MEMBERS of frequent grams -> INTERVALS. Trees hold different contexts only, dealt by the first of the ``longer`` grams that fits."""
    session = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.groupBy("h1", "h2").agg(F.min("least").alias("dk"), F.min("context").alias("context"))
    rows, found = rows.select("h1", "h2", "dk", F.lit(0).alias("first"), "context"), []
    for gram in longer:
        parts = land(rows.mapInArrow(parts_of_contexts(window, gram), PARTS), f"contexts-by-{gram}-words")
        counts = land(parts.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")), f"grams-of-{gram}-words")
        size = counts.agg(F.sum("rows").alias("rows"), F.max("rows").alias("most")).first()
        every = (size["most"] or 0) <= group_rows
        fit = parts if every else parts.join(counts.where(F.col("rows") <= group_rows).select("gram"), "gram").select(parts.columns)
        n = max(session, -(-int(size["rows"] or 0) // parts_of))
        found.append(fit.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(resolve(flush_rows, lambda t: solve_least(t, window)), LEAST))
        if every:
            break
        rows = parts.join(counts.where(F.col("rows") > group_rows).select("gram"), "gram").select("h1", "h2", "dk", "first", "context")
    else:
        single = rows.mapInArrow(whole_windows(window), WHOLE)
        least = single.groupBy("w1", "w2").agg(F.min("dk").alias("least"))
        found.append(single.join(least, ["w1", "w2"]).select("h1", "h2", "first", F.array("least").alias("least")))
    each = F.transform("least", lambda x, i: F.struct((F.col("first") + i).alias("at"), x.alias("dk")))
    least = reduce(DataFrame.unionByName, found).groupBy("h1", "h2").agg(F.flatten(F.collect_list(each)).alias("least"))
    back = members.select("h1", "h2", "chunk", "dk", "th", "place").join(small(least, BROADCAST_ROWS), ["h1", "h2"])
    back = back.select("chunk", "dk", "th", "place", F.col("least")["at"].cast("array<long>").alias("at"), F.col("least")["dk"].alias("least")).mapInArrow(covered_members(window), COVERED)
    # Those of a chunk come together again before they are told apart: one row for each stretch of a document, not for each context.
    return back.groupBy("chunk").agg(F.collect_list("found").alias("found")).select("found").mapInArrow(joined_intervals, INTERVALS)


def repeated_words(base: DataFrame, window: int, prefixes: tuple[int, ...], group_rows: int, flush_rows: int = 10_000, context_bytes: int = 64 << 20) -> DataFrame:
    """(dk, th, spans): intervals of words, from 0 in the document, that windows cover which also start in a document of smaller dk.

    base: dk, th, text and others. prefixes: lengths of grams, ascending, at most ``window``. group_rows: contexts of one gram
    that a task may hold; those of more frequent grams take the next length, and beyond the last go by hashes."""
    session = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    gram, parts_of = prefixes[0], context_bytes // (8 * window)
    found = base.select("dk", "th", "text").mapInArrow(grams_of_documents(window, gram), GRAMS)
    counts = found.groupBy("gram").agg((F.min("dk") < F.max("dk")).alias("many"), F.sum("n").alias("rows"))
    again = land(counts.where("many").select("gram", "rows"), "repeated-grams")
    fits = F.col("rows") <= group_rows
    size = again.agg(F.sum(F.when(fits, F.col("rows"))).alias("rows"), F.max("rows").alias("most")).first()

    def texts(grams: DataFrame) -> DataFrame:
        """Texts with their grams of those given, else none. An outer join keeps the shuffle of texts the one that the caller uses again."""
        lists = found.join(grams.select("gram"), "gram").groupBy("dk", "th").agg(F.collect_list("gram").alias("grams"))
        return base.join(lists, ["dk", "th"], "left").select("dk", "th", F.when(F.col("grams").isNotNull(), F.col("text")).alias("text"), "grams")

    n = max(session, -(-int(size["rows"] or 0) // parts_of))
    rows = texts(again.where(fits)).mapInArrow(contexts_of_documents(window, gram), CONTEXTS)
    out = rows.repartition(n, "gram").sortWithinPartitions("gram").mapInArrow(resolve(flush_rows, lambda t: solve(t, window)), INTERVALS)
    if (size["most"] or 0) > group_rows:
        frequent = again.where(~fits).select("gram")
        if frequent.count() <= LISTED_GRAMS:  # no shuffle of texts
            few = Few(np.array([r["gram"] for r in frequent.collect()], np.int64))
            members = base.select("dk", "th", "text").mapInArrow(members_of_documents(window, gram, few), MEMBERS)
        else:
            members = texts(frequent).mapInArrow(members_of_documents(window, gram), MEMBERS)
        members = land(members, "contexts-of-frequent-grams")
        out = out.unionByName(frequent_intervals(members, window, prefixes[1:], group_rows, flush_rows, parts_of))
    return out.groupBy("dk", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
