"""Near-duplicates by b-bit MinHash.

Documents with equal shingle sets form a class, and only classes are compared. Bands of minima give candidates; the packed
low bits of the minima give an estimate of the similarity, corrected for chance collisions; what may be similar enough is
confirmed on the full sets.

A bucket of a band never emits all its pairs. First each class is compared with the bucket's least class, and the links found
give components. Then only pairs of one bucket in different components are left; they are compared by their packed signatures
in blocks of bounded size, and only those that may be links are emitted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, passing
from .components import connected_components
from .kernels import BASE, byte_values, chunks, gram_hash, lower_table, mix, prefix, ranges, space_table, span_hash, text_buffer, word_spans

ROWS, BANDS, BITS = 4, 24, 4
HASHES = ROWS * BANDS
#: Standard deviations of the estimate below the threshold that are still confirmed.
SIGMAS = 5.0
SIGNATURES = "doc_id long, n_shingles long, s1 long, s2 long, sig binary, bands array<long>"


def shingle_sets(part: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes by document, bounds); a text of fewer than k words is one shingle."""
    low = lower_table()[part]
    start, end, bounds = word_spans(low, at, space_table())
    h = span_hash(prefix(byte_values()[low]), start, end) if len(start) else np.zeros(0, np.uint64)
    n = np.diff(bounds)
    grams = gram_hash(h, k)
    full = np.maximum(n - k + 1, 0)
    where = ranges(bounds[:-1], full)
    doc, value = np.repeat(np.arange(len(n)), full), grams[where]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        own = [mix(gram_hash(h[bounds[i]:bounds[i + 1]], int(n[i])) + n[i].astype(np.uint64))[0] for i in short]
        doc, value = np.concatenate([doc, short]), np.concatenate([value, np.array(own, np.uint64)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    if len(doc):
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
        doc, value = doc[new], value[new]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def set_keys(value: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name a set: two sums of mixed hashes."""
    out = []
    for salt in (1, 2):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(value + np.uint64(salt)), dtype=np.uint64)])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(docs: DataFrame, k: int = 5) -> DataFrame:
    factors = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
    offsets_ = mix(factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi, part, at in chunks(raw, offsets):
                value, bounds = shingle_sets(part, at, k)
                n = np.diff(bounds)
                on = np.flatnonzero(n)
                least = np.zeros((hi - lo, HASHES), np.uint64)
                if len(on):
                    for i in range(HASHES):
                        least[on, i] = np.minimum.reduceat(value * factors[i] + offsets_[i], bounds[:-1][on])
                bands = np.zeros((hi - lo, BANDS), np.uint64)
                for r in range(ROWS):
                    bands = mix(bands * np.uint64(BASE) + least[:, r::ROWS])
                low = (mix(least) & np.uint64(15)).astype(np.uint8)
                packed = (low[:, ::2] << 4) | low[:, 1::2]
                s1, s2 = set_keys(value, bounds)
                none = n == 0
                wide = packed.shape[1]
                sig = pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(np.arange(0, (hi - lo + 1) * wide, wide, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(packed))])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(bands.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(s1, mask=none), pa.array(s2, mask=none), sig, lists],
                                                 names=[f.split()[0] for f in SIGNATURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURES)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed low bits (rows of 64-bit words): equal groups of bits, less the share that is equal by chance."""
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1)
    chance = 1.0 / (1 << BITS)
    return (1.0 - differ / HASHES - chance) / (1.0 - chance)


def floor_of(threshold: float) -> float:
    """Estimates below this are not links, but for a chance of SIGMAS standard deviations."""
    chance = 1.0 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * float(np.sqrt(p * (1 - p) / HASHES)) / (1 - chance)


def words_of_signatures(column: pa.Array) -> np.ndarray:
    raw, _ = text_buffer(column.view(pa.string()))
    return np.frombuffer(raw.tobytes(), np.uint64).reshape(len(column), -1)


def promising(pairs: DataFrame, threshold: float) -> DataFrame:
    """Of (a, b, sig_a, sig_b, n_a, n_b) the pairs (a, b) that the estimate and the sizes leave possible."""
    floor = floor_of(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                on = pa.array(estimate(words_of_signatures(batch.column(2)), words_of_signatures(batch.column(3))) >= floor)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(on), batch.column(1).filter(on)], names=["a", "b"])

    sized = pairs.where(F.least("n_a", "n_b") >= F.lit(threshold) * F.greatest("n_a", "n_b"))
    return sized.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _gathered(batches: Iterator[pa.RecordBatch], take) -> Iterator[list]:
    """Columns of rows of equal first column, which come one after the other; ``take`` turns columns into arrays or lists."""
    held, last = [], None
    for batch in batches:
        group = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)]]).tolist()
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a == z:
                continue
            if held and group[a] != last:
                yield [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            last = group[a]
            held.append(take(batch.slice(a, z - a)))
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _plain(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [x.to_numpy() for x in batch.columns[1:4]] + [words_of_signatures(batch.column(4))]


def _partners(i: int, component, n, sig, threshold: float, floor: float) -> np.ndarray:
    """Later rows of other components that sizes and estimates leave possible."""
    j = np.flatnonzero((component[i + 1:] != component[i]) & (np.minimum(n[i + 1:], n[i]) >= threshold * np.maximum(n[i + 1:], n[i]))) + i + 1
    return j[estimate(sig[j], sig[i]) >= floor] if len(j) else j


def in_small_buckets(members: DataFrame, threshold: float) -> DataFrame:
    """Of (g, node, component, n, sig), dealt out and sorted by g: pairs of different components that may be links."""
    floor = floor_of(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, component, n, sig in _gathered(batches, _plain):
            for i in range(len(node) - 1):
                j = _partners(i, component, n, sig, threshold, floor)
                if len(j):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[j], node[i])), pa.array(np.maximum(node[j], node[i]))], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def in_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """Of (g, node, component, n, sig, shingles), dealt out and sorted by g: links that join components.

    A group is two blocks of a large bucket. Its pairs are confirmed here, on the full sets, and only those links are emitted
    that join what was apart: fewer than rows."""
    floor, share = floor_of(threshold), round(threshold * 100)

    def take(batch: pa.RecordBatch) -> list[np.ndarray]:
        lists = batch.column(5)
        sets = np.empty(len(lists), object)
        flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        for i in range(len(lists)):
            sets[i] = flat[at[i]:at[i + 1]]
        return [*_plain(batch), sets]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for node, component, n, sig, sets in _gathered(batches, take):
            values, flat = np.unique(np.concatenate(list(sets)), return_inverse=True)
            at = np.concatenate([[0], np.cumsum(n)])
            mark, left, right = np.zeros(len(values), bool), [], []
            component = component.copy()
            for i in range(len(node) - 1):
                j = _partners(i, component, n, sig, threshold, floor)
                if not len(j):
                    continue
                mark[flat[at[i]:at[i + 1]]] = True
                both = np.add.reduceat(mark[flat[ranges(at[j], n[j])]].astype(np.int64), np.cumsum(n[j]) - n[j])
                mark[flat[at[i]:at[i + 1]]] = False
                for k in j[100 * both >= share * (n[j] + n[i] - both)].tolist():
                    if component[k] != component[i]:
                        left.append(min(node[i], node[k]))
                        right.append(max(node[i], node[k]))
                        component[component == component[k]] = component[i]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of (node, s1, s2): hashes of the full shingle sets, from the texts."""
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), F.col("text").cast("string").alias("text")).where("node is not null and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(3))
            s1, s2 = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, part, at in chunks(raw, offsets):
                value, bounds = shingle_sets(part, at, k)
                k1, k2 = set_keys(value, bounds)
                on = pa.array((k1 == s1[lo:hi]) & (k2 == s2[lo:hi]))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(on), lists.filter(on)], names=["node", "shingles"])

    return nodes.join(texts, "node").select("node", "s1", "s2", "text").mapInArrow(run, "node long, shingles array<long>").dropDuplicates(["node"])


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, threshold: float, k: int, portion: int = 500) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    Texts meet by a and a number below (partners of a) / portion, so that a document with many partners is dealt to many tasks.
    The set is compared with its class's key first: of rows that share a doc_id, that of the class is taken."""
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("partners"))
    dealt = pairs.join(counted, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("partners") / portion)).cast("int"))
    sides = dealt.select("a", "salt", F.col("b").alias("doc_id"), F.lit(1).alias("side")).unionByName(
        dealt.select("a", "salt").distinct().select("a", "salt", F.col("a").alias("doc_id"), F.lit(0).alias("side")))
    keyed = sides.join(classes.select(F.col("rep").alias("doc_id"), "s1", "s2"), "doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    rows = keyed.join(texts, "doc_id").select("a", "salt", "side", "doc_id", "s1", "s2", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "side")
    share = round(threshold * 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, salt, side, doc, s1, s2 = (batch.column(i).to_numpy() for i in range(6))
            raw, offsets = text_buffer(batch.column(6))
            found_a, found_b = [], []
            for lo, hi, part, at in chunks(raw, offsets):
                value, bounds = shingle_sets(part, at, k)
                k1, k2 = set_keys(value, bounds)
                for i in range(hi - lo):
                    r = lo + i
                    if k1[i] != s1[r] or k2[i] != s2[r]:
                        continue
                    mine = value[bounds[i]:bounds[i + 1]]
                    if side[r] == 0:
                        group, own = (a[r], salt[r]), mine.copy()
                    elif group == (a[r], salt[r]):
                        both = len(np.intersect1d(own, mine, assume_unique=True))
                        if 100 * both >= share * (len(own) + len(mine) - both):
                            found_a.append(a[r])
                            found_b.append(doc[r])
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, threshold: float = 0.85, k: int = 5, small_bucket: int = 64, block: int = 1000) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``.

    Shingles are k words, in lower case for A-Z; documents are linked when the similarity of their sets is ``threshold`` (in
    whole hundredths) or more. Null and empty texts and texts without words have no shingles and are linked with nothing.
    Repeated rows get equal results; rows that share a doc_id but
    not the text are told apart by their sets. A null doc_id is no document: component_id is null and kept true. Very long
    texts are read whole; an empty table gives an empty one; columns other than doc_id and text are not read.

    small_bucket: classes of a bucket up to which what may be a link is emitted for confirmation; in larger ones pairs of
    different components are confirmed within blocks of ``block`` classes. Both ways give the same links.

    A link is missed only if no band of both documents agrees, at 0.85 a chance of about 2e-8 and at 0.8 of
    about 3e-6, or the estimate is off by more
    than SIGMAS standard deviations."""
    with passing(docs.sparkSession) as put:
        return land(judged(docs, threshold, k, small_bucket, block, put), "near-duplicates")


def judged(docs: DataFrame, threshold: float, k: int, small_bucket: int, block: int, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What :func:`near_duplicates` returns, read from the tables that ``put`` landed."""
    rows = put(signatures(docs, k), "signatures")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("s1", "s2").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = put(classes, "classes")
    buckets = classes.select("rep", "n", "sig", F.posexplode("bands").alias("band", "key"))
    hubs = buckets.groupBy("band", "key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = put(buckets.join(hubs, ["band", "key"]), "buckets")
    one = shared.where("rep > hub").groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.first("sig").alias("sig_b"), F.first("n").alias("n_b"))
    hub_sigs = classes.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n").alias("n_a"))
    first = put(confirm(promising(one.join(hub_sigs, "a"), threshold), docs, classes, threshold, k), "links")
    found = connected_components(first, put=put)

    labelled = shared.select("band", "key", F.col("rep").alias("node"), "n", "sig", "size").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = labelled.groupBy("band", "key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band", "key")
    left = put(labelled.join(open_, ["band", "key"]), "open-members")
    few = left.where(F.col("size") <= small_bucket).withColumn("g", F.xxhash64("band", "key"))
    few = few.select("g", "node", "component", "n", "sig").repartition("g").sortWithinPartitions("g")
    some = put(in_small_buckets(few, threshold).distinct(), "open-pairs")
    links = first
    if not some.isEmpty():
        links = links.unionByName(confirm(some, docs, classes, threshold, k))
    many = left.where(F.col("size") > small_bucket)
    if not many.isEmpty():
        parts = F.ceil(F.col("size") / block).cast("int")
        many = many.withColumn("parts", parts).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        group = F.xxhash64("band", "key", F.least("mine", "other"), F.greatest("mine", "other"))
        keyed = many.select("node").distinct().join(classes.select(F.col("rep").alias("node"), "s1", "s2"), "node")
        sets = put(full_sets(docs, keyed, k), "open-sets")
        many = many.select(group.alias("g"), "node", "component", "n", "sig").join(sets, "node").select("g", "node", "component", "n", "sig", "shingles")
        links = links.unionByName(in_blocks(many.repartition("g").sortWithinPartitions("g", "node"), threshold))
    if links is not first:
        found = connected_components(links, put=put)
    named = classes.select("s1", "s2", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("c"))
    own = rows.select("doc_id", "n_shingles", "s1", "s2")
    out = own.join(named, ["s1", "s2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
