"""Packing documents into sequences as a cutting-stock problem solved by column generation.

A document is tokenised and cut into full sequences and a tail. The histogram of tail lengths, in steps of a few tokens, is
all that the linear program sees: a master problem over patterns, priced by a knapsack over lengths. Rounded patterns are
given to documents by their rank within a length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import land
from .kernels import byte_values, chunks, prefix, ranges, span_hash, text_buffer

#: Fixed value: the pre-tokenisation of the byte-level vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def segment_bounds(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of segments: documents, and single spaces between other characters.

    Byte-level pre-tokenisation always cuts before such a space, so segments can be encoded apart from each other."""
    space = np.isin(raw, np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160], np.uint8)) | (raw >= 0xC2)  # the last: any start of a wider character
    blank = raw == 32
    cut = np.zeros(len(raw), bool)
    if len(raw) > 2:
        plain = ~np.isin(raw, np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32], np.uint8))
        cut[1:-1] = blank[1:-1] & plain[:-2] & ~space[2:]
        # Wider white space ends in a byte of 0x80 or more; only ASCII before the space is certain not to be white space.
        cut[1:-1] &= raw[:-2] < 128
    first = offsets[:-1][np.diff(offsets) > 0]
    cut[first] = True
    return np.flatnonzero(cut)


def byte_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a byte-level vocabulary file, whose keys stand for bytes by printable characters."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    to_byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]["vocab"]
    return {bytes(to_byte[c] for c in k): v for k, v in model.items() if all(c in to_byte for c in k)}


def added_tokens(path: str) -> dict[bytes, int]:
    """Contents and ids of the tokens that a tokenizer file adds to its vocabulary."""
    with open(path, encoding="utf-8") as f:
        tokens = json.load(f).get("added_tokens") or []
    if any(t.get(flag) for t in tokens for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError(f"{path}: added tokens that depend on the text around them are not supported")
    return {t["content"].encode(): t["id"] for t in tokens if t["content"]}


def token_places(raw: np.ndarray, offsets: np.ndarray, tokens: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of added tokens within documents: the leftmost first, the longest of one start, without overlaps."""
    data, found = raw.tobytes() if tokens else b"", []
    for token in tokens:
        at = data.find(token)
        while at >= 0:
            found.append((at, -len(token)))
            at = data.find(token, at + 1)
    starts, ends = [], []
    for at, size in sorted(found):
        end = at - size
        if (not ends or at >= ends[-1]) and np.searchsorted(offsets, at, "right") == np.searchsorted(offsets, end, "left"):
            starts.append(at)
            ends.append(end)
    return np.array(starts, np.int64), np.array(ends, np.int64)


class Encoder:
    """Token ids of documents; each different segment is encoded once.

    The vocabulary is that of the tokenizer file; the merging is left to a faster library that gives the same ids (tests
    compare them). added: a text that holds the content of an added token of the file has that token's id there, as the
    tokenizer gives by default; else it is text like any other."""

    def __init__(self, path: str, most: int = 1_500_000, added: bool = False):
        import tiktoken

        ranks = byte_ranks(path)
        ranks = {k: v for k, v in ranks.items() if k != b"<|endoftext|>"}
        self.tokenizer, self.most = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), most
        self.added = added_tokens(path) if added else {}
        self.clear()

    def clear(self):
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.sizes, self.flat, self.count = np.zeros(0, np.int64), np.zeros(1 << 20, np.uint32), 0

    def learn(self, keys: np.ndarray, texts: list[str]):
        """Add segments; ``keys`` ascend."""
        encode, ids, own = self.tokenizer.encode_ordinary, [], {k.decode(): [v] for k, v in self.added.items()}
        sizes = np.fromiter((ids.extend(x) or len(x) for x in (own.get(t) or encode(t) for t in texts)), np.int64, len(texts))
        if self.count + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(ids), len(self.flat)), np.uint32)])
        self.flat[self.count:self.count + len(ids)] = ids
        at = self.count + np.cumsum(sizes) - sizes
        self.count += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.sizes = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.sizes, place, sizes)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents, where each begins)."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        starts = segment_bounds(raw, offsets)
        token, stop = token_places(raw, offsets, self.added)
        if len(token):
            last = np.searchsorted(token, starts, "right") - 1
            inside = (last >= 0) & (starts < stop[last]) & (starts > token[last])
            starts = np.unique(np.concatenate([starts[~inside], token, stop[stop < len(raw)]]))
        ends = np.append(starts[1:], len(raw))
        key, first, which = np.unique(span_hash(prefix(byte_values()[raw]), starts, ends), return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.clear()
        there = np.searchsorted(self.keys, key)
        known = (there < len(self.keys)) & (self.keys[np.minimum(there, len(self.keys) - 1)] == key) if len(self.keys) else np.zeros(len(key), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            data = raw.tobytes()
            self.learn(key[new], [data[starts[i]:ends[i]].decode("utf-8", "replace") for i in first[new]])
        slot = np.searchsorted(self.keys, key)[which]
        sizes = self.sizes[slot]
        ids = self.flat[ranges(self.at[slot], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, total[np.searchsorted(starts, offsets)]


def cut_documents(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Pieces of every document: full sequences, then the tail, in two where it is longer than half a sequence (short pieces
    leave little padding). ``with_ids`` adds their token ids."""
    half = capacity // 2
    schema = PIECES + (", ids array<long>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, added=True)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            for lo, hi, part, at in chunks(raw, offsets):
                ids, begin = encoder.encode(part, at)
                n = np.diff(begin) + 1
                full_pieces, rest = n // capacity, n % capacity
                pieces = full_pieces + (rest > 0) + (rest > half)
                doc = np.repeat(np.arange(hi - lo), pieces)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = np.minimum(nth, full_pieces[doc]) * capacity + np.where(nth > full_pieces[doc], half, 0)
                length = np.minimum(np.where(nth < full_pieces[doc], capacity, half), n[doc] - start)
                full = np.insert(ids, begin[1:], np.uint32(end_id)).astype("<u4")
                whole, where = full.tobytes(), np.cumsum(n) - n
                a = where[doc] + start
                crc = [zlib.crc32(whole[4 * x:4 * y]) for x, y in zip(a.tolist(), (a + length).tolist(), strict=True)]
                cols = [batch.column(0).slice(lo, hi - lo).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(n[doc])]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([a, [len(full)]]).astype(np.int32)), pa.array(full.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def best_pattern(prices: np.ndarray, units: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: (worth, copies of each size) of the pattern worth most."""
    worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(units, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        worth[c], k = worth[c - 1], fits[c]
        if k:
            got = worth[c - units[:k]] + prices[:k]
            i = int(got.argmax())
            if got[i] > worth[c] + 1e-12:
                worth[c], last[c] = got[i], i
    c, copies = capacity, np.zeros(len(units), np.int64)
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            copies[last[c]] += 1
            c -= int(units[last[c]])
    return float(worth[capacity]), copies


def solve_patterns(units: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.001, rounds: int = 5000) -> list[tuple[np.ndarray, int]]:
    """Patterns (copies of each size) and how often each is used; together they hold exactly ``demand`` pieces.

    units: ascending sizes, in the unit of ``capacity``. Revised simplex with column generation, begun from one pattern for
    each size and ended when no pattern is worth more than 1 + gap, which bounds the distance from the optimum. The solution
    is rounded down; the rest, at most a pattern for each size, is packed first fit decreasing."""
    m = len(units)
    if not m:
        return []
    columns = np.diag(np.maximum(1, capacity // units)).astype(np.float64)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(rounds):
        value, pattern = best_pattern(inverse.sum(axis=0), units, capacity)
        if value <= 1 + gap:
            break
        direction = inverse @ pattern
        ratio = np.where(direction > 1e-10, x / np.where(direction > 1e-10, direction, 1.0), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * direction, 0.0)
        x[out], columns[:, out] = ratio[out], pattern
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
    left, used = demand.astype(np.int64).copy(), []
    for i in np.argsort(-x, kind="stable"):
        pattern = columns[:, i].astype(np.int64)
        on = pattern > 0
        n = min(int(x[i] + 1e-9), int((left[on] // pattern[on]).min()))
        if n > 0:
            used.append((pattern, n))
            left -= n * pattern
    while left.any():
        room, pattern = capacity, np.zeros(m, np.int64)
        for i in range(m - 1, -1, -1):
            k = min(int(left[i]), room // int(units[i]))
            pattern[i], room = k, room - k * int(units[i])
        n = int((left[pattern > 0] // pattern[pattern > 0]).min())
        used.append((pattern, n))
        left -= n * pattern
    return used


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, step: int = 4, end_id: int = 0, buckets: int = 256, with_ids: bool = False) -> DataFrame:
    """Pieces with sequence_id and offset.

    Ids are those of the tokenizer without the tokens it would put around a text; the content of an added token in a text is
    that token. Every document ends in ``end_id``; null and empty texts have that id alone. A piece as long as the capacity is a sequence
    of its own. Repeated rows are packed each for itself; ties in rank are broken by the piece's columns, and pieces alike in
    all of them are interchangeable. An empty table gives an empty one; columns other than doc_id and text are not read.

    To the driver come at most capacity / step counts of lengths; to executors go the slots of at most twice as many patterns.
    Ranks within a length are counted by (length, hash bucket) first, so no length is ranked by one task.
    """
    pieces = land(cut_documents(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    whole = F.col("length") == capacity
    kind = F.when(whole, F.lit(0)).otherwise(F.ceil(F.col("length") / F.lit(step)).cast("int"))
    spark = docs.sparkSession
    parts = pieces.withColumn("kind", kind).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = land(parts.groupBy("kind", "bucket").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    before = Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("kind", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    local = Window.partitionBy("kind", "bucket").orderBy("doc_id", "start", "ids_crc32")
    # At most (capacity / step + 1) * buckets rows.
    ranked = parts.join(F.broadcast(base), ["kind", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(local) - 1).drop("base", "bucket")

    tally = {r["kind"]: r["n"] for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    kinds = np.array(sorted(k for k in tally if k), np.int64)
    slots, sequence, seen = [], int(tally.get(0, 0)), dict.fromkeys(kinds.tolist(), 0)
    for pattern, times in solve_patterns(kinds, np.array([tally[k] for k in kinds.tolist()], np.float64), capacity // step):
        at = 0
        for i in np.flatnonzero(pattern):
            k, each = int(kinds[i]), int(pattern[i])
            slots.append((k, seen[k], seen[k] + each * times, each, sequence, at))
            seen[k] += each * times
            at += each
        sequence += times
    # Piece number ``rank`` of its kind lies in the slot whose range holds it: ``each`` pieces of that kind to a sequence.
    table = spark.createDataFrame(slots, "kind int, first long, stop long, each int, first_sequence long, place int")
    table = table.groupBy("kind").agg(F.sort_array(F.collect_list(F.struct("first", "stop", "each", "first_sequence", "place"))).alias("slots"))
    tails = ranked.where("kind > 0").join(F.broadcast(table), "kind")
    slot = F.filter("slots", lambda s: (s["first"] <= F.col("rank")) & (F.col("rank") < s["stop"]))[0]
    tails = tails.withColumn("slot", slot).drop("slots")
    within = F.col("rank") - F.col("slot.first")
    tails = tails.select(*pieces.columns, (F.col("slot.first_sequence") + F.floor(within / F.col("slot.each"))).cast("long").alias("sequence_id"),
                         (F.col("slot.place") + F.pmod(within, F.col("slot.each"))).alias("place"))
    order = Window.partitionBy("sequence_id").orderBy("place")  # at most the capacity of pieces
    tails = tails.withColumn("offset", (F.sum("length").over(order) - F.col("length")).cast("long")).drop("place")
    alone = ranked.where("kind = 0").select(*pieces.columns, F.col("rank").cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(tails)
