"""Phrases of two to four words counted by direct-address tiling, scored by their weakest cut.

1. Words of every language are counted, combined in tasks. Those with enough occurrences are numbered by frequency, all
   languages together, so a number stands for a word of one language.
2. Texts become arrays of numbers; separators and rarer words are -1. Neighbouring numbers are a pair. A task cuts the square
   of numbers into tiles: in tiles that its pairs fill well a pair is an address, counted by a dense bincount; the pairs of all
   other tiles are sorted coordinates with counts. Frequent words have small numbers, so the full tiles lie near the origin.
   Spark adds up the cells of the tasks.
3. Frequent pairs are numbered by frequency in turn. The pairs at neighbouring places overlap in a word, so a pair of pairs is
   a phrase of three words, and a pair of these one of four: each level is the same step on the numbers of the level before. A
   part of a frequent phrase is frequent, so no frequent phrase is lost.
4. Every frequent phrase keeps the counts of all its beginnings and endings, which are those of its two halves and its own.

Numbers up to a bound are looked up in tasks, in a table that goes to them by broadcast: the most frequent codes. The codes of
a document beyond it are joined by the key. Those are rare ones by their rank, so no key of the join is hot.

Handling. A null language is ``und``, together with texts of that language; null and empty texts have no words. Repeated rows
count as often as they stand there; ids are not read. An empty table gives an empty result. Other columns do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import ordinal
from .common import land

#: Bytes that end a piece are tokens of their own, which no word equals.
TOKENS = re.compile(rb"[.,;:!?\x0A-\x0D]|[^\x20\x09.,;:!?\x0A-\x0D]+")
#: Codes that go to the tasks at each level; those of lower rank are joined.
HEAD = 400_000
#: Edge of a tile, the share of its cells from which it is counted densely, dense tiles a task holds, pairs counted at a time.
EDGE, DENSE, TILES, PAIRS = 1024, 1 / 16, 8, 1 << 20
#: Sorted cells a task holds before they go to Spark, and counted words.
CELLS, WORDS = 1 << 20, 400_000


def _language(lang: str | None) -> str:
    return "und" if lang is None else lang


def _tokens(text: str | None) -> list[bytes]:
    return TOKENS.findall(text.encode().lower()) if text else []


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, f."""

    def kernel(batches):
        counts: dict[str, Counter] = {}

        def flush():
            rows = [(lang, w, c) for lang, own in counts.items() for w, c in own.items() if w[0] not in b".,;:!?\n\x0b\x0c\r"]
            counts.clear()
            lang, word, f = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array([w.decode() for w in word], pa.string()), pa.array(f, pa.int64())], names=["lang", "word", "f"])

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts.setdefault(_language(lang), Counter()).update(_tokens(text))
                if sum(map(len, counts.values())) > WORDS:
                    yield flush()
        yield flush()

    return docs.select("lang", "text").mapInArrow(kernel, "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))


def numbered(counted: DataFrame, label: str) -> DataFrame:
    """``number`` from 0 by falling f, ties by a hash of the other columns, added.

    No task sorts all rows: runs of equal f, for small f cut further by the hash, are sorted apart, and of large f, which few
    rows have, runs of nearly equal f. Numbers have 31 bits; more rows are an error.
    """
    own = [c for c in counted.columns if c != "f"]
    tie, f = F.xxhash64(*own), F.col("f")
    exact = F.struct((-f).alias("f"), F.when(f < 256, F.shiftright(tie, 58)).otherwise(0).cast("int").alias("k"))
    rough = F.struct((-4096 - F.floor(F.log2(f / F.lit(4096.0)) * 64)).cast("long").alias("f"), F.lit(0).alias("k"))
    rows = counted.withColumns({"_all": F.lit(0), "_fall": -f, "_tie": tie, "_run": F.when(f < 4096, exact).otherwise(rough)})
    out = ordinal(rows, ["_all"], "_run", ["_fall", "_tie", *own], "number")
    return land(out.select((F.col("number") - 1).cast("int").alias("number"), *counted.columns), label)


def _join_rest(coded: DataFrame, rest: DataFrame, on: list[str]) -> DataFrame:
    """Numbers of codes beyond the head, as the arrays ``keys`` and ``values`` of each document that has some."""
    wanted = coded.select("doc", *[c for c in on if c != "code"], F.explode("open").alias("code"))
    return wanted.join(rest, on).groupBy("doc").agg(F.collect_list(F.struct("code", "number")).alias("found"))


def _filled(coded: DataFrame, table: DataFrame, on: list[str], label: str) -> DataFrame:
    """doc, ids with the open places, marked by -2 - (index in open), filled in from the table's rows beyond the head."""
    landed = land(coded, label)
    rest = table.where(F.col("number") >= HEAD).select(*on, "number")
    if not rest.limit(1).count():
        return landed.select("doc", "ids")
    joined = landed.join(_join_rest(landed.where(F.size("open") > 0), rest, on), "doc", "left")

    def kernel(batches):
        for batch in batches:
            out = []
            for ids, open_codes, found in zip(*(batch.column(c).to_pylist() for c in ("ids", "open", "found")), strict=True):
                numbers = {r["code"]: r["number"] for r in found or ()}
                to = np.array([*(numbers.get(c, -1) for c in open_codes), -1], np.int32)
                own = np.array(ids, np.int32)
                out.append(np.where(own < -1, to[np.clip(-2 - own, 0, len(open_codes))], own))
            at = np.cumsum([0, *map(len, out)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), lists], names=["doc", "ids"])

    return land(joined.select("doc", "ids", "open", "found").mapInArrow(kernel, "doc long, ids array<int>"), label)


def encode_words(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc, ids: the numbers of the words of each text, -1 for rarer words and ends of pieces."""
    head = table.where(F.col("number") < HEAD).select("lang", "word", "number").toArrow()
    more = table.count() > HEAD
    shared = docs.sparkSession.sparkContext.broadcast((head["lang"].to_pylist(), head["word"].to_pylist(), head["number"].to_pylist(), more))

    def kernel(batches):
        langs, words, numbers, more = shared.value
        known: dict[str, dict[bytes, int]] = {}
        for lang, w, n in zip(langs, words, numbers, strict=True):
            known.setdefault(lang, {})[w.encode()] = n
        for batch in batches:
            out, opened = [], []
            for lang, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "text")), strict=True):
                own, left = known.get(_language(lang), {}), {}
                if more:
                    ids = [own[t] if t in own else -1 if t[0] in b".,;:!?\n\x0b\x0c\r" else -2 - left.setdefault(t, len(left)) for t in _tokens(text)]
                else:
                    ids = [own.get(t, -1) for t in _tokens(text)]
                out.append(np.array(ids, np.int32))
                opened.append([t.decode() for t in left])
            at = np.cumsum([0, *map(len, out)])
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *out])))
            lang = pa.array([_language(v) for v in batch.column("lang").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), lang, lists, pa.array(opened, pa.list_(pa.string()))], names=["doc", "lang", "ids", "open"])

    rows = docs.select(F.monotonically_increasing_id().alias("doc"), "lang", "text")
    coded = rows.mapInArrow(kernel, "doc long, lang string, ids array<int>, open array<string>")
    return _filled(coded, table.withColumnRenamed("word", "code"), ["lang", "code"], "words")


def _pairs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, offsets, code of the pair that begins at each number or -1) of an array column."""
    at = column.offsets.to_numpy().astype(np.int64)
    ids = column.values.to_numpy(zero_copy_only=False)[at[0]:at[-1]].astype(np.int64)
    at = at - at[0]
    code = np.full(len(ids), -1, np.int64)
    if len(ids) > 1:
        whole = (ids[:-1] >= 0) & (ids[1:] >= 0)
        code[:-1] = np.where(whole, ids[:-1] << 32 | ids[1:], -1)
        ends = at[1:] - 1
        code[ends[ends >= 0]] = -1
    return ids, at, code


class Tiles:
    """Counts of pairs in a task: dense arrays for full tiles, sorted coordinates for the rest."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, code: np.ndarray) -> None:
        x, y = code >> 32, code & 0xFFFFFFFF
        tile, cell = (x // EDGE) << 32 | y // EDGE, (x % EDGE) * EDGE + y % EDGE
        if len(self.dense) < TILES:
            names, n = np.unique(tile, return_counts=True)
            for k in np.argsort(-n, kind="stable")[:TILES - len(self.dense)]:
                if n[k] >= DENSE * EDGE * EDGE and int(names[k]) not in self.dense:
                    self.dense[int(names[k])] = np.zeros(EDGE * EDGE, np.int64)
        rest = np.ones(len(code), bool)
        for name, cells in self.dense.items():
            own = tile == name
            cells += np.bincount(cell[own], minlength=EDGE * EDGE)
            rest &= ~own
        new, counts = np.unique(code[rest], return_counts=True)
        both = np.concatenate([self.codes, new])
        self.codes, place = np.unique(both, return_inverse=True)
        total = np.zeros(len(self.codes), np.int64)
        np.add.at(total, place, np.concatenate([self.counts, counts]))
        self.counts = total

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.codes, self.counts
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return out

    def full(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for name, cells in self.dense.items():
            at = np.flatnonzero(cells)
            x, y = (name >> 32) * EDGE + at // EDGE, (name & 0xFFFFFFFF) * EDGE + at % EDGE
            yield x << 32 | y, cells[at]


def count_pairs(coded: DataFrame, least: int) -> DataFrame:
    """code, f of the pairs of neighbouring numbers with at least so many occurrences."""

    def kernel(batches):
        tiles, waiting, held = Tiles(), [], 0
        rows = lambda r: pa.RecordBatch.from_arrays([pa.array(r[0]), pa.array(r[1])], names=["code", "f"])
        for batch in batches:
            _, _, code = _pairs(batch.column("ids"))
            for lo in range(0, len(code), PAIRS):
                part = code[lo:lo + PAIRS]
                waiting.append(part[part >= 0])
                held += len(waiting[-1])
                if held >= PAIRS:
                    tiles.add(np.concatenate(waiting))
                    waiting, held = [], 0
                    if len(tiles.codes) > CELLS:
                        yield rows(tiles.sparse())
        if held:
            tiles.add(np.concatenate(waiting))
        yield rows(tiles.sparse())
        yield from map(rows, tiles.full())

    cells = coded.select("ids").mapInArrow(kernel, "code long, f long")
    return cells.groupBy("code").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def encode_pairs(coded: DataFrame, table: DataFrame, label: str) -> DataFrame:
    """doc, ids: the number of the pair that begins at each place, -1 where there is no frequent one."""
    head = table.where(F.col("number") < HEAD).select("code", "number").toArrow()
    codes, numbers = head["code"].to_numpy(), head["number"].to_numpy()
    order = np.argsort(codes)
    shared = coded.sparkSession.sparkContext.broadcast((codes[order], numbers[order].astype(np.int32), table.count() > HEAD))

    def kernel(batches):
        codes, numbers, more = shared.value
        for batch in batches:
            _, at, code = _pairs(batch.column("ids"))
            place = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
            hit = (codes[place] == code) & (code >= 0) if len(codes) else np.zeros(len(code), bool)
            ids = np.where(hit, numbers[place] if len(codes) else -1, -1).astype(np.int32)
            opened, bounds = np.zeros(0, np.int64), np.zeros(len(at), np.int64)
            if more:
                left = np.flatnonzero(~hit & (code >= 0))
                doc = np.searchsorted(at, left, side="right") - 1
                pairs, place = np.unique(np.stack([doc, code[left]]), axis=1, return_inverse=True)
                bounds = np.searchsorted(pairs[0], np.arange(len(at)))
                ids[left] = (-2 - (place.ravel() - bounds[doc])).astype(np.int32)
                opened = pairs[1]
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
            opened = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(opened))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), lists, opened], names=["doc", "ids", "open"])

    out = coded.select("doc", "ids").mapInArrow(kernel, "doc long, ids array<int>, open array<bigint>")
    return _filled(out, table, ["code"], label)


def described(table: DataFrame, below: DataFrame, label: str) -> DataFrame:
    """Phrases of the next level from numbered pairs: number, f, left, right, lang, words, starts (counts of the first 1, 2, ..
    words), ends (counts of the last 1, 2, .. words)."""
    half = below.select("number", "lang", "words", "starts", "ends")
    a = half.select(F.col("number").alias("left"), "lang", F.col("words").alias("_w"), "starts")
    b = half.select(F.col("number").alias("right"), F.element_at("words", -1).alias("_last"), "ends")
    pairs = table.select("number", "f", F.shiftright("code", 32).cast("int").alias("left"), F.col("code").bitwiseAND(0xFFFFFFFF).cast("int").alias("right"))
    out = pairs.join(a, "left").join(b, "right")
    own = F.array("f")
    return land(out.select("number", "f", "left", "right", "lang", F.concat("_w", F.array("_last")).alias("words"), F.concat("starts", own).alias("starts"), F.concat("ends", own).alias("ends")), label)


def scored(level: DataFrame, above: DataFrame | None, size: int) -> DataFrame:
    """lang, phrase, a, l, r, score of the phrases of so many words, without those that a phrase of one more word covers.

    A longer phrase that covers one contains a phrase of one more word with at least its own count, so these decide.
    """
    a = F.col("f")
    cuts = []
    for k in range(1, size):
        l, r = F.element_at("starts", k), F.element_at("ends", size - k)
        wide = lambda c: c.cast("decimal(20,0)")
        cuts.append(F.struct((F.floor((wide(a) * F.lit(2_000_000).cast("decimal(7,0)") - (wide(a) * F.lit(2_000_000).cast("decimal(7,0)")) % (wide(l) + wide(r))) / (wide(l) + wide(r)))).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")))
    if above is not None:
        covers = above.select(F.col("left").alias("number"), F.col("f").alias("_more")).unionByName(above.select(F.col("right").alias("number"), F.col("f").alias("_more")))
        covers = covers.groupBy("number").agg(F.max("_more").alias("_more"))
        level = level.join(covers, "number", "left").where(F.col("_more").isNull() | (F.col("_more").cast("decimal(20,0)") * 100 < a.cast("decimal(20,0)") * 80))
    best = F.array_min(F.array(*cuts))
    return level.select("lang", F.array_join("words", " ").alias("phrase"), a.alias("a"), best["l"].alias("l"), best["r"].alias("r"), best["score"].cast("long").alias("score"))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, DataFrame]:
    """All phrases with their counts and scores (lang, phrase, a, l, r, score), and the words of each language (lang, n)."""
    words = land(count_words(docs), "word_counts")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    table = numbered(words.where(F.col("f") >= least), "ranked_words")
    coded = encode_words(docs, table)
    levels = [table.select("number", "f", "lang", F.array("word").alias("words"), F.array("f").alias("starts"), F.array("f").alias("ends"))]
    for size in range(2, longest + 1):
        ranked = numbered(count_pairs(coded, least), f"ranked_{size}")
        levels.append(described(ranked, levels[-1], f"phrases_{size}"))
        if size < longest:
            coded = encode_pairs(coded, ranked, f"places_{size}")
    parts = [scored(levels[size - 1], levels[size] if size < longest else None, size) for size in range(2, longest + 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, totals


def top_phrases(phrases: DataFrame, totals: DataFrame, most: int = 2000) -> DataFrame:
    """Each language's first phrases by score and count falling, then by their bytes."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    first = phrases.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
