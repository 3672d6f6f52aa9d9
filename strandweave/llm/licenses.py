"""License scan with a positional index of rare words.

The index holds, for each template, the positions of its words of highest inverse document frequency: two more than the words
that may be changed, added or left out, so a notice that is near enough has at least two of them. A file's places of such a word, less
its position in the template, say where the template would begin; postings of a template are intersected by that relative
position, which added and missing words shift by no more than their number. Where two postings agree, the file's words are
aligned with the template by edit distance, and a label is given when few enough words differ and the template's key phrase
stands in the aligned stretch as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import alnum_table, byte_values, chunks, group_ids, lower_table, prefix, span_hash, text_buffer, word_spans

#: Fixed values: (label, phrase) of the base rules.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
#: (label, wording, key phrase): usual notices of public licenses.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc0", "released under the cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("gpl", "licensed under the gnu general public license", "gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license", "affero general public license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("copyright", "copyright all rights reserved", "all rights reserved"),
]
#: Stretches that are aligned with a template at a time.
SLICE = 1 << 16
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", text.translate({c: c + 32 for c in range(65, 91)}))


def hashed(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    raw = np.frombuffer(b"".join(data), np.uint8)
    ends = np.cumsum([len(d) for d in data])
    return span_hash(prefix(byte_values()[raw]), np.concatenate([[0], ends[:-1]]), ends) if data else np.zeros(0, np.uint64)


class Vocabulary:
    """Numbers of the words of templates and phrases; all other words have -1."""

    def __init__(self, texts: list[str]):
        self.words = sorted({w for t in texts for w in words_of(t)})
        h = hashed(self.words)
        self.order = np.argsort(h)
        self.sorted = h[self.order]
        self.number = {w: i for i, w in enumerate(self.words)}
        self.first = np.zeros(1 << 16, bool)
        self.first[(h & np.uint64(0xFFFF)).astype(np.int64)] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array([self.number[w] for w in words_of(text)], np.int16)

    def lookup(self, part: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each word, bounds of documents)."""
        low = lower_table()[part]
        start, end, bounds = word_spans(low, at, alnum_table())
        out = np.full(len(start), -1, np.int16)
        if len(start):
            h = span_hash(prefix(byte_values()[low]), start, end)
            maybe = np.flatnonzero(self.first[(h & np.uint64(0xFFFF)).astype(np.int64)])
            slot = np.minimum(np.searchsorted(self.sorted, h[maybe]), len(self.sorted) - 1)
            hit = self.sorted[slot] == h[maybe]
            out[maybe[hit]] = self.order[slot[hit]]
        return out, bounds


@dataclass
class Index:
    vocabulary: Vocabulary
    templates: list[tuple[str, np.ndarray, np.ndarray, int]]  # label, words, key phrase, words that may differ
    postings: dict[int, list[tuple[int, int]]]  # rare word -> (template, position)
    least: float  # share of a template's words from which no notice is missed
    phrases: list[tuple[str, np.ndarray]]


def build_index(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, least: float = 0.8) -> Index:
    """Document frequencies of the templates' words over all documents decide which are rare.

    least: the smallest share of a template's words that ``scan`` may accept."""
    vocabulary = Vocabulary([t for _, t, _ in templates] + [p for _, _, p in templates] + [p for _, p in phrases])
    size = len(vocabulary.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            raw, offsets = text_buffer(batch.column(0))
            for _, _, part, at in chunks(raw, offsets):
                number, bounds = vocabulary.lookup(part, at)
                on = number >= 0
                seen = np.unique(group_ids(bounds)[on] * size + number[on])
                df += np.bincount(seen % size, minlength=size)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(df)], names=["word", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # a row for each word of the templates
    df = np.zeros(size, np.int64)
    for r in rows:
        df[r["word"]] = r["n"]
    postings: dict[int, list[tuple[int, int]]] = {}
    out = []
    for t, (label, text, key) in enumerate(templates):
        words = vocabulary.ids(text)
        differ = sum(n / len(words) >= least for n in range(1, len(words)))  # words that may be changed, added or left out
        for p in sorted(range(len(words)), key=lambda p: (df[words[p]], words[p], p))[:differ + 2]:
            postings.setdefault(int(words[p]), []).append((t, p))
        out.append((label, words, vocabulary.ids(key), differ))
    return Index(vocabulary, out, postings, least, [(label, vocabulary.ids(p)) for label, p in phrases])


def places(number: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the words of ``phrase`` stand consecutively in one document."""
    n = len(number) - len(phrase) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at = np.flatnonzero(number[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[number[at + k] == phrase[k]]
    return at[doc[at] == doc[at + len(phrase) - 1]]


def propose(index: Index, number: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(template, beginnings) on which the postings of two of its rare words agree, up to the words that may be added or left out."""
    votes: dict[int, list[tuple[int, np.ndarray]]] = {}
    for word, posts in index.postings.items():
        at = np.flatnonzero(number == word)
        for t, p in posts if len(at) else ():
            votes.setdefault(t, []).append((p, at - p))
    out = []
    for t, lists in votes.items():
        _, words, _, differ = index.templates[t]
        start = np.concatenate([x for _, x in lists])
        if len(words) > 1:
            position = np.repeat([p for p, _ in lists], [len(x) for _, x in lists])
            order = np.lexsort((position, start))
            start, position = start[order], position[order]
            # The last and the next posting of another position, over runs of one position.
            run = np.flatnonzero(np.concatenate([[True], position[1:] != position[:-1]]))
            own = np.searchsorted(run, np.arange(len(start)), "right") - 1
            before = np.where(own > 0, start[run[own] - 1], -(1 << 40))
            after = np.where(own < len(run) - 1, start[run[np.minimum(own + 1, len(run) - 1)]], 1 << 40)
            start = start[(start - before <= differ) | (after - start <= differ)]
        if len(start):
            out.append((t, np.unique(start[:, None] + np.arange(-differ, differ + 1))))
    return out


def edits(windows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Edit distance, in words, of ``words`` to the first 0, 1, .. words of each row of ``windows``."""
    ramp = np.arange(windows.shape[1] + 1, dtype=np.int32)
    row = np.broadcast_to(ramp, (len(windows), len(ramp)))
    for w in words:
        changed = row + 1
        np.minimum(changed[:, 1:], row[:, :-1] + (windows != w), out=changed[:, 1:])
        row = np.minimum.accumulate(changed - ramp, axis=1) + ramp
    return row


def verify(template: tuple, start: np.ndarray, number: np.ndarray, doc: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, share) of the beginnings from which a stretch of words is near the template and holds its key phrase.

    share: 1 less the edit distance of the nearest such stretch over the number of the template's words."""
    _, words, key, differ = template
    found = [np.zeros(0, np.int64)], [np.zeros(0)]
    keys = places(number, doc, key)
    start = start[(start >= 0) & (start < len(number))]
    if not len(keys) or not len(start):
        return found[0][0], found[1][0]
    place = np.searchsorted(keys, start)
    beyond = keys[np.minimum(place, len(keys) - 1)] + len(key) - start  # words up to the end of the first key phrase
    reach = np.minimum(len(words) + differ, bounds[doc[start] + 1] - start)
    on = (place < len(keys)) & (beyond <= reach)
    start, beyond, reach = start[on], beyond[on], reach[on]
    column = np.arange(len(words) + differ + 1)
    for lo in range(0, len(start), SLICE):
        s, b, r = start[lo:lo + SLICE], beyond[lo:lo + SLICE, None], reach[lo:lo + SLICE, None]
        at = s[:, None] + column[:-1]
        windows = np.where(column[:-1] < r, number[np.minimum(at, len(number) - 1)], -2)
        distance = np.where((column >= b) & (column <= r), edits(windows, words), len(words)).min(axis=1)
        near = distance <= differ
        found[0].append(doc[s[near]])
        found[1].append((len(words) - distance[near]) / len(words))
    return np.concatenate(found[0]), np.concatenate(found[1])


def scan(docs: DataFrame, index: Index, least: float = 0.8, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` with the counts of words and base phrases, labels of the base rules and all labels, and a score.

    score: the largest share of a template's words that an aligned stretch has unchanged, 1 less its edit distance over the
    template's length, over stretches that hold the key phrase; 1 for a base label; else 0. Labels need a share of ``least``, which must not be below that of the index. Null
    and empty texts have no words and no labels. A phrase counts wherever it stands, also in overlaps; ties need no choice, as
    all labels are given. Repeated rows are judged alike; an empty table gives an empty one; other columns are not read."""
    if least < index.least:
        raise ValueError(f"the index finds notices from a share of {index.least}, not {least}")
    fields = {f.name: f for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in carry), SCHEMA])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(len(carry)))
            for lo, hi, part, at in chunks(raw, offsets):
                number, bounds = index.vocabulary.lookup(part, at)
                doc, n = group_ids(bounds), hi - lo
                count, score = np.zeros(n, np.int64), np.zeros(n)
                first, last = np.full(n, 1 << 62), np.full(n, -1)
                base: list[set] = [set() for _ in range(n)]
                more: list[set] = [set() for _ in range(n)]
                for label, phrase in index.phrases:
                    where = places(number, doc, phrase)
                    d, w = doc[where], where - bounds[doc[where]]
                    np.add.at(count, d, 1)
                    np.minimum.at(first, d, w)
                    np.maximum.at(last, d, w)
                    for i in np.unique(d):
                        base[i].add(label)
                        score[i] = 1.0
                for t, start in propose(index, number):
                    near, share = verify(index.templates[t], start, number, doc, bounds)
                    on = share >= least
                    np.maximum.at(score, near[on], share[on])
                    for i in np.unique(near[on]):
                        more[i].add(index.templates[t][0])
                none = count == 0
                cols = [batch.column(i).slice(lo, n) for i in range(len(carry))]
                cols += [pa.array(np.diff(bounds).astype(np.int64)), pa.array(count), pa.array(first, mask=none), pa.array(last, mask=none),
                         pa.array([",".join(sorted(b)) for b in base], pa.string()), pa.array([",".join(sorted(a | b)) for a, b in zip(base, more, strict=True)], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, names=[*carry, *(x.split()[0] for x in SCHEMA.split(", "))])

    return docs.select(*carry, F.col("text").cast("string").alias("__text")).mapInArrow(run, schema)
