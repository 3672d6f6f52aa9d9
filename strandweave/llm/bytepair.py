"""Byte-level BPE through a sentencepiece model that is serialised from a vocabulary of ranks; nothing is trained.

Every byte b stands as the letter with code point 256 + b, so a piece of the vocabulary is a string of such letters, whatever
its bytes. Its score is its negative rank: the processor then joins, as a byte-level merge does, the pair of the least rank
first and the leftmost among equals. The normaliser is the identity. Texts are split into pre-tokens before, and a pre-token
that is itself in the vocabulary is one id.

Handling. A null or empty text has no ids and decodes to no bytes; null ids stay null. Texts of any length are encoded whole,
in runs of bounded memory besides the ids of the text itself. The pattern must match every character of a text. Rows are independent of each other: repeated rows and ids repeat
in the result, an empty table gives an empty one, and of other columns only those named in ``carry`` are returned, by name.
"""

from __future__ import annotations

import base64
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .kernels import chunks, ranges, text_buffer

#: Fixed values of the serialised format: types of pieces and the kind of model.
NORMAL, UNKNOWN, UNUSED, BPE = 1, 2, 5, 2
#: Pre-tokens kept with their ids in a task, and the longest that is kept.
CACHED, CACHED_CHARS = 400_000, 64
#: Characters that are split into pre-tokens at a time, and how far ahead of its end a pre-token may look.
RUN_CHARS, AHEAD = 1 << 16, 3


#: Letters and numbers that Unicode has had since version 17, as the inside of a character class. The tokenizer
#: library whose splits are matched has the tables of version 16, the expressions here may have newer ones.
NEWER = "".join(
    chr(int(a, 16)) + "-" + chr(int(b, 16))
    for a, b in (r.split("-") for r in (
        "558-558 58B-58C 88F-88F C5C-C5C CDC-CDC 208F-208F 209D-209F A7CE-A7CF A7D2-A7D2 A7D4-A7D4 A7DD-A7DD A7E2-A7E2 A7F1-A7F1 "
        "AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A-11B0A 11DB0-11DDB 11DE0-11DE9 11DF1-11DF1 1246F-1246F "
        "12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 "
        "191A0-191D2 1B123-1B128 1B168-1B168 1D6A6-1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 "
        "1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E-2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
    ).split())
)


def older(pattern: str) -> str:
    """The pattern with letters and numbers as Unicode 16 has them."""
    for kind in (r"\p{L}", r"\p{N}"):
        pattern = pattern.replace(kind, f"[{kind}--[{NEWER}]]")
    return f"(?V1){pattern}"


def read_ranks(path: str) -> dict[bytes, int]:
    """Bytes and rank of each line: base64, a space, a number."""
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


LETTERS = {b: 256 + b for b in range(256)}


def letters(raw: bytes) -> str:
    return raw.decode("latin-1").translate(LETTERS)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _nested(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model as sentencepiece reads it: pieces in the order of their ranks, so that a piece's id is its rank; a gap is an
    unused piece, and the unknown piece stands last."""
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
    by_rank = {r: letters(p) for p, r in ranks.items()}
    last = max(by_rank)

    def piece(text: str, rank: int, kind: int) -> bytes:
        return _nested(1, _nested(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank) + _number(3, kind))

    body = [piece(by_rank[r], r, NORMAL) if r in by_rank else piece(f"<{r}>", r, UNUSED) for r in range(last + 1)]
    body.append(piece("<unk>", last + 1, UNKNOWN))
    trainer = _number(3, BPE) + _number(40, last + 1)
    normaliser = _nested(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join(body) + _nested(2, trainer) + _nested(3, normaliser)


class Encoder:
    """Ids of texts; one per task."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = self.processor.unk_id()
        self.known = {p: i for i, p in enumerate(self.processor.id_to_piece(list(range(size)))) if not self.processor.is_unused(i)}
        self.pieces, self.strict = regex.compile(pattern), regex.compile(older(pattern))
        self.newer = regex.compile(f"[{NEWER}]")
        self.cache: dict[str, list[int]] = {}

    def learn(self, texts: list[str]) -> dict[str, list[int]]:
        """Ids of pre-tokens: the id of one that is a piece itself, else those of the merges."""
        mapped = [letters(t.encode()) for t in texts]
        rest = iter(self.processor.encode([m for m in mapped if m not in self.known], num_threads=1))
        found = {t: [self.known[m]] if m in self.known else next(rest) for t, m in zip(texts, mapped, strict=True)}
        if len(self.cache) >= CACHED:
            self.cache.clear()
        self.cache.update((t, ids) for t, ids in found.items() if len(t) <= CACHED_CHARS)
        return found

    def runs(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of runs of a text. A pre-token depends on its own characters and the next ones only, so those that end
        near the end of a run are left to the next run."""
        split = (self.strict if not text.isascii() and self.newer.search(text) else self.pieces).findall
        at, width = 0, RUN_CHARS
        while at + width < len(text):
            found, size = split(text[at:at + width]), width
            while found and size > width - AHEAD:
                size -= len(found.pop())
            if found:
                yield found
                at, width = at + size, RUN_CHARS
            else:
                width *= 2
        yield split(text[at:])

    def text(self, text: str, into: array) -> None:
        for found in self.runs(text):
            ids = [*map(self.cache.get, found)]
            if None in ids:
                new = self.learn([*{p for p, known in zip(found, ids, strict=True) if known is None}])
                ids = [new[p] if known is None else known for p, known in zip(found, ids, strict=True)]
            into.extend(chain.from_iterable(ids))


def _carried(df: DataFrame, carry: tuple[str, ...], more: list[T.StructField]) -> T.StructType:
    return T.StructType([*[df.schema[c] for c in carry], *more])


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", carry: tuple[str, ...] = ("doc_id",), name: str = "ids") -> DataFrame:
    """The columns ``carry`` and the ids of each text. The file is read by the driver, a few hundred kB that go to the tasks."""
    model = docs.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks_path)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model.value, pattern)
        for batch in batches:
            column = batch.column(len(carry))
            _, offsets = text_buffer(column)
            for lo, hi, _, _ in chunks(np.zeros(0, np.uint8), offsets):
                ids, ends = array("i"), [0]
                for value in column.slice(lo, hi - lo):
                    encoder.text(value.as_py() or "", ids)
                    ends.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(ids, np.int32) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:len(carry)]], lists], names=[*carry, name])

    return docs.select(*carry, text).mapInArrow(kernel, _carried(docs, carry, [T.StructField(name, T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", carry: tuple[str, ...] = ("doc_id",), name: str = "decoded") -> DataFrame:
    """The columns ``carry`` and the bytes of each list of ids: the letters of the model's pieces mapped back to bytes.

    An id without a piece is an error, as is a null among ids.
    """
    model = encoded.sparkSession.sparkContext.broadcast(serialise(read_ranks(ranks_path)))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        pieces = [np.array([ord(c) - 256 for c in p], np.int64) if not p.startswith("<") else None for p in processor.id_to_piece(list(range(processor.get_piece_size())))]
        size = np.array([-1 if p is None else len(p) for p in pieces])
        start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
        raw = np.concatenate([p for p in pieces if p is not None]).astype(np.uint8)
        for batch in batches:
            column = batch.column(len(carry))
            where = column.offsets.to_numpy().astype(np.int64)
            for lo, hi, _, at in chunks(np.zeros(0, np.uint8), 4 * where):
                own = column.values[where[lo]:where[hi]].to_numpy(zero_copy_only=False)
                if len(own) and (own.dtype.kind == "f" or own.min() < 0 or own.max() >= len(size) or size[own].min() < 0):
                    raise ValueError("an id has no piece in the vocabulary")
                n = size[own]
                ends = np.zeros(len(own) + 1, np.int64)
                np.cumsum(n, out=ends[1:])
                data = raw[ranges(start[own], n)]
                bounds = ends[at // 4]
                out = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
                valid = column.slice(lo, hi - lo).is_valid()
                out = pa.compute.if_else(valid, out, pa.scalar(None, pa.large_binary())).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*[c.slice(lo, hi - lo) for c in batch.columns[:len(carry)]], out], names=[*carry, name])

    return encoded.select(*carry, ids).mapInArrow(kernel, _carried(encoded, carry, [T.StructField(name, T.BinaryType())]))
