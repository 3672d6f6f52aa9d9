"""FASTQ as a Spark data source.

``spark.read.format("fastq").load(path)`` cuts plain files into byte ranges; each task moves to the first record of its range
and reads past the end to finish its last record. Gzip files made of blocks that state their size (as block-gzip tools write)
are cut between blocks in the same way; other gzip files cannot be entered in the middle and make one partition each.

Records are not read one by one: the line ends of a block of bytes are indexed at once, and the lines go as they lie into Arrow
columns. ``byte_offset`` is the offset of a record in the (decompressed) file; in block gzip that of its block in the file
times 65536, plus the offset in the block. Either grows along the file.
"""

from __future__ import annotations

import gzip
import io
import posixpath
import struct
import zlib
from collections.abc import Iterator
from fnmatch import fnmatch

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("byte_offset", T.LongType(), False),
        T.StructField("header", T.StringType(), False),
        T.StructField("seq", T.StringType(), False),
        T.StructField("qual", T.StringType(), False),
    ]
)
#: Bytes that are indexed at once, at least one record.
BLOCK_BYTES = 4 * 1024 * 1024
#: Fixed value: the first bytes of a gzip member with an extra field, which block gzip has in every member.
MEMBER = b"\x1f\x8b\x08\x04"
NEWLINE, RETURN, AT, PLUS = b"\n\r@+"


class _Range(InputPartition):
    """Bytes of a file; ``blocks`` for block gzip, ``end`` -1 for a gzip file that is read whole."""

    def __init__(self, path: str, start: int, end: int, blocks: bool = False):
        self.path, self.start, self.end, self.blocks = path, start, end, blocks


def _member_size(head: bytes) -> int | None:
    """Size of a block-gzip member from its header, None for any other bytes."""
    if len(head) < 18 or head[:4] != MEMBER:
        return None
    extra, at = head[12:12 + struct.unpack("<H", head[10:12])[0]], 0
    while at + 6 <= len(extra):
        size = struct.unpack("<H", extra[at + 2:at + 4])[0]
        if extra[at:at + 2] == b"BC" and size == 2:
            return struct.unpack("<H", extra[at + 4:at + 6])[0] + 1
        at += 4 + size
    return None


def _first_member(f, start: int) -> int | None:
    """Offset of the first member at or after ``start``: one that another member or the end of the file follows."""
    f.seek(start)
    window, at = f.read(4 * 65536), -1
    while (at := window.find(MEMBER, at + 1)) >= 0:
        size = _member_size(window[at:at + 512])
        if size:
            f.seek(start + at + size)
            following = f.read(512)
            if not following or _member_size(following):
                return start + at
    return None


def _pieces(part: _Range) -> Iterator[tuple[int, bytes]]:
    """(position, bytes) from the byte before the range on, to the end of the file."""
    with _open(part.path, raw=part.blocks) as f:
        if part.blocks:
            at = _first_member(f, part.start)
            while at is not None:
                f.seek(at)
                head = f.read(512)
                if not head:
                    return
                size = _member_size(head)
                if size is None:
                    raise ValueError(f"not a block of gzip at byte {at} of {part.path}")
                yield at << 16, zlib.decompress(head[:size] + f.read(max(0, size - len(head))), 31)
                at += size
        else:
            at = max(part.start - 1, 0)
            if at:
                f.seek(at)
            while block := f.read(BLOCK_BYTES):
                yield at, block
                at += len(block)


def _lines(data: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end without line ends) of the whole lines from ``begin`` on."""
    newline = np.flatnonzero(data[begin:] == NEWLINE) + begin
    start, end = np.concatenate([[begin], newline[:-1] + 1])[:len(newline)], newline.copy()
    while len(tail := np.flatnonzero((end > start) & (data[end - 1] == RETURN))):
        end[tail] -= 1
    return start, end


def _is_record(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each row of four lines: a header, a sequence, a plus, a quality as long as the sequence."""
    filled = (end[:, 0] > start[:, 0]) & (end[:, 2] > start[:, 2])
    last = len(data) - 1
    marks = (data[np.minimum(start[:, 0], last)] == AT) & (data[np.minimum(start[:, 2], last)] == PLUS)
    return filled & marks & (end[:, 1] - start[:, 1] == end[:, 3] - start[:, 3])


def _columns(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Header without its mark, sequence and quality of rows of four lines, as Arrow strings.

    The bytes of all lines are kept in one pass, the line ends and marks left out; every column takes its lines from them.
    """
    import pyarrow as pa

    first = start[:, 0] + 1
    begin, stop = np.stack([first, start[:, 1], start[:, 2], start[:, 3]], 1).ravel(), end.ravel()
    size = stop - begin
    edge = np.zeros(int(stop[-1] - begin[0]) + 1, np.int8)
    np.add.at(edge, begin - begin[0], 1)
    np.add.at(edge, stop - begin[0], -1)
    kept = data[begin[0]:stop[-1]][np.cumsum(edge[:-1], dtype=np.int8) > 0]
    offsets = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offsets[1:])
    lines = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept))])
    if len(kept) and kept.max() > 127:
        lines.validate(full=True)
    row = np.arange(0, len(size), 4)
    return [lines.take(pa.array(row + k)) for k in (0, 1, 3)]


def _batches(part: _Range):
    """Record batches of the records of a range.

    A record belongs to the range that holds the byte before it, the first of a file to the first range. A quality line may
    begin with ``@``, so inside a file a record is recognised by all its four lines.
    """
    import pyarrow as pa

    limit = float("inf") if part.end < 0 else part.end << 16 if part.blocks else part.end - 1
    pieces, held, places, before = _pieces(part), b"", [], -1
    search, ended = part.start > 0, False
    while not ended:
        parts, size = [held], len(held)
        while size < max(BLOCK_BYTES, len(held) + 1):
            piece = next(pieces, None)
            if piece is None:
                ended = True
                break
            places.append((size, piece[0]))
            parts.append(piece[1])
            size += len(piece[1])
        held = b"".join(parts)
        if ended and held[-1:] not in (b"", b"\n"):
            held += b"\n"
        data = np.frombuffer(held, np.uint8)
        offsets, bases = (np.array(c, np.int64) for c in zip(*places, strict=True)) if places else (np.zeros(1, np.int64),) * 2

        def position(at):
            k = np.searchsorted(offsets, at, side="right") - 1
            return np.where(at < 0, before, bases[k] + at - offsets[k])  # noqa: B023

        start, end = _lines(data, 0)
        i = 0
        if search:
            i = 1  # the rest of the line in which the range begins
            rows = np.arange(1, len(start) - 3)[:, None] + np.arange(4)
            found = _is_record(data, start[rows], end[rows]) if len(rows) else np.zeros(0, bool)
            if not found.any():
                if ended:
                    return
                continue
            i, search = 1 + int(found.argmax()), False
        while True:
            n = (len(start) - i) // 4
            s, e = start[i:i + 4 * n].reshape(n, 4), end[i:i + 4 * n].reshape(n, 4)
            good = _is_record(data, s, e) if n else np.ones(0, bool)
            k = n if good.all() else int(good.argmin())
            own = int(np.count_nonzero(position(s[:k, 0] - 1) < limit))
            if own:
                header, seq, qual = _columns(data, s[:own], e[:own])
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * own), pa.array(position(s[:own, 0])), header, seq, qual], names=SCHEMA.names)
            if own < k:
                return
            i += 4 * k
            if i < len(start) and not held[start[i]:end[i]].strip():
                i += 1
            elif k < n:
                at = int(position(start[i:i + 1])[0])
                if position(start[i:i + 1] - 1)[0] >= limit:
                    return
                raise ValueError(f"malformed FASTQ record at byte {at} of {part.path}")
            else:
                break
        if ended and i < len(start):
            if len(start) - i == 3 and held[start[i]] == AT and start[i + 1] == end[i + 1] and held[start[i + 2]:start[i + 2] + 1] == b"+":
                if position(start[i:i + 1] - 1)[0] < limit:  # an empty quality line that the end of the file leaves out
                    header = held[start[i] + 1:end[i]].decode()
                    yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array(position(start[i:i + 1])), pa.array([header]), pa.array([""]), pa.array([""])], names=SCHEMA.names)
            elif position(start[i:i + 1] - 1)[0] < limit:
                raise ValueError(f"malformed FASTQ record at byte {int(position(start[i:i + 1])[0])} of {part.path}")
        rest = int(start[i]) if i < len(start) else held.rfind(b"\n") + 1
        before = int(position(np.array([rest - 1]))[0])
        k = int(np.searchsorted(offsets, rest, side="right") - 1)
        places = [(int(o - rest), int(b)) for o, b in zip(offsets[k:], bases[k:], strict=True)]
        if places and places[0][0] < 0:
            places[0] = (0, places[0][1] - places[0][0])
        held = held[rest:]


def _filesystem(path: str):
    """(filesystem, path inside it): a URI names any store Arrow can reach, a bare path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _open(path: str, raw: bool = False):
    store, inner = _filesystem(path)
    f = io.BufferedReader(store.open_input_file(inner), 1 << 20)
    return gzip.GzipFile(fileobj=f) if path.endswith(".gz") and not raw else f


def _has_blocks(path: str) -> bool:
    with _open(path, raw=True) as f:
        return _member_size(f.read(512)) is not None


def _list(pattern: str) -> list[tuple[str, int]]:
    """(path, size) of the files a folder, file or last-component wildcard stands for."""
    from pyarrow import fs

    store, inner = _filesystem(pattern)
    head = pattern[: len(pattern) - len(inner)]
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(pattern, info.size)]
    folder, mask = (inner, "*") if info.type == fs.FileType.Directory else posixpath.split(inner)
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return [
        (head + i.path, i.size) for i in found
        if i.type == fs.FileType.File and fnmatch(i.base_name, mask) and not i.base_name.startswith(("_", "."))
    ]


class FastqReader(DataSourceReader):
    def __init__(self, options):
        path = options.get("path")
        if not path:
            raise ValueError("fastq: load(path) is required")
        self.files = sorted({f for p in path.split(",") for f in _list(p)})
        if not self.files:
            raise FileNotFoundError(path)
        self.split = int(options.get("splitbytes", 128 * 1024 * 1024))

    def partitions(self):
        out = []
        for p, size in self.files:
            blocks = p.endswith(".gz") and _has_blocks(p)
            if p.endswith(".gz") and not blocks:
                out.append(_Range(p, 0, -1))
                continue
            out += [_Range(p, s, min(s + self.split, size), blocks) for s in range(0, size, self.split)]
        return out

    def read(self, partition):
        yield from _batches(partition)


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, mate: str, split_bytes: int | None = None, fold_case: bool = True) -> DataFrame:
    """Reads of one mate: path, byte_offset, read_id, pair_id, mate, seq (in upper case unless ``fold_case`` is off), qual."""
    from ..functions.reads import clean_read_id

    spark.dataSource.register(FastqSource)
    r = spark.read.format("fastq")
    if split_bytes:
        r = r.option("splitBytes", str(split_bytes))
    return r.load(path).select(
        "path", "byte_offset",
        F.regexp_replace("header", r"\s.*$", "").alias("read_id"),
        clean_read_id("header").alias("pair_id"), F.lit(mate).alias("mate"), (F.upper("seq") if fold_case else F.col("seq")).alias("seq"), "qual",
    )


def with_read_index(reads: DataFrame, bucket_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """1-based ordinal over all files of a mate in (path, byte offset) order.

    Byte offsets order the reads already, so only counts per byte bucket are scanned globally; the
    number is a property of the data and is stored, never regenerated.
    """
    from ..operators.running import ordinal

    b = reads.withColumn("_b", F.struct("path", F.floor(F.col("byte_offset") / bucket_bytes).alias("k")))
    return ordinal(b, ["mate"], "_b", ["path", "byte_offset"], "read_index").drop("_b")


def write_fastq(reads: DataFrame, path: str, **write_options) -> None:
    reads.select(F.concat_ws("\n", F.concat(F.lit("@"), "read_id"), "seq", F.lit("+"), "qual").alias("value")).write.options(
        **write_options
    ).text(path)
