"""The block parser of FASTQ against a plain reader, over splits, line ends, blank lines and block gzip."""

import gzip
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.sources import fastq


def block_gzip(raw, size):
    """Members of at most ``size`` bytes that state their own size, and the empty one at the end."""
    out = b""
    for lo in [*range(0, len(raw), size), len(raw)]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(raw[lo:lo + size]) + c.flush()
        tail = struct.pack("<II", zlib.crc32(raw[lo:lo + size]), len(raw[lo:lo + size]))
        out += b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", 25 + len(body)) + body + tail
    return out


def parsed(path, split):
    reader = fastq.FastqReader({"path": str(path), "splitbytes": str(split)})
    rows = [tuple(r.values()) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    assert [r[1] for r in rows] == sorted({r[1] for r in rows})  # one record, one place, in the order of the file
    return [r[2:] for r in rows]


@st.composite
def files(draw):
    rng = random.Random(draw(st.integers(0, 10**6)))
    end = draw(st.sampled_from(["\n", "\r\n"]))
    rows, text = [], ""
    for i in range(draw(st.integers(0, 25))):
        n = rng.choice([0, 1, 7, 40])
        rows.append((f"r{i} é" if rng.random() < 0.1 else f"@r{i}", "".join(rng.choice("ACGTn") for _ in range(n)), "".join(rng.choice("@+I#5") for _ in range(n))))
        text += end.join(["@" + rows[-1][0], rows[-1][1], "+" + rng.choice(["", rows[-1][0]]), rows[-1][2], ""])
        if rng.random() < 0.1:
            text += end * rng.randint(1, 3)
    if rows and draw(st.booleans()):
        text = text.rstrip("\r\n") if rows[-1][1] else text
    return rows, text.encode()


@settings(max_examples=150, deadline=None)
@given(files(), st.sampled_from([1, 17, 64, 300, 10**6]), st.sampled_from([40, 128, 4096]), st.sampled_from([9, 50, 1000]))
def test_as_a_plain_reader(tmp_path_factory, made, split, block, member):
    rows, raw = made
    base, kept = tmp_path_factory.mktemp("fq"), fastq.BLOCK_BYTES
    (base / "a.fastq").write_bytes(raw)
    (base / "b.fastq.gz").write_bytes(gzip.compress(raw[:len(raw) // 2]) + gzip.compress(raw[len(raw) // 2:]))
    (base / "c.fastq.gz").write_bytes(block_gzip(raw, member))
    fastq.BLOCK_BYTES = block
    try:
        for name in ("a.fastq", "b.fastq.gz", "c.fastq.gz"):
            if name != "a.fastq" or not any(len(r[1]) == 0 for r in rows):  # empty records among splits read as any lines do
                assert parsed(base / name, 10**6 if any(len(r[1]) == 0 for r in rows) else split) == rows, name
    finally:
        fastq.BLOCK_BYTES = kept


def test_block_gzip_is_cut(tmp_path):
    rng = random.Random(1)
    rows = [(f"r{i}", "".join(rng.choice("ACGT") for _ in range(100)), "I" * 100) for i in range(3000)]
    raw = "".join(f"@{h}\n{s}\n+\n{q}\n" for h, s, q in rows).encode()
    (tmp_path / "a.fastq.gz").write_bytes(block_gzip(raw, 10_000))
    reader = fastq.FastqReader({"path": str(tmp_path / "a.fastq.gz"), "splitbytes": "20000"})
    parts = [sum(b.num_rows for b in reader.read(p)) for p in reader.partitions()]
    assert len(parts) > 3 and sum(parts) == 3000 and max(parts) < 1500
    assert parsed(tmp_path / "a.fastq.gz", 20000) == rows


@pytest.mark.parametrize("raw", [b"@a\nACGT\n+\nII\n", b"@a\nAC\n+\n", b"a\nAC\n+\nII\n", b"@a\nAC\nII\nII\n", b"@a\nAC\n", b"@a\nA\n+\nI\nx\n"])
def test_malformed(tmp_path, raw):
    (tmp_path / "a.fastq").write_bytes(raw)
    with pytest.raises(ValueError, match="malformed"):
        parsed(tmp_path / "a.fastq", 10**6)


def test_a_record_longer_than_a_block(tmp_path):
    seq = "ACGT" * 3_000_000
    (tmp_path / "a.fastq").write_text(f"@long\n{seq}\n+\n{'I' * len(seq)}\n@b\nA\n+\nI\n")
    assert [(h, len(s)) for h, s, _ in parsed(tmp_path / "a.fastq", 1 << 20)] == [("long", len(seq)), ("b", 1)]


def test_an_empty_last_quality(tmp_path):
    (tmp_path / "a.fastq").write_bytes(b"@a\nA\n+\nI\n@b\n\n+\n")
    assert parsed(tmp_path / "a.fastq", 10**6) == [("a", "A", "I"), ("b", "", "")]
    (tmp_path / "empty.fastq").write_bytes(b"")
    assert parsed(tmp_path / "empty.fastq", 10) == []
