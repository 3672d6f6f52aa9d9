"""Suffix-array deduplication over bytes by longest previous factors: the previous and next smaller positions in suffix order
give, for each place, the longest match at an earlier one (see :mod:`.factors`)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .factors import bytes_unit, repeated_spans, with_text_keys
from .kernels import chunks, text_buffer
from .repeats import NO_ID, merged


def remove_repeated_bytes(docs: DataFrame, length: int = 400, gram: int = 32, keep_first: bool = True, group_rows: int = 20_000, with_text: bool = False,
                          carry: tuple[str, ...] = (), least: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, longest_repeat (and kept_text, and ``carry``) of every document.

    longest_repeat: bytes of the longest run that strings of ``least`` bytes (``length`` if not given) cover which also start
    elsewhere, by the same rule; 0 if there are none. It takes in repeats too short to be removed.

    A byte goes when a string of ``length`` bytes over it also starts elsewhere: with ``keep_first``, at an earlier place in
    the order of doc_id and position, so that the first copy stays; without, anywhere else. Matches end at the borders of
    documents. Repeated rows (equal doc_id and text) are different places without ``keep_first``, and one place with it. A
    null doc_id comes before all others. Null and empty texts have no bytes. kept_text drops bytes that are no whole
    character at the edges of what was removed; kept_sha256 is of the bytes. Whole texts of any length are read; an empty
    table gives an empty one."""
    unit = bytes_unit(length if least is None else least, length, gram, keep_first)
    own = ["dk", "th", "text"]
    base = with_text_keys(docs.select("doc_id", F.col("text").cast("string").alias("text"), *[F.col(c).alias(f"__{i}") for i, c in enumerate(carry)]))
    base = base.select(*own, *[f"__{i}" for i in range(len(carry))])
    spans = repeated_spans(base, unit, group_rows)
    kinds = {f.name: f.dataType.simpleString() for f in base.schema.fields}
    passed = ["dk", *[f"__{i}" for i in range(len(carry))]]
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in passed), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, longest_repeat long", *(["kept_text string"] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(len(passed)))
            lists = batch.column(len(passed) + 1)
            for lo, hi, part, at in chunks(raw, offsets):
                data, sha, gone, runs, longest, kept = part.tobytes(), [], [], [], [], []
                for i in range(hi - lo):
                    listed = lists[lo + i].as_py() or []
                    text, spans_here = data[at[i]:at[i + 1]], merged([s for s in listed if s["kind"] == 1])
                    longest.append(max((z - a for a, z in merged([s for s in listed if s["kind"] == 0])), default=0))
                    left = [0, *[z for _, z in spans_here]], [*[a for a, _ in spans_here], len(text)]
                    rest = b"".join([text[a:z] for a, z in zip(*left, strict=True)])
                    sha.append(hashlib.sha256(rest).hexdigest())
                    gone.append(len(text) - len(rest))
                    runs.append(len(spans_here))
                    kept.append(b"".join([text[a:z].decode("utf-8", "ignore").encode() for a, z in zip(*left, strict=True)]).decode() if with_text else None)
                cols = [batch.column(c).slice(lo, hi - lo) for c in range(len(passed))]
                cols += [pa.array(np.diff(at)), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(sha, pa.string()), pa.array(longest, pa.int64())]
                names = [*passed, "n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_repeat"]
                if with_text:
                    cols.append(pa.array(kept, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = base.join(spans, ["dk", "th"], "left").select(*passed, "text", "spans").mapInArrow(run, schema)
    return out.select(F.nullif("dk", F.lit(NO_ID)).alias("doc_id"), *[F.col(f"__{i}").alias(c) for i, c in enumerate(carry)],
                      "n_bytes", "n_removed", "n_spans", "kept_sha256", "longest_repeat", *(["kept_text"] if with_text else []))
