"""Substring deduplication over words, by prefix-partitioned suffix trees (see :mod:`.trees`)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import chunks, space_table, text_buffer, word_spans
from .repeats import NO_ID, merged, with_keys
from .trees import repeated_words


def remove_repeated_words(docs: DataFrame, window: int = 13, prefixes: tuple[int, ...] = (5, 7, 9, 11), group_rows: int = 20_000, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every document.

    A word goes when a window of ``window`` words over it also starts in a document of smaller doc_id. Rows with equal doc_id
    are one document, so repeated rows do not count against each other; a null doc_id counts as smaller than all others.
    Null and empty texts have no words. Whole texts of any length are read; an empty table gives an empty one; other columns
    are not read, whatever their names."""
    base = with_keys(docs.select("doc_id", F.col("text").cast("string").alias("text"))).select("dk", "th", "text")
    spans = repeated_words(base, window, prefixes, group_rows)
    schema = "dk long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column(1))
            lists = batch.column(2)
            for lo, hi, part, at in chunks(raw, offsets):
                start, end, bounds = word_spans(part, at, space_table())
                data, sha, gone, kept = part.tobytes(), [], [], []
                for i in range(hi - lo):
                    keep = np.ones(bounds[i + 1] - bounds[i], bool)
                    for a, z in merged(lists[lo + i].as_py()):
                        keep[a:z] = False
                    on = bounds[i] + np.flatnonzero(keep)
                    text = b" ".join([data[a:z] for a, z in zip(start[on].tolist(), end[on].tolist(), strict=True)])
                    sha.append(hashlib.sha256(text).hexdigest())
                    gone.append(len(keep) - len(on))
                    kept.append(text.decode("utf-8", "replace") if with_text else None)
                cols = [batch.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(gone, pa.int64()), pa.array(sha, pa.string())]
                names = ["dk", "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    cols.append(pa.array(kept, pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    out = base.join(spans, ["dk", "th"], "left").select("dk", "text", "spans").mapInArrow(run, schema)
    return out.select(F.nullif("dk", F.lit(NO_ID)).alias("doc_id"), *[c for c in out.columns if c != "dk"])
