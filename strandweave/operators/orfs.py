"""Open reading frames scored by local alignment against reference proteins."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import count_residue, open_segments, six_frames
from .ranking import first_per_group

ALIGNMENT = "identity double, coverage double, aligned_ref int, score int"


# Cells of score matrix that are held at once (four bytes each), of any number of alignments.
BATCH_CELLS = 32_000_000
# Cells of a group of alignments: its rows of scores stay in a core's cache.
GROUP_CELLS = 16_000_000


def _encode(seqs: list[str], width: int, blank: int) -> np.ndarray:
    out = np.full((len(seqs), width), blank, dtype=np.uint8)
    for k, s in enumerate(seqs):
        out[k, : len(s)] = np.frombuffer(s.encode("ascii", "replace"), dtype=np.uint8)
    return out


def _align_whole(a: np.ndarray, b: np.ndarray, match: int, mismatch: int, gap: int, traceback: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best score, alignment columns, equal ones) of pairs whose scores are all held: a row is (query, pair), so every step runs
    along pairs that lie side by side. A score reaches no farther along a row than it is high, so the running maximum over
    the query takes windows twice as wide each time until they are wider than the best score."""
    (k, n), m = a.shape, b.shape[1]
    kind = np.int16 if max(match, 1) * min(n, m) - gap * (m + 1) + abs(mismatch) < 32_000 else np.int32
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    ramp = (np.arange(1, m + 1) * -gap).astype(kind)[:, None]
    h = np.zeros((n + 1, m + 1, k), dtype=kind)
    inner, upper, zero = np.empty((m, k), dtype=kind), np.empty((m, k), dtype=kind), np.zeros((m, k), dtype=kind)
    best, bi, bj = (np.zeros(k, dtype=np.int64) for _ in range(3))
    for i in range(1, n + 1):
        above, row = h[i - 1], h[i]
        np.multiply((b == a[i - 1]).view(np.int8), kind(match - mismatch), out=inner)
        inner += above[:-1]
        inner += kind(mismatch)
        np.add(above[1:], kind(gap), out=upper)
        np.maximum(inner, upper, out=inner)
        np.maximum(inner, zero, out=inner)
        reach, shift = (int(inner.max()) // -gap if gap < 0 else m), 1
        inner += ramp
        while shift <= min(reach, m - 1):
            upper[:shift] = inner[:shift]
            np.maximum(inner[shift:], inner[:-shift], out=upper[shift:])
            inner, upper, shift = upper, inner, 2 * shift
        np.subtract(inner, ramp, out=row[1:])
        top = row.max(axis=0)
        up = np.flatnonzero(top > best)
        if len(up):
            best[up], bi[up], bj[up] = top[up], i, row[:, up].argmax(axis=0)
    columns, same = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
    scores, wide = h.reshape(-1), (m + 1) * k
    live = np.flatnonzero(best > 0)
    x, y = bi[live], bj[live]
    while len(live):
        at = x * wide + y * k + live
        here = scores[at]
        if not here.all():  # row and column 0 have no score
            on = here > 0
            live, x, y, at, here = live[on], x[on], y[on], at[on], here[on]
        equal = a[x - 1, live] == b[y - 1, live]
        diagonal = here == scores[at - wide - k] + np.where(equal, match, mismatch)
        upward = here == scores[at - wide] + gap
        columns[live] += 1
        same[live] += equal if traceback == "legacy" else equal & diagonal
        first = upward if traceback != "legacy" else ~upward
        x = x - (diagonal | first)
        y = y - (diagonal | ~first)
    return best, columns, same


def align_batch(references: list[str], queries: list[str], match: int = 1, mismatch: int = -1, gap: int = -1,
                traceback: str = "standard") -> list[tuple[float, float, int, int]]:
    """Smith-Waterman with linear gaps for many pairs at once.

    Per pair: identity %, coverage % of the reference, alignment columns, score. All pairs advance one
    reference residue per step; the dependency on the left neighbour is a running maximum of the
    gap-adjusted row. Shorter sequences are padded with letters that match nothing, which cannot
    raise a score. Ties take the first cell in row order and the diagonal, then up, then left move;
    ``traceback="legacy"`` swaps the up and left moves, as some published results did.

    Memory is linear in the lengths: where not all scores fit ``BATCH_CELLS``, one row of them is kept. The way back halves the rows until a part, as wide as
    the way still is, fits: the lower half is followed from its first row, which is computed again, then the upper.
    """
    k, n, m = len(references), max(map(len, references)), max(map(len, queries))
    a, b = _encode(references, n, 1), _encode(queries, m, 2)
    ramp = (np.arange(1, m + 1) * -gap).astype(np.int32)

    def below(row: np.ndarray, i: int) -> np.ndarray:
        """Scores of row ``i`` (from 1) from those of the row above, over as many columns."""
        width = row.shape[1] - 1
        inner = row[:, :-1] + np.where(b[:, :width] == a[:, i - 1, None], match, mismatch).astype(np.int32)
        np.maximum(inner, row[:, 1:] + np.int32(gap), out=inner)
        np.maximum(inner, 0, out=inner)
        out = np.zeros_like(row)
        out[:, 1:] = np.maximum.accumulate(inner + ramp[:width], axis=1) - ramp[:width]
        return out

    best, bi, bj = (np.zeros(k, dtype=np.int64) for _ in range(3))
    lengths = np.array([len(r) for r in references])
    if (n + 1) * (m + 1) * k <= BATCH_CELLS:
        best, columns, same = _align_whole(a, b, match, mismatch, gap, traceback)
        return _metrics(best, columns, same, lengths)
    row, at = np.zeros((k, m + 1), dtype=np.int32), np.arange(k)
    for i in range(1, n + 1):
        row = below(row, i)
        j = row.argmax(axis=1)
        up = row[at, j] > best
        best[up], bi[up], bj[up] = row[at, j][up], i, j[up]
    i, j = bi.copy(), bj.copy()
    columns, same = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)

    def follow(h: np.ndarray, top: int) -> None:
        """Walk all pairs through rows of scores that begin at row ``top``, until they leave or end there."""
        while True:
            live = at[(i > top) & (i < top + len(h)) & (j > 0)]
            live = live[h[i[live] - top, live, j[live]] > 0]
            if not len(live):
                return
            x, y = i[live], j[live]
            here = h[x - top, live, y]
            equal = a[live, x - 1] == b[live, y - 1]
            diagonal = here == h[x - top - 1, live, y - 1] + np.where(equal, match, mismatch)
            upward = here == h[x - top - 1, live, y] + gap
            columns[live] += 1
            same[live] += equal if traceback == "legacy" else equal & diagonal
            first = upward if traceback != "legacy" else ~upward
            i[live] = x - (diagonal | first)
            j[live] = y - (diagonal | ~first)

    def back(top: int, end: int, row: np.ndarray) -> None:
        """The way back through the rows after ``top`` up to ``end``; ``row``: scores of row ``top``."""
        live = (i > top) & (i <= end) & (j > 0)
        if not live.any():
            return
        end, row = int(i[live].max()), row[:, : int(j[live].max()) + 1]
        if end - top == 1 or (end - top + 1) * row.size <= BATCH_CELLS:
            rows = [row]
            for x in range(top + 1, end + 1):
                rows.append(below(rows[-1], x))
            follow(np.stack(rows), top)
            return
        middle, half = (top + end) // 2, row
        for x in range(top + 1, middle + 1):
            half = below(half, x)
        back(middle, end, half)
        del half
        back(top, middle, row)

    back(0, n, np.zeros((k, m + 1), dtype=np.int32))
    return _metrics(best, columns, same, lengths)


def _metrics(best: np.ndarray, columns: np.ndarray, same: np.ndarray, lengths: np.ndarray) -> list[tuple[float, float, int, int]]:
    return [
        (100.0 * same[z] / columns[z], 100.0 * columns[z] / lengths[z], int(columns[z]), int(best[z])) if best[z] > 0 else (0.0, 0.0, 0, 0)
        for z in range(len(best))
    ]


def align_local(reference: str, query: str, traceback: str = "standard") -> tuple[float, float, int, int]:
    if not reference or not query:
        return 0.0, 0.0, 0, 0
    return align_batch([reference], [query], traceback=traceback)[0]


def _align_series(ref: pd.Series, qry: pd.Series, traceback: str) -> pd.DataFrame:
    """Pairs of an Arrow batch in order of size, cut into groups of bounded memory."""
    ref, qry = ref.tolist(), qry.tolist()
    out = [(0.0, 0.0, 0, 0)] * len(ref)
    order = sorted((z for z in range(len(ref)) if ref[z] and qry[z]), key=lambda z: (len(qry[z]), len(ref[z])))
    group, n, m = [], 0, 0

    def flush():
        for z, r in zip(group, align_batch([ref[z] for z in group], [qry[z] for z in group], traceback=traceback)):
            out[z] = r

    for z in order:
        n2, m2 = max(n, len(ref[z])), max(m, len(qry[z]))
        if group and (n2 + 1) * (m2 + 1) * (len(group) + 1) > min(BATCH_CELLS, GROUP_CELLS):
            flush()
            group, n2, m2 = [], len(ref[z]), len(qry[z])
        group.append(z)
        n, m = n2, m2
    if group:
        flush()
    return pd.DataFrame(out, columns=["identity", "coverage", "aligned_ref", "score"])


def alignment_metrics(reference, query, traceback: str = "standard"):
    """Column of alignment metrics; Spark partitions the pairs, each task aligns its own."""

    @F.pandas_udf(ALIGNMENT)
    def kernel(ref: pd.Series, qry: pd.Series) -> pd.DataFrame:
        return _align_series(ref, qry, traceback)

    return kernel(reference, query)


def orf_score(identity, coverage, orf_length, ref_length, stops):
    """identity x coverage x length factor, less a tenth per internal stop."""
    factor = F.least(orf_length / ref_length, F.lit(1.0))
    return identity / 100 * coverage / 100 * factor - 0.10 * stops


def candidate_orfs(df: DataFrame, keys: list[str], seq: str, reference: str, min_length: int = 30) -> DataFrame:
    """Stop-free segments of six frames, at least max(min_length, 10 % of the reference) long."""
    least = F.greatest(F.lit(min_length), F.floor(F.length(reference) * 0.10).cast("int"))
    frames = df.select(*keys, F.col(reference).alias("_ref"), least.alias("_min"), F.explode(six_frames(seq)).alias("_f"))
    return frames.select(
        *keys, "_ref", F.col("_f.ordinal").alias("frame_ordinal"), F.col("_f.orientation").alias("orientation"),
        F.col("_f.frame").alias("frame"), F.posexplode(open_segments(F.col("_f.peptide"), F.col("_min"))).alias("segment", "protein"),
    )


def best_orfs(df: DataFrame, keys: list[str], seq: str, reference: str, min_length: int = 30, partitions: int | None = None,
              traceback: str = "standard") -> DataFrame:
    """Best-scoring segment per key: score, identity, coverage, length, then frame order.

    Segments are spread over the cluster before aligning, since one long region may hold most of them.
    """
    cand = candidate_orfs(df, keys, seq, reference, min_length)
    cand = cand.repartition(partitions) if partitions else cand.repartition(*keys, "frame_ordinal", "segment")
    scored = cand.withColumn("_a", alignment_metrics(F.col("_ref"), F.col("protein"), traceback))
    scored = scored.select(
        *keys, "frame_ordinal", "orientation", "frame", "segment", "protein",
        F.col("_a.identity").alias("identity"), F.col("_a.coverage").alias("coverage"),
        F.length("protein").alias("orf_length"), count_residue("protein", "*").alias("internal_stops"), F.length("_ref").alias("ref_length"),
    )
    scored = scored.withColumn(
        "score", orf_score(F.col("identity"), F.col("coverage"), F.col("orf_length"), F.col("ref_length"), F.col("internal_stops"))
    )
    order = [F.col(c).desc() for c in ("score", "identity", "coverage", "orf_length")] + [F.col("frame_ordinal"), F.col("segment")]
    return first_per_group(scored, keys, order)


def recover_genes(hits: DataFrame, contigs: DataFrame, proteins: DataFrame, flank: int, tie: list, gene: str = "gene") -> DataFrame:
    """Hits -> best hit -> region -> best ORF, for all genes in one plan."""
    from .recovery import best_hits, extract_regions

    best = best_hits(hits, [gene], tie)
    region = extract_regions(best, contigs, flank).join(proteins.select(gene, F.col("seq").alias("protein_ref")), gene)
    orf = best_orfs(region, [gene], "region", "protein_ref")
    stats = region.select(gene, "contig", "region_start", "region_end", "pident", "bitscore", "evalue")
    return stats.join(orf, gene, "left")
