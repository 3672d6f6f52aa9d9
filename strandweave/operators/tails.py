"""Read tails that run from a hit into an uncovered window of the protein.

A tail row has: seq, side (N or C), raw hit coordinates qstart, qend, sstart, send. Everything is
column arithmetic; lists are ARRAY<STRUCT> no longer than the read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .once import once
from ..functions.reads import codon_start, is_forward
from ..functions.sequence import codons, composition_ratio, reverse_complement, translate_codon

MIN_TAIL_NT = 30


def gap_facing(seq="seq", sstart="sstart", send="send", side="side") -> Column:
    """Struct (nt_start, nt_end, segment): the part of the read beyond the hit on the gap's side, in
    coding orientation; nulls and an empty segment when the hit reaches the read's end."""
    s, a, b = F.col(seq), F.col(sstart), F.col(send)
    fwd, n_side = is_forward(a, b), F.col(side) == "N"
    low = F.when(n_side & fwd, b + 1).when(~n_side & ~fwd, a + 1).otherwise(F.lit(1))
    high = F.when(n_side & ~fwd, b - 1).when(~n_side & fwd, a - 1).otherwise(F.length(s))
    ok = (low <= high) & (low >= 1) & (high <= F.length(s))
    raw = F.substring(s, low.cast("int"), (high - low + 1).cast("int"))
    return F.struct(
        F.when(ok, low).cast("int").alias("nt_start"),
        F.when(ok, high).cast("int").alias("nt_end"),
        F.when(ok, F.when(fwd, raw).otherwise(reverse_complement(raw))).otherwise("").alias("segment"),
    )


def extension_range(gap_start: int, gap_end: int, seq="seq", qstart="qstart", qend="qend", sstart="sstart", send="send",
                    side="side") -> tuple[Column, Column]:
    """First and last protein position the read can spell from the hit's frame inside the window.

    Walking outward from the hit stops where the codon leaves the read; that bound is arithmetic,
    so no position is visited.
    """
    n, qs, qe, a = F.length(seq), F.col(qstart), F.col(qend), F.col(sstart)
    fwd, n_side = is_forward(sstart, send), F.col(side) == "N"
    last = F.when(fwd, qs + F.floor((n - a - 2) / 3)).otherwise(qs + F.floor((a - 3) / 3))
    first = F.when(fwd, qs - F.floor((a - 1) / 3)).otherwise(qs - F.floor((n - a) / 3))
    low = F.when(n_side, F.greatest(qe + 1, F.lit(gap_start))).otherwise(F.greatest(first, F.lit(gap_start)))
    high = F.when(n_side, F.least(last, F.lit(gap_end))).otherwise(F.least(qs - 1, F.lit(gap_end)))
    return low.cast("int"), high.cast("int")


def extend_into_gap(df: DataFrame, gap_start: int, gap_end: int, name: str = "extension", **cols) -> DataFrame:
    """Add ``name``: array of (position, codon, aa) in ascending position order on both sides."""
    lo, hi = extension_range(gap_start, gap_end, **cols)
    seq, qs, a, b = (F.col(cols.get(c, c)) for c in ("seq", "qstart", "sstart", "send"))
    fwd = is_forward(a, b)
    # The codons of lo..hi are one contiguous stretch of the read: cut it out once, orient it, then split.
    first = F.when(fwd, codon_start(qs, a, b, F.col("_lo"))).otherwise(codon_start(qs, a, b, F.col("_hi")))
    stretch = F.substring(seq, first.cast("int"), (F.col("_hi") - F.col("_lo") + 1) * 3)
    spelled = F.transform(
        codons(F.when(fwd, stretch).otherwise(reverse_complement(stretch))),
        lambda c, i: F.struct((F.col("_lo") + i).alias("position"), c.alias("codon"), translate_codon(c).alias("aa")),
    )
    empty = F.array().cast("array<struct<position:int,codon:string,aa:string>>")
    out = df.withColumns({"_lo": lo, "_hi": hi})
    return once(out, {name: F.when(F.col("_lo") <= F.col("_hi"), spelled).otherwise(empty)}).drop("_lo", "_hi")


def evidence_class(df: DataFrame, reference: str, segment: str = "segment", extension: str = "extension",
                   lysine_fraction: float = 0.369) -> DataFrame:
    """Compare the extension with the reference protein and grade it A-D with a reason.

    A: >= 10 matches and >= 50 %; B: >= 6 and >= 30 %; C: anything else of >= 30 nt; D: too short,
    or no residue could be spelled.
    """
    ref, ext = F.col(reference), F.col(extension)
    seen = F.filter(ext, lambda x: (x["aa"] != "X") & (x["position"] <= F.length(ref)))
    same = F.filter(seen, lambda x: x["aa"] == F.substring(ref, x["position"], F.lit(1)))
    df = once(df, {"_n": F.size(seen), "_m": F.size(same), "_pep": F.array_join(F.transform(ext, lambda x: x["aa"]), "")})
    n, m = F.col("_n"), F.col("_m")
    pct = F.when(n > 0, 100.0 * m / n).otherwise(0.0)
    nt = F.length(segment)
    short, none = nt < MIN_TAIL_NT, F.size(ext) == 0
    cls = (
        F.when(short | none, "D")
        .when((m >= 10) & (pct >= 50), "A")
        .when((m >= 6) & (pct >= 30), "B")
        .otherwise("C")
    )
    peptide = F.col("_pep")
    seen_text = F.concat(m.cast("string"), F.lit("/"), n.cast("string"), F.format_string(" interpretable aa match (%.1f%%)", pct))
    reason = (
        F.when(short, F.concat(F.lit(f"tail shorter than {MIN_TAIL_NT} nt ("), nt.cast("string"), F.lit(" nt)")))
        .when(none, F.lit("no codon-anchored extension into the window"))
        .otherwise(seen_text)
    )
    graded = ~(short | none)
    return df.withColumns(
        {
            "gap_position_start": F.when(graded, ext[0]["position"]),
            "gap_position_end": F.when(graded, F.element_at(ext, -1)["position"]),
            "translated_candidate": F.when(graded, peptide),
            "aligned_aa": F.when(graded, n),
            "matching_aa": F.when(graded, m),
            "pident_aa": F.when(graded, F.round(pct, 1)),
            "composition_similarity": F.when(graded, composition_ratio(peptide, "K", lysine_fraction)),
            "evidence_class": cls,
            "class_reason": reason,
        }
    ).drop("_n", "_m", "_pep")


def valid_gap_rows(df: DataFrame, gap_start: int, gap_end: int, seq: str = "translated_candidate") -> DataFrame:
    """Rows with coordinates inside the window, and whether the peptide length fits them."""
    s, e = F.col("gap_position_start"), F.col("gap_position_end")
    ok = s.isNotNull() & e.isNotNull() & (s >= gap_start) & (e <= gap_end) & (s <= e) & F.col(seq).isNotNull() & (F.col(seq) != "")
    return df.filter(ok).withColumn("length_matches", F.length(seq) == e - s + 1)
