"""Read-level scalars: Phred quality, read ids, codon coordinates, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sequence import _c, reverse_complement, translate_codon

# ------------------------------------------------------------------ quality


def phred(qual, offset: int = 33) -> Column:
    """Quality string -> array of Phred scores."""
    q = _c(qual)
    return F.when(F.length(q) > 0, F.transform(F.split(q, ""), lambda c: F.ascii(c) - offset)).when(
        q.isNotNull(), F.array().cast("array<int>")
    )


def phred_at(qual, start, offset: int = 33) -> Column:
    """Phred score of one base (1-based)."""
    return F.ascii(F.substring(_c(qual), _c(start), F.lit(1))) - offset


def codon_quality(qual, start, reverse, offset: int = 33) -> Column:
    """(q1, q2, q3, min_qual, mean_qual) of the codon starting at ``start`` of the stored read.

    On the reverse strand the three scores are listed in codon order, i.e. reversed.
    """
    q, s, rev = _c(qual), _c(start), _c(reverse)
    a, b, c = (phred_at(q, (s + i).cast("int"), offset) for i in range(3))
    return F.struct(
        F.when(rev, c).otherwise(a).alias("q1"),
        b.alias("q2"),
        F.when(rev, a).otherwise(c).alias("q3"),
        F.least(a, b, c).alias("min_qual"),
        F.round((a + b + c) / 3, 2).alias("mean_qual"),
    )


def low_quality_characters(threshold: int, offset: int = 33) -> str:
    """Quality characters that encode a score below ``threshold``."""
    return "".join(chr(i) for i in range(offset, offset + threshold))


def bases_at_least(qual, threshold: int, offset: int = 33) -> Column:
    """How many bases of a read have at least this Phred score."""
    q = _c(qual)
    return F.length(F.translate(q, low_quality_characters(threshold, offset), ""))


# ------------------------------------------------------------------ read ids

PAIR_RULES = {
    "first_token": r"\s.*$",
    "dot_suffix": r"\.[12]$",
    "slash_suffix": r"/[12]$",
    "space_suffix": r"\s+[12](:.*)?$",
    "identical_ids": None,
}


def clean_read_id(read_id) -> Column:
    """Read id without the comment after the first blank and without ``/1`` or ``/2``."""
    return F.regexp_replace(F.regexp_replace(_c(read_id), r"\s.*$", ""), r"/[12]$", "")


def pair_id_by_rule(read_id, rule: str) -> Column:
    """Pair id under a named convention; the rule is chosen at run time and applied as a column."""
    pattern = PAIR_RULES[rule]
    return _c(read_id) if pattern is None else F.regexp_replace(_c(read_id), pattern, "")


def pair_id(read_id, strip_separators: bool = False) -> Column:
    """Pair id: comment and ``/1``,``/2`` dropped.

    ``strip_separators`` also drops a trailing ``.1``, ``_1`` or ``-1``; leave it off unless the
    convention has been confirmed, since reads numbered 1 and 2 would collapse into one pair.
    """
    x = clean_read_id(read_id)
    return F.regexp_replace(x, r"[._-][12]$", "") if strip_separators else x


# ------------------------------------------------------------------ coordinates


def is_forward(sstart, send) -> Column:
    return _c(sstart) < _c(send)


def strand(sstart, send) -> Column:
    return F.when(is_forward(sstart, send), "forward").otherwise("reverse")


def codon_start(qstart, sstart, send, position) -> Column:
    """Lowest read coordinate of the codon of a protein position, from a hit's raw coordinates."""
    shift = (_c(position) - _c(qstart)) * 3
    return F.when(is_forward(sstart, send), _c(sstart) + shift).otherwise(_c(sstart) - shift - 2)


def read_codon(seq, start, reverse) -> Column:
    """The codon starting at ``start`` of the stored read, reverse complemented when asked."""
    raw = F.substring(_c(seq), _c(start).cast("int"), F.lit(3))
    return F.upper(F.when(_c(reverse), reverse_complement(raw)).otherwise(raw))


def original_coordinates(start, end, read_length, reverse) -> Column:
    """Oriented -> stored read coordinates as (start, end)."""
    s, e, n, r = _c(start), _c(end), _c(read_length), _c(reverse)
    return F.struct(
        F.when(r, n - e + 1).otherwise(s).alias("start"), F.when(r, n - s + 1).otherwise(e).alias("end")
    )


def segment_codon(segment, seg_start, seg_end, position) -> Column:
    """Codon of an absolute residue position inside a stored in-frame segment; null out of range."""
    s, p = _c(segment), _c(position)
    rel = p - _c(seg_start)
    at = rel * 3 + 1
    ok = (rel >= 0) & (p <= _c(seg_end)) & (at + 2 <= F.length(s))
    return F.when(ok, F.substring(s, at.cast("int"), F.lit(3)))


def frame_status(segment) -> Column:
    s = _c(segment)
    return (
        F.when(s.isNull(), "missing_nt")
        .when(F.length(s) % 3 == 0, "frame_consistent")
        .otherwise("frame_inconsistent")
    )


def translation_matches(codon, residue) -> Column:
    """Whether a stored residue equals the translation of its stored codon."""
    return translate_codon(codon) == _c(residue)


# ------------------------------------------------------------------ labels


def variant_class(expected, position, observed) -> Column:
    return F.when(_c(expected) == _c(observed), "REFERENCE_MATCH").otherwise(
        F.concat(_c(expected), _c(position).cast("string"), _c(observed))
    )


def haplotype_aa(aa_a, pos_a, aa_b, pos_b) -> Column:
    return F.concat(_c(aa_a), F.lit(str(pos_a)), F.lit("-"), _c(aa_b), F.lit(str(pos_b)))


def range_label(start, end) -> Column:
    return F.concat_ws("-", _c(start).cast("string"), _c(end).cast("string"))


def count_with_percent(n, total, digits: int = 1) -> Column:
    return F.format_string(f"%d (%.{digits}f%%)", _c(n).cast("long"), (100.0 * _c(n) / _c(total)).cast("double"))


def first_available(df, candidates):
    """First of the candidate names that ``df`` has (schema lookup, no job)."""
    for name in candidates:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {list(candidates)} in {df.columns}")


def as_int(value) -> Column:
    """Integer, or null when the text is not a number."""
    return _c(value).try_cast("double").cast("int")
