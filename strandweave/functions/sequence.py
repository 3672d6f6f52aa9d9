"""Nucleotide and peptide scalars as column expressions; whole sequences are translated by an Arrow kernel, a batch at a time."""

from __future__ import annotations

from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
# Standard genetic code, codons in T,C,A,G order.
BASES = "TCAG"
AA64 = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
# IUPAC nucleotide codes and their complements.
IUPAC = "ACGTURYSWKMBDHVN"
IUPAC_COMPLEMENT = "TGCAAYRSWMKVHDBN"
# IUPAC code -> bases it stands for.
IUPAC_BASES = {
    "A": "A", "C": "C", "G": "G", "T": "T",
    "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC",
    "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}
STANDARD_RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
START_CODONS = ("ATG", "GTG", "TTG")
STOP_CODONS = ("TAA", "TAG", "TGA")
LYS_CODONS = ("AAA", "AAG")
GLU_CODONS = ("GAA", "GAG")
# -----------------------------------------------------------------------------------------

CODONS = ["".join(c) for c in product(BASES, repeat=3)]
CODE = dict(zip(CODONS, AA64))


def codons_for(residue: str) -> list[str]:
    """Codons that encode ``residue`` (inverse lookup)."""
    return [c for c in CODONS if CODE[c] == residue]


def min_hamming_table() -> list[tuple[str, str, int]]:
    """(codon, residue, minimum number of base changes to any codon of that residue)."""
    residues = sorted(set(AA64))
    return [
        (c, aa, min(sum(x != y for x, y in zip(c, d)) for d in codons_for(aa)))
        for c in CODONS
        for aa in residues
    ]


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(_c(seq), IUPAC, IUPAC_COMPLEMENT))


#: Residue of a codon written in digits, T 0, C 1, A 2, G 3 and 4 for any other letter, at the number the digits spell.
BY_DIGITS = "".join(AA64[16 * (n // 100) + 4 * (n // 10 % 10) + n % 10] if max(f"{n:03d}") < "4" else "X" for n in range(445))


def base_digits(seq) -> Column:
    """The sequence, in either case, as one digit for each letter: T 0, C 1, A 2, G 3, all others 4."""
    return F.translate(F.regexp_replace(_c(seq), "(?s)[^TCAGtcag]", "4"), BASES + BASES.lower(), "01230123")


def _residue(digits: Column) -> Column:
    return F.get(F.split(F.lit(BY_DIGITS), ""), digits.cast("int"))


def translate_codon(codon) -> Column:
    """Residue of an exact ACGT codon in either case; X for anything else; null stays null.

    The internal-codon rule applies everywhere: CTG and TTG are leucine even in first place.
    """
    c = _c(codon)
    return F.when(F.length(c) == 3, _residue(base_digits(c))).when(c.isNotNull(), "X")


def codons(seq, frame=1) -> Column:
    """Array of the complete codons from ``frame`` (1-3) on.

    One linear pass: the sequence is evaluated once and cut by the regex engine, so neither long
    contigs nor costly input expressions are revisited per codon.
    """
    s, f = _c(seq), (frame if isinstance(frame, Column) else F.lit(frame))
    return F.regexp_extract_all(F.substring(s, f, F.length(s)), F.lit("(?s)..."), F.lit(0))


def translate_array(seq, frame=1) -> Column:
    """Residues of the complete codons from ``frame`` (1-3) on, as an array."""
    return F.transform(codons(base_digits(seq), frame), _residue)


#: The same by five times five times five, for the kernel.
_DIGIT = np.full(256, 4, dtype=np.uint8)
for _i, _b in enumerate(BASES.encode()):
    _DIGIT[_b] = _DIGIT[_b + 32] = _i
_BY_FIVES = np.frombuffer("".join(BY_DIGITS[100 * (n // 25) + 10 * (n // 5 % 5) + n % 5] for n in range(125)).encode(), dtype=np.uint8)
_COMPLEMENT = np.array([2, 3, 0, 1, 4], dtype=np.uint8)


def peptides(seqs: pa.Array, frame: int, reverse: bool = False) -> pa.Array:
    """Peptides of a batch of sequences from ``frame`` on, of the reverse complement if so asked; null stays null."""
    seqs = seqs.cast(pa.large_string())
    n = len(seqs)
    off = np.frombuffer(seqs.buffers()[1], dtype=np.int64)[seqs.offset:seqs.offset + n + 1] if n else np.zeros(1, np.int64)
    data = seqs.buffers()[2] if n else None
    blob = np.frombuffer(data, dtype=np.uint8)[off[0]:off[-1]] if data is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    if len(blob) and blob.max() >= 128:  # letters of several bytes count once
        first = (blob & 0xC0) != 0x80
        off, blob = np.concatenate([[0], np.cumsum(first)])[off], blob[first]
    digit = _DIGIT[blob]
    absent = np.asarray(seqs.is_null())
    count = np.where(absent, 0, np.maximum(np.diff(off) - frame + 1, 0) // 3)
    ends = np.concatenate([[0], np.cumsum(count)])
    step = 3 * (np.arange(ends[-1]) - np.repeat(ends[:-1], count))
    if reverse:
        digit, at, on = _COMPLEMENT[digit], np.repeat(off[1:] - frame, count) - step, -1
    else:
        at, on = np.repeat(off[:-1] + frame - 1, count) + step, 1
    out = _BY_FIVES[25 * digit[at] + 5 * digit[at + on] + digit[at + 2 * on]]
    valid = pa.py_buffer(np.packbits(~absent, bitorder="little").tobytes())
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(out.tobytes()), valid).cast(pa.string())


@cache
def _kernel(frame: int, reverse: bool):
    def kernel(seqs: pa.Array) -> pa.Array:
        return peptides(seqs, frame, reverse)

    return F.arrow_udf(kernel, "string")


def translate_frame(seq, frame=1) -> Column:
    """Peptide read from ``frame`` (1-3), either case; trailing bases that do not fill a codon are ignored."""
    return F.array_join(translate_array(seq, frame), "") if isinstance(frame, Column) else _kernel(frame, False)(_c(seq).cast("string"))


def translate_strict(seq) -> Column:
    """Peptide, or the empty string unless the length is a multiple of three."""
    s = _c(seq)
    return F.when((F.length(s) % 3 == 0) & (F.length(s) > 0), translate_frame(s)).when(s.isNotNull(), F.lit(""))


def six_frames(seq) -> Column:
    """Array of (ordinal, orientation, frame, peptide) for 2 orientations x 3 frames; the reverse complement is of exact bases in either case."""
    row = lambda o, name, f: F.struct(F.lit(o + f).alias("ordinal"), F.lit(name).alias("orientation"), F.lit(f).alias("frame"),
                                      _kernel(f, o > 0)(_c(seq).cast("string")).alias("peptide"))
    return F.array(*[row(o, name, f) for o, name in ((0, "fwd"), (3, "rev")) for f in (1, 2, 3)])


def best_frame(seq) -> Column:
    """The frame with most residues other than X; first on ties. Struct (residues, rank, orientation, frame).

    Read it with ``inline(array(best_frame(..)))`` so that the six translations run once per row.
    """
    return F.array_max(
        F.transform(
            six_frames(seq),
            lambda f: F.struct(
                (F.length(f["peptide"]) - count_residue(f["peptide"], "X")).alias("residues"),
                (-f["ordinal"]).alias("rank"), f["orientation"].alias("orientation"), f["frame"].alias("frame"),
            ),
        )
    )


def count_letters(s, letters: str) -> Column:
    """How many characters of ``s`` are in ``letters``."""
    c = _c(s)
    return F.length(c) - F.length(F.translate(c, letters, ""))


def count_residue(s, residue: str) -> Column:
    c = _c(s)
    return F.length(c) - F.length(F.replace(c, F.lit(residue), F.lit("")))


def residue_fraction(s, residue: str) -> Column:
    c = _c(s)
    return F.when(F.length(c) > 0, count_residue(c, residue) / F.length(c))


def composition_ratio(s, residue: str, reference_fraction: float) -> Column:
    """Residue fraction relative to a reference fraction; null for empty input."""
    return F.round(residue_fraction(s, residue) / F.lit(reference_fraction), 3)


def open_segments(peptide, min_length) -> Column:
    """Stretches between stops that are at least ``min_length`` residues long."""
    return F.filter(F.split(_c(peptide), "\\*"), lambda x: F.length(x) >= min_length)


def _chars(s: Column) -> Column:
    return F.split(s, "")


def match_count(a, b) -> Column:
    """Equal characters over the shared prefix length of two strings."""
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(
        _chars(F.substring(a, F.lit(1), n)), _chars(F.substring(b, F.lit(1), n)), lambda x, y: x == y
    )
    return F.when(n > 0, F.size(F.filter(pairs, lambda v: v))).when(n == 0, F.lit(0))


def percent_identity(a, b, unequal: str = "null") -> Column:
    """Percent of equal characters.

    ``unequal`` decides what happens when the lengths differ: ``"null"`` gives null,
    ``"truncate"`` compares up to the shorter length, ``"error"`` fails the job.
    """
    a, b = _c(a), _c(b)
    n = F.least(F.length(a), F.length(b))
    value = F.when(n > 0, match_count(a, b) / n * 100)
    if unequal == "truncate":
        return value
    same = F.length(a) == F.length(b)
    if unequal == "null":
        return F.when(same, value)
    if unequal == "error":
        bad = F.raise_error(F.lit("sequences differ in length")).cast("double")
        return F.when(~same, bad).otherwise(value)
    raise ValueError(f"unequal must be null, truncate or error, not {unequal!r}")


def substitutions(reference, observed, offset: int = 0, truncate: bool = False) -> Column:
    """Array of (position, mutation, reference, observed) where two proteins differ."""
    a, b = _c(reference), _c(observed)
    rows = F.transform(
        _differing(a, b),
        lambda r: F.struct(
            (r["i"] + offset).alias("position"),
            F.concat(r["x"], (r["i"] + offset).cast("string"), r["y"]).alias("mutation"),
            r["x"].alias("reference"),
            r["y"].alias("observed"),
        ),
    )
    return rows if truncate else F.when(F.length(a) == F.length(b), rows)


def _differing(a: Column, b: Column) -> Column:
    """Array of (i, x, y) where two strings differ over their shared length; linear in the length."""
    n = F.least(F.length(a), F.length(b))
    head = lambda s: _chars(F.substring(s, F.lit(1), n))
    pairs = F.transform(
        F.arrays_zip(head(a).alias("x"), head(b).alias("y")),
        lambda p, i: F.struct((i + 1).alias("i"), p["x"].alias("x"), p["y"].alias("y")),
    )
    empty = F.array().cast("array<struct<i:int,x:string,y:string>>")
    return F.when(n > 0, F.filter(pairs, lambda p: p["x"] != p["y"])).when(n == 0, empty)


def mismatch_positions(a, b) -> Column:
    """1-based indices at which two strings differ, over their shared length."""
    return F.transform(_differing(_c(a), _c(b)), lambda p: p["i"])


def detect_sequence_type(seq) -> Column:
    """``nucleotide`` when every letter is an IUPAC nucleotide code, else ``protein``; null when empty."""
    s = F.upper(F.regexp_replace(_c(seq), "\\s", ""))
    return F.when(F.length(s) == 0, F.lit(None)).when(s.rlike("^[ACGTUNRYWSKMBDHV-]+$"), "nucleotide").otherwise("protein")


def normalize_sequence_type(declared) -> Column:
    t = F.lower(F.trim(_c(declared)))
    return F.when(t.isin("nucleotide", "dna", "cds"), "nucleotide").when(
        t.isin("protein", "amino_acid", "amino acid"), "protein"
    )


def sequence_checksum(seq, line_end: str = "\r\n") -> Column:
    """MD5 of the sequence written as one text line."""
    return F.md5(F.concat(_c(seq), F.lit(line_end)).cast("binary"))
