"""Exhaustive positional scan: degenerate prefilter, six-frame anchor validation, mate partners.

Every read passes an Arrow kernel that counts pattern placements with mismatches; only the few
candidates go on to the kernel that validates anchors, to the mate join and to the summaries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import AA64, IUPAC, IUPAC_BASES, IUPAC_COMPLEMENT, codons_for
from ..session import cut_lineage
from .ranking import first_per_group

MIN_ANCHOR_IDENTITY = 0.75
MAX_AA_MISMATCH = 5
FLANK = 8


# ------------------------------------------------------------------ targets and patterns


@dataclass(frozen=True)
class Target:
    """A protein position to genotype and the peptide window around it."""

    position: int
    anchor: str
    offset: int  # 1-based place of the target in the anchor
    anchor_start: int

    @property
    def residue(self) -> str:
        return self.anchor[self.offset - 1]


def make_target(reference: str, position: int, flank: int = FLANK, clip: bool = False) -> Target:
    """Window position-flank .. position+flank; at the protein's ends clipped, or an error."""
    lo, hi = position - flank, position + flank
    if not clip and (lo < 1 or hi > len(reference)):
        raise ValueError(f"anchor {lo}..{hi} leaves the reference of {len(reference)} residues")
    lo, hi = max(1, lo), min(len(reference), hi)
    return Target(position, reference[lo - 1 : hi], position - lo + 1, lo)


def anchor_window(seq, position, flank: int = FLANK) -> Column:
    """The same window as a column, clipped to the protein."""
    s = F.col(seq) if isinstance(seq, str) else seq
    p = F.col(position) if isinstance(position, str) else position
    lo = F.greatest(F.lit(1), p - flank)
    return F.substring(s, lo.cast("int"), (F.least(F.length(s), p + flank) - lo + 1).cast("int"))


def residue_to_iupac(residue: str) -> str:
    """Per-position union of the bases of all codons of a residue, as IUPAC codes."""
    by_bases = {frozenset(v): k for k, v in IUPAC_BASES.items()}
    return "".join(by_bases[frozenset(c[i] for c in codons_for(residue))] for i in range(3))


def degenerate_pattern(anchor: str, offset: int, target_codon: str = "NNN") -> str:
    return "".join(target_codon if i == offset else residue_to_iupac(a) for i, a in enumerate(anchor, 1))


def degenerate_pattern_column(anchor, offset: int, target_codon: str = "NNN") -> Column:
    """The same pattern as a column, for catalogues held as data; X and unknown letters give NNN."""
    a = F.col(anchor) if isinstance(anchor, str) else anchor
    letters = "".join(sorted(set(AA64)))
    codes = "".join(residue_to_iupac(x) for x in letters)
    codon = lambda x: F.when(F.instr(F.lit(letters), x) > 0, F.substring(F.lit(codes), (F.instr(F.lit(letters), x) * 3 - 2), F.lit(3))).otherwise("NNN")
    parts = F.transform(F.filter(F.split(a, ""), lambda x: x != ""), lambda x, i: F.when(i == offset - 1, F.lit(target_codon)).otherwise(codon(x)))
    return F.array_join(parts, "")


def iupac_reverse_complement(pattern: str) -> str:
    return pattern[::-1].translate(str.maketrans(IUPAC, IUPAC_COMPLEMENT))


CATALOGUE_SCHEMA = T.StructType(
    [
        T.StructField("target_position", T.IntegerType()),
        T.StructField("target_reference_aa", T.StringType()),
        T.StructField("anchor_start", T.IntegerType()),
        T.StructField("anchor_end", T.IntegerType()),
        T.StructField("anchor_peptide", T.StringType()),
        T.StructField("target_offset_in_anchor", T.IntegerType()),
        T.StructField("pattern_type", T.StringType()),
        T.StructField("target_codon_pattern", T.StringType()),
        T.StructField("forward_pattern", T.StringType()),
        T.StructField("reverse_complement_pattern", T.StringType()),
        T.StructField("pattern_length_nt", T.IntegerType()),
        T.StructField("prefilter_max_mismatch", T.IntegerType()),
    ]
)


def pattern_catalogue(targets: list[Target], max_mismatch: int = 1) -> list[tuple]:
    """One row per target; the list of targets is a parameter of the scan."""
    rows = []
    for t in targets:
        fwd = degenerate_pattern(t.anchor, t.offset)
        rows.append(
            (t.position, t.residue, t.anchor_start, t.anchor_start + len(t.anchor) - 1, t.anchor, t.offset,
             "protein_derived_codon_degenerate", "NNN", fwd, iupac_reverse_complement(fwd), len(fwd), max_mismatch)
        )
    return rows


# ------------------------------------------------------------------ prefilter


def _masks(pattern: str) -> np.ndarray:
    bit = {"A": 1, "C": 2, "G": 4, "T": 8}
    return np.array([sum(bit[b] for b in IUPAC_BASES[c]) for c in pattern], dtype=np.uint8)


_BASE_MASK = np.zeros(256, dtype=np.uint8)
for _b, _v in zip(b"ACGTacgt", (1, 2, 4, 8) * 2):
    _BASE_MASK[_b] = _v
# Pattern positions compared over a whole batch before only surviving placements are followed.
LEAD_POSITIONS = 8


def _utf8_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column: the reads of a batch are already laid end to end."""
    wide = column.type in ("large_string", "large_utf8") or str(column.type).startswith("large")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    blob = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return blob[off[0] : off[-1]], off - off[0]


def _placements(blob: np.ndarray, off: np.ndarray, pattern: np.ndarray, k: int, overhang: bool) -> np.ndarray:
    """Placements of one pattern with at most k mismatches, per read of a batch.

    The most specific positions are compared everywhere; the few placements still within k mismatches
    are then followed through the rest. With ``overhang`` a pattern may stick out of either end of a
    read, each base outside being a mismatch. A base N in the read matches nothing.
    """
    base, reads, width = _BASE_MASK[blob], len(off) - 1, len(pattern)
    counts = np.zeros(reads, dtype=np.int64)
    n = len(base) - width + 1
    specific = np.argsort([bin(m).count("1") for m in pattern], kind="stable")
    lead, rest = specific[:LEAD_POSITIONS], specific[LEAD_POSITIONS:]
    if n > 0:
        miss = np.zeros(n, dtype=np.int32)
        for i in lead:
            miss += (base[i : i + n] & pattern[i]) == 0
        at = np.nonzero(miss <= k)[0]
        miss = miss[at]
        for i in rest:
            miss += (base[at + i] & pattern[i]) == 0
        at = at[miss <= k]
        read = np.searchsorted(off, at, side="right") - 1
        counts += np.bincount(read[at + width <= off[read + 1]], minlength=reads)
    for o in range(1, k + 1) if overhang else ():
        size = width - o
        fits = np.nonzero(np.diff(off) >= size)[0]
        for start, part in ((off[fits], pattern[o:]), (off[fits + 1] - size, pattern[:size])):
            miss = np.zeros(len(fits), dtype=np.int64)
            for i, m in enumerate(part):
                miss += (base[start + i] & m) == 0
            counts[fits] += miss <= k - o
        for left in range(1, o):  # short reads: the pattern sticks out of both ends
            fits = np.nonzero(np.diff(off) == size)[0]
            miss = np.zeros(len(fits), dtype=np.int64)
            for i, m in enumerate(pattern[left : left + size]):
                miss += (base[off[fits] + i] & m) == 0
            counts[fits] += miss <= k - o
    return counts


def prefilter(reads: DataFrame, targets: list[Target], max_mismatch: int = 1, overhang: bool = True,
              keep_all: bool = False) -> DataFrame:
    """Placement counts ``forward_count_<p>`` / ``reverse_count_<p>`` and candidate flags per read.

    The kernel works on the Arrow buffers of the read column and drops non-candidates before anything
    returns to the JVM; ``keep_all`` returns every read. It is a map step: no shuffle, any split size.
    """
    catalogue = pattern_catalogue(targets, max_mismatch)
    named = [(f"forward_count_{r[0]}", r[8]) for r in catalogue] + [(f"reverse_count_{r[0]}", r[9]) for r in catalogue]
    patterns = [(n, _masks(p)) for n, p in named]
    schema = T.StructType([*reads.schema.fields, *[T.StructField(n, T.IntegerType()) for n, _ in named]])

    def kernel(batches):
        import pyarrow as pa

        for batch in batches:
            blob, off = _utf8_buffers(batch.column(batch.schema.get_field_index("seq")))
            counts = [_placements(blob, off, p, max_mismatch, overhang).astype(np.int32) for _, p in patterns]
            out = pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(c) for c in counts]], names=[*batch.schema.names, *[n for n, _ in patterns]]
            )
            yield out if keep_all else out.filter(pa.array(np.sum(counts, axis=0) > 0))

    out = reads.mapInArrow(kernel, schema)
    flags = {f"any_{t.position}": (F.col(f"forward_count_{t.position}") > 0) | (F.col(f"reverse_count_{t.position}") > 0) for t in targets}
    any_flag = F.lit(False)
    for f in flags.values():
        any_flag = any_flag | f
    return out.withColumns({**flags, "any_candidate": any_flag})


# ------------------------------------------------------------------ validation

EVIDENCE_FIELDS = [
    ("read_id", "string"), ("pair_id", "string"), ("mate", "string"), ("read_index", "long"), ("evidence_role", "string"),
    ("target_position", "int"), ("orientation", "string"), ("frame", "int"), ("anchor_reference_start", "int"),
    ("anchor_reference_end", "int"), ("anchor_peptide", "string"), ("anchor_candidate", "string"),
    ("anchor_identity", "double"), ("target_aa", "string"), ("target_codon", "string"), ("expected_reference_aa", "string"),
    ("pct_reference_aa", "double"), ("variant_class", "string"), ("read_codon_start", "int"), ("read_codon_end", "int"),
    ("codon_min_qual", "int"), ("codon_mean_qual", "double"), ("read_length", "int"), ("prefilter_forward_count", "int"),
    ("prefilter_reverse_count", "int"), ("validator_max_aa_mismatch", "int"),
]
EVIDENCE_SCHEMA = ", ".join(f"{n} {t}" for n, t in EVIDENCE_FIELDS)

_DIGIT = np.full(256, 4, dtype=np.uint8)
for _i, _b in enumerate(b"TCAG"):
    _DIGIT[_b] = _DIGIT[_b + 32] = _i
_RESIDUES = np.frombuffer(AA64.encode(), dtype=np.uint8)
_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _a, _b in zip(IUPAC.encode(), IUPAC_COMPLEMENT.encode()):
    _COMPLEMENT[_a] = _b
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[97:123] -= 32


def _residues(blob: np.ndarray) -> np.ndarray:
    """The residue of the codon that begins at each base, so all three frames at once; X where a base is no base."""
    d = _DIGIT[blob].astype(np.int16)
    if len(d) < 3:
        return np.zeros(0, np.uint8)
    a, b, c = d[:-2], d[1:-1], d[2:]
    return np.where((a < 4) & (b < 4) & (c < 4), _RESIDUES[np.minimum(16 * a + 4 * b + c, 63)], ord("X")).astype(np.uint8)


def _windows(blob: np.ndarray, off: np.ndarray, target: Target, max_mismatch: int, min_identity: float):
    """(first base, read, residues, identity of the flanks) of the anchor windows in all reads of a batch.

    Mismatches are sums of shifted comparisons over the whole buffer; windows that leave their read are masked out.
    """
    residues, width = _residues(blob), len(target.anchor)
    n = len(residues) - 3 * (width - 1)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.uint8), np.zeros(0)
    differ = np.zeros(n, np.int16)
    for j, aa in enumerate(target.anchor.encode()):
        differ += residues[3 * j : 3 * j + n] != aa
    at = np.flatnonzero(differ <= max_mismatch)
    read = np.searchsorted(off, at, side="right") - 1
    inside = at + 3 * width <= off[read + 1]
    at, read = at[inside], read[inside]
    window = residues[at[:, None] + 3 * np.arange(width)]
    own = window[:, target.offset - 1]
    flank = differ[at] - (own != ord(target.residue))
    identity = 1.0 - flank / max(width - 1, 1)
    keep = (identity >= min_identity) & (own != ord("X")) & (own != ord("*"))
    return at[keep], read[keep], window[keep], identity[keep]


def _texts(letters: np.ndarray):
    """An Arrow string column from a matrix of ASCII letters, one string a row."""
    import pyarrow as pa

    n, width = letters.shape
    at = (np.arange(n + 1) * width).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), n, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(letters))])


def _hits(batch, target: Target, orientation: str, seq, qual, role, max_mismatch, min_identity, qual_offset, with_counts):
    """Evidence rows of one target and strand as a record batch. The reverse strand is the whole buffer reversed and
    complemented, with the reads in reverse order."""
    import pyarrow as pa

    blob, off = seq
    total = len(blob)
    ahead = orientation == "fwd"
    strand, bounds = (blob, off) if ahead else (_COMPLEMENT[blob][::-1], total - off[::-1])
    at, read, window, identity = _windows(strand, bounds, target, max_mismatch, min_identity)
    first = at + 3 * (target.offset - 1)  # of the target codon, on this strand
    start = first - bounds[read] + 1
    frame = (at - bounds[read]) % 3 + 1
    if not ahead:
        read = len(off) - 2 - read
    length = (off[read + 1] - off[read])
    low = start if ahead else length - start - 1
    phred = qual[0][(qual[1][read] + low - 1)[:, None] + np.arange(3)].astype(np.int32) - qual_offset
    aa = window[:, target.offset - 1]
    n = len(at)
    take = lambda name: batch.column(name).take(pa.array(read))
    same = lambda value, kind: pa.array([value] * n, kind)
    labels = pa.array(["REFERENCE_MATCH" if chr(c) == target.residue else f"{target.residue}{target.position}{chr(c)}" for c in range(128)])
    counts = [take(f"{d}_count_{target.position}") if with_counts else same(None, pa.int32()) for d in ("forward", "reverse")]
    i32 = lambda v: pa.array(v.astype(np.int32))
    columns = [
        take("read_id"), take("pair_id"), take("mate"), take("read_index"), same(role, pa.string()), same(target.position, pa.int32()),
        same(orientation, pa.string()), i32(frame), same(target.anchor_start, pa.int32()),
        same(target.anchor_start + len(target.anchor) - 1, pa.int32()), same(target.anchor, pa.string()), _texts(window),
        pa.array(identity), _texts(aa[:, None]), _texts(_UPPER[strand[first[:, None] + np.arange(3)]]), same(target.residue, pa.string()),
        pa.array(np.where(aa == ord(target.residue), 100.0, 0.0)), labels.take(pa.array(aa)), i32(low), i32(low + 2),
        i32(phred.min(axis=1, initial=1 << 30)), pa.array(phred.sum(axis=1) / 3.0), i32(length), *counts, same(max_mismatch, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f for f, _ in EVIDENCE_FIELDS])


def _ascii_buffers(column):
    """Buffers of a string column in which every character is one byte; null is empty, a letter outside ASCII is ``?``."""
    import pyarrow.compute as pc

    column = column.fill_null("") if column.null_count else column
    blob, off = _utf8_buffers(column)
    return _utf8_buffers(pc.replace_substring_regex(column, r"[^\x00-\x7F]", "?")) if len(blob) and blob.max() > 127 else (blob, off)


def validate_anchors(reads: DataFrame, targets: list[Target], role: str = "PRIMARY", max_mismatch: int = MAX_AA_MISMATCH,
                     min_identity: float = MIN_ANCHOR_IDENTITY, qual_offset: int = 33) -> DataFrame:
    """All anchor hits of each read in six frames, with codon, quality and coordinates.

    Runs on candidates only, a batch of reads at a time. Identity is over the flanks, the target residue left out; windows
    whose target codon is ambiguous or a stop are rejected. A read without sequence has no hits.
    """
    with_counts = f"forward_count_{targets[0].position}" in reads.columns
    cols = ["read_id", "pair_id", "mate", "read_index", "seq", "qual"]
    if with_counts:
        cols += [f"{d}_count_{t.position}" for t in targets for d in ("forward", "reverse")]

    def kernel(batches):
        for batch in batches:
            seq, qual = (_ascii_buffers(batch.column(c)) for c in ("seq", "qual"))
            bad = np.flatnonzero(np.diff(seq[1]) != np.diff(qual[1]))
            if len(bad):
                raise ValueError(f"sequence and quality differ in length for read {batch.column('read_id')[int(bad[0])].as_py()}")
            if len(qual[0]) and qual[0].min() < qual_offset:
                at = int(np.searchsorted(qual[1], int(qual[0].argmin()), "right")) - 1
                raise ValueError(f"quality below Phred+{qual_offset} in read {batch.column('read_id')[at].as_py()}")
            for t in targets:
                for strand in ("fwd", "rev"):
                    yield _hits(batch, t, strand, seq, qual, role, max_mismatch, min_identity, qual_offset, with_counts)

    return reads.select(*cols).mapInArrow(kernel, EVIDENCE_SCHEMA)


def best_anchor(evidence: DataFrame) -> DataFrame:
    """Best hit per (read, mate, position): highest identity, then forward before reverse, low frame,
    leftmost window."""
    length, start = F.col("read_length"), F.col("read_codon_start")
    oriented = F.when(F.col("orientation") == "fwd", start).otherwise(length - F.col("read_codon_end") + 1)
    return first_per_group(
        evidence, ["read_id", "mate", "target_position"],
        [F.col("anchor_identity").desc(), F.col("orientation"), F.col("frame"), oriented],
    )


def partners(reads: DataFrame, candidates: DataFrame) -> DataFrame:
    """The other mate of every candidate read, carrying the candidate's read index.

    An equi-join on (pair, mate) after the candidates have been reduced to keys; Spark broadcasts the
    candidates when their measured size allows. A pair id met twice keeps its first read.
    """
    other = F.when(F.col("mate") == "R1", "R2").otherwise("R1")
    wanted = candidates.groupBy("pair_id", other.alias("mate")).agg(F.min("read_index").alias("candidate_index"))
    joined = reads.join(wanted, ["pair_id", "mate"])
    first = first_per_group(joined, ["pair_id", "mate"], [F.col("read_index"), F.col("read_id")])
    return first.withColumn("read_index", F.col("candidate_index")).drop("candidate_index")


def positional_scan(reads: DataFrame, targets: list[Target], max_mismatch: int = 1, materialise=None, qual_offset: int | None = None,
                    laid_out: bool = False) -> dict[str, DataFrame]:
    """Candidates, primary, partner and deduplicated evidence.

    Without ``qual_offset`` the candidates' qualities decide it, and stop the run where they fit none. ``laid_out`` says that
    ``reads`` is a table of :func:`..sources.layout.save_by_pair`, so mates are found without moving reads.

    ``materialise(df, label)`` writes the small candidate table once so that the prefilter does not
    run again for each consumer; by default below the cluster's checkpoint folder.
    """
    from ..sources.layout import partners_by_pair
    from .alleles import deduplicate_evidence
    from .qc import detect_phred_offset

    keep = materialise or cut_lineage
    cand = keep(prefilter(reads, targets, max_mismatch), "candidates")
    offset = detect_phred_offset(cand) if qual_offset is None else qual_offset
    primary = validate_anchors(cand, targets, qual_offset=offset)
    every = reads.select("read_id", "pair_id", "mate", "read_index", "seq", "qual")
    mate = validate_anchors((partners_by_pair if laid_out else partners)(every, cand), targets, "PAIRED_PARTNER", qual_offset=offset)
    both = keep(primary.unionByName(mate), "evidence")
    return {
        "candidates": cand,
        "primary": both.filter(F.col("evidence_role") == "PRIMARY"),
        "partners": both.filter(F.col("evidence_role") == "PAIRED_PARTNER"),
        "evidence": deduplicate_evidence(both, [F.col("read_codon_start")]),
    }
