"""Audits of disagreeing evidence: classification rules as column expressions, no row functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .once import once
from ..functions.reads import codon_quality, codon_start, frame_status, is_forward, read_codon, segment_codon, strand
from ..functions.sequence import (
    GLU_CODONS, LYS_CODONS, match_count, min_hamming_table, mismatch_positions, percent_identity, reverse_complement,
    translate_codon, translate_frame, translate_strict,
)


# ------------------------------------------------------------------ base evidence


def base_evidence(df: DataFrame, qual_offset: int = 33) -> DataFrame:
    """Codon, three Phred scores, residue and a note for one protein position per row.

    Input columns: mate, seq, qual (null when the read was not found), raw qstart, sstart, send, and
    target_position. Failing rows stay, with nulls and a note.
    """
    start = codon_start("qstart", "sstart", "send", "target_position")
    n = F.length("seq")
    note = (
        F.when(~F.coalesce(F.col("mate").isin("R1", "R2"), F.lit(False)), "mate_unknown")
        .when(F.col("seq").isNull() | F.col("qual").isNull(), "read_missing")
        .when(start.isNull(), "coordinates_missing")
        .when((start < 1) | (start + 2 > n), "codon_off_read")
        .when(F.length("qual") < start + 2, "quality_too_short")
        .otherwise("")
    )
    rev = ~is_forward("sstart", "send")
    out = df.withColumns({"note": note, "_start": start.cast("int")})
    ok, located = F.col("note") == "", ~F.col("note").isin(
        "mate_unknown", "read_missing", "coordinates_missing")
    out = out.withColumns(
        {
            "hsp_strand": F.when(located, strand("sstart", "send")),
            "codon_nt_start": F.when(located, F.col("_start")),
            "codon_nt_end": F.when(located, F.col("_start") + 2),
            "read_length": n,
        }
    )
    out = once(out, {"codon": F.when(ok, read_codon("seq", "_start", rev)), "_q": F.when(ok, codon_quality("qual", "_start", rev, qual_offset))})
    return out.withColumns(
        {
            **{f"codon_base{i}": F.substring("codon", i, 1) for i in (1, 2, 3)},
            **{f"codon_qual_pos{i}": F.col(f"_q.q{i}") for i in (1, 2, 3)},
            "codon_min_qual": F.col("_q.min_qual"),
            "codon_mean_qual": F.col("_q.mean_qual"),
            "translated_aa": translate_codon("codon"),
        }
    ).drop("_q", "_start")


# ------------------------------------------------------------------ conflicts between roles


def conflict_audit(df: DataFrame) -> DataFrame:
    """Codons, frames, overlap and class of N/C conflicts.

    Input: position, aa_n, aa_c and per role segment_x, start_x, end_x (null when the tail is absent).
    """
    out = once(
        df, {f"codon_{r}": segment_codon(f"segment_{r}", f"start_{r}", f"end_{r}", "position") for r in ("n", "c")}
    ).withColumns({f"frame_{r}": frame_status(f"segment_{r}") for r in ("n", "c")})
    cn, cc, an, ac = (F.col(x) for x in ("codon_n", "codon_c", "aa_n", "aa_c"))
    low = F.greatest("start_n", "start_c")
    high = F.least("end_n", "end_c")
    known = F.col("start_n").isNotNull() & F.col("start_c").isNotNull() & F.col("end_n").isNotNull() & F.col("end_c").isNotNull()
    simple = LYS_CODONS + GLU_CODONS
    cls = (
        F.when(an.isNull() | ac.isNull(), "missing_aa_call")
        .when(cn.isNull() | cc.isNull(), "unresolved_missing_nt")
        .when((cn == cc) & (an != ac), "nucleotide_identical_translation_discrepancy")
        .when((F.col("frame_n") == "frame_inconsistent") | (F.col("frame_c") == "frame_inconsistent"), "frame_inconsistent_tail")
        .when((cn != cc) & (an == ac), "synonymous_nucleotide_difference")
        .when(cn.isin(*simple) & cc.isin(*simple), "low_complexity_Lys_Glu_region")
        .when((cn != cc) & (an != ac), "nonsynonymous_nucleotide_difference")
        .otherwise("unresolved")
    )
    flag = lambda c, s: F.coalesce(c.isin(*s), F.lit(False))
    return out.withColumns(
        {
            "overlap_start": F.when(known, low),
            "overlap_end": F.when(known, high),
            "overlap_len_aa": F.when(known, F.greatest(F.lit(0), high - low + 1)).otherwise(0),
            "n_is_lys": flag(cn, LYS_CODONS), "c_is_lys": flag(cc, LYS_CODONS),
            "n_is_glu": flag(cn, GLU_CODONS), "c_is_glu": flag(cc, GLU_CODONS),
            "conflict_class": cls,
        }
    )


def tails_of_pairs(tails: DataFrame, on: str = "pair_id", frames: bool = False) -> DataFrame:
    """One row a pair with segment, start, end and reported peptide of its N tail and its C tail, in one aggregation.

    ``tails`` has at most one row per (pair, role). ``frames`` also carries the frame that reproduces
    the reported peptide, found once per tail rather than once per conflict.
    """
    payload = [("segment", "segment"), ("gap_position_start", "start"), ("gap_position_end", "end"), ("translated_candidate", "reported")]
    if frames:
        fwd, rev = frame_match("segment", "translated_candidate")
        tails = once(tails, {"_fwd": fwd, "_rev": rev})
        payload += [("_fwd", "fwd"), ("_rev", "rev")]
    pick = lambda r, c: F.max(F.when(F.col("role") == r, F.col(c)))
    return tails.groupBy(on).agg(*[pick(r, c).alias(f"{n}_{r.lower()}") for r in ("N", "C") for c, n in payload])


def attach_tails(conflicts: DataFrame, tails: DataFrame, on: str = "pair_id", frames: bool = False) -> DataFrame:
    """Left-join the N tail and the C tail of the pair to conflicts found elsewhere; one join (see :func:`tails_of_pairs`)."""
    return conflicts.join(tails_of_pairs(tails, on, frames), on, "left")


def overlap_calls(tails: DataFrame, on: str = "pair_id", frames: bool = False) -> DataFrame:
    """Each position that both tails of a pair cover, with the residue that either reports (aa_n, aa_c) and the tails' columns.

    Positions are listed from the pivoted pair itself, so the tails are read and shuffled once and nothing is joined back. A
    pair that lacks a tail, or whose tails do not overlap, gives no row."""
    pairs = tails_of_pairs(tails, on, frames)
    low, high = F.greatest("start_n", "start_c"), F.least("end_n", "end_c")
    known = F.col("start_n").isNotNull() & F.col("start_c").isNotNull() & (low <= high)
    at = pairs.filter(known).select("*", F.explode(F.sequence(low, high)).alias("position"))
    said = lambda r: F.substring(F.col(f"reported_{r}"), F.col("position") - F.col(f"start_{r}") + 1, F.lit(1))
    return at.select(on, "position", said("n").alias("aa_n"), said("c").alias("aa_c"), *[c for c in pairs.columns if c != on])


# ------------------------------------------------------------------ frames


def frame_match(segment, reported) -> tuple[Column, Column]:
    """First forward and first reverse frame (1-3) that translates to the reported peptide; null if none."""
    s, r = F.col(segment), F.col(reported)
    rc = reverse_complement(s)
    find = lambda t: F.coalesce(*[F.when(translate_frame(t, f) == r, F.lit(f)) for f in (1, 2, 3)])
    return find(s), find(rc)


def frame_audit(df: DataFrame, segment: str = "segment", reported: str = "translated_candidate") -> DataFrame:
    fwd, rev = frame_match(segment, reported)
    out = once(df, {"_f": fwd, "_r": rev})
    cls = (
        F.when(F.col("_f") == 1, "frame_1_match")
        .when(F.col("_f").isNotNull(), "non_frame_1_forward")
        .when(F.col("_r").isNotNull(), "reverse_complement_required")
        .otherwise("translation_not_reproduced")
    )
    return out.withColumns({"matched_frame": F.coalesce("_f", "_r"), "direct_frame_class": cls}).drop("_f", "_r")


def anomaly_cause(df: DataFrame) -> DataFrame:
    """Why identical codons were reported as different residues; tails attached with ``frames=True``."""
    gone = F.col("segment_n").isNull() | F.col("segment_c").isNull()
    shift = lambda c: (F.col(c) - 1).cast("string")
    cause = (
        F.when(gone, "tail_missing")
        .when((F.col("fwd_n") == 1) & (F.col("fwd_c") == 1),
              "both_in_frame_1")
        .when(F.col("fwd_n") > 1, F.concat(F.lit("n_tail_shift:"), shift("fwd_n")))
        .when(F.col("fwd_c") > 1, F.concat(F.lit("c_tail_shift:"), shift("fwd_c")))
        .when(F.col("rev_n").isNotNull() | F.col("rev_c").isNotNull(), "reverse_strand")
        .otherwise("not_reproduced")
    )
    label = lambda c: F.when(gone, "Missing").when(F.col(c).isNotNull(), F.concat(F.lit("+"), F.col(c).cast("string"))).otherwise("RC/None")
    return df.withColumns({"frame_n_matched": label("fwd_n"), "frame_c_matched": label("fwd_c"), "diagnostic_cause": cause})


def substitution_context(df: DataFrame, flank: int = 6) -> DataFrame:
    """Bases around the codon of each role and whether the codon change is a valid substitution."""
    def ctx(r):
        seg, at = F.col(f"segment_{r}"), (F.col("position") - F.col(f"start_{r}")) * 3 + 1
        lo = F.greatest(F.lit(1), at - flank)
        hi = F.least(F.length(seg), at + 2 + flank)
        return F.substring(seg, lo.cast("int"), F.greatest(hi - lo + 1, F.lit(0)).cast("int"))

    n, c = F.col("codon_n"), F.col("codon_c")
    valid = (F.length(n) == 3) & (F.length(c) == 3) & (n != c) & (F.col("aa_n") != F.col("aa_c"))
    return df.withColumns({"context_n": ctx("n"), "context_c": ctx("c"), "is_valid_substitution": F.coalesce(valid, F.lit(False))})


# ------------------------------------------------------------------ windows


def codon_window(df: DataFrame) -> DataFrame:
    """Add window_start, window_end: read coordinates of the codons of gap_position_start..end."""
    fwd = F.coalesce(is_forward("sstart", "send"), F.lit(True))
    a, q = F.col("sstart"), F.col("qstart")
    p, r = F.col("gap_position_start"), F.col("gap_position_end")
    return df.withColumns(
        {
            "window_start": F.when(fwd, a + (p - q) * 3).otherwise(a - (r - q) * 3 - 2),
            "window_end": F.when(fwd, a + (r - q) * 3 + 2).otherwise(a - (p - q) * 3),
        }
    )


def window_nesting(df: DataFrame) -> DataFrame:
    """Whether the codon window lies in the tail window, overlap in bases, phase offset modulo 3."""
    out = codon_window(df)
    ws, we, gs, ge = (F.col(c) for c in ("window_start", "window_end", "nt_start", "nt_end"))
    known = gs.isNotNull() & ge.isNotNull()
    return out.withColumns(
        {
            "strand": F.when(F.coalesce(is_forward("sstart", "send"), F.lit(True)), "+").otherwise("-"),
            "is_nested": F.coalesce(known & (ws >= gs) & (we <= ge), F.lit(False)),
            "overlap_bp": F.when(known, F.greatest(F.lit(0), F.least(we, ge) - F.greatest(ws, gs) + 1)).otherwise(0),
            "phase_offset": F.pmod(ws - gs, F.lit(3)),
        }
    )


def _local_start(strand_aware: bool) -> Column:
    """Offset (1-based) of the window inside the coding-oriented tail segment."""
    fwd = F.coalesce(is_forward("sstart", "send"), F.lit(True))
    straight = F.col("window_start") - F.col("nt_start") + 1
    return F.when(fwd, straight).otherwise(F.col("nt_end") - F.col("window_end") + 1) if strand_aware else straight


def discordance_audit(df: DataFrame, strand_aware: bool = True) -> DataFrame:
    """Re-slice the expected codons from the tail, translate, compare with the reported peptide.

    ``strand_aware=False`` slices reverse tails with forward offsets, as the published tables did.
    """
    out = codon_window(df)
    lo = _local_start(strand_aware)
    span = F.col("window_end") - F.col("window_start") + 1
    n = F.length("segment")
    missing = (
        F.col("nt_start").isNull() | F.col("nt_end").isNull() | F.col("gap_position_start").isNull()
        | F.col("gap_position_end").isNull() | F.coalesce(F.col("segment") == "", F.lit(True))
    )
    no_hit = F.col("qstart").isNull() | F.col("sstart").isNull() | F.col("send").isNull()
    status = (
        F.when(missing, "missing_coordinates_or_sequence")
        .when(no_hit, "missing_HSP_coordinates")
        .when((lo < 1) | (lo + span - 1 > n) | (span < 1), "codon_window_outside_gap_facing_sequence")
        .when(span % 3 != 0, "extracted_window_not_multiple_of_3")
        .otherwise("success")
    )
    out = out.withColumns({"extraction_status": status, "_lo": lo.cast("int"), "_span": span.cast("int"),
                           "reported_aa": F.upper("translated_candidate")})
    ok = F.col("extraction_status") == "success"
    nt = F.when(ok, F.substring(F.col("segment"), F.col("_lo"), F.col("_span")))
    out = once(out, {"expected_nt": nt, "reconstructed_aa": translate_strict(nt)})
    same_len = F.coalesce(F.length("reconstructed_aa") == F.length("reported_aa"), F.lit(False))
    out = once(
        out, {"aa_mismatch_count": F.when(same_len, F.length("reported_aa") - match_count("reconstructed_aa", "reported_aa"))}
    )
    cls = (
        F.when(~ok, F.col("extraction_status"))
        .when(F.coalesce((F.col("reconstructed_aa") == F.col("reported_aa")) & (F.col("reconstructed_aa") != ""), F.lit(False)),
              "direct_translation_reproduces_reported_candidate")
        .when(~same_len, "translation_length_discordance")
        .when(F.col("aa_mismatch_count") > 0, "same_length_amino_acid_discordance")
        .otherwise("unclassified")
    )
    return out.withColumn("discordance_class", cls).drop("_lo", "_span")


def hamming_frame(spark) -> DataFrame:
    """(codon, residue, distance): 64 codons x 21 residues, a fixed table from the genetic code."""
    return spark.createDataFrame(min_hamming_table(), "codon string, residue string, distance int")


def provenance_audit(df: DataFrame, strand_aware: bool = True) -> DataFrame:
    """First differing residue, its codon in frames 0/+1/+2, what each encodes, and a class A-E.

    Input: the discordance audit's columns. Rows without a difference drop out.
    """
    diff = mismatch_positions("reported_aa", "reconstructed_aa")
    out = once(df, {"_d": diff}).filter(F.size("_d") > 0)
    if "window_start" not in out.columns:
        out = codon_window(out)
    seg = F.col("segment")
    fwd = F.coalesce(is_forward("sstart", "send"), F.lit(True))
    first_start = F.when(fwd, F.col("window_start")).otherwise(F.col("window_end") - 2)
    local = _local_start(True) if strand_aware else first_start - F.col("nt_start") + 1
    out = out.withColumns(
        {
            "first_idx": F.col("_d")[0],
            "mismatch_positions": F.size("_d"),
            "_at": (local + (F.col("_d")[0] - 1) * 3).cast("int"),
        }
    ).drop("_d")

    def cut(k):
        at = F.col("_at") + k
        return F.when((at >= 1) & (at + 2 <= F.length(seg)), F.substring(seg, at, F.lit(3)))

    out = out.withColumns(
        {
            "first_position": F.col("gap_position_start") + F.col("first_idx") - 1,
            "reported_residue": F.substring(F.col("reported_aa"), F.col("first_idx"), F.lit(1)),
            "reconstructed_residue": F.substring(F.col("reconstructed_aa"), F.col("first_idx"), F.lit(1)),
            **{f"frame{k}_codon": cut(k) for k in (0, 1, 2)},
        }
    )
    out = once(out, {f"frame{k}_aa": translate_codon(f"frame{k}_codon") for k in (0, 1, 2)})
    spark = df.sparkSession
    table = F.broadcast(hamming_frame(spark).select(
        F.col("codon").alias("frame0_codon"), F.col("residue").alias("reported_residue"), F.col("distance").alias("hamming_distance")))
    out = out.join(table, ["frame0_codon", "reported_residue"], "left")
    rep = F.col("reported_residue")
    restored = F.coalesce(F.col("frame1_aa") == rep, F.lit(False)) | F.coalesce(F.col("frame2_aa") == rep, F.lit(False))
    out = out.withColumns(
        {
            "codon_encodes_reported": F.coalesce(F.col("frame0_aa") == rep, F.lit(False)),
            "codon_encodes_reconstructed": F.coalesce(F.col("frame0_aa") == F.col("reconstructed_residue"), F.lit(False)),
            "frame_shift_restores_reported": restored,
        }
    )
    return out.withColumn(
        "provenance_class",
        provenance_class("frame0_codon", "codon_encodes_reported", "frame_shift_restores_reported", "hamming_distance"),
    ).drop("_at")


def provenance_class(codon, encodes_reported, shift_restores, distance) -> Column:
    return (
        F.when(F.coalesce(F.length(codon) != 3, F.lit(True)), "E_insufficient_nucleotide_evidence")
        .when(F.col(encodes_reported), "A_translation_bookkeeping_mismatch")
        .when(F.col(shift_restores), "C_codon_boundary_frame_interpretation")
        .when(F.col(distance) == 1, "D_single_nucleotide_difference_candidate")
        .when(F.col(distance) >= 2, "B_extraction_provenance_nucleotide_mismatch")
        .otherwise("E_ambiguous_evidence")
    )


# ------------------------------------------------------------------ orientation, ground truth


def orientation_diagnostic(df: DataFrame, reference: str, reverse_anchor: str = "sstart") -> DataFrame:
    """Translate the window as stored and reverse complemented; compare with the reference and, as a
    control, the reversed reference.

    ``reverse_anchor="send"`` anchors reverse hits on the other end, as one published table did.
    """
    fwd = F.col("sstart") <= F.col("send")
    q, p, r = F.col("qstart"), F.col("gap_position_start"), F.col("gap_position_end")
    anchor = F.col(reverse_anchor)
    lo = F.when(fwd, F.col("sstart") + (p - q) * 3).otherwise(anchor - (r - q) * 3 - 2)
    hi = F.when(fwd, F.col("sstart") + (r - q) * 3 + 2).otherwise(anchor - (p - q) * 3)
    needed = [F.col(c).isNull() for c in ("sstart", "send", "qstart", "qend", "gap_position_start", "gap_position_end")]
    lacking = needed[0]
    for x in needed[1:]:
        lacking = lacking | x
    note = (
        F.when(lacking, "coordinates_missing")
        .when(~F.coalesce(F.col("mate").isin("R1", "R2"), F.lit(False)), F.concat(F.lit("mate_unknown:"), F.coalesce("mate", F.lit("NA"))))
        .when(F.col("seq").isNull(), "read_missing")
        .when((lo < 1) | (hi > F.length("seq")) | (lo > hi), "window_off_read")
        .otherwise("")
    )
    out = df.withColumns({"note": note, "nt_lo": lo, "nt_hi": hi})
    ok = F.col("note") == ""
    out = out.withColumn(
        "raw_segment",
        F.when(ok, F.substring(F.col("seq"), F.col("nt_lo").cast("int"), (F.col("nt_hi") - F.col("nt_lo") + 1).cast("int"))),
    )
    ref = F.when(ok, F.substring(F.col(reference), p.cast("int"), (r - p + 1).cast("int")))
    out = once(
        out,
        {
            "as_is": translate_frame("raw_segment"),
            "reverse_complemented": translate_frame(reverse_complement("raw_segment")),
            "reference_window": ref,
            "reversed_window": F.reverse(ref),
        }
    )
    same = {
        "id_as_is": ("as_is", "reference_window"),
        "id_rc": ("reverse_complemented", "reference_window"),
        "id_as_is_control": ("as_is", "reversed_window"),
        "id_rc_control": ("reverse_complemented", "reversed_window"),
    }
    out = once(out, {f"_{k}": match_count(a, b) for k, (a, b) in same.items()})
    compared = {k: F.least(F.length(a), F.length(b)) for k, (a, b) in same.items()}
    out = out.withColumns({k: F.when(n > 0, F.col(f"_{k}") / n * 100) for k, n in compared.items()})
    best = F.when(F.col("id_as_is") >= F.coalesce("id_rc", F.lit(-1.0)), "as_is").when(F.col("id_rc").isNotNull(), "reverse_complement")
    out = out.withColumn("best_orientation", best)
    best_len = F.when(F.col("best_orientation") == "as_is", F.length("as_is")).when(
        F.col("best_orientation") == "reverse_complement", F.length("reverse_complemented"))
    excess = F.greatest(F.col("id_as_is_control") - F.col("id_as_is"), F.col("id_rc_control") - F.col("id_rc"))
    # Counts decide: differences of percentages just miss 20 where the counts say 20 exactly.
    above = lambda k: F.coalesce((F.col(f"_{k}_control") - F.col(f"_{k}")) * 5 >= compared[k], F.lit(False)) & (compared[k] > 0)
    return out.withColumns(
        {
            "length_difference": best_len - F.length("reference_window"),
            "control_excess": excess,
            "control_excess_flag": F.coalesce(above("id_as_is") | above("id_rc"), F.lit(False)),
        }
    ).drop(*[f"_{k}" for k in same])


def validate_hits(df: DataFrame) -> DataFrame:
    """Re-translate the read span of a hit and compare it with the aligner's own strings.

    Input: a row per selected (read, mate) with seq and the best hit's sstart, send, qseq, sseq
    (nulls when there is none).
    """
    lo, hi = F.least("sstart", "send"), F.greatest("sstart", "send")
    out = df.withColumns(
        {
            "raw_nt": F.substring(F.col("seq"), lo.cast("int"), (hi - lo + 1).cast("int")),
            "sseq_ungapped": F.replace("sseq", F.lit("-"), F.lit("")),
            "qseq_ungapped": F.replace("qseq", F.lit("-"), F.lit("")),
        }
    )
    whole = F.length("raw_nt") % 3 == 0
    oriented = F.when(is_forward("sstart", "send"), F.col("raw_nt")).otherwise(reverse_complement("raw_nt"))
    out = once(out, {"our_translation": F.when(whole, translate_frame(oriented))})
    out = once(
        out,
        {
            "matches_sseq_pct": percent_identity("our_translation", "sseq_ungapped"),
            "length_difference": F.length("our_translation") - F.length("sseq_ungapped"),
            "sseq_vs_qseq_pct": percent_identity("sseq_ungapped", "qseq_ungapped"),
        }
    )
    status = (
        F.when(F.col("sstart").isNull(), "NO_HSP")
        .when(F.col("seq").isNull(), "ERROR")
        .when(~whole, "NON_MULTIPLE_OF_3")
        .when(F.col("length_difference") != 0, "LENGTH_MISMATCH")
        .when(F.col("matches_sseq_pct") == 100, "PASS")
        .otherwise("FAIL")
    )
    return out.withColumn("status", status)


def cds_extraction_check(df: DataFrame, expected_bp: str, reference: str, region: str = "region") -> DataFrame:
    """Extracted CDS: divisible by three, expected length, start codon, identity to the reference protein."""
    s = F.col(region)
    aa = F.col("protein")
    return once(df, {"protein": F.regexp_replace(translate_frame(s), "\\*$", "")}).withColumns(
        {
            "region_bp": F.length(s),
            "divisible_by_3": F.length(s) % 3 == 0,
            "length_matches": F.length(s) == F.col(expected_bp),
            "start_codon": F.substring(s, 1, 3),
            "identity_pct": percent_identity(aa, F.col(reference)),
        }
    )
