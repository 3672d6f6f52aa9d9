import random

import pytest
from pyspark.sql import functions as F

from strandweave.functions.sequence import CODE, IUPAC_BASES
from strandweave.operators import scan

BACK = {}
for _c, _a in CODE.items():
    BACK.setdefault(_a, _c)


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


def reads_frame(spark, seqs, quals=None):
    rows = [(i, f"r{i}/1", f"r{i}", "R1", s, (quals or {}).get(i, "I" * len(s))) for i, s in enumerate(seqs)]
    return spark.createDataFrame(rows, "read_index long, read_id string, pair_id string, mate string, seq string, qual string")


def plain_count(seq, pattern, k, overhang=True):
    pad = k if overhang else 0
    s = "#" * pad + seq + "#" * pad
    return sum(
        sum(s[i + j] not in IUPAC_BASES[p] for j, p in enumerate(pattern)) <= k for i in range(len(s) - len(pattern) + 1)
    )


def test_degenerate_codons():
    assert [scan.residue_to_iupac(a) for a in "KELSRM*"] == ["AAR", "GAR", "YTN", "WSN", "MGN", "ATG", "TRR"]
    p = scan.degenerate_pattern("KEM", 2)
    assert p == "AARNNNATG" and scan.iupac_reverse_complement(p) == "CATNNNYTT"


def test_pattern_column_equals_literal_pattern(spark):
    anchors = ["MKLEDWHRTYVNQPSGA", "KXKKEEEEKKKKEEEE*"]
    df = spark.createDataFrame([(a,) for a in anchors], "a string").select("a", scan.degenerate_pattern_column("a", 9).alias("p"))
    for r in df.collect():
        want = "".join("NNN" if i == 9 or a == "X" else scan.residue_to_iupac(a) for i, a in enumerate(r.a, 1))
        assert r.p == want


def test_target_windows():
    t = scan.make_target("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 10, 8)
    assert (t.anchor, t.offset, t.anchor_start, t.residue) == ("BCDEFGHIJKLMNOPQR", 9, 2, "J")
    with pytest.raises(ValueError):
        scan.make_target("ABCDEFGH", 2)
    assert scan.make_target("ABCDEFGH", 2, clip=True).anchor == "ABCDEFGH"


@pytest.mark.parametrize("k", [0, 1, 2])
def test_prefilter_equals_plain_counting(spark, k):
    """Seeds must lose no candidate: planted copies with 0..k+1 changes, N bases, both strands, both ends."""
    rng = random.Random(k)
    targets = [scan.Target(5, "KEKLE", 3, 3), scan.Target(9, "MWKFY", 3, 7)]
    seqs = []
    for t in targets:
        coding = "".join(BACK[a] for a in t.anchor)
        for changes in range(k + 2):
            for _ in range(12):
                c = list(coding)
                for p in rng.sample(range(len(c)), changes):
                    c[p] = rng.choice("ACGTN".replace(c[p], ""))
                c = "".join(c)[rng.choice([0, 0, 1, 2]) :]
                s = "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9))) * rng.choice([0, 1]) + c + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 9)))
                seqs.append(rng.choice([s, rc(s)]))
    seqs += ["", "ACG", "N" * 40] + ["".join(rng.choice("ACGTN") for _ in range(60)) for _ in range(40)]
    for overhang in (True, False):
        got = {r.read_index: r for r in scan.prefilter(reads_frame(spark, seqs), targets, k, overhang, keep_all=True).collect()}
        assert len(got) == len(seqs)
        for i, s in enumerate(seqs):
            for row in scan.pattern_catalogue(targets, k):
                assert got[i][f"forward_count_{row[0]}"] == plain_count(s, row[8], k, overhang), (i, s)
                assert got[i][f"reverse_count_{row[0]}"] == plain_count(s, row[9], k, overhang)
            assert got[i].any_candidate == any(got[i][f"{d}_count_{t.position}"] > 0 for t in targets for d in ("forward", "reverse"))
    kept = scan.prefilter(reads_frame(spark, seqs), targets, k)
    assert {r.read_index for r in kept.collect()} == {i for i, s in enumerate(seqs) if any(plain_count(s, p, k) for r in scan.pattern_catalogue(targets, k) for p in r[8:10])}


PROTEIN = "MKLEDWHRTYVNQPSGAICFMKLED"
TARGET = scan.make_target(PROTEIN, 11)
CODING = "".join(BACK[a] for a in TARGET.anchor)


def evidence(spark, seqs, quals=None, **kw):
    return scan.validate_anchors(reads_frame(spark, seqs, quals), [TARGET], **kw).orderBy("read_index", "orientation", "frame").collect()


def test_known_answers_orientation_frame_coordinates(spark):
    plus = "AC" + CODING + "GATT"
    minus = rc("A" + CODING + "CC")
    quals = {0: "".join(chr(33 + i % 40) for i in range(len(plus))), 1: "".join(chr(33 + i % 40) for i in range(len(minus)))}
    a, b = evidence(spark, [plus, minus], quals)
    start = 3 + 3 * (TARGET.offset - 1)
    assert (a.orientation, a.frame, a.read_codon_start, a.read_codon_end) == ("fwd", 3, start, start + 2)
    assert a.target_codon == plus[start - 1 : start + 2] and a.codon_min_qual == (start - 1) % 40 and a.codon_mean_qual == start % 40
    assert (b.orientation, b.frame, b.target_aa, b.variant_class) == ("rev", 2, "V", "REFERENCE_MATCH")
    assert rc(minus[b.read_codon_start - 1 : b.read_codon_end]) == b.target_codon
    q = [ord(c) - 33 for c in quals[1][b.read_codon_start - 1 : b.read_codon_end]]
    assert b.codon_min_qual == min(q) and b.anchor_identity == 1.0 and b.pct_reference_aa == 100.0


def test_variants_stops_ambiguity_and_unrelated_reads(spark):
    at = 3 * (TARGET.offset - 1)
    put = lambda codon: CODING[:at] + codon + CODING[at + 3 :]
    rows = evidence(spark, [put("AAA"), put("TAA"), put("NAA"), "ACGT" * 20, CODING[:-1], "N" * 90])
    assert [(r.read_index, r.variant_class, r.pct_reference_aa) for r in rows] == [(0, "V11K", 0.0)]


def test_flank_identity_leaves_the_target_out(spark):
    swap = lambda n: "".join("GGG" if i < n else BACK[a] for i, a in enumerate(TARGET.anchor))
    got = {r.read_index: r.anchor_identity for r in evidence(spark, [swap(1), swap(4), swap(5)])}
    assert got == {0: 15 / 16, 1: 12 / 16}


def test_partner_evidence_and_dedup(spark):
    r1 = "".join(BACK[a] for a in TARGET.anchor)
    rows = [(1, "p/1", "p", "R1", r1, "I" * 51), (1, "p/2", "p", "R2", rc("GAC" + r1[3:24] + "AAA" + r1[27:]), "5" * 51), (2, "q/1", "q", "R1", "ACGT" * 12, "I" * 48), (2, "q/2", "q", "R2", "ACGT" * 12, "I" * 48)]
    reads = spark.createDataFrame(rows, "read_index long, read_id string, pair_id string, mate string, seq string, qual string")
    out = scan.positional_scan(reads, [TARGET])
    assert {r.read_id for r in out["candidates"].collect()} == {"p/1"}
    assert [(r.read_id, r.read_index, r.prefilter_forward_count) for r in out["partners"].collect()] == [("p/2", 1, None)]
    assert sorted((r.read_id, r.evidence_role) for r in out["evidence"].collect()) == [("p/1", "PRIMARY"), ("p/2", "PAIRED_PARTNER")]


def test_sequence_quality_length_mismatch_fails(spark):
    with pytest.raises(Exception, match="differ in length"):
        evidence(spark, [CODING], {0: "I"})


def test_long_patterns_and_two_sided_overhang():
    import numpy as np

    def count(seq, pattern, k):
        mask = scan._masks(pattern)
        blob = np.frombuffer(seq.encode(), np.uint8)
        return int(scan._placements(blob, np.array([0, len(blob)]), mask, k, True)[0])

    assert count("A" * 400, "C" * 257 + "A" * 43, 1) == 0  # 257 mismatches are not one
    assert count("CGTACGTA", "ACGTACGTAC", 2) == 1  # one base out at each end
    assert count("acgtacgt", "ACGTACGT", 0) == 1


def test_alignment_of_a_long_query():
    from strandweave.operators.orfs import align_batch

    assert align_batch(["ACDEFGHIKL"], ["W" * 40_000 + "ACDEFGHIKL"])[0][3] == 10


def plain_hits(seq, qual, t, most, least):
    """Anchor hits of one read by loops over strands, frames and windows."""
    out = set()
    for orientation in ("fwd", "rev"):
        s = seq if orientation == "fwd" else seq[::-1].translate(str.maketrans("ACGTURYSWKMBDHVN", "TGCAAYRSWMKVHDBN"))
        for frame in (1, 2, 3):
            codons = [s[i:i + 3] for i in range(frame - 1, len(s) - 2, 3)]
            pep = "".join(CODE.get(c.upper(), "X") for c in codons)
            for i in range(len(pep) - len(t.anchor) + 1):
                w = pep[i:i + len(t.anchor)]
                differ = [a != b for a, b in zip(w, t.anchor)]
                identity = 1 - (sum(differ) - differ[t.offset - 1]) / (len(w) - 1)
                if sum(differ) > most or identity < least or w[t.offset - 1] in "X*":
                    continue
                start = frame + 3 * (i + t.offset - 1)
                lo = start if orientation == "fwd" else len(seq) - start - 1
                q = [ord(c) - 33 for c in qual[lo - 1:lo + 2]]
                out.add((orientation, frame, w, round(identity, 9), s[start - 1:start + 2].upper(), lo, lo + 2, min(q), round(sum(q) / 3, 9)))
    return out


def test_batch_of_reads_equals_loops(spark):
    """Windows that would cross into the next read, repeated anchors, ambiguous and lower-case letters, empty and missing reads."""
    rng = random.Random(11)
    targets = [scan.Target(7, "KEK", 2, 6), scan.Target(9, "MWKFYL", 6, 4), scan.Target(1, "EE", 1, 1)]
    coding = {t: "".join(BACK[a] for a in t.anchor) for t in targets}
    seqs = ["", "A", "ACG"]
    for _ in range(150):
        parts = [rng.choice([coding[rng.choice(targets)], rc(coding[rng.choice(targets)]), rng.choice("ACGTNRYacgt"), "AAGGAA"]) for _ in range(rng.randint(1, 9))]
        seqs.append("".join(parts))
    seqs += [coding[targets[1]][:9], coding[targets[1]][9:]]  # halves of an anchor in neighbouring reads
    quals = {i: "".join(chr(33 + rng.randint(0, 60)) for _ in s) for i, s in enumerate(seqs)}
    df = reads_frame(spark, seqs, quals).coalesce(1).unionByName(spark.createDataFrame([(9999, "none", "p", "R1", None, None)], reads_frame(spark, []).schema))
    got = {}
    for r in scan.validate_anchors(df, targets, max_mismatch=2, min_identity=0.5).collect():
        key = (r.orientation, r.frame, r.anchor_candidate, round(r.anchor_identity, 9), r.target_codon, r.read_codon_start, r.read_codon_end, r.codon_min_qual, round(r.codon_mean_qual, 9))
        assert key not in got.setdefault((r.read_index, r.target_position), set())
        got[r.read_index, r.target_position].add(key)
    want = {(i, t.position): plain_hits(s, quals[i], t, 2, 0.5) for i, s in enumerate(seqs) for t in targets}
    assert got == {k: v for k, v in want.items() if v} and sum(map(len, got.values())) > 300
