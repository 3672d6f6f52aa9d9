import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandweave.operators import references
from strandweave.functions import reads as rd
from strandweave.functions import sequence as sq


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first().asDict(recursive=True)


def peptide(s):
    return "".join(sq.CODE.get(s[i : i + 3], "X") for i in range(0, len(s) - 2, 3))


def rc(s):
    return s[::-1].translate(str.maketrans("ACGTN", "TGCAN"))


@pytest.fixture(scope="module")
def dna():
    rng = random.Random(3)
    return ["".join(rng.choice("ACGTACGTACGTN") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", "A", "AC", "NNN"]


def test_translation_and_reverse_complement(spark, dna):
    df = spark.createDataFrame([(s,) for s in dna], "s string")
    got = df.select("s", *[sq.translate_frame("s", f).alias(f"f{f}") for f in (1, 2, 3)], sq.reverse_complement("s").alias("r"),
                    sq.reverse_complement(sq.reverse_complement("s")).alias("rr"), sq.translate_strict("s").alias("strict")).collect()
    for r in got:
        assert [r.f1, r.f2, r.f3] == [peptide(r.s[k:]) for k in range(3)]
        assert r.r == rc(r.s) and r.rr == r.s
        assert r.strict == (peptide(r.s) if len(r.s) % 3 == 0 else "")


def test_codons(spark):
    got = one(spark, a=sq.translate_codon(F.lit("CTG")), b=sq.translate_codon(F.lit("TTG")), c=sq.translate_codon(F.lit("ATN")),
              d=sq.translate_codon(F.lit("AT")), e=sq.translate_codon(F.lit(None).cast("string")), f=sq.translate_codon(F.lit("TAA")))
    assert list(got.values()) == ["L", "L", "X", "X", None, "*"]
    assert sorted(sq.codons_for("M")) == ["ATG"] and len(sq.codons_for("L")) == 6
    table = {(c, a): d for c, a, d in sq.min_hamming_table()}
    assert table["AAA", "K"] == 0 and table["AAA", "E"] == 1 and table["TTT", "W"] == 2 and len(table) == 64 * 21


def test_best_frame_takes_first_on_tie(spark, dna):
    df = spark.createDataFrame([(s,) for s in dna if len(s) >= 3], "s string")
    for r in df.select("s", F.inline(F.array(sq.best_frame("s")))).collect():
        frames = [(o, f + 1, peptide((r.s if o == "fwd" else rc(r.s))[f:])) for o in ("fwd", "rev") for f in range(3)]
        best = max(len(p) - p.count("X") for *_, p in frames)
        want = next((o, f) for o, f, p in frames if len(p) - p.count("X") == best)
        assert r.residues == best and (r.orientation, r.frame) == want


def test_identity_modes_and_substitutions(spark):
    got = one(spark, same=sq.percent_identity(F.lit("KLME"), F.lit("KLMQ")), short=sq.percent_identity(F.lit("KLME"), F.lit("KL")),
              cut=sq.percent_identity(F.lit("KLME"), F.lit("KX"), "truncate"), empty=sq.percent_identity(F.lit(""), F.lit("")),
              subs=sq.substitutions(F.lit("KLME"), F.lit("KAMQ"), offset=65))
    assert (got["same"], got["short"], got["cut"], got["empty"]) == (75.0, None, 50.0, None)
    assert [s["mutation"] for s in got["subs"]] == ["L67A", "E69Q"]
    with pytest.raises(PySparkException):
        one(spark, x=sq.percent_identity(F.lit("KL"), F.lit("K"), "error"))


def plain_repeats(s, k, least=3):
    out, i = [], 0
    while i <= len(s) - k * least:
        n = 1
        while s[i + n * k : i + (n + 1) * k] == s[i : i + k]:
            n += 1
        if n >= least:
            out.append((s[i : i + k], n, i + 1))
            i += n * k
        else:
            i += 1
    return out


@pytest.mark.parametrize("unit", [2, 3])
def test_tandem_repeats_match_plain_scan(spark, unit):
    rng = random.Random(unit)
    seqs = ["".join(rng.choice("KE") for _ in range(60)) for _ in range(60)] + ["KEKEKEKKKKKKEKE", "KK", ""]
    seqs += ["ACAC", "ACACAC" + "G", "", "AAAAAAAA", "N" * 5000 + "AC" * 3000, None, "ÄÖÄÖÄÖÄÖ"]
    df = spark.createDataFrame([(i, s, "own") for i, s in enumerate(seqs)], "motif long, s string, start string").coalesce(1)
    got = {}
    for r in references.tandem_repeats(df.select(F.col("motif").alias("id"), "s"), "id", "s", [unit, 5]).where(F.col("unit") == unit).collect():
        got.setdefault(r.id, []).append((r.motif, r.copies, r.start))
    assert {k: sorted(v, key=lambda x: x[2]) for k, v in got.items()} == {i: plain_repeats(s, unit) for i, s in enumerate(seqs) if s and plain_repeats(s, unit)}


def test_phred_and_ids(spark):
    got = one(spark, p=rd.phred(F.lit("!+5I")), low=rd.bases_at_least(F.lit("!+5I"), 20), a=rd.clean_read_id(F.lit("run.7/2 7 length=301")),
              b=rd.pair_id(F.lit("run.1 x")), c=rd.pair_id(F.lit("run.1 x"), strip_separators=True), d=rd.pair_id_by_rule(F.lit("x 1:N:0"), "space_suffix"))
    assert got == {"p": [0, 10, 20, 40], "low": 2, "a": "run.7", "b": "run.1", "c": "run", "d": "x"}


def test_codon_window_on_both_strands(spark):
    seq, qual = "AAATGCCCGGG", "!\"#$%&'()*+"
    fwd = one(spark, s=rd.codon_start(F.lit(10), F.lit(3), F.lit(8), F.lit(11)), c=rd.read_codon(F.lit(seq), F.lit(6), F.lit(False)),
              q=rd.codon_quality(F.lit(qual), F.lit(6), F.lit(False)))
    assert (fwd["s"], fwd["c"]) == (6, "CCC") and (fwd["q"]["q1"], fwd["q"]["q3"], fwd["q"]["min_qual"], fwd["q"]["mean_qual"]) == (5, 7, 5, 6.0)
    rev = one(spark, s=rd.codon_start(F.lit(10), F.lit(8), F.lit(3), F.lit(11)), c=rd.read_codon(F.lit(seq), F.lit(3), F.lit(True)),
              q=rd.codon_quality(F.lit(qual), F.lit(3), F.lit(True)))
    assert (rev["s"], rev["c"]) == (3, "CAT") and (rev["q"]["q1"], rev["q"]["q3"]) == (4, 2)


def test_checksum_and_types(spark):
    got = one(spark, m=sq.sequence_checksum(F.lit("MK")), n=sq.detect_sequence_type(F.lit("acgtn-")), p=sq.detect_sequence_type(F.lit("MKE")),
              t=sq.normalize_sequence_type(F.lit(" CDS ")), u=sq.normalize_sequence_type(F.lit("rna")))
    import hashlib

    assert got == {"m": hashlib.md5(b"MK\r\n").hexdigest(), "n": "nucleotide", "p": "protein", "t": "nucleotide", "u": None}
