import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandweave.operators import audits as au
from strandweave.operators import checks
from strandweave.operators import consensus as cs
from strandweave.operators import haplotypes as hp
from strandweave.operators import intervals as iv
from strandweave.operators import orfs, ranking, running
from strandweave.operators import tails as tl
from strandweave.operators.alleles import compare_key_sets, deduplicate_evidence
from strandweave.operators.pairs import consolidate, merge_roles, pair_calls


def plain_merge(spans):
    out = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def spans(spark):
    """A third of all intervals share one key; lengths vary so that carries cross many buckets."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        s = rng.randint(1, 900)
        rows.append(("hot" if i % 3 == 0 else f"k{i % 7}", s, s + rng.choice([0, 1, 3, 40, 200])))
    return rows, spark.createDataFrame(rows, "key string, start int, end int")


@pytest.mark.parametrize("width", [1, 7, 64, 4096])
def test_merge_equals_plain_merge_for_any_bucket_width(spans, width):
    rows, df = spans
    got = {}
    for r in iv.merge_intervals(df, ["key"], bucket_width=width).collect():
        got.setdefault(r.key, []).append((r.seg_start, r.seg_end))
    for k in {r[0] for r in rows}:
        want = plain_merge([(s, e) for key, s, e in rows if key == k])
        assert sorted(got[k]) == want
        assert all(b[0] > a[1] + 1 for a, b in zip(want, want[1:]))


def test_merge_within_equals_merge(spans):
    rows, df = spans
    for r in iv.merge_within(df, ["key"], "start", "end", "segs").collect():
        mine = [(s, e) for key, s, e in rows if key == r.key]
        assert [tuple(x) for x in r.segs] == plain_merge(mine) and r.n_intervals == len(mine)


@pytest.mark.parametrize("width", [5, 4096])
def test_depth_and_uncovered(spark, spans, width):
    rows, df = spans
    lens = spark.createDataFrame([(k, 700) for k in {r[0] for r in rows}] + [("empty", 30)], "key string, len int")
    d = iv.depth(df, ["key"], lens, "len", bucket_width=width).collect()
    got = {(r.key, r.position): r.depth for r in d}
    for k in {r[0] for r in rows}:
        clipped = [(max(1, s), min(700, e)) for key, s, e in rows if key == k]
        assert sum(got[k, p] for p in range(1, 701)) == sum(max(0, e - s + 1) for s, e in clipped)
        assert all(got[k, p] == sum(s <= p <= e for s, e in clipped) for p in range(1, 701, 13))
    runs = iv.uncovered_intervals(df, ["key"], lens, "len", bucket_width=width).collect()
    zero = iv.uncovered(spark.createDataFrame(d), ["key"], bucket_width=width).collect()
    assert sorted(map(tuple, runs)) == sorted(map(tuple, zero))
    runs = iv.uncovered(spark.createDataFrame(d), ["key"], bucket_width=width).filter("key = 'empty'").collect()
    assert [(r.start, r.end, r.length) for r in runs] == [(1, 30, 30)]


@pytest.mark.parametrize("width", [2, 50, 4096])
def test_families_are_single_linkage(spark, width):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2]), rng.choice(["R1", "R2"]), rng.choice("+-"), rng.randint(1, 120), i) for i in range(200)]
    df = spark.createDataFrame(rows, "pos int, mate string, strand string, st int, id int")
    got = {r.id: r.family for r in iv.families(df, ["pos"], ["mate", "strand"], "st", 3, width).collect()}
    for pos in (1, 2):
        k, last = 0, None
        for _, m, s, st, i in sorted((r for r in rows if r[0] == pos), key=lambda r: r[1:4]):
            if last is None or last[:2] != (m, s) or st - last[2] > 3:
                k += 1
            last = (m, s, st)
            assert got[i] == f"{m}_{s}_F{k}"


def test_range_join_finds_every_pair_once(spark, spans):
    rows, df = spans
    pts = spark.createDataFrame([(p,) for p in (1, 64, 128, 129, 500)], "p int")
    got = {r.p: r.n for r in iv.points_in_intervals(pts, df, "p", bin_width=16).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {p: n for p in (1, 64, 128, 129, 500) if (n := sum(s <= p <= e for _, s, e in rows))}


def test_ordinal_and_evenly_spaced(spark):
    rows = [("a" if i % 3 else "b", float(i * 37 % 50), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v double, i int").withColumn("b", F.floor(F.col("i") / 8))
    got = running.ordinal(df, ["k"], "b", ["i"], "n").collect()
    for k in "ab":
        assert [r.n for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)] == list(range(1, 1 + sum(x[0] == k for x in rows)))
    picked = ranking.evenly_spaced(df.select("k", "v", "i"), ["k"], "v", "i", 5, tie_width=4).collect()
    for k in "ab":
        pool = sorted((v, i) for kk, v, i in rows if kk == k)
        want = [pool[round(1 + j * (len(pool) - 1) / 4) - 1][1] for j in range(5)]
        assert sorted(r.i for r in picked if r.k == k) == sorted(want)


def test_first_per_group_is_limited_before_the_shuffle(spark, spans):
    out = ranking.first_per_group(spans[1], ["key"], [F.col("end").desc(), F.col("start")])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_quantiles_are_type_seven(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (35, 100, 250, 301, 301)], "k string, v double")
    r = ranking.exact_quantiles(df, ["k"], "v", [0.05, 0.25, 0.75, 0.95]).first()
    assert [round(x, 6) for x in r[1:]] == [48.0, 100.0, 301.0, 301.0]


def test_consensus_ties_and_pair_weights(spark):
    obs = [(1, 10, "K", "N", 1), (1, 10, "E", "C", 2), (2, 10, "E", "N", 3), (3, 10, "K", "C", 4), (3, 11, "M", "C", 5)]
    df = spark.createDataFrame(obs, "pair int, position int, aa string, role string, ord int")
    c = {r.position: r for r in cs.consensus(cs.residue_counts(df, ["position"]), ["position"]).collect()}
    assert (c[10].dominant_aa, c[10].dominant_count, c[10].coverage_depth, c[10].all_observed_aa) == ("E", 2, 4, "E/K")
    res = cs.resolve_pairs(df, "pair", "position", F.col("ord"))
    assert {(r.pair, r.position): r.status for r in res.collect()} == {(1, 10): "NC_conflict", (2, 10): "N_only", (3, 10): "C_only", (3, 11): "C_only"}
    w = {r.position: r for r in cs.weighted_consensus(res, "position").collect()}
    assert (w[10].dominant_aa, w[10].dominant_pair_count, w[10].total_weight, w[10].nc_conflict_count) == ("E", 1.5, 3.0, 1)
    labels = spark.createDataFrame([(x,) for x in (100.0, 95.0, 94.9, 75.0, 74.9)], "p double").select(cs.concordance_class("p").alias("c"))
    assert [r.c for r in labels.collect()] == ["100%", ">=95%", "90-94.9%", "75-89.9%", "<75%"]


def test_deduplication_prefers_primary_and_is_idempotent(spark):
    cols = "read_id string, mate string, target_position int, orientation string, frame int, evidence_role string, anchor_identity double, codon_min_qual int"
    rows = [("r", "R1", 5, "fwd", 1, "PAIRED_PARTNER", 1.0, 40), ("r", "R1", 5, "fwd", 1, "PRIMARY", 0.8, 10), ("r", "R1", 5, "fwd", 1, "PRIMARY", 0.8, 12), ("r", "R1", 5, "rev", 1, "PRIMARY", 0.8, 1)]
    once = deduplicate_evidence(spark.createDataFrame(rows, cols))
    got = sorted(tuple(r) for r in once.collect())
    assert got == sorted([rows[2], rows[3]]) and sorted(tuple(r) for r in deduplicate_evidence(once).collect()) == got


def test_pair_calls(spark):
    rows = [("a", "R1", 1, "M", 1), ("a", "R2", 1, "M", 2), ("b", "R1", 1, "M", 1), ("b", "R1", 1, "K", 0), ("b", "R2", 1, "K", 3), ("c", "R2", 2, "L", 1)]
    got = {r.pair_id: r for r in pair_calls(spark.createDataFrame(rows, "pair_id string, mate string, target_position int, target_aa string, o int"), [1, 2], F.col("o")).collect()}
    assert got["a"].paired_1_status == "BOTH_MATES_CONCORDANT" and got["b"].r1_1 == "K/M" and got["b"].paired_1_status == "BOTH_MATES_DISCORDANT"
    assert got["c"].paired_1_status == "NO_POSITIONAL_EVIDENCE" and got["c"].paired_2_status == "R2_ONLY_POSITIONAL_EVIDENCE"


def test_thresholds_keep_empty_levels(spark):
    df = spark.createDataFrame([(5,), (12,), (31,)], "q int")
    got = {r.threshold: r.n for r in hp.by_threshold(df, "q", [0, 10, 30, 40], [F.count(F.lit(1)).alias("n")]).fillna(0).collect()}
    assert got == {0: 3, 10: 2, 30: 1, 40: 0}


def test_key_set_comparison(spark):
    a, b = (spark.createDataFrame([(x,) for x in v], "k int") for v in ([1, 2, 2, 3], [3, 4]))
    r = compare_key_sets(a, b, ["k"]).first()
    assert (r.old_keys, r.new_keys, r.overlap, r.missing_from_new, r.new_only, round(r.recovery_pct, 2)) == (3, 2, 1, 2, 1, 33.33)


def plain_align(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best, at = 0, None
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
            if h[i][j] > best:
                best, at = h[i][j], (i, j)
    if not best:
        return 0.0, 0.0, 0, 0
    (i, j), cols, same = at, 0, 0
    while i and j and h[i][j] > 0:
        cols += 1
        eq = a[i - 1] == b[j - 1]
        if h[i][j] == h[i - 1][j - 1] + (1 if eq else -1):
            same, i, j = same + eq, i - 1, j - 1
        elif h[i][j] == h[i - 1][j] - 1:
            i -= 1
        else:
            j -= 1
    return 100.0 * same / cols, 100.0 * cols / len(a), cols, best


def plain_recovery(hits, contigs, proteins, flank):
    """Best hit, region and best open segment of each gene, one after the other."""
    from strandweave.functions.sequence import CODE

    def peptide(x):
        return "".join(CODE.get(x[i:i + 3], "X") for i in range(0, len(x) - 2, 3))

    turned = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    out = []
    for gene, ref in proteins:
        own = [h for h in hits if h[1] == gene and h[2] in contigs]
        if not own:
            continue
        _, _, contig, _, start, end = min(own, key=lambda h: (-h[3], h[0]))
        seq = contigs[contig]
        lo, hi = max(1, min(start, end) - flank), min(len(seq), max(start, end) + flank)
        region = seq[lo - 1:hi] if start <= end else turned(seq[lo - 1:hi])
        best = None
        for n, (strand, x, frame) in enumerate((s, x, f) for s, x in (("+", region), ("-", turned(region))) for f in (1, 2, 3)):
            for k, part in enumerate(peptide(x[frame - 1:]).split("*")):
                if len(part) >= max(30, int(len(ref) * 0.1)):
                    identity, coverage, _, _ = plain_align(ref, part)
                    score = identity / 100 * coverage / 100 * min(len(part) / len(ref), 1.0)
                    found = (-score, -identity, -coverage, -len(part), n, k), frame, part
                    best = min(best or found, found)
        out.append((gene, contig, lo, hi, *((best[1], best[2], round(-best[0][1], 6), round(-best[0][0], 6)) if best else (None,) * 4)))
    return sorted(out)


def test_gene_recovery_equals_plain_code(spark):
    rng = random.Random(21)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    from strandweave.functions.sequence import codons_for

    proteins = [(f"g{i}", "M" + "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(rng.randint(40, 60)))) for i in range(5)]
    contigs, hits = {}, []
    for i, (gene, ref) in enumerate(proteins[:4]):
        cds = "".join(rng.choice(codons_for(a)) for a in ref[:-3]) + "TAA"
        left = dna(rng.randint(20, 90))
        seq = left + cds + dna(rng.randint(0, 80))
        start, end = len(left) + 1, len(left) + len(cds)
        if i % 2:
            seq = seq[::-1].translate(str.maketrans("ACGT", "TGCA"))
            start, end = len(seq) - start + 1, len(seq) - end + 1
        contigs[f"c{i}"] = seq
        hits += [(10 * i, gene, f"c{i}", 50.0, start, end), (10 * i + 1, gene, f"c{i}", 50.0, 1, 30), (10 * i + 2, gene, f"c{(i + 1) % 4}", 20.0, 5, 60)]
    contigs["short"] = "ACGTACGT"
    hits.append((99, "g4", "short", 9.0, 2, 7))
    df = spark.createDataFrame([(*h, 90.0, 1e-9) for h in hits], "hit long, gene string, contig string, bitscore double, sstart int, send int, pident double, evalue double")
    got = orfs.recover_genes(df, spark.createDataFrame(list(contigs.items()), "contig string, seq string"), spark.createDataFrame(proteins, "gene string, seq string"), 30, [F.col("hit")])
    rows = [(r.gene, r.contig, r.region_start, r.region_end, r.frame, r.protein, *(None if v is None else round(v, 6) for v in (r.identity, r.score))) for r in got.collect()]
    assert sorted(rows) == plain_recovery(hits, contigs, proteins, 30)
    assert all(r[6] > 90 for r in sorted(rows)[:4]) and rows and sorted(rows)[4][4] is None


@pytest.mark.parametrize("cells", [3000, 40, 1])
def test_batched_alignment_equals_plain_recursion(monkeypatch, cells):
    import pandas as pd

    rng = random.Random(9)
    pairs = [("".join(rng.choice("KEML") for _ in range(rng.randint(1, 25))), "".join(rng.choice("KEML") for _ in range(rng.randint(1, 30)))) for _ in range(120)]
    pairs += [("K", "E"), ("", "K"), ("KEML", "")]
    monkeypatch.setattr(orfs, "BATCH_CELLS", cells)
    got = orfs._align_series(pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs]), "standard")
    for (a, b), r in zip(pairs, got.itertuples(index=False)):
        assert tuple(r) == pytest.approx(plain_align(a, b) if a and b else (0, 0, 0, 0))


def test_alignment_of_long_sequences_in_bounded_memory(monkeypatch):
    """600 x 200,000 letters would be 480 MB of scores."""
    import tracemalloc

    rng = random.Random(3)
    gene = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(600))
    query = "B" * 120_000 + gene[:300] + "B" + gene[301:550] + "B" * 79_500
    monkeypatch.setattr(orfs, "BATCH_CELLS", 2_000_000)
    tracemalloc.start()
    got = orfs.align_batch([gene], [query])[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == pytest.approx((100 * 549 / 550, 100 * 550 / 600, 550, 548))
    assert peak < 60_000_000


def test_best_orf_finds_planted_gene(spark):
    from strandweave.functions.sequence import CODE, reverse_complement

    back = {}
    for c, a in CODE.items():
        back.setdefault(a, c)
    protein = "MKLEDWHRTYVNQPSGAICFMKLEDWHRTYVNQPSG"
    contig = "A" + "".join(back[a] for a in protein) + "TAACC"
    df = spark.createDataFrame([("g", contig, protein)], "gene string, seq string, ref string").withColumn("seq", reverse_complement("seq"))
    r = orfs.best_orfs(df, ["gene"], "seq", "ref").first()
    assert (r.orientation, r.frame, r.identity, r.coverage) == ("rev", 2, 100.0, 100.0) and protein in r.protein


def test_four_quadrants_of_the_gap_facing_segment(spark):
    seq = "AAAAACCCCCGGGGGTTTTT"
    rows = [("N", 6, 11), ("N", 11, 6), ("C", 6, 11), ("C", 11, 6), ("N", 1, 20)]
    df = spark.createDataFrame([(seq, *r) for r in rows], "seq string, side string, sstart int, send int")
    got = [r.g.asDict() for r in df.select(tl.gap_facing().alias("g")).collect()]
    assert [(g["nt_start"], g["nt_end"], g["segment"]) for g in got] == [
        (12, 20, "GGGGTTTTT"), (1, 5, "TTTTT"), (1, 5, "AAAAA"), (12, 20, "AAAAACCCC"), (None, None, "")]


def test_extension_walks_outward_and_ascends(spark):
    seq = "ATGAAAGAACTGTGG" + "CC"  # M K E L W
    rows = [("N", 10, 10, 1, 3), ("C", 14, 14, 13, 15)]
    df = spark.createDataFrame([(seq, *r) for r in rows], "seq string, side string, qstart int, qend int, sstart int, send int")
    n, c = (r.extension for r in tl.extend_into_gap(df, 12, 20).collect())
    assert [(x.position, x.aa) for x in n] == [(12, "E"), (13, "L"), (14, "W")]
    assert [(x.position, x.aa) for x in c] == [(12, "E"), (13, "L")]


def test_evidence_grades(spark):
    ext = lambda good, bad: [(i, "AAA", "K") for i in range(1, good + 1)] + [(good + j, "GAA", "E") for j in range(1, bad + 1)]
    rows = [("x" * 40, ext(10, 10)), ("x" * 40, ext(10, 11)), ("x" * 40, ext(6, 14)), ("x" * 40, ext(5, 0)), ("x" * 29, ext(10, 0)), ("x" * 40, [])]
    df = spark.createDataFrame(rows, "segment string, extension array<struct<position:int,codon:string,aa:string>>").withColumn("ref", F.lit("K" * 40))
    assert [r.evidence_class for r in tl.evidence_class(df, "ref").collect()] == ["A", "B", "B", "C", "D", "D"]


def test_conflict_rules_keep_their_order(spark):
    base = ("K", "E", 10, 12, 10, 12)
    rows = [("a", "AAAGAACTG", "AAAGAACTG"), ("b", "AAAGAACT", "GAAGAACTG"), ("c", "AAAGAACTG", "GAAGAACTG"), ("d", "CTGGAACTG", "GAAGAACTG"), ("e", None, "GAAGAACTG")]
    df = spark.createDataFrame([(i, 10, *base[:2], n, base[2], base[3], c, base[4], base[5]) for i, n, c in rows],
                               "id string, position int, aa_n string, aa_c string, segment_n string, start_n int, end_n int, segment_c string, start_c int, end_c int")
    got = {r.id: r.conflict_class for r in au.conflict_audit(df).collect()}
    assert got == {"a": "nucleotide_identical_translation_discrepancy", "b": "frame_inconsistent_tail", "c": "low_complexity_Lys_Glu_region",
                   "d": "nonsynonymous_nucleotide_difference", "e": "unresolved_missing_nt"}


def test_base_evidence_notes(spark):
    rows = [("R1", "ATGAAA", "IIIIII", 1, 1, 6, 2), ("R1", "ATGAAA", "IIIIII", 1, 1, 6, 9), ("R3", "ATGAAA", "IIIIII", 1, 1, 6, 2), ("R2", None, None, 1, 1, 6, 2),
            ("R2", "ATGAAA", "IIIIII", None, 1, 6, 2), ("R2", "TTTCAT", "!\"#$%&", 1, 6, 1, 1)]
    df = spark.createDataFrame(rows, "mate string, seq string, qual string, qstart int, sstart int, send int, target_position int")
    got = au.base_evidence(df).collect()
    assert [r.note for r in got] == ["", "codon_off_read", "mate_unknown", "read_missing", "coordinates_missing", ""]
    assert (got[0].codon, got[0].translated_aa, got[0].codon_min_qual) == ("AAA", "K", 40)
    assert (got[5].codon, got[5].translated_aa, got[5].codon_qual_pos1, got[5].codon_qual_pos3, got[5].hsp_strand) == ("ATG", "M", 5, 3, "reverse")


def test_pair_consolidation(spark):
    rows = [("p", "N", "A", 5, 9), ("p", "C", "A", 8, 20), ("q", "N", "D", None, None), ("q", "C", "A", 4, 6), ("r", "N", "D", None, None), ("r", "C", "D", None, None)]
    df = spark.createDataFrame(rows, "pair_id string, role string, evidence_class string, gap_position_start int, gap_position_end int")
    got = {r.pair_id: r for r in consolidate(merge_roles(df, ["evidence_class", "gap_position_start", "gap_position_end"]), 5, 20).collect()}
    assert (got["p"].pair_class, got["p"].pair_gap_span_aa, got["p"].full_gap) == ("A/A", 16, True)
    assert (got["q"].pair_class, got["q"].full_gap, got["r"].pair_class) == ("A/other", False, "D/D")


def test_gates(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    with pytest.raises(checks.SchemaMismatch):
        checks.require_columns(df, ["a", "c"])
    with pytest.raises(Exception, match="must hold"):
        checks.enforce(df, F.col("a") > 1, "must hold").collect()
    assert checks.enforce(df, F.col("a") > 0, "must hold").count() == 1


def test_pilot_and_sample_take_exactly_n_rows(spark):
    keys = [None, None, *[k * k for k in range(300)], *[7] * 50]
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    want = sorted(((k, i) for i, k in enumerate(keys)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    for n in (1, 2, 3, 40, 352, 400):
        got = {tuple(r) for r in ranking.first_rows(df, "k", n, ["i"]).collect()}
        assert got == set(want[:n]), n
    by_hash = sorted(range(len(keys)), key=lambda i: hashlib.md5(f"3|{i}".encode()).hexdigest())
    for n in (1, 100, 1000):
        assert {r["i"] for r in ranking.hash_sample(df, "i", n, seed=3).collect()} == set(by_hash[:n]), n
    assert ranking.first_rows(df.limit(0), "k", 5).collect() == []


# ------------------------------------------------------------------ measured joins and gates


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_measured_join_either_way(spark, how):
    from strandweave.operators.joins import measured_join

    many = spark.createDataFrame([(i % 3 if i % 2 else 0, i, None if i % 5 else "x") for i in range(60)] + [(None, 99, "n")], "k int, v int, s string")
    few = spark.createDataFrame([(0, "a"), (2, "c"), (7, "z")], "k int, name string")
    want = sorted(map(repr, many.join(few, "k", how).collect()))
    for most in (10, 2):
        got = measured_join(many, few, ["k"], how, most=most, parts=4)
        assert sorted(map(repr, got.collect())) == want
    assert "Exchange hashpartitioning" not in plan_of(measured_join(many, few, ["k"], how))


def test_measured_join_deals_a_hot_key(spark):
    from strandweave.operators.joins import measured_join

    hot = spark.range(4000).select(F.lit(1).alias("k"), "id")
    few = spark.range(50).select(F.col("id").cast("int").alias("k"), F.col("id").alias("w"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = measured_join(hot, few, ["k"], most=10, parts=8).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in out) == 4000 and max(r["count"] for r in out) < 3000


def test_share_of_all_rows_needs_no_single_partition(spark):
    from strandweave.operators.ranking import share_of_total

    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n long")
    out = share_of_total(df, "n")
    assert {r["k"]: r["percent"] for r in out.collect()} == {"a": 25.0, "b": 75.0}
    assert "Window" not in plan_of(out)


def test_gates_stop(spark):
    from strandweave.operators import checks

    df = spark.createDataFrame([("AAA", "K", "g1", "KML"), ("CTG", "L", "g2", "KVL"), ("TTT", "L", "g3", "MML")], "codon string, aa string, gene string, seq string")
    assert checks.require_translation(df.limit(2), "codon", "aa").count() == 2
    with pytest.raises(Exception, match="codon TTT stored with residue L"):
        checks.require_translation(df, "codon", "aa").collect()
    with pytest.raises(Exception, match="reference lock fails for g3"):
        checks.locked_references(df, "seq", {1: "K"}, "gene").collect()
    assert checks.require_reference("KML", {1: "K", 3: "L"}) == "KML"
    with pytest.raises(checks.ReferenceMismatch, match="2: M for V, 9: none for L"):
        checks.require_reference("KML", {1: "K", 2: "V", 9: "L"})


def test_observed_gate_counts_without_another_scan(spark, tmp_path):
    from strandweave.operators.checks import Gate, GateFailed

    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, v int")
    gate = Gate("values")
    watched = gate.watch(df, small=F.col("v") < 100)
    watched.write.parquet(str(tmp_path / "out"))
    with pytest.raises(GateFailed, match="1 of 3 rows break small"):
        gate.require()
    gate = Gate("more")
    gate.watch(df.where("v is not null"), small=F.col("v") < 100).write.parquet(str(tmp_path / "two"))
    assert gate.require() == {"rows": 2, "small": 0}


def test_pairing_gate(spark):
    from strandweave.operators.checks import GateFailed, require_pairing

    rows = [(1, "p", "R1"), (1, "p", "R2"), (2, "q", "R1"), (2, "r", "R2"), (3, "s", "R1")]
    df = spark.createDataFrame(rows, "read_index long, pair_id string, mate string")
    require_pairing(df.where("read_index = 1"))
    with pytest.raises(GateFailed, match="1 rows with two ids and 1 with one side, of 3"):
        require_pairing(df)


def test_overlap_calls_equal_joined_tails(spark):
    """Positions from the pivoted pair, against tails attached to listed positions and against plain slices."""
    tails = [("p1", "N", "AAACCC", 5, 8, "KEML"), ("p1", "C", "CCC", 7, 10, "MLKE"), ("p2", "N", "AAA", 1, 3, "KEM"), ("p3", "N", "AAA", 1, 3, "KEM"), ("p3", "C", "AAA", 4, 6, "KEM"),
             ("p4", "N", "A", 2, 4, "K"), ("p4", "C", None, 2, 3, None)]
    df = spark.createDataFrame(tails, "pair_id string, role string, segment string, gap_position_start int, gap_position_end int, translated_candidate string")
    out = au.overlap_calls(df)
    got = sorted((r.pair_id, r.position, r.aa_n, r.aa_c) for r in out.collect())
    assert got == [("p1", 7, "M", "M"), ("p1", 8, "L", "L"), ("p4", 2, "K", None), ("p4", 3, "", None)]
    again = au.attach_tails(out.select("pair_id", "position", "aa_n", "aa_c"), df)
    assert sorted(map(str, again.select(out.columns).collect())) == sorted(map(str, out.collect()))
    assert out._jdf.queryExecution().executedPlan().toString().count("Join") == 0
