"""Consensus, concordance, alleles, haplotypes, class counts, accounting and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.reads import haplotype_aa, variant_class
from ..operators import alleles as al
from ..operators import consensus as cs
from ..operators import haplotypes as hp
from ..operators import summaries as sm
from ..operators.checks import pairing_report, translation_consistency
from ..operators.intervals import families
from ..operators.pairs import concordance_rate, merge_roles, pair_calls, role_problems
from ..operators.reshape import pivot_positions, spine, with_levels
from .adapters import EVIDENCE, EVIDENCE_TIES, OBS, POS_A, POS_B, READS, TIES_SQL, evidence, observations, reads, sql_codon, table
from .registry import query

P = (POS_A, POS_B)

# ------------------------------------------------------------------ consensus

CONS = f"""{OBS}, pc AS (SELECT position, aa, count(*) AS n FROM obs GROUP BY ALL),
cons AS (SELECT position, sum(n) AS depth, count(*) AS uniq, (array_agg(aa ORDER BY n DESC, aa))[1] AS dominant_aa, max(n) AS dom,
  string_agg(aa, '/' ORDER BY aa) AS observed FROM pc GROUP BY position),
cls AS (SELECT *, round(dom / depth, 4) AS freq, round(dom / depth * 100, 1) AS pct, depth - dom AS bad FROM cons)"""


def cons(s, d):
    return cs.consensus(cs.residue_counts(observations(s, d), ["position"]), ["position"])


@query("d18_positional_consensus", "position i, coverage_depth i, unique_aa_count i, dominant_aa s, dominant_count i, dominant_frequency d4, concordance_pct d1, all_observed_aa s",
       f"""WITH {CONS} SELECT position, depth AS coverage_depth, uniq AS unique_aa_count, dominant_aa, dom AS dominant_count, freq AS dominant_frequency,
       pct AS concordance_pct, observed AS all_observed_aa FROM cls""")
def d18(s, d):
    return cons(s, d)


BAND = "CASE WHEN pct = 100 THEN '100%' WHEN pct >= 95 THEN '>=95%' WHEN pct >= 90 THEN '90-94.9%' WHEN pct >= 75 THEN '75-89.9%' ELSE '<75%' END"


@query("d19_concordance_classes", "position i, discordant_count i, discordance_pct d1, concordance_class s",
       f"WITH {CONS} SELECT position, bad AS discordant_count, round(bad / depth * 100, 1) AS discordance_pct, {BAND} AS concordance_class FROM cls")
def d19(s, d):
    return cs.classify_concordance(cons(s, d))


@query("d20_within_pair_concordance", "pair_id i, positions_observed i, concordant_positions i, discordant_positions i, pair_concordance_pct d1",
       f"""WITH {OBS}, pp AS (SELECT pair_id, position, count(DISTINCT aa) = 1 AS one FROM obs GROUP BY ALL)
       SELECT pair_id, count(*) AS positions_observed, count(*) FILTER (WHERE one) AS concordant_positions, count(*) FILTER (WHERE NOT one) AS discordant_positions,
       round(count(*) FILTER (WHERE one) / count(*) * 100, 1) AS pair_concordance_pct FROM pp GROUP BY pair_id""")
def d20(s, d):
    return cs.within_pair(observations(s, d), "pair_id", "position")


def _against(key):
    return f"""WITH {CONS} SELECT {key}, count(*) AS positions_observed, count(*) FILTER (WHERE aa = dominant_aa) AS concordant_positions,
    count(*) FILTER (WHERE aa <> dominant_aa) AS discordant_positions, round(count(*) FILTER (WHERE aa = dominant_aa) / count(*) * 100, 1) AS pair_concordance_pct
    FROM obs LEFT JOIN cons USING (position) GROUP BY {key}"""


@query("d21_pair_vs_consensus", "pair_id i, positions_observed i, concordant_positions i, discordant_positions i, pair_concordance_pct d1", _against("pair_id"))
def d21(s, d):
    return cs.against_consensus(observations(s, d), cons(s, d), ["pair_id"], "position")


@query("d22_flank_vs_consensus", "role s, positions_observed i, concordant_positions i, discordant_positions i, pair_concordance_pct d1", _against("role"))
def d22(s, d):
    return cs.against_consensus(observations(s, d), cons(s, d), ["role"], "position")


@query("d23_coverage_rollup", "positions_covered i, positions_missing i, mean_depth d, positions_ge_90 i, positions_100 i, variable_positions i",
       f"""WITH {CONS}, sp AS (SELECT unnest(range(640, 741)) AS position)
       SELECT count(depth) AS positions_covered, count(*) - count(depth) AS positions_missing, avg(depth) AS mean_depth, count(*) FILTER (WHERE pct >= 90) AS positions_ge_90,
       count(*) FILTER (WHERE pct = 100) AS positions_100, count(*) FILTER (WHERE uniq > 1) AS variable_positions FROM sp LEFT JOIN cls USING (position)""")
def d23(s, d):
    sp = spine(s.range(1), [], F.lit(640), F.lit(740))
    return cs.coverage_rollup(sp.join(cons(s, d), "position", "left"))


@query("d24_consensus_string", "consensus s, n_positions i",
       f"WITH {CONS} SELECT string_agg(dominant_aa, '' ORDER BY position) AS consensus, count(*) AS n_positions FROM cons")
def d24(s, d):
    return cs.consensus_string(cons(s, d), "position")


@query("b20_variable_positions", "position i, unique_aa_count i, kind s",
       f"WITH {CONS} SELECT position, uniq AS unique_aa_count, CASE WHEN uniq > 1 THEN 'variable' ELSE 'invariant' END AS kind FROM cls WHERE uniq > 1 OR pct = 100")
def b20(s, d):
    c = cons(s, d).filter((F.col("unique_aa_count") > 1) | (F.col("concordance_pct") == 100))
    return c.withColumn("kind", F.when(F.col("unique_aa_count") > 1, "variable").otherwise("invariant"))


@query("g7_pivot_wider", "pair_id i, pos_649 s, pos_650 s, pos_700 s, pos_732 s",
       f"""WITH {OBS} SELECT pair_id, {', '.join(f"coalesce(min_by(aa, ord) FILTER (WHERE position = {p}), '-') AS pos_{p}" for p in (649, 650, 700, 732))} FROM obs GROUP BY pair_id""")
def g7(s, d):
    w = pivot_positions(observations(s, d), ["pair_id"], "position", "aa", [649, 650, 700, 732], order="ord")
    return w.fillna("-")


# ------------------------------------------------------------------ pair resolution

RES = f"""{OBS}, rs AS (SELECT pair_id, position, bool_or(role = 'N') AS has_n, bool_or(role = 'C') AS has_c, min_by(aa, ord) FILTER (WHERE role = 'N') AS aa_n,
  min_by(aa, ord) FILTER (WHERE role = 'C') AS aa_c FROM obs GROUP BY ALL),
res AS (SELECT *, CASE WHEN has_n AND NOT has_c THEN 'N_only' WHEN has_c AND NOT has_n THEN 'C_only' WHEN aa_n = aa_c THEN 'NC_concordant' ELSE 'NC_conflict' END AS status FROM rs)"""
STAT = ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x.lower()}_count" for x in cs.STATUSES)


def resolved(s, d):
    return cs.resolve_pairs(observations(s, d), "pair_id", "position", F.col("ord"))


@query("d25_pair_position_resolution", "pair_id i, position i, has_n b, has_c b, aa_n s, aa_c s, status s", f"WITH {RES} SELECT * FROM res")
def d25(s, d):
    return resolved(s, d)


@query("d26_conflict_list", "pair_id i, position i, aa_n s, aa_c s", f"WITH {RES} SELECT * FROM res WHERE status = 'NC_conflict'")
def d26(s, d):
    return cs.conflicts(resolved(s, d))


@query("d27_pair_weighted_consensus",
       "position i, pair_depth i, n_only_count i, c_only_count i, nc_concordant_count i, nc_conflict_count i, unique_aa_count i, dominant_aa s, dominant_pair_count d1, total_weight d1, all_observed_aa s, pair_concordance_pct d1, discordant_pair_count d1, discordance_pct d1",
       f"""WITH {RES}, v AS (SELECT position, aa_n AS aa, 0.5 AS w FROM res WHERE status = 'NC_conflict' UNION ALL SELECT position, aa_c, 0.5 FROM res WHERE status = 'NC_conflict'
         UNION ALL SELECT position, coalesce(aa_n, aa_c), 1.0 FROM res WHERE status <> 'NC_conflict'),
       pc AS (SELECT position, aa, CAST(sum(w) AS DOUBLE) AS n FROM v GROUP BY ALL),
       c AS (SELECT position, count(*) AS unique_aa_count, (array_agg(aa ORDER BY n DESC, aa))[1] AS dominant_aa, max(n) AS dominant_pair_count, sum(n) AS total_weight,
         string_agg(aa, '/' ORDER BY aa) AS all_observed_aa FROM pc GROUP BY position),
       st AS (SELECT position, count(*) AS pair_depth, {STAT} FROM res GROUP BY position)
       SELECT *, round(dominant_pair_count / total_weight * 100, 1) AS pair_concordance_pct, total_weight - dominant_pair_count AS discordant_pair_count,
       round((total_weight - dominant_pair_count) / total_weight * 100, 1) AS discordance_pct FROM st JOIN c USING (position)""")
def d27(s, d):
    return cs.weighted_consensus(resolved(s, d), "position")


@query("d28_status_breakdown", "pair_id i, positions_observed i, n_only_count i, c_only_count i, nc_concordant_count i, nc_conflict_count i, internal_concordance_pct d1",
       f"""WITH {RES}, st AS (SELECT pair_id, count(*) AS positions_observed, {STAT} FROM res GROUP BY pair_id)
       SELECT *, coalesce(round(nc_concordant_count / nullif(nc_concordant_count + nc_conflict_count, 0) * 100, 1), -1) AS internal_concordance_pct FROM st""")
def d28(s, d):
    return cs.internal_concordance(resolved(s, d), "pair_id").fillna({"internal_concordance_pct": -1.0})


@query("d42_conflicts_per_position", "position i, n i, n_residues s, c_residues s",
       f"""WITH {RES} SELECT position, count(*) AS n, array_to_string(list_sort(list(DISTINCT aa_n)), '/') AS n_residues,
       array_to_string(list_sort(list(DISTINCT aa_c)), '/') AS c_residues FROM res WHERE status = 'NC_conflict' GROUP BY position""")
def d42(s, d):
    return sm.value_lists(cs.conflicts(resolved(s, d)), ["position"], {"aa_n": "n_residues", "aa_c": "c_residues"})


@query("d41_residue_pair_counts", "aa_n s, aa_c s, n i", f"WITH {RES} SELECT aa_n, aa_c, count(*) AS n FROM res WHERE status = 'NC_conflict' GROUP BY ALL")
def d41(s, d):
    return cs.conflicts(resolved(s, d)).groupBy("aa_n", "aa_c").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("d39_class_counts_with_percentage", "status s, n i, percent d1",
       f"WITH {RES} SELECT status, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM res GROUP BY status")
def d39(s, d):
    return sm.class_counts(resolved(s, d), ["status"])


@query("d40_global_conditional_sums", "conflicts i, lysine_n i, glutamate_c i, both_roles i",
       f"""WITH {RES} SELECT count(*) FILTER (WHERE status = 'NC_conflict') AS conflicts, count(*) FILTER (WHERE aa_n = 'K') AS lysine_n,
       count(*) FILTER (WHERE aa_c = 'E') AS glutamate_c, count(*) FILTER (WHERE has_n AND has_c) AS both_roles FROM res""")
def d40(s, d):
    return sm.conditional_sums(resolved(s, d), {
        "conflicts": F.col("status") == "NC_conflict", "lysine_n": F.col("aa_n") == "K", "glutamate_c": F.col("aa_c") == "E",
        "both_roles": F.col("has_n") & F.col("has_c")})


@query("c3_role_halves_left_join", "pair_id i, position i, n_rows i, c_rows i",
       f"""WITH {RES}, k AS (SELECT pair_id, role, count(*) AS n FROM obs GROUP BY ALL)
       SELECT res.pair_id, position, coalesce(a.n, 0) AS n_rows, coalesce(b.n, 0) AS c_rows FROM res LEFT JOIN k a ON a.pair_id = res.pair_id AND a.role = 'N'
       LEFT JOIN k b ON b.pair_id = res.pair_id AND b.role = 'C' WHERE status = 'NC_conflict'""")
def c3(s, d):
    obs = observations(s, d)
    wide = obs.groupBy("pair_id").agg(F.count_if(F.col("role") == "N").alias("n_rows"), F.count_if(F.col("role") == "C").alias("c_rows"))
    return cs.conflicts(resolved(s, d)).join(wide, "pair_id", "left")


@query("c4_role_outer_merge", "pair_id i, n_position i, n_aa s, c_position i, c_aa s",
       f"""WITH {OBS}, f AS (SELECT pair_id, role, position, aa FROM obs QUALIFY row_number() OVER (PARTITION BY pair_id, role ORDER BY ord) = 1)
       SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.position, -1) AS n_position, a.aa AS n_aa, coalesce(b.position, -1) AS c_position, b.aa AS c_aa
       FROM (SELECT * FROM f WHERE role = 'N') a FULL JOIN (SELECT * FROM f WHERE role = 'C') b ON a.pair_id = b.pair_id""")
def c4(s, d):
    from ..operators.ranking import first_per_group

    f = first_per_group(observations(s, d), ["pair_id", "role"], [F.col("ord")])
    return merge_roles(f, ["position", "aa"]).fillna({"n_position": -1, "c_position": -1})


@query("d45_exactly_one_check", "pair_id i, n_rows i, c_rows i",
       f"""WITH {OBS}, k AS (SELECT pair_id, count(*) FILTER (WHERE role = 'N') AS n_rows, count(*) FILTER (WHERE role = 'C') AS c_rows FROM obs GROUP BY pair_id)
       SELECT * FROM k WHERE n_rows <> 1 OR c_rows <> 1""")
def d45(s, d):
    return role_problems(observations(s, d))


# ------------------------------------------------------------------ alleles

FAM = f"""{EVIDENCE}, fs AS (SELECT DISTINCT target_position, mate, orientation, codon_nt_start AS st FROM ev),
fo AS (SELECT *, CASE WHEN st - lag(st) OVER (PARTITION BY target_position, mate, orientation ORDER BY st) <= 3 THEN 0 ELSE 1 END AS o FROM fs),
fk AS (SELECT *, mate || '_' || orientation || '_F' || CAST(sum(o) OVER (PARTITION BY target_position ORDER BY mate, orientation, st ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fam FROM fo),
evf AS (SELECT ev.*, fam FROM ev JOIN fk ON ev.target_position = fk.target_position AND ev.mate = fk.mate AND ev.orientation = fk.orientation AND codon_nt_start = st),
ok AS (SELECT * FROM evf WHERE note = '' AND aa <> 'X')"""


def with_families(s, d):
    return families(evidence(s, d), ["target_position"], ["mate", "orientation"], "codon_nt_start", 3, name="dup_family")


@query("b6_usable_evidence_filter", "target_position i, usable i",
       f"WITH {EVIDENCE} SELECT target_position, count(*) AS usable FROM ev WHERE note = '' AND aa <> 'X' AND target_position IN ({POS_A}, {POS_B}) GROUP BY ALL")
def b6(s, d):
    return al.usable_evidence(evidence(s, d), list(P)).groupBy("target_position").agg(F.count(F.lit(1)).alias("usable"))


@query("d29_allele_summary", "target_position i, translated_aa s, read_count i, mean_min_phred d2, minimum_min_phred i, independent_families i",
       f"""WITH {FAM} SELECT target_position, aa AS translated_aa, count(*) AS read_count, round(avg(q), 2) AS mean_min_phred, min(q) AS minimum_min_phred,
       count(DISTINCT fam) AS independent_families FROM ok GROUP BY ALL""")
def d29(s, d):
    return al.allele_summary(al.usable_evidence(with_families(s, d)))


@query("d30_position_support", "target_position i, candidates i, usable i, families i, mean_min_phred d2, min_min_phred i",
       f"""WITH {FAM} SELECT target_position, count(*) AS candidates, count(*) FILTER (WHERE note = '') AS usable, count(DISTINCT fam) FILTER (WHERE note = '') AS families,
       round(avg(q) FILTER (WHERE note = ''), 2) AS mean_min_phred, min(q) FILTER (WHERE note = '') AS min_min_phred FROM evf GROUP BY ALL
       UNION ALL SELECT 999, 0, 0, 0, -1, -1""")
def d30(s, d):
    out = al.position_support(with_families(s, d), [*P, 999], F.col("note") == "")
    return out.fillna({"mean_min_phred": -1.0, "min_min_phred": -1})


@query("d31_position_summary",
       "target_position i, total_hits i, unique_read_ids i, unique_reads i, M i, L i, P i, other i, reference_aa s, reference_matches i, pct_reference_aa d, mean_anchor_identity d, median_anchor_identity d, mean_codon_min_qual d, median_codon_min_qual d",
       f"""WITH {EVIDENCE} SELECT target_position, count(*) AS total_hits, count(DISTINCT read_id) AS unique_read_ids, count(DISTINCT (read_id, mate)) AS unique_reads,
       count(*) FILTER (WHERE aa = 'M') AS M, count(*) FILTER (WHERE aa = 'L') AS L, count(*) FILTER (WHERE aa = 'P') AS P, count(*) FILTER (WHERE aa NOT IN ('M', 'L', 'P')) AS other,
       min(expected) AS reference_aa, count(*) FILTER (WHERE aa = expected) AS reference_matches, 100.0 * count(*) FILTER (WHERE aa = expected) / count(*) AS pct_reference_aa,
       avg(anchor_identity) AS mean_anchor_identity, median(anchor_identity) AS median_anchor_identity, avg(q) AS mean_codon_min_qual, median(q) AS median_codon_min_qual
       FROM ev GROUP BY target_position UNION ALL SELECT 999, 0, 0, 0, 0, 0, 0, 0, 'K', 0, -1, -1, -1, -1, -1""")
def d31(s, d):
    return al.position_summary(evidence(s, d), {POS_A: "M", POS_B: "L", 999: "K"}).fillna(-1.0)


@query("d32_allele_contingency", "mate s, target_position i, target_aa s, hit_count i, percent d",
       f"""WITH {EVIDENCE}, c AS (SELECT mate, target_position, aa, count(*) AS n FROM ev GROUP BY ALL),
       g AS (SELECT * FROM (SELECT DISTINCT mate FROM ev), (SELECT DISTINCT target_position FROM ev), (SELECT DISTINCT aa FROM ev))
       SELECT mate, target_position, aa AS target_aa, coalesce(n, 0) AS hit_count, 100.0 * coalesce(n, 0) / sum(n) OVER (PARTITION BY target_position) AS percent
       FROM g LEFT JOIN c USING (mate, target_position, aa)""")
def d32(s, d):
    return al.allele_contingency(evidence(s, d), ["mate", "target_position", "target_aa"], ["target_position"])


@query("d33_allele_counts", "mate s, target_position i, target_aa s, target_codon s, hit_count i, percent d2",
       f"""WITH {EVIDENCE}, c AS (SELECT mate, target_position, aa AS target_aa, codon AS target_codon, count(*) AS hit_count FROM ev GROUP BY ALL)
       SELECT *, round(100.0 * hit_count / sum(hit_count) OVER (PARTITION BY mate, target_position), 2) AS percent FROM c""")
def d33(s, d):
    return al.allele_counts(evidence(s, d), ["mate", "target_position", "target_aa", "target_codon"], ["mate", "target_position"])


@query("d34_families_per_allele", "target_position i, translated_aa s, independent_families i",
       f"WITH {FAM} SELECT target_position, aa AS translated_aa, count(DISTINCT fam) AS independent_families FROM ok GROUP BY ALL")
def d34(s, d):
    return al.families_per_allele(al.usable_evidence(with_families(s, d)))



def ties():
    return [F.col(c) for c in EVIDENCE_TIES]


DEDUP = f"""{EVIDENCE}, dd AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY read_id, mate, target_position, orientation, frame
  ORDER BY CASE WHEN evidence_role = 'PRIMARY' THEN 1 ELSE 2 END, anchor_identity DESC, q DESC, {TIES_SQL}) = 1)"""


def dedup(s, d):
    return al.deduplicate_evidence(evidence(s, d), ties())


@query("e3_evidence_dedup", "read_id s, mate s, target_position i, orientation s, frame i, evidence_role s, anchor_identity d, codon_min_qual i, target_aa s",
       f"WITH {DEDUP} SELECT *, q AS codon_min_qual, aa AS target_aa FROM dd")
def e3(s, d):
    return dedup(s, d)


def _al(m, p):
    return f"string_agg(aa, '/' ORDER BY o, aa) FILTER (WHERE mate = '{m}' AND target_position = {p})"


def _st(p):
    a, b = f"r1_{p}", f"r2_{p}"
    return (f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 'NO_POSITIONAL_EVIDENCE' WHEN {a} IS NULL THEN 'R2_ONLY_POSITIONAL_EVIDENCE' WHEN {b} IS NULL THEN "
            f"'R1_ONLY_POSITIONAL_EVIDENCE' WHEN {a} = {b} THEN 'BOTH_MATES_CONCORDANT' ELSE 'BOTH_MATES_DISCORDANT' END")


CALLS = f"""{DEDUP}, fa AS (SELECT pair_id, mate, target_position, aa, min(orientation || frame) AS o FROM dd GROUP BY ALL),
w AS (SELECT pair_id, {', '.join(f"{_al(m, p)} AS {m.lower()}_{p}" for p in P for m in ('R1', 'R2'))} FROM fa GROUP BY pair_id),
calls AS (SELECT *, {', '.join(f"{_st(p)} AS paired_{p}_status" for p in P)} FROM w)"""


def calls(s, d):
    return pair_calls(dedup(s, d), list(P), F.concat("orientation", F.col("frame").cast("string")))


@query("d49_mate_call_concordance", f"pair_id s, r1_{POS_A} s, r2_{POS_A} s, r1_{POS_B} s, r2_{POS_B} s, paired_{POS_A}_status s, paired_{POS_B}_status s", f"WITH {CALLS} SELECT * FROM calls")
def d49(s, d):
    return calls(s, d)


@query("d50_concordance_rate", "target_position i, concordant i, discordant i, r1_only i, r2_only i, concordance_rate_pct d1",
       f"""WITH {CALLS}, l AS (SELECT {POS_A} AS target_position, paired_{POS_A}_status AS st FROM calls UNION ALL SELECT {POS_B}, paired_{POS_B}_status FROM calls),
       k AS (SELECT target_position, count(*) FILTER (WHERE st = 'BOTH_MATES_CONCORDANT') AS concordant, count(*) FILTER (WHERE st = 'BOTH_MATES_DISCORDANT') AS discordant,
         count(*) FILTER (WHERE st = 'R1_ONLY_POSITIONAL_EVIDENCE') AS r1_only, count(*) FILTER (WHERE st = 'R2_ONLY_POSITIONAL_EVIDENCE') AS r2_only FROM l GROUP BY ALL)
       SELECT *, round(100.0 * concordant / (concordant + discordant), 1) AS concordance_rate_pct FROM k""")
def d50(s, d):
    return concordance_rate(calls(s, d), list(P))


@query("d51_pair_audit", "batch_id i, n_candidate_pairs i, n_r1_candidate_pairs i, n_r2_candidate_pairs i, n_r1_with_r2_mate i, n_r2_with_r1_mate i, n_partner_records i, n_partner_pairs i",
       f"""WITH {EVIDENCE}, p AS (SELECT batch_id, pair_id, bool_or(mate = 'R1' AND any_candidate) AS c1, bool_or(mate = 'R2' AND any_candidate) AS c2,
         bool_or(mate = 'R1') AS h1, bool_or(mate = 'R2') AS h2 FROM ev GROUP BY ALL),
       a AS (SELECT batch_id, count(*) FILTER (WHERE c1 OR c2) AS n_candidate_pairs, count(*) FILTER (WHERE c1) AS n_r1_candidate_pairs, count(*) FILTER (WHERE c2) AS n_r2_candidate_pairs,
         count(*) FILTER (WHERE c1 AND h2) AS n_r1_with_r2_mate, count(*) FILTER (WHERE c2 AND h1) AS n_r2_with_r1_mate FROM p GROUP BY batch_id),
       b AS (SELECT batch_id, count(*) AS n_partner_records, count(DISTINCT pair_id) AS n_partner_pairs FROM ev WHERE evidence_role = 'PAIRED_PARTNER' GROUP BY batch_id)
       SELECT * FROM a JOIN b USING (batch_id)""")
def d51(s, d):
    e = evidence(s, d)
    return al.pair_audit(e, e.filter(F.col("evidence_role") == "PAIRED_PARTNER"))


@query("c15_candidate_accounting", "read_id s, mate s, pair_id s, n_positions i, positions_detected s",
       f"""WITH {EVIDENCE}, c AS (SELECT DISTINCT read_id, mate, pair_id FROM ev WHERE any_candidate), u AS (SELECT DISTINCT read_id, mate, pair_id, target_position FROM ev WHERE note = '' AND q >= 20),
       k AS (SELECT read_id, mate, pair_id, count(*) AS n_positions, string_agg(CAST(target_position AS VARCHAR), ',' ORDER BY target_position) AS positions_detected FROM u GROUP BY ALL)
       SELECT read_id, mate, pair_id, coalesce(n_positions, 0) AS n_positions, coalesce(positions_detected, '') AS positions_detected FROM c LEFT JOIN k USING (read_id, mate, pair_id)""")
def c15(s, d):
    e = evidence(s, d)
    return al.candidate_accounting(e.filter("any_candidate"), e.filter((F.col("note") == "") & (F.col("codon_min_qual") >= 20)))


@query("c16_result_set_comparison", "old_keys i, new_keys i, overlap i, missing_from_new i, new_only i, recovery_pct d",
       f"""WITH {EVIDENCE}, o AS (SELECT DISTINCT read_id, mate, target_position FROM ev WHERE evidence_role = 'PRIMARY'), n AS (SELECT DISTINCT read_id, mate, target_position FROM ev WHERE q >= 15),
       x AS (SELECT (SELECT count(*) FROM o) AS old_keys, (SELECT count(*) FROM n) AS new_keys, (SELECT count(*) FROM (SELECT * FROM o INTERSECT SELECT * FROM n)) AS overlap)
       SELECT *, old_keys - overlap AS missing_from_new, new_keys - overlap AS new_only, 100.0 * overlap / old_keys AS recovery_pct FROM x""")
def c16(s, d):
    e = evidence(s, d)
    return al.compare_key_sets(e.filter(F.col("evidence_role") == "PRIMARY"), e.filter(F.col("codon_min_qual") >= 15), ["read_id", "mate", "target_position"])


# ------------------------------------------------------------------ haplotypes

A, B = POS_A, POS_B
PHASED = f"""{FAM}, bs AS (SELECT * FROM ok QUALIFY row_number() OVER (PARTITION BY pair_id, target_position ORDER BY q DESC, {TIES_SQL}) = 1),
ph AS (SELECT a.pair_id, a.codon AS codon_{A}, a.aa AS aa_{A}, a.q AS qmin_{A}, a.qmean AS qmean_{A}, a.fam AS family_{A},
  b.codon AS codon_{B}, b.aa AS aa_{B}, b.q AS qmin_{B}, b.qmean AS qmean_{B}, b.fam AS family_{B},
  a.aa || '{A}-' || b.aa || '{B}' AS haplotype_aa, a.codon || '-' || b.codon AS haplotype_codon, least(a.q, b.q) AS qboth, round((a.qmean + b.qmean) / 2, 2) AS mboth
  FROM bs a JOIN bs b ON a.pair_id = b.pair_id AND a.target_position = {A} AND b.target_position = {B})"""


def phased(s, d):
    return hp.phase_pairs(al.usable_evidence(with_families(s, d)), P, ties())


@query("c13_phasing_self_join", f"pair_id s, codon_{A} s, aa_{A} s, qmin_{A} i, codon_{B} s, aa_{B} s, qmin_{B} i, family_{A} s, family_{B} s, haplotype_aa s, haplotype_codon s, min_phred_both i, mean_phred_both d2",
       f"WITH {PHASED} SELECT *, qboth AS min_phred_both, mboth AS mean_phred_both FROM ph")
def c13(s, d):
    return phased(s, d)


@query("c14_single_read_phasing", f"read_id s, mate s, pair_id s, aa_{A} s, aa_{B} s, haplotype_aa s, haplotype_codon s",
       f"""WITH {DEDUP}, f AS (SELECT * FROM dd QUALIFY row_number() OVER (PARTITION BY read_id, mate, pair_id, target_position ORDER BY orientation, frame) = 1)
       SELECT a.read_id, a.mate, a.pair_id, a.aa AS aa_{A}, b.aa AS aa_{B}, a.aa || '{A}-' || b.aa || '{B}' AS haplotype_aa, a.codon || '-' || b.codon AS haplotype_codon
       FROM f a JOIN f b ON a.read_id = b.read_id AND a.mate = b.mate AND a.target_position = {A} AND b.target_position = {B}""")
def c14(s, d):
    return hp.phase_reads(dedup(s, d), P, [F.col("orientation"), F.col("frame")])


@query("c14_single_read_phasing_exact", "haplotype_aa s, n i",
       f"""WITH {DEDUP}, k AS (SELECT read_id, mate, count(*) FILTER (WHERE target_position = {A}) AS na, count(*) FILTER (WHERE target_position = {B}) AS nb,
         max(aa) FILTER (WHERE target_position = {A}) AS xa, max(aa) FILTER (WHERE target_position = {B}) AS xb FROM dd GROUP BY ALL)
       SELECT xa || '{A}-' || xb || '{B}' AS haplotype_aa, count(*) AS n FROM k WHERE na = 1 AND nb = 1 GROUP BY ALL""")
def c14b(s, d):
    r = hp.phase_reads(dedup(s, d), P, [F.col("orientation"), F.col("frame")], exactly_one=True)
    return r.groupBy("haplotype_aa").agg(F.count(F.lit(1)).alias("n"))


@query("d35_haplotype_summary", "haplotype_aa s, haplotype_codon s, pair_count i, mean_qmin_both d2, min_qmin_both i, max_qmin_both i, percent d1",
       f"""WITH {PHASED} SELECT haplotype_aa, haplotype_codon, count(*) AS pair_count, round(avg(qboth), 2) AS mean_qmin_both, min(qboth) AS min_qmin_both, max(qboth) AS max_qmin_both,
       round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM ph GROUP BY ALL""")
def d35(s, d):
    return hp.haplotype_summary(phased(s, d))


@query("c19_summary_quality_merge", "haplotype_aa s, pair_count i, mean_q d, min_q i",
       f"WITH {PHASED} SELECT haplotype_aa, count(*) AS pair_count, avg(qboth) AS mean_q, min(qboth) AS min_q FROM ph GROUP BY haplotype_aa")
def c19(s, d):
    return phased(s, d).groupBy("haplotype_aa").agg(
        F.count(F.lit(1)).alias("pair_count"), F.avg("min_phred_both").alias("mean_q"), F.min("min_phred_both").alias("min_q"))


THR = "(SELECT unnest([0, 10, 15, 20, 25, 30]) AS threshold)"


@query("d36_quality_stratification",
       "threshold i, pairs_remaining i, site_a_major i, site_a_other i, site_b_major i, site_b_minor i, site_b_other i, joint_major i, joint_alternative i, pct_site_a_major d1, pct_site_b_major d1, pct_joint_major d1, pct_joint_alternative d1",
       f"""WITH {PHASED}, k AS (SELECT threshold, count(pair_id) AS pairs_remaining, count(*) FILTER (WHERE aa_{A} = 'M') AS site_a_major, count(*) FILTER (WHERE aa_{A} <> 'M') AS site_a_other,
         count(*) FILTER (WHERE aa_{B} = 'L') AS site_b_major, count(*) FILTER (WHERE aa_{B} = 'P') AS site_b_minor, count(*) FILTER (WHERE aa_{B} NOT IN ('L', 'P')) AS site_b_other,
         count(*) FILTER (WHERE haplotype_aa = 'M{A}-L{B}') AS joint_major, count(*) FILTER (WHERE haplotype_aa <> 'M{A}-L{B}') AS joint_alternative
         FROM {THR} t LEFT JOIN ph ON qboth >= threshold GROUP BY threshold)
       SELECT *, coalesce(round(100.0 * site_a_major / nullif(pairs_remaining, 0), 1), 0) AS pct_site_a_major, coalesce(round(100.0 * site_b_major / nullif(pairs_remaining, 0), 1), 0) AS pct_site_b_major,
       coalesce(round(100.0 * joint_major / nullif(pairs_remaining, 0), 1), 0) AS pct_joint_major, coalesce(round(100.0 * joint_alternative / nullif(pairs_remaining, 0), 1), 0) AS pct_joint_alternative FROM k""")
def d36(s, d):
    return hp.quality_stratification(phased(s, d), P, ("M", "L"), "P")


@query("c11_threshold_join", "threshold i, total_hits i, hits_a i, hits_b i",
       f"""WITH {EVIDENCE} SELECT threshold, count(pair_id) AS total_hits, count(*) FILTER (WHERE target_position = {A}) AS hits_a, count(*) FILTER (WHERE target_position = {B}) AS hits_b
       FROM (SELECT unnest([0, 10, 20, 30, 99]) AS threshold) t LEFT JOIN ev ON q >= threshold GROUP BY threshold""")
def c11(s, d):
    return hp.by_threshold(evidence(s, d), "codon_min_qual", [0, 10, 20, 30, 99], [
        F.count(F.lit(1)).alias("total_hits"), F.count_if(F.col("target_position") == A).alias("hits_a"),
        F.count_if(F.col("target_position") == B).alias("hits_b")]).fillna(0)


@query("d37_family_collapse", f"family_{A} s, family_{B} s, haplotype_aa s, pair_count i, percent d1",
       f"""WITH {PHASED} SELECT family_{A}, family_{B}, haplotype_aa, count(DISTINCT pair_id) AS pair_count, round(100.0 * count(DISTINCT pair_id) / sum(count(DISTINCT pair_id)) OVER (), 1) AS percent
       FROM ph WHERE qboth >= 10 GROUP BY ALL""")
def d37(s, d):
    return hp.family_collapse(phased(s, d), P)


@query("d38_family_metrics", "metric s, value i",
       f"""WITH {PHASED}, h AS (SELECT * FROM ph WHERE qboth >= 10)
       SELECT 'phased_records' AS metric, count(*) AS value FROM h UNION ALL SELECT 'families_{A}', count(DISTINCT family_{A}) FROM h
       UNION ALL SELECT 'families_{A}_M', count(DISTINCT family_{A}) FROM h WHERE aa_{A} = 'M' UNION ALL SELECT 'families_{B}', count(DISTINCT family_{B}) FROM h
       UNION ALL SELECT 'families_{B}_L', count(DISTINCT family_{B}) FROM h WHERE aa_{B} = 'L' UNION ALL SELECT 'families_{B}_P', count(DISTINCT family_{B}) FROM h WHERE aa_{B} = 'P'
       UNION ALL SELECT 'family_combinations', count(DISTINCT (family_{A}, family_{B})) FROM h""")
def d38(s, d):
    return hp.family_metrics(phased(s, d), P, {A: ("M",), B: ("L", "P")})


@query("h54_variant_label", "target_position i, variant_class s, n i",
       f"""WITH {EVIDENCE} SELECT target_position, CASE WHEN aa = expected THEN 'REFERENCE_MATCH' ELSE expected || target_position || aa END AS variant_class, count(*) AS n FROM ev GROUP BY ALL""")
def h54(s, d):
    e = evidence(s, d).withColumn("variant_class", variant_class("expected_reference_aa", "target_position", "target_aa"))
    return e.groupBy("target_position", "variant_class").agg(F.count(F.lit(1)).alias("n"))


@query("h55_haplotype_label", "l_orderkey i, l_linenumber i, l_partkey i, label s",
       f"WITH {EVIDENCE} SELECT *, aa || '{A}-' || expected || '{B}' AS label FROM ev")
def h55(s, d):
    return evidence(s, d).withColumn("label", haplotype_aa("target_aa", A, "expected_reference_aa", B))


# ------------------------------------------------------------------ crosstabs, classes, checks


@query("d43_class_levels_zero_fill", "event_type s, n i",
       """SELECT l AS event_type, count(event_id) AS n FROM (SELECT unnest(['view', 'click', 'purchase', 'absent']) AS l) LEFT JOIN events ON event_type = l GROUP BY l""")
def d43(s, d):
    c = table(s, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return with_levels(s, ["view", "click", "purchase", "absent"], "event_type", c, "n")


@query("d44_class_string_per_pair", "user_id i, classes s",
       """WITH f AS (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, ';' ORDER BY o) AS classes FROM f GROUP BY user_id""")
def d44(s, d):
    return sm.joined_classes(table(s, d, "events"), "user_id", "event_type", F.col("event_id"))


@query("d46_two_way_table", "row_level s, column_level s, n i",
       """SELECT CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS row_level, l_linestatus AS column_level, count(*) AS n FROM lineitem GROUP BY ALL""")
def d46(s, d):
    li = table(s, d, "lineitem").select(F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("row_level"), F.col("l_linestatus").alias("column_level"))
    return sm.crosstab(li, "row_level", "column_level")


@query("d47_orientation_counts", "pair_id s, n i, forward i, reverse i",
       f"WITH {EVIDENCE} SELECT pair_id, count(*) AS n, count(*) FILTER (WHERE orientation = 'fwd') AS forward, count(*) FILTER (WHERE orientation = 'rev') AS reverse FROM ev GROUP BY pair_id")
def d47(s, d):
    return evidence(s, d).groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("orientation") == "fwd").alias("forward"), F.count_if(F.col("orientation") == "rev").alias("reverse"))


@query("d52_duplicate_keys", "l_orderkey i, l_linenumber i, n i", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d52(s, d):
    return sm.duplicate_keys(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c2_inner_join_composite_key", "l_orderkey i, l_linenumber i, l_partkey i, o_totalprice d2",
       """WITH r AS (SELECT o_orderkey, 1 + o_custkey % 7 AS line, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderkey, 1 + o_custkey % 7 ORDER BY o_totalprice) = 1)
       SELECT l_orderkey, l_linenumber, l_partkey, o_totalprice FROM lineitem JOIN r ON l_orderkey = o_orderkey AND l_linenumber = line""")
def c2(s, d):
    from ..operators.ranking import first_per_group

    keys = ["l_orderkey", "l_linenumber"]
    r = table(s, d, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), (1 + F.col("o_custkey") % 7).cast("int").alias("l_linenumber"), "o_totalprice")
    return table(s, d, "lineitem").join(first_per_group(r, keys, [F.col("o_totalprice")]), keys)


@query("c9_pairing_check", "rows i, aligned i, misaligned i, one_sided i",
       f"""WITH {READS}, p AS (SELECT read_index, max(pair_id) FILTER (WHERE mate = 'R1') AS a, max(pair_id) FILTER (WHERE mate = 'R2') AS b FROM reads GROUP BY read_index)
       SELECT count(*) AS rows, count(*) FILTER (WHERE a = b) AS aligned, count(*) FILTER (WHERE a <> b) AS misaligned, count(*) FILTER (WHERE a IS NULL OR b IS NULL) AS one_sided FROM p""")
def c9(s, d):
    return pairing_report(reads(s, d))


@query("h26_translation_consistency", "checked i, inconsistent i",
       f"WITH {EVIDENCE} SELECT count(*) AS checked, count(*) FILTER (WHERE ({sql_codon('codon')}) <> aa) AS inconsistent FROM ev")
def h26(s, d):
    return translation_consistency(evidence(s, d), "codon", "translated_aa")
