"""Sequence scalars, references, read QC, gap tails and audits."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..functions import reads as rd
from ..functions import sequence as sq
from ..operators import audits as au
from ..operators import orfs
from ..operators.once import once
from ..operators import qc
from ..operators import references as rf
from ..operators import reshape as rs
from ..operators import tails as tl
from ..operators.checks import reference_lock
from ..operators.pairs import consolidate, merge_roles
from ..operators.recovery import extract_reads, extract_regions, extraction_report
from ..operators.scan import anchor_window, degenerate_pattern_column, residue_to_iupac
from ..operators.summaries import class_counts
from .adapters import (
    DOCS, GAP_END, GAP_START, PROTEINS, RC, READS, documents_dna, genes, proteins, reads, sql_codon, sql_match, sql_translate, table,
)
from .registry import query

G0, G1 = GAP_START, GAP_END

# ------------------------------------------------------------------ translation (H1-H9)


@query("h1_reverse_complement", "read_id s, rc s", f"WITH {READS} SELECT read_id, {RC('seq')} AS rc FROM reads")
def h1(s, d):
    return reads(s, d).select("read_id", sq.reverse_complement("seq").alias("rc"))


@query("h2_translate_frame", "read_id s, frame1 s, frame2 s, frame3 s",
       f"WITH {READS} SELECT read_id, {sql_translate('seq', 1)} AS frame1, {sql_translate('seq', 2)} AS frame2, {sql_translate('seq', 3)} AS frame3 FROM reads")
def h2(s, d):
    return reads(s, d).select("read_id", *[sq.translate_frame("seq", f).alias(f"frame{f}") for f in (1, 2, 3)])


@query("h3_translate_strict", "name s, peptide s",
       f"WITH {DOCS} SELECT name, CASE WHEN length(seq) % 3 = 0 THEN {sql_translate('seq')} ELSE '' END AS peptide FROM docs")
def h3(s, d):
    return documents_dna(s, d).select("name", sq.translate_strict("seq").alias("peptide"))


CODON_USE = f"""{READS}, cu AS (SELECT codon, count(*) AS n FROM (SELECT unnest(list_transform(range(0, length(seq) // 3), lambda i: substr(seq, 1 + 3 * i, 3))) AS codon FROM reads) GROUP BY codon)"""


def codon_usage(s, d):
    return reads(s, d).select(F.explode(F.regexp_extract_all("seq", F.lit("..."), F.lit(0))).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))


@query("h4_translate_codon", "codon s, aa s, n i", f"WITH {CODON_USE} SELECT codon, {sql_codon('codon')} AS aa, n FROM cu")
def h4(s, d):
    return codon_usage(s, d).withColumn("aa", sq.translate_codon("codon"))


@query("h5_codon_table_usage", "aa s, codons i, n i", f"WITH {CODON_USE} SELECT {sql_codon('codon')} AS aa, count(*) AS codons, sum(n) AS n FROM cu WHERE regexp_matches(codon, '^[ACGT]+$') GROUP BY aa")
def h5(s, d):
    u = codon_usage(s, d).filter(F.col("codon").isin(*sq.CODONS))
    return u.groupBy(sq.translate_codon("codon").alias("aa")).agg(F.count(F.lit(1)).alias("codons"), F.sum("n").alias("n"))


@query("h6_codons_for_residue", "aa s, codons s, n i",
       f"WITH {CODON_USE} SELECT {sql_codon('codon')} AS aa, string_agg(codon, ',' ORDER BY codon) AS codons, sum(n) AS n FROM cu WHERE ({sql_codon('codon')}) IN ('K', 'E', 'L', 'M') GROUP BY aa")
def h6(s, d):
    inverse = [(aa, c) for aa in "KELM" for c in sq.codons_for(aa)]
    t = F.broadcast(s.createDataFrame(inverse, "aa string, codon string"))
    return codon_usage(s, d).join(t, "codon").groupBy("aa").agg(
        F.array_join(F.array_sort(F.collect_list("codon")), ",").alias("codons"), F.sum("n").alias("n"))


@query("h7_min_codon_hamming", "codon s, residue s, distance i, n i", f"""
WITH {CODON_USE}, b AS (SELECT unnest(['T', 'C', 'A', 'G']) AS x), all64 AS (SELECT b1.x || b2.x || b3.x AS c FROM b b1, b b2, b b3), t AS (SELECT c, {sql_codon('c')} AS residue FROM all64)
SELECT codon, residue, min(hamming(codon, c)) AS distance, min(n) AS n FROM cu, t WHERE regexp_matches(codon, '^[ACGT]+$') GROUP BY codon, residue""")
def h7(s, d):
    return codon_usage(s, d).join(F.broadcast(au.hamming_frame(s)), "codon")


def _nonx(o, f):
    return f"length(replace({sql_translate(o, f)}, 'X', ''))"


@query("h8_six_frame_best", "read_id s, orientation s, frame i, residues i", f"""
WITH {READS}, o AS (SELECT read_id, seq AS a, {RC('seq')} AS b FROM reads), l AS (
 {' UNION ALL '.join(f"SELECT read_id, '{n}' AS orientation, {f} AS frame, {k * 3 + f} AS o, {_nonx(c, f)} AS residues FROM o" for k, (n, c) in enumerate((('fwd', 'a'), ('rev', 'b'))) for f in (1, 2, 3))})
SELECT read_id, CASE WHEN residues > 0 THEN orientation ELSE 'none' END AS orientation, CASE WHEN residues > 0 THEN frame ELSE 0 END AS frame, residues FROM l QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY residues DESC, o) = 1""")
def h8(s, d):
    best = reads(s, d).select("read_id", F.inline(F.array(sq.best_frame("seq"))))
    found = F.col("residues") > 0  # a read of no whole codon has no frame
    return best.select("read_id", F.when(found, F.col("orientation")).otherwise("none").alias("orientation"), F.when(found, F.col("frame")).otherwise(0).alias("frame"), "residues")


@query("h9_open_segments", "name s, segments i, longest i, total i", f"""
WITH {DOCS}, sg AS (SELECT name, unnest(string_split({sql_translate('seq')}, '*')) AS x FROM docs)
SELECT name, count(*) AS segments, max(length(x)) AS longest, sum(length(x)) AS total FROM sg WHERE length(x) >= 30 GROUP BY name""")
def h9(s, d):
    x = documents_dna(s, d).select("name", F.explode(sq.open_segments(sq.translate_frame("seq"), F.lit(30))).alias("x"))
    return x.groupBy("name").agg(F.count(F.lit(1)).alias("segments"), F.max(F.length("x")).alias("longest"), F.sum(F.length("x")).alias("total"))


# ------------------------------------------------------------------ alignment, ORFs


def neighbours(s, d):
    """Each protein with the next one; the last one with the first."""
    p = proteins(s, d)
    ends = p.agg(F.min("item_id").alias("lo"), F.max("item_id").alias("hi")).first()
    before = F.when(F.col("item_id") == ends["lo"], F.lit(ends["hi"])).otherwise(F.col("item_id") - 1)
    return p.join(p.select(before.alias("item_id"), F.col("seq").alias("other")), "item_id")


NEIGH = f"{PROTEINS}, nb AS (SELECT a.item_id, a.gene, a.cds, a.seq, b.seq AS other FROM proteins a JOIN proteins b ON b.item_id = CASE WHEN a.item_id = (SELECT max(item_id) FROM proteins) THEN (SELECT min(item_id) FROM proteins) ELSE a.item_id + 1 END)"


# Scores over anti-diagonals: each step makes one from the two before. A cell carries the columns and matches of its own way
# back, which its score decides: diagonal, then up, then left. d: diagonal, l1 and l2: the last two, by row.
ALIGN_SQL = """al(gene, a, b, n, m, d, l2, l1) AS (
 SELECT gene, seq, other, length(seq), length(other), 1, z, z FROM (SELECT *, list_transform(range(0, length(seq) + 1), lambda i: {'h': 0, 'c': 0, 's': 0}) AS z FROM nb)
 UNION ALL
 SELECT gene, a, b, n, m, d + 1, l1, list_transform(list_transform(list_transform(range(0, n + 1),
   lambda i: CASE WHEN i >= 1 AND d + 1 - i >= 1 AND d + 1 - i <= m THEN {'g': l2[i], 'u': l1[i], 'l': l1[i + 1], 'e': CASE WHEN substr(a, CAST(i AS INTEGER), 1) = substr(b, CAST(d + 1 - i AS INTEGER), 1) THEN 1 ELSE -1 END} END),
   lambda x: CASE WHEN x IS NOT NULL THEN {'x': x, 'v': greatest(0, x.g.h + x.e, x.u.h - 1, x.l.h - 1)} END),
   lambda y: CASE WHEN y IS NULL OR y.v = 0 THEN {'h': 0, 'c': 0, 's': 0}
     WHEN y.v = y.x.g.h + y.x.e THEN {'h': y.v, 'c': y.x.g.c + 1, 's': y.x.g.s + CASE WHEN y.x.e = 1 THEN 1 ELSE 0 END}
     WHEN y.v = y.x.u.h - 1 THEN {'h': y.v, 'c': y.x.u.c + 1, 's': y.x.u.s} ELSE {'h': y.v, 'c': y.x.l.c + 1, 's': y.x.l.s} END)
 FROM al WHERE d < n + m),
cells AS (SELECT gene, n, d, unnest(l1) AS k, generate_subscripts(l1, 1) - 1 AS i FROM al),
top AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY gene ORDER BY k.h DESC, i, d) = 1)"""


@query("h10_local_alignment", "gene s, identity d, coverage d, aligned_ref i, score i",
       f"WITH RECURSIVE {NEIGH}, {ALIGN_SQL} SELECT gene, CASE WHEN k.h > 0 THEN 100.0 * k.s / k.c ELSE 0 END AS identity, CASE WHEN k.h > 0 THEN 100.0 * k.c / n ELSE 0 END AS coverage, k.c AS aligned_ref, k.h AS score FROM top")
def h10(s, d):
    return neighbours(s, d).select("gene", orfs.alignment_metrics(F.col("seq"), F.col("other")).alias("a")).select("gene", "a.*")


@query("h11_orf_score", "l_orderkey i, l_linenumber i, l_partkey i, score d",
       """SELECT *, (100 - l_quantity) / 100 * (l_discount * 1000) / 100 * least(l_linenumber / 5.0, 1.0) - 0.10 * (l_suppkey % 3) AS score FROM lineitem""")
def h11(s, d):
    return table(s, d, "lineitem").withColumn("score", orfs.orf_score(
        100 - F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_linenumber"), F.lit(5.0), F.col("l_suppkey") % 3))


def doc_genes(s, d):
    docs = documents_dna(s, d).withColumn("gene", F.concat(F.lit("B"), (F.col("doc_id") % genes(s, d)).cast("string")))
    return docs.join(proteins(s, d).select("gene", F.col("seq").alias("protein_ref"), "cds"), "gene")


@query("h12_best_orf", "name s, orientation s, frame i, orf_length i, identity d, coverage d, score d")
def h12(s, d):
    return orfs.best_orfs(doc_genes(s, d).select("name", "seq", "protein_ref"), ["name"], "seq", "protein_ref")


DOC_HITS = f"""{DOCS}, dh AS (SELECT doc_id, name AS contig, seq AS contig_seq, 'B' || (doc_id % (SELECT count(*) FROM benchmark)) AS gene, length(seq) AS bitscore,
  CASE WHEN doc_id % 2 = 0 THEN 1 + (doc_id * 37) % 200 ELSE 90 + (doc_id * 37) % 200 END AS sstart,
  CASE WHEN doc_id % 2 = 0 THEN 90 + (doc_id * 37) % 200 ELSE 1 + (doc_id * 37) % 200 END AS send FROM docs)"""


def doc_hits(s, d):
    k = (F.col("doc_id") * 37) % 200
    even = F.col("doc_id") % 2 == 0
    return documents_dna(s, d).select(
        "doc_id", F.col("name").alias("contig"), F.concat(F.lit("B"), (F.col("doc_id") % genes(s, d)).cast("string")).alias("gene"),
        F.length("seq").cast("double").alias("bitscore"), F.lit(90.0).alias("pident"), F.lit(1e-20).alias("evalue"),
        F.when(even, k + 1).otherwise(k + 90).alias("sstart"), F.when(even, k + 90).otherwise(k + 1).alias("send"))


def contigs(s, d):
    return documents_dna(s, d).select(F.col("name").alias("contig"), "seq")


REGION = "substr(contig_seq, greatest(1, least(sstart, send) - 15), greatest(0, least(length(contig_seq), greatest(sstart, send) + 15) - greatest(1, least(sstart, send) - 15) + 1))"


@query("h16_region_extraction", "contig s, region_start i, region_end i, region s",
       f"""WITH {DOC_HITS} SELECT contig, greatest(1, least(sstart, send) - 15) AS region_start, least(length(contig_seq), greatest(sstart, send) + 15) AS region_end,
       CASE WHEN sstart > send THEN {RC(REGION)} ELSE {REGION} END AS region FROM dh""")
def h16(s, d):
    """A hit beyond its contig has an empty region."""
    return extract_regions(doc_hits(s, d), contigs(s, d), flank=15)


@query("h58_recover_gene", "gene s, contig s, region_start i, region_end i, orientation s, frame i, identity d, score d")
def h58(s, d):
    return orfs.recover_genes(doc_hits(s, d), contigs(s, d), proteins(s, d), 150, [F.col("doc_id")])


@query("h59_cds_extraction_check", "contig s, region_bp i, divisible_by_3 b, length_matches b, start_codon s, protein s, identity_pct d",
       f"""WITH {DOC_HITS}, {PROTEINS}, r AS (SELECT contig, sstart, send, proteins.seq AS ref, CASE WHEN sstart > send THEN {RC(REGION.replace('15', '0'))} ELSE {REGION.replace('15', '0')} END AS region
         FROM dh JOIN proteins USING (gene)),
       t AS (SELECT *, regexp_replace({sql_translate('region')}, '\\*$', '') AS protein FROM r)
       SELECT contig, length(region) AS region_bp, length(region) % 3 = 0 AS divisible_by_3, length(region) = 90 AS length_matches, substr(region, 1, 3) AS start_codon, protein,
       CASE WHEN length(protein) = length(ref) AND length(ref) > 0 THEN 100.0 * {sql_match('protein', 'ref')} / length(ref) ELSE -1 END AS identity_pct FROM t""")
def h59(s, d):
    r = extract_regions(doc_hits(s, d), contigs(s, d))
    r = r.join(proteins(s, d).select("gene", F.col("seq").alias("ref")), "gene").withColumn("expected", F.lit(90))
    return au.cds_extraction_check(r, "expected", "ref").fillna({"identity_pct": -1.0})


# ------------------------------------------------------------------ identity, substitutions, references


@query("h13_percent_identity", "gene s, truncated d, equal_only d",
       f"""WITH {NEIGH} SELECT gene, 100.0 * {sql_match('seq', 'other')} / least(length(seq), length(other)) AS truncated,
       CASE WHEN length(seq) = length(other) THEN 100.0 * {sql_match('seq', 'other')} / length(seq) ELSE -1 END AS equal_only FROM nb""")
def h13(s, d):
    return neighbours(s, d).select(
        "gene", sq.percent_identity("seq", "other", "truncate").alias("truncated"),
        F.coalesce(sq.percent_identity("seq", "other"), F.lit(-1.0)).alias("equal_only"))


@query("h14_substitution_list", "gene s, position i, mutation s, reference s, observed s",
       f"""WITH {NEIGH}, p AS (SELECT gene, seq, other, unnest(range(1, least(length(seq), length(other)) + 1)) AS i FROM nb)
       SELECT gene, i + 10 AS position, substr(seq, i, 1) || (i + 10) || substr(other, i, 1) AS mutation, substr(seq, i, 1) AS reference, substr(other, i, 1) AS observed
       FROM p WHERE substr(seq, i, 1) <> substr(other, i, 1)""")
def h14(s, d):
    return neighbours(s, d).select("gene", F.explode(sq.substitutions("seq", "other", offset=10, truncate=True)).alias("m")).select("gene", "m.*")


@query("h15_marker_genotyping", "gene s, position i, residue s, observed s, marker_status s",
       f"""WITH {NEIGH}, m AS (SELECT gene, seq, unnest([5, 10, 15, 500]) AS position, other FROM nb),
       k AS (SELECT gene, seq, position, substr(other, position, 1) AS residue, CASE WHEN position % 10 = 5 THEN 'marker' ELSE 'substitution' END AS kind FROM m)
       SELECT gene, position, residue, substr(seq, position, 1) AS observed, CASE kind WHEN 'substitution' THEN CASE WHEN position <= length(seq) AND substr(seq, position, 1) = residue THEN 'Present' ELSE 'Absent' END
       ELSE CASE WHEN position <= length(seq) AND substr(seq, position, 1) = residue THEN 'Wild type' ELSE 'Variant' END END AS marker_status FROM k""")
def h15(s, d):
    n = neighbours(s, d)
    t = n.select("gene", "other", F.explode(F.array(*[F.lit(p) for p in (5, 10, 15, 500)])).alias("position")).select(
        "gene", "position", F.substring(F.col("other"), F.col("position"), F.lit(1)).alias("residue"),
        F.when(F.col("position") % 10 == 5, "marker").otherwise("substitution").alias("kind"))
    return rf.markers(n.select("gene", "seq"), "seq", t).fillna({"observed": ""})


CDS_PEP = f"""{DOCS}, d1 AS (SELECT docs.*, n_chars AS expected_bp, n_chars // 3 AS expected_aa, {sql_translate('seq')} AS aa FROM docs JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id)),
d2 AS (SELECT *, CASE WHEN aa LIKE '%*' THEN 1 ELSE 0 END AS term FROM d1),
d3 AS (SELECT *, length(aa) - term AS aa_exc, substr(aa, 1, length(aa) - term) AS body FROM d2)"""


def doc_cds(s, d):
    n = table(s, d, "documents").select("doc_id", F.col("n_chars").alias("expected_bp"), F.floor(F.col("n_chars") / 3).alias("expected_aa"))
    return documents_dna(s, d).join(n, "doc_id")


@query("h17_cds_validation", "name s, cds_length i, cds_length_match b, cds_divisible_by_3 b, start_codon_valid b, stop_codon_valid b, ambiguous_bases i, internal_stops i, aa_length_excluding_stop i, gc_percent d2, status s, reason s", f"""
WITH {CDS_PEP}, f AS (SELECT *, length(seq) AS n, length(seq) = expected_bp AND expected_bp > 0 AS lm, CASE WHEN length(seq) >= 3 THEN substr(seq, 1, 3) ELSE 'NA' END AS a, CASE WHEN length(seq) >= 3 THEN substr(seq, length(seq) - 2, 3) ELSE 'NA' END AS z, length(regexp_replace(seq, '[ACGT]', '', 'g')) AS amb,
  length(regexp_replace(body, '[^*]', '', 'g')) AS st FROM d3)
SELECT name, n AS cds_length, lm AS cds_length_match, n % 3 = 0 AS cds_divisible_by_3, a IN ('ATG', 'GTG', 'TTG') AS start_codon_valid, z IN ('TAA', 'TAG', 'TGA') AS stop_codon_valid, amb AS ambiguous_bases,
 st AS internal_stops, aa_exc AS aa_length_excluding_stop, round(100.0 * length(regexp_replace(seq, '[^GC]', '', 'g')) / nullif(n, 0), 2) AS gc_percent,
 CASE WHEN lm AND n % 3 = 0 AND a IN ('ATG', 'GTG', 'TTG') AND z IN ('TAA', 'TAG', 'TGA') AND amb = 0 AND st = 0 AND aa_exc = expected_aa AND expected_aa > 0 THEN 'PASS' ELSE 'FAIL' END AS status,
 coalesce(nullif(array_to_string(list_filter([CASE WHEN NOT lm THEN 'length:' || n || '/' || expected_bp END, CASE WHEN n % 3 <> 0 THEN 'partial_codon' END,
  CASE WHEN a NOT IN ('ATG', 'GTG', 'TTG') THEN 'start:' || a END, CASE WHEN z NOT IN ('TAA', 'TAG', 'TGA') THEN 'stop:' || z END, CASE WHEN amb > 0 THEN 'ambiguous:' || amb END,
  CASE WHEN st > 0 THEN 'inner_stops:' || st END, CASE WHEN NOT (aa_exc = expected_aa AND expected_aa > 0) THEN 'protein_length:' || aa_exc || '/' || expected_aa END],
  lambda x: x IS NOT NULL), '; '), ''), 'OK') AS reason FROM f""")
def h17(s, d):
    return rf.validate_cds(doc_cds(s, d))


@query("h18_protein_validation", "name s, aa_length_excluding_stop i, internal_stops i, invalid_residues i, aa_length_match b, terminal_stop_included b, status s", f"""
WITH {CDS_PEP}, f AS (SELECT *, length(regexp_replace(body, '[^*]', '', 'g')) AS st, length(regexp_replace(body, '[ACDEFGHIKLMNPQRSTVWY]', '', 'g')) AS bad FROM d3)
SELECT name, aa_exc AS aa_length_excluding_stop, st AS internal_stops, bad AS invalid_residues, aa_exc = expected_aa AND expected_aa > 0 AS aa_length_match, term = 1 AS terminal_stop_included,
 CASE WHEN aa_exc = expected_aa AND expected_aa > 0 AND st = 0 AND bad = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM f""")
def h18(s, d):
    return rf.validate_protein(doc_cds(s, d).withColumn("seq", sq.translate_frame("seq")))


@query("d54_validation_rollup", "overall_status s, checked i, failed i, failing s", f"""
WITH {CDS_PEP}, f AS (SELECT name, length(regexp_replace(body, '[^*]', '', 'g')) = 0 AS ok FROM d3) SELECT CASE WHEN bool_and(ok) THEN 'PASS' ELSE 'FAIL' END AS overall_status, count(*) AS checked, count(*) FILTER (WHERE NOT ok) AS failed,
 coalesce(string_agg(name, '; ' ORDER BY name) FILTER (WHERE NOT ok), '') AS failing FROM f""")
def d54(s, d):
    v = rf.validate_protein(doc_cds(s, d).withColumn("seq", sq.translate_frame("seq")))
    return rf.validation_rollup(v.withColumn("status", F.when(F.col("internal_stops") == 0, "PASS").otherwise("FAIL")), "name")


@query("h19_sequence_type_detection", "detected s, declared s, n i", f"""
WITH {DOCS}, x AS (SELECT upper(regexp_replace(text, '\\s', '', 'g')) AS t, source FROM documents UNION ALL SELECT seq, ' CDS ' FROM docs)
SELECT CASE WHEN t = '' THEN NULL WHEN regexp_matches(t, '^[ACGTUNRYWSKMBDHV-]+$') THEN 'nucleotide' ELSE 'protein' END AS detected, CASE WHEN source = ' CDS ' THEN 'nucleotide' ELSE NULL END AS declared, count(*) AS n FROM x GROUP BY ALL""")
def h19(s, d):
    a = table(s, d, "documents").select(F.col("text").alias("t"), "source")
    b = documents_dna(s, d).select(F.col("seq").alias("t"), F.lit(" CDS ").alias("source"))
    x = rf.sequence_types(a.unionByName(b), "t", "source")
    return x.groupBy(F.col("detected_type").alias("detected"), F.col("declared_type").alias("declared")).agg(F.count(F.lit(1)).alias("n"))


@query("h20_header_checks", "doc_id i, header_contains_target b, header_valid b, header_unique b", """
WITH h AS (SELECT doc_id, lang, CASE doc_id % 4 WHEN 0 THEN lang || ' | ' || source WHEN 1 THEN 'gene=' || doc_id WHEN 2 THEN source || doc_id ELSE ' ' END AS header FROM documents),
c AS (SELECT header, count(*) AS n FROM h GROUP BY header)
SELECT doc_id, contains(upper(header), upper(lang)) AS header_contains_target, trim(header) <> '' AND (contains(upper(header), upper(lang)) OR contains(header, 'gene=')) AS header_valid, n = 1 AS header_unique FROM h JOIN c USING (header)""")
def h20(s, d):
    k = F.col("doc_id") % 4
    h = table(s, d, "documents").withColumn(
        "header", F.when(k == 0, F.concat("lang", F.lit(" | "), "source")).when(k == 1, F.concat(F.lit("gene="), F.col("doc_id").cast("string")))
        .when(k == 2, F.concat("source", F.col("doc_id").cast("string"))).otherwise(" "))
    return rf.header_checks(h, "header", "lang")


@query("h21_sequence_checksum", "name s, checksum s", f"WITH {DOCS} SELECT name, md5(seq || chr(13) || chr(10)) AS checksum FROM docs")
def h21(s, d):
    return rf.checksums(documents_dna(s, d))


def _motifs(unit):
    return "|".join(f"(?:{''.join(m)}){{3,}}" for m in product("ACGTN", repeat=unit))


# A back-reference as an alternation of all motifs; the text between runs gives their places.
@query("h22_tandem_repeats", "name s, unit i, motif s, copies i, start i", f"""
WITH {DOCS}, cut AS ({' UNION ALL '.join(f"SELECT name, {u} AS unit, string_split(regexp_replace(seq, '({_motifs(u)})', '|\\1|', 'g'), '|') AS parts FROM docs" for u in (2, 3))}),
p AS (SELECT name, unit, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM cut),
w AS (SELECT *, sum(length(part)) OVER (PARTITION BY name, unit ORDER BY i) - length(part) + 1 AS start FROM p)
SELECT name, unit, substr(part, 1, unit) AS motif, length(part) // unit AS copies, start FROM w WHERE i % 2 = 0""")
def h22(s, d):
    return rf.tandem_repeats(documents_dna(s, d), "name", "seq", [2, 3])


@query("h23_residue_fraction", "gene s, k_fraction d, e_fraction d, k_ratio d3", f"""
WITH {PROTEINS} SELECT gene, length(regexp_replace(seq, '[^K]', '', 'g')) / length(seq) AS k_fraction, length(regexp_replace(seq, '[^E]', '', 'g')) / length(seq) AS e_fraction,
 round(length(regexp_replace(seq, '[^K]', '', 'g')) / length(seq) / 0.369, 3) AS k_ratio FROM proteins""")
def h23(s, d):
    return proteins(s, d).select("gene", sq.residue_fraction("seq", "K").alias("k_fraction"), sq.residue_fraction("seq", "E").alias("e_fraction"),
                                 sq.composition_ratio("seq", "K", 0.369).alias("k_ratio"))


@query("d3_assembly_statistics", "lang s, contigs i, total_bp i, longest_bp i",
       f"WITH {DOCS} SELECT lang, count(*) AS contigs, sum(length(seq)) AS total_bp, max(length(seq)) AS longest_bp FROM docs GROUP BY lang")
def d3(s, d):
    return rf.assembly_statistics(documents_dna(s, d), ["lang"])


@query("d4_sequence_summary", "name s, length i, preview s", f"WITH {DOCS} SELECT name, length(seq) AS length, substr(seq, 1, 60) AS preview FROM docs")
def d4(s, d):
    return rf.sequence_summary(documents_dna(s, d))


@query("d16_residue_composition", "gene s, residue s, region_pct d2, whole_pct d2, enrichment_ratio d2", f"""
WITH {PROTEINS}, a AS (SELECT unnest(string_split('ACDEFGHIKLMNPQRSTVWY', '')) AS residue),
c AS (SELECT gene, residue, round(100.0 * len(list_filter(string_split(substr(seq, 11, 20), ''), lambda x: x = residue)) / length(substr(seq, 11, 20)), 2) AS region_pct,
  round(100.0 * len(list_filter(string_split(seq, ''), lambda x: x = residue)) / length(seq), 2) AS whole_pct FROM proteins, a WHERE length(seq) > 10)
SELECT *, CASE WHEN whole_pct > 0 THEN round(region_pct / whole_pct, 2) ELSE -1 END AS enrichment_ratio FROM c""")
def d16(s, d):
    return rf.composition(proteins(s, d), ["gene"], "seq", F.lit(11), F.lit(30)).fillna({"enrichment_ratio": -1.0})


@query("d17_shannon_entropy", "name s, entropy_bits d", f"""
WITH {DOCS}, c AS (SELECT name, ch, count(*) AS n FROM (SELECT name, unnest(string_split(seq, '')) AS ch FROM docs WHERE seq <> '') GROUP BY ALL),
t AS (SELECT name, n, sum(n) OVER (PARTITION BY name) AS t FROM c) SELECT name, -sum(n / t * log2(n / t)) AS entropy_bits FROM t GROUP BY name""")
def d17(s, d):
    return rf.entropy(documents_dna(s, d).filter(F.col("seq") != ""), ["name"], "seq")


@query("d53_gene_summary", "gene s, reference_cds_bp i, full_length_aa i, recovered_aa i, recovered_cds_bp i, start_codon s, coverage_pct d1, identity_pct d2, substitutions i, observed_substitutions s, internal_stops i", f"""
WITH {NEIGH}, b AS (SELECT gene, cds, other AS r, seq AS q FROM nb),
m AS (SELECT *, list_filter(range(1, least(length(r), length(q)) + 1), lambda i: substr(r, i, 1) <> substr(q, i, 1)) AS d FROM b)
SELECT gene, 3 * length(r) AS reference_cds_bp, length(r) AS full_length_aa, length(q) AS recovered_aa, length(cds) AS recovered_cds_bp, substr(cds, 1, 3) AS start_codon, round(100.0 * length(q) / length(r), 1) AS coverage_pct,
 round(100.0 * (length(q) - len(d)) / length(q), 2) AS identity_pct, len(d) AS substitutions, CASE WHEN len(d) = 0 THEN 'None' ELSE array_to_string(list_transform(d, lambda i: substr(r, i, 1) || i || substr(q, i, 1)), '; ') END AS observed_substitutions,
 length(regexp_replace(substr(q, 1, length(q) - 1), '[^*]', '', 'g')) AS internal_stops FROM m""")
def d53(s, d):
    return rf.gene_summary(neighbours(s, d), "other", "seq", "cds")


@query("b16_reference_lock", "gene s, locked b", f"WITH {PROTEINS} SELECT gene, substr(seq, 1, 1) = 'K' AND substr(seq, 3, 1) = 'L' AS locked FROM proteins")
def b16(s, d):
    return proteins(s, d).withColumn("locked", reference_lock("seq", {1: "K", 3: "L"}))


@query("g8_mismatch_explode", "pair_id s, position i, a s, b s",
       f"""WITH {READS}, p AS (SELECT pair_id, max(seq) FILTER (WHERE mate = 'R1') AS x, max(seq) FILTER (WHERE mate = 'R2') AS y FROM reads GROUP BY pair_id),
       e AS (SELECT pair_id, x, y, unnest(range(1, length(x) + 1)) AS i FROM p WHERE length(x) = length(y))
       SELECT pair_id, i + 99 AS position, substr(x, i, 1) AS a, substr(y, i, 1) AS b FROM e WHERE substr(x, i, 1) <> substr(y, i, 1)""")
def g8(s, d):
    p = reads(s, d).groupBy("pair_id").agg(
        F.max(F.when(F.col("mate") == "R1", F.col("seq"))).alias("x"), F.max(F.when(F.col("mate") == "R2", F.col("seq"))).alias("y"))
    m = rs.mismatch_explode(p.withColumn("st", F.lit(100)), ["pair_id"], "x", "y", "st")
    return m.select("pair_id", "position", F.col("residue_a").alias("a"), F.col("residue_b").alias("b"))


@query("g6_positional_explode", "gene s, position i, aa s",
       f"WITH {PROTEINS}, e AS (SELECT gene, seq, unnest(range(1, length(seq) + 1)) AS i FROM proteins) SELECT gene, 100 + i AS position, substr(seq, i, 1) AS aa FROM e")
def g6(s, d):
    return rs.positional_explode(proteins(s, d).withColumn("st", F.lit(101)), ["gene"], "seq", "st")


# ------------------------------------------------------------------ read QC

QV = "list_transform(string_split(qual, ''), lambda c: ascii(c) - 33)"
METRICS = f"""{READS}, m AS (SELECT mate, read_id, seq, length(seq) AS len, length(regexp_replace(seq, '[^GC]', '', 'g')) AS gc, length(regexp_replace(seq, '[^N]', '', 'g')) AS nn,
  list_sum({QV}) AS qs, len(list_filter({QV}, lambda x: x >= 20)) AS q20, len(list_filter({QV}, lambda x: x >= 30)) AS q30 FROM reads)"""


def metrics(s, d):
    return qc.read_metrics(reads(s, d))


@query("d5_read_counts", "r1_reads i, r2_reads i, mates_symmetric b",
       f"WITH {READS} SELECT count(*) FILTER (WHERE mate = 'R1') AS r1_reads, count(*) FILTER (WHERE mate = 'R2') AS r2_reads, count(*) FILTER (WHERE mate = 'R1') = count(*) FILTER (WHERE mate = 'R2') AS mates_symmetric FROM reads")
def d5(s, d):
    return qc.read_counts(reads(s, d))


@query("d6_read_length_statistics", "mate s, reads i, mean_len d, median_len d, sd_len d, min_len i, max_len i, distinct_lengths i",
       f"WITH {METRICS} SELECT mate, count(*) AS reads, avg(len) AS mean_len, median(len) AS median_len, stddev_samp(len) AS sd_len, min(len) AS min_len, max(len) AS max_len, count(DISTINCT len) AS distinct_lengths FROM m GROUP BY mate")
def d6(s, d):
    return qc.length_statistics(reads(s, d))


@query("d7_length_percentiles", "mate s, p05 d, p25 d, p75 d, p95 d",
       f"WITH {METRICS} SELECT mate, quantile_cont(len, 0.05) AS p05, quantile_cont(len, 0.25) AS p25, quantile_cont(len, 0.75) AS p75, quantile_cont(len, 0.95) AS p95 FROM m GROUP BY mate")
def d7(s, d):
    return qc.length_quantiles(reads(s, d))


SHARES = """SELECT mate, 100.0 * count(*) FILTER (WHERE len = mx) / count(*) AS pct_at_max_len, 100.0 * count(*) FILTER (WHERE len < 100) / count(*) AS pct_lt_100, 100.0 * count(*) FILTER (WHERE len < 50) / count(*) AS pct_lt_50,
 100.0 * count(*) FILTER (WHERE len >= 301 * 0.8) / count(*) AS pct_ge_report_len, (1 - avg(len) / 301) * 100 AS mean_reduction_pct, min(len) AS min_len, avg(len) AS mean_len FROM (SELECT *, max(len) OVER (PARTITION BY mate) AS mx FROM m) GROUP BY mate"""


@query("d8_share_metrics", "mate s, pct_at_max_len d, pct_lt_100 d, pct_lt_50 d, pct_ge_report_len d, mean_reduction_pct d", f"WITH {METRICS} {SHARES}")
def d8(s, d):
    return qc.share_metrics(reads(s, d))


@query("d9_gc_statistics", "mate s, mean_gc d, median_gc d, sd_gc d, mean_n_pct d",
       f"WITH {METRICS} SELECT mate, avg(gc / len * 100) AS mean_gc, median(gc / len * 100) AS median_gc, stddev_samp(gc / len * 100) AS sd_gc, avg(nn / len * 100) AS mean_n_pct FROM m GROUP BY mate")
def d9(s, d):
    return qc.gc_statistics(metrics(s, d))


@query("d10_base_composition", "mate s, pct_a d2, pct_c d2, pct_g d2, pct_t d2, pct_n d2", f"""
WITH {READS}, c AS (SELECT mate, ch, count(*) AS n FROM (SELECT mate, unnest(string_split(seq, '')) AS ch FROM reads) GROUP BY ALL)
SELECT mate, {', '.join(f"round(100.0 * sum(n) FILTER (WHERE ch = '{b}') / sum(n), 2) AS pct_{b.lower()}" for b in 'ACGTN')} FROM c GROUP BY mate""")
def d10(s, d):
    return qc.base_composition(metrics(s, d))


@query("d11_quality_shares", "mate s, q20_pct d, q30_pct d, mean_phred d",
       f"WITH {METRICS} SELECT mate, 100.0 * sum(q20) / sum(len) AS q20_pct, 100.0 * sum(q30) / sum(len) AS q30_pct, avg(qs / len) AS mean_phred FROM m GROUP BY mate")
def d11(s, d):
    return qc.quality_shares(metrics(s, d))


@query("d12_cycle_quality", "mate s, cycle i, reads i, mean_q d", f"""
WITH {READS}, e AS (SELECT mate, qual, unnest(range(1, length(qual) + 1)) AS cycle FROM reads) SELECT mate, cycle, count(*) AS reads, avg(ascii(substr(qual, cycle, 1)) - 33) AS mean_q FROM e GROUP BY ALL""")
def d12(s, d):
    return qc.cycle_quality(reads(s, d))


@query("d13_histograms", "metric s, mate s, bin_start d1, n i", f"""
WITH {METRICS} SELECT 'length' AS metric, mate, floor(len / 1.0) AS bin_start, count(*) AS n FROM m GROUP BY ALL UNION ALL SELECT 'gc', mate, floor(gc / len * 100), count(*) FROM m GROUP BY ALL
UNION ALL SELECT 'quality', mate, floor(qs / len / 0.5) * 0.5, count(*) FROM m GROUP BY ALL UNION ALL SELECT 'n', mate, floor(nn / len * 100 / 0.1) * 0.1, count(*) FROM m GROUP BY ALL""")
def d13(s, d):
    bins = qc.histograms(metrics(s, d), ["mate"], {"len": 1.0, "gc_pct": 1.0, "mean_q": 0.5, "n_pct": 0.1})
    labels = F.create_map(*[F.lit(x) for pair in (("len", "length"), ("gc_pct", "gc"), ("mean_q", "quality"), ("n_pct", "n")) for x in pair])
    return bins.withColumn("metric", labels[F.col("metric")])


@query("d14_throughput_coverage", "mate s, reads i, mean_len d, throughput_mb d6, throughput_gb d9, paired_coverage d6", f"""
WITH {METRICS}, p AS (SELECT mate, count(*) AS reads, avg(len) AS mean_len, sum(len) AS b FROM m GROUP BY mate)
SELECT mate, reads, mean_len, b / 1e6 AS throughput_mb, b / 1e9 AS throughput_gb, (SELECT sum(b) FROM p) / 35e6 AS paired_coverage FROM p""")
def d14(s, d):
    return qc.throughput(reads(s, d), 35e6)


@query("d15_length_verdict", "mate s, qc_status s, qc_flags s", f"""
WITH {METRICS}, sh AS ({SHARES}), f AS (SELECT mate, list_filter([CASE WHEN min_len < 35 THEN 'min_length:' || min_len || '<35' END,
 CASE WHEN pct_lt_50 > 1 THEN printf('short_reads:%.2f>1.00', pct_lt_50) END, CASE WHEN mean_len < 301 * 0.75 THEN printf('mean_length:%.2f<225.75', mean_len) END], lambda x: x IS NOT NULL) AS fl FROM sh)
SELECT mate, CASE WHEN len(fl) = 0 THEN 'PASS' ELSE 'WARNING' END AS qc_status, coalesce(array_to_string(fl, '; '), '') AS qc_flags FROM f""")
def d15(s, d):
    st = qc.length_statistics(reads(s, d)).join(qc.share_metrics(reads(s, d)), "mate")
    return qc.length_verdict(st)


@query("h51_phred_decoding", "read_id s, q_sum i, q_min i, q_max i",
       f"WITH {READS} SELECT read_id, list_sum({QV}) AS q_sum, list_min({QV}) AS q_min, list_max({QV}) AS q_max FROM reads")
def h51(s, d):
    r = reads(s, d).withColumn("p", rd.phred("qual"))
    return r.select("read_id", F.aggregate("p", F.lit(0), lambda a, x: a + x).alias("q_sum"), F.array_min("p").alias("q_min"), F.array_max("p").alias("q_max"))


@query("h52_read_id_normalisation", "read_id s, clean s, pair s, stripped s", f"""
WITH {READS}, x AS (SELECT read_id || ' 1 length=' || length(seq) AS raw, read_id FROM reads)
SELECT read_id, regexp_replace(regexp_replace(raw, '\\s.*$', ''), '/[12]$', '') AS clean, regexp_replace(regexp_replace(raw, '\\s.*$', ''), '/[12]$', '') AS pair,
 regexp_replace(regexp_replace(regexp_replace(replace(raw, ':', '.'), '\\s.*$', ''), '/[12]$', ''), '[._-][12]$', '') AS stripped FROM x""")
def h52(s, d):
    raw = F.concat("read_id", F.lit(" 1 length="), F.length("seq").cast("string"))
    return reads(s, d).select("read_id", rd.clean_read_id(raw).alias("clean"), rd.pair_id(raw).alias("pair"),
                              rd.pair_id(F.replace(raw, F.lit(":"), F.lit(".")), strip_separators=True).alias("stripped"))


@query("h53_pair_rule_detection", "rule s, match_rate d", f"""
WITH {READS}, p AS (SELECT read_index, max(read_id) FILTER (WHERE mate = 'R1') AS a, max(read_id) FILTER (WHERE mate = 'R2') AS b FROM reads GROUP BY read_index),
k AS (SELECT * FROM p WHERE a IS NOT NULL AND b IS NOT NULL)
SELECT rule, avg(CASE WHEN regexp_replace(a, pat, '') = regexp_replace(b, pat, '') THEN 1.0 ELSE 0.0 END) AS match_rate
FROM k, (VALUES ('first_token', '\\s.*$'), ('dot_suffix', '\\.[12]$'), ('slash_suffix', '/[12]$'), ('space_suffix', '\\s+[12](:.*)?$'), ('identical_ids', '^$')) v(rule, pat) GROUP BY rule""")
def h53(s, d):
    from ..operators.pairs import pair_rule_rates

    return pair_rule_rates(reads(s, d))


# ------------------------------------------------------------------ anchored hits on reads

RHITS = f"""{READS}, rh0 AS (SELECT *, greatest(1, least(20 + (doc_id + tile) % 30, length(seq) // 3)) AS span,
  1 + (doc_id * 7 + tile * 11) % 120 % greatest(1, length(seq) - 3 * greatest(1, least(20 + (doc_id + tile) % 30, length(seq) // 3)) + 1) AS s0,
  (doc_id + tile) % 3 = 0 AS rev, CASE WHEN tile % 2 = 0 THEN 'N' ELSE 'C' END AS side FROM reads),
rh AS (SELECT *, s0 + 3 * span - 1 AS e0, CASE WHEN rev THEN s0 + 3 * span - 1 ELSE s0 END AS sstart, CASE WHEN rev THEN s0 ELSE s0 + 3 * span - 1 END AS send,
 CASE WHEN side = 'N' THEN {G0} - 1 - doc_id % 3 - span + 1 ELSE {G1} + 1 + doc_id % 3 END AS qstart, CASE WHEN side = 'N' THEN {G0} - 1 - doc_id % 3 ELSE {G1} + doc_id % 3 + span END AS qend FROM rh0)"""


def rhits(s, d):
    """A hit on every read, within it where the read holds a codon."""
    k, whole = F.col("doc_id") % 3, F.length("seq")
    span = F.greatest(F.lit(1), F.least(20 + (F.col("doc_id") + F.col("tile")) % 30, F.floor(whole / 3)))
    r = reads(s, d).withColumn("span", span).withColumns({
        "s0": 1 + (F.col("doc_id") * 7 + F.col("tile") * 11) % 120 % F.greatest(F.lit(1), whole - 3 * F.col("span") + 1),
        "rev": (F.col("doc_id") + F.col("tile")) % 3 == 0, "side": F.when(F.col("tile") % 2 == 0, "N").otherwise("C")})
    e0 = F.col("s0") + 3 * F.col("span") - 1
    n = F.col("side") == "N"
    return r.withColumns({
        "sstart": F.when(F.col("rev"), e0).otherwise(F.col("s0")), "send": F.when(F.col("rev"), F.col("s0")).otherwise(e0),
        "qstart": F.when(n, G0 - k - F.col("span")).otherwise(G1 + 1 + k), "qend": F.when(n, G0 - 1 - k).otherwise(G1 + k + F.col("span"))})


def cstart(p):
    return f"(CASE WHEN sstart < send THEN sstart + ({p} - qstart) * 3 ELSE sstart - ({p} - qstart) * 3 - 2 END)"


def codon_at(p):
    raw = f"substr(seq, {cstart(p)}, 3)"
    return f"(CASE WHEN sstart < send THEN {raw} ELSE {RC(raw)} END)"


@query("h24_codon_window", "read_id s, hsp_strand s, codon_nt_start i, codon_nt_end i",
       f"WITH {RHITS} SELECT read_id, CASE WHEN sstart < send THEN 'forward' ELSE 'reverse' END AS hsp_strand, {cstart(35)} AS codon_nt_start, {cstart(35)} + 2 AS codon_nt_end FROM rh")
def h24(s, d):
    st = rd.codon_start("qstart", "sstart", "send", F.lit(35))
    return rhits(s, d).select("read_id", rd.strand("sstart", "send").alias("hsp_strand"), st.alias("codon_nt_start"), (st + 2).alias("codon_nt_end"))


def _q(i):
    return f"ascii(substr(qual, {cstart(18)} + {i}, 1)) - 33"


@query("h25_base_evidence", "read_id s, note s, codon s, translated_aa s, codon_qual_pos1 i, codon_qual_pos2 i, codon_qual_pos3 i, codon_min_qual i, codon_mean_qual d2", f"""
WITH {RHITS}, x AS (SELECT read_id, {cstart(18)} AS st, length(seq) AS n, {codon_at(18)} AS c, sstart < send AS f, {_q(0)} AS a, {_q(1)} AS b, {_q(2)} AS z FROM rh),
y AS (SELECT *, st >= 1 AND st + 2 <= n AS ok FROM x)
SELECT read_id, CASE WHEN ok THEN '' ELSE 'codon_off_read' END AS note, CASE WHEN ok THEN c ELSE '' END AS codon, CASE WHEN ok THEN {sql_codon('c')} ELSE '' END AS translated_aa,
 CASE WHEN ok THEN CASE WHEN f THEN a ELSE z END ELSE -1 END AS codon_qual_pos1, CASE WHEN ok THEN b ELSE -1 END AS codon_qual_pos2, CASE WHEN ok THEN CASE WHEN f THEN z ELSE a END ELSE -1 END AS codon_qual_pos3,
 CASE WHEN ok THEN least(a, b, z) ELSE -1 END AS codon_min_qual, CASE WHEN ok THEN round((a + b + z) / 3, 2) ELSE -1 END AS codon_mean_qual FROM y""")
def h25(s, d):
    e = au.base_evidence(rhits(s, d).withColumn("target_position", F.lit(18)))
    return e.fillna({"codon": "", "translated_aa": "", "codon_mean_qual": -1.0, **{c: -1 for c in ("codon_qual_pos1", "codon_qual_pos2", "codon_qual_pos3", "codon_min_qual")}})


@query("h27_original_coordinates", "read_id s, c_start i, c_end i",
       f"WITH {RHITS} SELECT read_id, CASE WHEN rev THEN length(seq) - (s0 + 2) + 1 ELSE s0 END AS c_start, CASE WHEN rev THEN length(seq) - s0 + 1 ELSE s0 + 2 END AS c_end FROM rh")
def h27(s, d):
    o = rhits(s, d).withColumn("o", rd.original_coordinates("s0", F.col("s0") + 2, F.length("seq"), "rev"))
    return o.select("read_id", F.col("o.start").alias("c_start"), F.col("o.end").alias("c_end"))


@query("h28_codon_quality", "read_id s, q1 i, q3 i, min_qual i, mean_qual d2", f"""
WITH {RHITS}, x AS (SELECT read_id, rev, ascii(substr(qual, s0, 1)) - 33 AS a, ascii(substr(qual, s0 + 1, 1)) - 33 AS b, ascii(substr(qual, s0 + 2, 1)) - 33 AS c FROM rh)
SELECT read_id, CASE WHEN rev THEN c ELSE a END AS q1, CASE WHEN rev THEN a ELSE c END AS q3, least(a, b, c) AS min_qual, round((a + b + c) / 3, 2) AS mean_qual FROM x""")
def h28(s, d):
    r = rhits(s, d).withColumn("q", rd.codon_quality("qual", F.col("s0").cast("int"), "rev"))
    return r.select("read_id", "q.q1", "q.q3", "q.min_qual", "q.mean_qual")


TAILS = f"""{RHITS}, t0 AS (SELECT *, CASE WHEN side = 'N' AND NOT rev THEN send + 1 WHEN side = 'C' AND rev THEN sstart + 1 ELSE 1 END AS lo_nt,
 CASE WHEN side = 'N' AND rev THEN send - 1 WHEN side = 'C' AND NOT rev THEN sstart - 1 ELSE length(seq) END AS hi_nt,
 CASE WHEN side = 'N' THEN greatest(qend + 1, {G0}) ELSE greatest({G0}, CASE WHEN rev THEN qstart - (length(seq) - sstart) // 3 ELSE qstart - (sstart - 1) // 3 END) END AS lo_p,
 CASE WHEN side = 'N' THEN least({G1}, CASE WHEN rev THEN qstart + (sstart - 3) // 3 ELSE qstart + (length(seq) - sstart - 2) // 3 END) ELSE least(qstart - 1, {G1}) END AS hi_p
 FROM rh),
t1 AS (SELECT *, lo_nt <= hi_nt AS has, list_transform(range(lo_p, hi_p + 1), lambda p: {codon_at('p')}) AS codons FROM t0),
t2 AS (SELECT *, CASE WHEN has THEN lo_nt END AS nt_start, CASE WHEN has THEN hi_nt END AS nt_end, CASE WHEN NOT has THEN '' WHEN rev THEN {RC('substr(seq, lo_nt, hi_nt - lo_nt + 1)')} ELSE substr(seq, lo_nt, hi_nt - lo_nt + 1) END AS segment,
 coalesce(array_to_string(list_transform(codons, lambda c: {sql_codon('c')}), ''), '') AS pep FROM t1),
t3 AS (SELECT *, repeat('G', CAST(greatest(lo_p - 1, 0) AS INTEGER)) || CASE doc_id % 3 WHEN 0 THEN translate(pep, 'LSR', 'WWW') WHEN 1 THEN translate(pep, 'LSRTPAVG', 'WWWWWWWW') ELSE reverse(pep) END AS reference FROM t2)"""


def tails(s, d):
    r = rhits(s, d)
    r = once(r, {"_g": tl.gap_facing()}).select("*", "_g.nt_start", "_g.nt_end", "_g.segment").drop("_g")
    r = tl.extend_into_gap(r, G0, G1)
    r = once(r, {"_pep": F.array_join(F.transform("extension", lambda x: x["aa"]), "")})
    pep = F.col("_pep")
    lo, _ = tl.extension_range(G0, G1)
    k = F.col("doc_id") % 3
    ref = F.when(k == 0, F.translate(pep, "LSR", "WWW")).when(k == 1, F.translate(pep, "LSRTPAVG", "WWWWWWWW")).otherwise(F.reverse(pep))
    return r.withColumn("reference", F.concat(F.repeat(F.lit("G"), F.greatest(lo - 1, F.lit(0))), ref))


@query("h29_gap_facing_segment", "read_id s, nt_start i, nt_end i, segment s", f"WITH {TAILS} SELECT read_id, coalesce(nt_start, -1) AS nt_start, coalesce(nt_end, -1) AS nt_end, segment FROM t3")
def h29(s, d):
    return tails(s, d).fillna({"nt_start": -1, "nt_end": -1})


@query("h30_extension_into_gap", "read_id s, position i, codon s, aa s",
       f"WITH {TAILS}, e AS (SELECT read_id, lo_p, unnest(codons) AS codon, unnest(range(lo_p, hi_p + 1)) AS position FROM t3) SELECT read_id, position, codon, {sql_codon('codon')} AS aa FROM e")
def h30(s, d):
    return tails(s, d).select("read_id", F.explode("extension").alias("x")).select("read_id", "x.position", "x.codon", "x.aa")


CLASSED = f"""{TAILS}, c0 AS (SELECT *, list_filter(range(1, length(pep) + 1), lambda i: substr(pep, i, 1) <> 'X' AND lo_p + i - 1 <= length(reference)) AS seen FROM t3),
c1 AS (SELECT *, len(seen) AS n, len(list_filter(seen, lambda i: substr(pep, i, 1) = substr(reference, lo_p + i - 1, 1))) AS m FROM c0),
c2 AS (SELECT *, CASE WHEN n > 0 THEN 100.0 * m / n ELSE 0 END AS pct, length(segment) < 30 OR pep = '' AS none FROM c1),
ct AS (SELECT *, CASE WHEN none THEN 'D' WHEN m >= 10 AND pct >= 50 THEN 'A' WHEN m >= 6 AND pct >= 30 THEN 'B' ELSE 'C' END AS evidence_class,
 CASE WHEN none THEN NULL ELSE lo_p END AS gap_position_start, CASE WHEN none THEN NULL ELSE hi_p END AS gap_position_end FROM c2)"""


def graded(s, d):
    return tl.evidence_class(tails(s, d), "reference")


@query("h31_evidence_class", "read_id s, evidence_class s, aligned_aa i, matching_aa i, pident_aa d1, gap_position_start i, gap_position_end i, translated_candidate s, composition_similarity d3", f"""
WITH {CLASSED} SELECT read_id, evidence_class, CASE WHEN none THEN -1 ELSE n END AS aligned_aa, CASE WHEN none THEN -1 ELSE m END AS matching_aa, CASE WHEN none THEN -1 ELSE round(pct, 1) END AS pident_aa,
 coalesce(gap_position_start, -1) AS gap_position_start, coalesce(gap_position_end, -1) AS gap_position_end, CASE WHEN none THEN '' ELSE pep END AS translated_candidate,
 CASE WHEN none THEN -1 ELSE round(length(regexp_replace(pep, '[^K]', '', 'g')) / length(pep) / 0.369, 3) END AS composition_similarity FROM ct""")
def h31(s, d):
    return graded(s, d).fillna({"aligned_aa": -1, "matching_aa": -1, "pident_aa": -1.0, "gap_position_start": -1, "gap_position_end": -1, "translated_candidate": "", "composition_similarity": -1.0})


@query("b7_valid_gap_rows", "side s, length_matches b, n i",
       f"""WITH {CLASSED} SELECT side, length(pep) = gap_position_end - gap_position_start + 1 AS length_matches, count(*) AS n FROM ct WHERE NOT none AND gap_position_start >= {G0 + 5} AND gap_position_end <= {G1} GROUP BY ALL""")
def b7(s, d):
    v = tl.valid_gap_rows(graded(s, d), G0 + 5, G1)
    return v.groupBy("side", "length_matches").agg(F.count(F.lit(1)).alias("n"))


REPORTED = "CASE doc_id % 4 WHEN 0 THEN pep WHEN 1 THEN translate(pep, 'L', 'V') WHEN 2 THEN reverse(pep) ELSE pep || 'K' END"


def reported(s, d):
    g = graded(s, d).filter(F.col("evidence_class") != "D").withColumn("role", F.col("side"))
    k, pep = F.col("doc_id") % 4, F.col("translated_candidate")
    r = F.when(k == 0, pep).when(k == 1, F.translate(pep, "L", "V")).when(k == 2, F.reverse(pep)).otherwise(F.concat(pep, F.lit("K")))
    return g.withColumn("translated_candidate", r)


REP = f"{CLASSED}, rp AS (SELECT *, {REPORTED} AS reported FROM ct WHERE NOT none)"


@query("b8_discordant_length_listing", "read_id s, peptide_length i, window_length i",
       f"WITH {REP} SELECT read_id, length(reported) AS peptide_length, hi_p - lo_p + 1 AS window_length FROM rp WHERE length(reported) <> hi_p - lo_p + 1")
def b8(s, d):
    v = tl.valid_gap_rows(reported(s, d), G0, G1).filter(~F.col("length_matches"))
    return v.select("read_id", F.length("translated_candidate").alias("peptide_length"), (F.col("gap_position_end") - F.col("gap_position_start") + 1).alias("window_length"))


@query("h34_pair_consolidation", "pair_id s, pair_class s, both_reach_gap b, pair_gap_start i, pair_gap_end i, pair_gap_span_aa i, full_gap b", f"""
WITH {CLASSED}, p AS (SELECT pair_id, max(evidence_class) FILTER (WHERE side = 'N') AS nc, max(evidence_class) FILTER (WHERE side = 'C') AS cc, max(gap_position_start) FILTER (WHERE side = 'N') AS ns, max(gap_position_end) FILTER (WHERE side = 'N') AS ne,
 max(gap_position_start) FILTER (WHERE side = 'C') AS cs, max(gap_position_end) FILTER (WHERE side = 'C') AS ce FROM ct GROUP BY pair_id), q AS (SELECT *, ns IS NOT NULL AND cs IS NOT NULL AS both_ FROM p)
SELECT pair_id, CASE WHEN nc = 'A' AND cc = 'A' THEN 'A/A' WHEN nc = 'A' OR cc = 'A' THEN 'A/other' WHEN nc = 'D' AND cc = 'D' THEN 'D/D' WHEN nc IS NOT NULL AND cc IS NOT NULL THEN 'other' END AS pair_class, both_ AS both_reach_gap,
 CASE WHEN both_ THEN least(ns, cs) ELSE -1 END AS pair_gap_start, CASE WHEN both_ THEN greatest(ne, ce) ELSE -1 END AS pair_gap_end, CASE WHEN both_ THEN greatest(ne, ce) - least(ns, cs) + 1 ELSE -1 END AS pair_gap_span_aa,
 both_ AND least(ns, cs) <= {G0} AND greatest(ne, ce) >= {G1} AS full_gap FROM q""")
def h34(s, d):
    m = merge_roles(graded(s, d).withColumn("role", F.col("side")), ["evidence_class", "gap_position_start", "gap_position_end"])
    return consolidate(m, G0, G1).fillna({"pair_gap_start": -1, "pair_gap_end": -1, "pair_gap_span_aa": -1})


def _seg_codon(r):
    return f"CASE WHEN (position - start_{r}) * 3 + 3 <= length(segment_{r}) THEN substr(segment_{r}, (position - start_{r}) * 3 + 1, 3) END"


CONF = f"""{REP}, w AS (SELECT pair_id, max(segment) FILTER (WHERE side = 'N') AS segment_n, max(lo_p) FILTER (WHERE side = 'N') AS start_n, max(hi_p) FILTER (WHERE side = 'N') AS end_n, max(reported) FILTER (WHERE side = 'N') AS reported_n,
 max(segment) FILTER (WHERE side = 'C') AS segment_c, max(lo_p) FILTER (WHERE side = 'C') AS start_c, max(hi_p) FILTER (WHERE side = 'C') AS end_c, max(reported) FILTER (WHERE side = 'C') AS reported_c FROM rp GROUP BY pair_id),
x AS (SELECT *, unnest(range(greatest(start_n, start_c), least(end_n, end_c) + 1)) AS position FROM w WHERE start_n IS NOT NULL AND start_c IS NOT NULL),
cf AS (SELECT *, substr(reported_n, position - start_n + 1, 1) AS aa_n, substr(reported_c, position - start_c + 1, 1) AS aa_c, {_seg_codon('n')} AS codon_n, {_seg_codon('c')} AS codon_c,
 CASE WHEN length(segment_n) % 3 = 0 THEN 'frame_consistent' ELSE 'frame_inconsistent' END AS frame_n, CASE WHEN length(segment_c) % 3 = 0 THEN 'frame_consistent' ELSE 'frame_inconsistent' END AS frame_c FROM x),
cg AS (SELECT *, least(end_n, end_c) - greatest(start_n, start_c) + 1 AS overlap_len_aa, CASE WHEN codon_n IS NULL OR codon_c IS NULL THEN 'unresolved_missing_nt' WHEN codon_n = codon_c AND aa_n <> aa_c THEN 'nucleotide_identical_translation_discrepancy'
 WHEN frame_n = 'frame_inconsistent' OR frame_c = 'frame_inconsistent' THEN 'frame_inconsistent_tail' WHEN codon_n <> codon_c AND aa_n = aa_c THEN 'synonymous_nucleotide_difference'
 WHEN codon_n IN ('AAA', 'AAG', 'GAA', 'GAG') AND codon_c IN ('AAA', 'AAG', 'GAA', 'GAG') THEN 'low_complexity_Lys_Glu_region' WHEN codon_n <> codon_c AND aa_n <> aa_c THEN 'nonsynonymous_nucleotide_difference' ELSE 'unresolved' END AS conflict_class FROM cf)"""


def conflict_rows(s, d, frames=False):
    return au.overlap_calls(reported(s, d), frames=frames)


@query("h35_segment_codon", "pair_id s, position i, codon_n s, codon_c s", f"WITH {CONF} SELECT pair_id, position, coalesce(codon_n, '') AS codon_n, coalesce(codon_c, '') AS codon_c FROM cg")
def h35(s, d):
    t = reported(s, d)
    r = au.attach_tails(au.overlap_calls(t).select("pair_id", "position"), t)
    return r.select("pair_id", "position", *[F.coalesce(rd.segment_codon(f"segment_{k}", f"start_{k}", f"end_{k}", "position"), F.lit("")).alias(f"codon_{k}") for k in "nc"])


@query("h36_frame_and_codon_flags", "pair_id s, position i, frame_n s, frame_c s, n_is_lys b, c_is_lys b, n_is_glu b, c_is_glu b", f"""
WITH {CONF} SELECT pair_id, position, frame_n, frame_c, coalesce(codon_n IN ('AAA', 'AAG'), false) AS n_is_lys, coalesce(codon_c IN ('AAA', 'AAG'), false) AS c_is_lys, coalesce(codon_n IN ('GAA', 'GAG'), false) AS n_is_glu, coalesce(codon_c IN ('GAA', 'GAG'), false) AS c_is_glu FROM cg""")
def h36(s, d):
    return au.conflict_audit(conflict_rows(s, d))


@query("h37_conflict_classification", "pair_id s, position i, aa_n s, aa_c s, overlap_len_aa i, conflict_class s", f"WITH {CONF} SELECT * FROM cg")
def h37(s, d):
    return au.conflict_audit(conflict_rows(s, d))


def _frame(seg, rep, rc=False):
    x = RC(seg) if rc else seg
    return "CASE " + " ".join(f"WHEN {sql_translate(x, f)} = {rep} THEN {f}" for f in (1, 2, 3)) + " END"


@query("h38_frame_audit", "read_id s, matched_frame i, direct_frame_class s", f"""
WITH {REP}, f AS (SELECT read_id, {_frame('segment', 'reported')} AS f, {_frame('segment', 'reported', True)} AS r FROM rp)
SELECT read_id, coalesce(f, r, 0) AS matched_frame, CASE WHEN f = 1 THEN 'frame_1_match' WHEN f IS NOT NULL THEN 'non_frame_1_forward' WHEN r IS NOT NULL THEN 'reverse_complement_required' ELSE 'translation_not_reproduced' END AS direct_frame_class FROM f""")
def h38(s, d):
    return au.frame_audit(reported(s, d)).fillna({"matched_frame": 0})


@query("h39_anomaly_cause", "pair_id s, position i, frame_n_matched s, frame_c_matched s, diagnostic_cause s", f"""
WITH {CONF}, a AS (SELECT *, {_frame('segment_n', 'reported_n')} AS fn, {_frame('segment_c', 'reported_c')} AS fc, {_frame('segment_n', 'reported_n', True)} AS rn, {_frame('segment_c', 'reported_c', True)} AS rc FROM cg)
SELECT pair_id, position, coalesce('+' || fn, 'RC/None') AS frame_n_matched, coalesce('+' || fc, 'RC/None') AS frame_c_matched,
 CASE WHEN fn = 1 AND fc = 1 THEN 'both_in_frame_1' WHEN fn > 1 THEN 'n_tail_shift:' || (fn - 1)
 WHEN fc > 1 THEN 'c_tail_shift:' || (fc - 1) WHEN rn IS NOT NULL OR rc IS NOT NULL THEN 'reverse_strand'
 ELSE 'not_reproduced' END AS diagnostic_cause FROM a""")
def h39(s, d):
    return au.anomaly_cause(conflict_rows(s, d, frames=True))


def _ctx(r):
    at = f"((position - start_{r}) * 3 + 1)"
    return f"substr(segment_{r}, greatest(1, {at} - 6), greatest(0, least(length(segment_{r}), {at} + 8) - greatest(1, {at} - 6) + 1))"


@query("h40_substitution_context", "pair_id s, position i, context_n s, context_c s, is_valid_substitution b", f"""
WITH {CONF} SELECT pair_id, position, {_ctx('n')} AS context_n, {_ctx('c')} AS context_c, coalesce(length(codon_n) = 3 AND length(codon_c) = 3 AND codon_n <> codon_c AND aa_n <> aa_c, false) AS is_valid_substitution FROM cg""")
def h40(s, d):
    return au.substitution_context(au.conflict_audit(conflict_rows(s, d)))


WIN = f"""{REP}, wn AS (SELECT *, CASE WHEN NOT rev THEN sstart + (lo_p - qstart) * 3 ELSE sstart - (hi_p - qstart) * 3 - 2 END AS ws, CASE WHEN NOT rev THEN sstart + (hi_p - qstart) * 3 + 2 ELSE sstart - (lo_p - qstart) * 3 END AS we FROM rp)"""


@query("h41_window_nesting", "read_id s, strand s, window_start i, window_end i, is_nested b, overlap_bp i, phase_offset i", f"""
WITH {WIN} SELECT read_id, CASE WHEN rev THEN '-' ELSE '+' END AS strand, ws AS window_start, we AS window_end, ws >= nt_start AND we <= nt_end AS is_nested, greatest(0, least(we, nt_end) - greatest(ws, nt_start) + 1) AS overlap_bp,
 ((ws - nt_start) % 3 + 3) % 3 AS phase_offset FROM wn""")
def h41(s, d):
    return au.window_nesting(reported(s, d))


def disc(aware):
    local = "CASE WHEN rev THEN nt_end - we + 1 ELSE ws - nt_start + 1 END" if aware else "ws - nt_start + 1"
    return f"""{WIN}, d0 AS (SELECT *, {local} AS lo FROM wn), d1 AS (SELECT *, lo >= 1 AND lo + (we - ws) <= length(segment) AS ok FROM d0),
    d2 AS (SELECT *, CASE WHEN ok THEN {sql_translate('substr(segment, lo, we - ws + 1)')} END AS recon FROM d1),
    d3 AS (SELECT *, CASE WHEN length(recon) = length(reported) THEN length(reported) - {sql_match('recon', 'reported')} END AS mm FROM d2),
    da AS (SELECT *, CASE WHEN NOT ok THEN 'codon_window_outside_gap_facing_sequence' WHEN recon = reported THEN 'direct_translation_reproduces_reported_candidate' WHEN mm IS NULL THEN 'translation_length_discordance' ELSE 'same_length_amino_acid_discordance' END AS cls FROM d3)"""


DISC_COLS = "read_id s, extraction_status s, reconstructed_aa s, aa_mismatch_count i, discordance_class s"


def _disc_sql(aware):
    return f"WITH {disc(aware)} SELECT read_id, CASE WHEN ok THEN 'success' ELSE 'codon_window_outside_gap_facing_sequence' END AS extraction_status, coalesce(recon, '') AS reconstructed_aa, coalesce(mm, -1) AS aa_mismatch_count, cls AS discordance_class FROM da"


@query("h42_discordance_audit", DISC_COLS, _disc_sql(True))
def h42(s, d):
    return au.discordance_audit(reported(s, d)).fillna({"reconstructed_aa": "", "aa_mismatch_count": -1})


@query("h42_discordance_audit_published_offsets", DISC_COLS, _disc_sql(False))
def h42b(s, d):
    return au.discordance_audit(reported(s, d), strand_aware=False).fillna({"reconstructed_aa": "", "aa_mismatch_count": -1})


@query("h43_provenance_class", "read_id s, first_idx i, mismatch_positions i, reported_residue s, frame0_codon s, frame0_aa s, hamming_distance i, provenance_class s", f"""
WITH {disc(True)}, b AS (SELECT unnest(['T', 'C', 'A', 'G']) AS x), all64 AS (SELECT b1.x || b2.x || b3.x AS c FROM b b1, b b2, b b3), tb AS (SELECT c, {sql_codon('c')} AS residue FROM all64),
hm AS (SELECT a.c AS codon, tb.residue, min(hamming(a.c, tb.c)) AS dist FROM all64 a, tb GROUP BY ALL),
p0 AS (SELECT *, list_filter(range(1, least(length(reported), length(recon)) + 1), lambda i: substr(reported, i, 1) <> substr(recon, i, 1)) AS dd FROM da WHERE ok),
p1 AS (SELECT *, dd[1] AS fi, lo + (dd[1] - 1) * 3 AS z FROM p0 WHERE len(dd) > 0),
p2 AS (SELECT *, substr(reported, fi, 1) AS rr, CASE WHEN z + 2 <= length(segment) THEN substr(segment, z, 3) END AS c0, CASE WHEN z + 3 <= length(segment) THEN substr(segment, z + 1, 3) END AS c1, CASE WHEN z + 4 <= length(segment) THEN substr(segment, z + 2, 3) END AS c2 FROM p1),
p3 AS (SELECT p2.*, {sql_codon('c0')} AS a0, {sql_codon('c1')} AS a1, {sql_codon('c2')} AS a2, dist FROM p2 LEFT JOIN hm ON hm.codon = c0 AND hm.residue = rr)
SELECT read_id, fi AS first_idx, len(dd) AS mismatch_positions, rr AS reported_residue, coalesce(c0, '') AS frame0_codon, coalesce(a0, '') AS frame0_aa, coalesce(dist, -1) AS hamming_distance,
 CASE WHEN c0 IS NULL THEN 'E_insufficient_nucleotide_evidence' WHEN a0 = rr THEN 'A_translation_bookkeeping_mismatch' WHEN coalesce(a1 = rr, false) OR coalesce(a2 = rr, false) THEN 'C_codon_boundary_frame_interpretation'
 WHEN dist = 1 THEN 'D_single_nucleotide_difference_candidate' WHEN dist >= 2 THEN 'B_extraction_provenance_nucleotide_mismatch' ELSE 'E_ambiguous_evidence' END AS provenance_class FROM p3""")
def h43(s, d):
    p = au.provenance_audit(au.discordance_audit(reported(s, d)).filter(F.col("extraction_status") == "success"))
    return p.fillna({"frame0_codon": "", "frame0_aa": "", "hamming_distance": -1})


@query("h44_orientation_diagnostic", "read_id s, note s, id_as_is d, id_rc d, id_as_is_control d, id_rc_control d, best_orientation s, length_difference i, control_excess d, control_excess_flag b", f"""
WITH {CLASSED}, o0 AS (SELECT *, CASE WHEN NOT rev THEN sstart + (lo_p - qstart) * 3 ELSE sstart - (hi_p - qstart) * 3 - 2 END AS lo, CASE WHEN NOT rev THEN sstart + (hi_p - qstart) * 3 + 2 ELSE sstart - (lo_p - qstart) * 3 END AS hi FROM ct WHERE NOT none),
o1 AS (SELECT *, CASE WHEN lo >= 1 AND hi <= length(seq) THEN substr(seq, lo, hi - lo + 1) END AS raw, CASE WHEN lo >= 1 AND hi <= length(seq) THEN substr(reference, lo_p, hi_p - lo_p + 1) END AS ref FROM o0),
o2 AS (SELECT *, {sql_translate('raw')} AS a, {sql_translate(RC('raw'))} AS b, reverse(ref) AS fer FROM o1),
o3 AS (SELECT *, {sql_match('a', 'ref')} AS m1, {sql_match('b', 'ref')} AS m2, {sql_match('a', 'fer')} AS m3, {sql_match('b', 'fer')} AS m4, least(length(a), length(ref)) AS n1, least(length(b), length(ref)) AS n2 FROM o2),
o4 AS (SELECT *, 100.0 * m1 / n1 AS i1, 100.0 * m2 / n2 AS i2, 100.0 * m3 / n1 AS i3, 100.0 * m4 / n2 AS i4 FROM o3)
SELECT read_id, i1 AS id_as_is, i2 AS id_rc, i3 AS id_as_is_control, i4 AS id_rc_control, CASE WHEN raw IS NULL THEN 'window_off_read' ELSE '' END AS note, CASE WHEN i1 >= i2 THEN 'as_is' WHEN i2 IS NOT NULL THEN 'reverse_complement' END AS best_orientation, length(a) - length(ref) AS length_difference,
 greatest(i3 - i1, i4 - i2) AS control_excess, coalesce(5 * (m3 - m1) >= n1 OR 5 * (m4 - m2) >= n2, false) AS control_excess_flag FROM o4""")
def h44(s, d):
    g = graded(s, d).filter(F.col("evidence_class") != "D")
    return au.orientation_diagnostic(g, "reference")


@query("h45_ground_truth_validation", "read_id s, our_translation s, matches_sseq_pct d, length_difference i, sseq_vs_qseq_pct d, status s", f"""
WITH {RHITS}, v0 AS (SELECT read_id, doc_id, rev, substr(seq, least(sstart, send), greatest(sstart, send) - least(sstart, send) + 1 - CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END) AS raw FROM rh),
v1 AS (SELECT *, CASE WHEN rev THEN {RC('raw')} ELSE raw END AS o FROM v0), v2 AS (SELECT *, {sql_translate('o')} AS tr FROM v1),
v3 AS (SELECT *, CASE WHEN length(raw) % 3 = 0 THEN tr END AS ours, CASE doc_id % 4 WHEN 0 THEN substr(tr, 1, 5) || '-' || substr(tr, 6) WHEN 1 THEN translate(tr, 'L', 'V') WHEN 2 THEN substr(tr, 2) ELSE tr END AS sseq, translate(tr, 'S', 'T') AS qseq FROM v2),
v4 AS (SELECT *, replace(sseq, '-', '') AS su FROM v3),
v5 AS (SELECT *, CASE WHEN length(ours) = length(su) THEN 100.0 * {sql_match('ours', 'su')} / length(su) END AS mp, CASE WHEN length(su) = length(qseq) AND length(su) > 0 THEN 100.0 * {sql_match('su', 'qseq')} / length(su) END AS sp FROM v4)
SELECT read_id, coalesce(ours, '') AS our_translation, coalesce(mp, -1) AS matches_sseq_pct, coalesce(length(ours) - length(su), -99) AS length_difference, coalesce(sp, -1) AS sseq_vs_qseq_pct,
 CASE WHEN ours IS NULL THEN 'NON_MULTIPLE_OF_3' WHEN length(ours) <> length(su) THEN 'LENGTH_MISMATCH' WHEN mp = 100 THEN 'PASS' ELSE 'FAIL' END AS status FROM v5""")
def h45(s, d):
    r = rhits(s, d)
    short = F.when(F.col("doc_id") % 7 == 0, 1).otherwise(0)
    r = r.withColumns({"sstart": F.when(F.col("rev"), F.col("sstart") - short).otherwise(F.col("sstart")), "send": F.when(F.col("rev"), F.col("send")).otherwise(F.col("send") - short)})
    raw = F.substring(F.col("seq"), F.least("sstart", "send").cast("int"), (F.abs(F.col("send") - F.col("sstart")) + 1).cast("int"))
    tr = sq.translate_frame(F.when(F.col("rev"), sq.reverse_complement(raw)).otherwise(raw))
    k = F.col("doc_id") % 4
    r = once(r, {"_t": tr}).withColumns({
        "sseq": F.when(k == 0, F.concat(F.substring("_t", 1, 5), F.lit("-"), F.substring(F.col("_t"), F.lit(6), F.length("_t")))).when(k == 1, F.translate("_t", "L", "V"))
        .when(k == 2, F.substring(F.col("_t"), F.lit(2), F.length("_t"))).otherwise(F.col("_t")), "qseq": F.translate("_t", "S", "T")})
    return au.validate_hits(r).fillna({"our_translation": "", "matches_sseq_pct": -1.0, "length_difference": -99, "sseq_vs_qseq_pct": -1.0})


@query("h56_rounding", "l_orderkey i, l_linenumber i, l_partkey i, half_even i, half_up i",
       "SELECT *, round_even(l_quantity / 2, 0) AS half_even, round(l_quantity / 2, 0) AS half_up FROM lineitem")
def h56(s, d):
    return table(s, d, "lineitem").withColumns({"half_even": F.bround(F.col("l_quantity") / 2, 0), "half_up": F.round(F.col("l_quantity") / 2, 0)})


@query("h46_anchor_window", "gene s, position i, anchor s", f"""
WITH {PROTEINS}, p AS (SELECT gene, seq, unnest([4, 20, 35, 48]) AS position FROM proteins)
SELECT gene, position, substr(seq, greatest(1, position - 8), greatest(0, least(length(seq), position + 8) - greatest(1, position - 8) + 1)) AS anchor FROM p""")
def h46(s, d):
    p = proteins(s, d).select("gene", "seq", F.explode(F.array(*[F.lit(x) for x in (4, 20, 35, 48)])).alias("position"))
    return p.select("gene", "position", anchor_window("seq", "position").alias("anchor"))


IUPAC_CASE = "CASE x " + " ".join(f"WHEN '{a}' THEN '{residue_to_iupac(a)}'" for a in sorted(set(sq.AA64))) + " ELSE 'NNN' END"


@query("h47_degenerate_pattern", "gene s, forward_pattern s, reverse_pattern s", f"""
WITH {PROTEINS}, a AS (SELECT gene, list_filter(string_split(substr(seq, 12, 17), ''), lambda x: x <> '') AS l FROM proteins),
p AS (SELECT gene, array_to_string(list_transform(l, lambda x, i: CASE WHEN i = 9 THEN 'NNN' ELSE {IUPAC_CASE} END), '') AS f FROM a) SELECT gene, f AS forward_pattern, {RC('f')} AS reverse_pattern FROM p""")
def h47(s, d):
    p = proteins(s, d).select("gene", degenerate_pattern_column(anchor_window("seq", F.lit(20)), 9).alias("forward_pattern"))
    return p.withColumn("reverse_pattern", sq.reverse_complement("forward_pattern"))


@query("c7_extract_reads_by_id", "pair_id s, mate s, read_id s", f"""
WITH {READS}, ids AS (SELECT DISTINCT 'D' || doc_id || ':0' AS pair_id FROM labels) SELECT pair_id, mate, read_id FROM reads WHERE pair_id IN (SELECT pair_id FROM ids)""")
def c7(s, d):
    ids = table(s, d, "labels").select(F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(":0")).alias("pair_id"))
    return extract_reads(reads(s, d), ids, F.col("read_index"))


@query("c7_extraction_report", "mate s, requested i, found i, missing i, duplicates i", f"""
WITH {READS}, ids AS (SELECT DISTINCT 'D' || doc_id || ':0' AS pair_id FROM labels), h AS (SELECT ids.pair_id, m.mate, count(r.read_id) AS n FROM ids, (VALUES ('R1'), ('R2')) m(mate) LEFT JOIN reads r ON r.pair_id = ids.pair_id AND r.mate = m.mate GROUP BY ALL)
SELECT mate, count(*) AS requested, count(*) FILTER (WHERE n > 0) AS found, count(*) FILTER (WHERE n = 0) AS missing, sum(greatest(n - 1, 0)) AS duplicates FROM h GROUP BY mate""")
def c7b(s, d):
    ids = table(s, d, "labels").select(F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(":0")).alias("pair_id"))
    return extraction_report(ids, reads(s, d))


@query("d39_discordance_class_counts", "discordance_class s, n i, percent d1", f"WITH {disc(True)} SELECT cls AS discordance_class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM da GROUP BY cls")
def d39b(s, d):
    return class_counts(au.discordance_audit(reported(s, d)), ["discordance_class"])
