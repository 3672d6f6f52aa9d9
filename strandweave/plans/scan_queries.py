"""Exhaustive scan, sources and sinks, incremental ingest."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import AA64
from ..operators import scan
from ..operators.alleles import position_summary
from ..operators.summaries import metric_lines
from ..session import cut_lineage, scratch_dir
from ..sources import fastq, layout, tables
from ..streaming import ingest
from .adapters import DOCS, HITS, PROTEINS, RC, READS, documents_dna, hits, portions, proteins, reads, sql_codon, sql_match, sql_translate, table
from .registry import query

# --- fixed values: the two anchors of the scan -------------------------------------------
TARGETS = [scan.Target(40, "TLFLLCTLSSDNVYYCL", 9, 32), scan.Target(85, "YVSTRLLLALALAYVYY", 9, 77)]
# -------------------------------------------------------------------------------------------
POS = [t.position for t in TARGETS]


def _sets(pattern):
    from ..functions.sequence import IUPAC_BASES

    return "[" + ", ".join(f"'{IUPAC_BASES[c]}'" for c in pattern) + "]"


def _regex(pattern):
    from ..functions.sequence import IUPAC_BASES

    return "".join(f"[{IUPAC_BASES[c]}]" for c in pattern)


def _count(pattern):
    """SQL: placements of a degenerate pattern with at most one mismatch, one base may overhang."""
    n = len(pattern)
    return (
        f"len(list_filter(range(1, length(p) - {n} + 2), lambda st: "
        f"len(list_filter(range(1, {n + 1}), lambda i: instr({_sets(pattern)}[i], substr(p, st + i - 1, 1)) = 0)) <= 1))"
    )


CAT = scan.pattern_catalogue(TARGETS, 1)
# A read with a placement of at most one mismatch spells one half of a pattern exactly (tests compare this
# with plain counting), so the SQL counts mismatches only there; every read is looked at.
SEEDS = "|".join(_regex(h) for r in CAT for p in (r[8], r[9]) for h in (p[: len(p) // 2], p[len(p) // 2 :]))
COUNTS = f"""{READS}, padded AS (SELECT *, '#' || seq || '#' AS p FROM reads WHERE regexp_matches(seq, '{SEEDS}')),
counted AS MATERIALIZED (SELECT * EXCLUDE (p), {', '.join(f"{_count(r[8])} AS forward_count_{r[0]}, {_count(r[9])} AS reverse_count_{r[0]}" for r in CAT)} FROM padded),
cand AS (SELECT * FROM counted WHERE {' OR '.join(f"forward_count_{p} > 0 OR reverse_count_{p} > 0" for p in POS)})"""
COUNT_COLS = ", ".join(f"forward_count_{p} i, reverse_count_{p} i" for p in POS)


@query("h48_prefilter_counts", f"read_id s, {COUNT_COLS}", f"WITH {COUNTS} SELECT * FROM cand")
def h48(s, d):
    return scan.prefilter(reads(s, d), TARGETS)


@query("c18_pattern_by_read", "target_position i, mate s, reads i, placements i",
       f"WITH {COUNTS} SELECT target_position, mate, count(*) AS reads, sum(c) AS placements FROM ("
       + " UNION ALL ".join(f"SELECT {p} AS target_position, reads.mate, coalesce(forward_count_{p} + reverse_count_{p}, 0) AS c FROM reads LEFT JOIN counted USING (read_id)" for p in POS)
       + ") GROUP BY ALL")
def c18(s, d):
    r = scan.prefilter(reads(s, d), TARGETS, keep_all=True)
    sums = r.groupBy("mate").agg(F.count(F.lit(1)).alias("reads"), *[F.sum(F.col(f"forward_count_{p}") + F.col(f"reverse_count_{p}")).alias(f"_{p}") for p in POS])
    return sums.select("mate", "reads", F.inline(F.array(*[F.struct(F.lit(p).alias("target_position"), F.col(f"_{p}").alias("placements")) for p in POS])))


def _validated(source, role):
    anchors = ", ".join(f"({t.position}, '{t.anchor}', {t.offset}, {t.anchor_start})" for t in TARGETS)
    counts = ("CASE pos " + " ".join(f"WHEN {p} THEN {{0}}_count_{p}" for p in POS) + " END") if role == "PRIMARY" else "NULL"
    extra = f", {counts.format('forward')} AS prefilter_forward_count, {counts.format('reverse')} AS prefilter_reverse_count" if role == "PRIMARY" else ", NULL AS prefilter_forward_count, NULL AS prefilter_reverse_count"
    return f"""(WITH o AS (SELECT *, 'fwd' AS orientation, seq AS os, qual AS oq FROM {source} UNION ALL SELECT *, 'rev', {RC('seq')}, reverse(qual) FROM {source}),
    f AS (SELECT o.*, f.frame, {sql_translate('os', 'f.frame')} AS pep FROM o, (SELECT unnest([1, 2, 3]) AS frame) f),
    w AS (SELECT f.*, t.pos, t.anchor, t.off, t.begins, unnest(range(1, length(pep) - length(anchor) + 2)) AS i FROM f, (VALUES {anchors}) t(pos, anchor, off, begins)),
    c AS (SELECT *, substr(pep, i, length(anchor)) AS win FROM w),
    m AS (SELECT *, length(anchor) - {sql_match('win', 'anchor')} AS mm, substr(win, off, 1) AS aa, substr(anchor, off, 1) AS ref FROM c),
    k AS (SELECT *, 1 - (mm - CASE WHEN aa <> ref THEN 1 ELSE 0 END) / (length(anchor) - 1) AS ident, frame + 3 * (i - 1 + off - 1) AS cs FROM m)
    SELECT read_id, pair_id, mate, read_index, '{role}' AS evidence_role, pos AS target_position, orientation, frame, win AS anchor_candidate, ident AS anchor_identity, aa AS target_aa,
     substr(os, cs, 3) AS target_codon, ref AS expected_reference_aa, CASE WHEN aa = ref THEN 'REFERENCE_MATCH' ELSE ref || pos || aa END AS variant_class,
     CASE WHEN orientation = 'fwd' THEN cs ELSE length(seq) - cs - 1 END AS read_codon_start, least(ascii(substr(oq, cs, 1)), ascii(substr(oq, cs + 1, 1)), ascii(substr(oq, cs + 2, 1))) - 33 AS codon_min_qual,
     (ascii(substr(oq, cs, 1)) + ascii(substr(oq, cs + 1, 1)) + ascii(substr(oq, cs + 2, 1))) / 3 - 33 AS codon_mean_qual, length(seq) AS read_length,
     begins AS anchor_reference_start, begins + length(anchor) - 1 AS anchor_reference_end, anchor AS anchor_peptide, CASE WHEN aa = ref THEN 100 ELSE 0 END AS pct_reference_aa,
     CASE WHEN orientation = 'fwd' THEN cs + 2 ELSE length(seq) - cs + 1 END AS read_codon_end, 5 AS validator_max_aa_mismatch{extra}
    FROM k WHERE mm <= 5 AND ident >= 0.75 AND aa NOT IN ('X', '*'))"""


EV_COLS = ("read_id s, pair_id s, mate s, read_index i, evidence_role s, target_position i, orientation s, frame i, anchor_candidate s, anchor_identity d, target_aa s, target_codon s, "
           "expected_reference_aa s, variant_class s, read_codon_start i, codon_min_qual i, codon_mean_qual d, read_length i, anchor_reference_start i, anchor_reference_end i, anchor_peptide s, "
           "pct_reference_aa d, read_codon_end i, validator_max_aa_mismatch i, prefilter_forward_count i, prefilter_reverse_count i")


@query("h50_validate_anchors", EV_COLS, f"WITH {COUNTS} SELECT * FROM {_validated('cand', 'PRIMARY')}")
def h50(s, d):
    return scan.validate_anchors(scan.prefilter(reads(s, d), TARGETS), TARGETS)


@query("h49_best_anchor", EV_COLS,
       f"""WITH {COUNTS}, e AS (SELECT * FROM {_validated('cand', 'PRIMARY')}) SELECT * FROM e
       QUALIFY row_number() OVER (PARTITION BY read_id, mate, target_position ORDER BY anchor_identity DESC, orientation, frame,
         CASE WHEN orientation = 'fwd' THEN read_codon_start ELSE read_length - read_codon_start - 1 END) = 1""")
def h49(s, d):
    return scan.best_anchor(scan.validate_anchors(scan.prefilter(reads(s, d), TARGETS), TARGETS))


PARTNER = f"""{COUNTS}, wanted AS (SELECT pair_id, CASE WHEN mate = 'R1' THEN 'R2' ELSE 'R1' END AS mate, min(read_index) AS read_index FROM cand GROUP BY ALL),
mates AS (SELECT reads.* REPLACE (wanted.read_index AS read_index) FROM reads JOIN wanted ON reads.pair_id = wanted.pair_id AND reads.mate = wanted.mate)"""


@query("c8_mate_partner_join", "read_id s, pair_id s, mate s, read_index i", f"WITH {PARTNER} SELECT * FROM mates")
def c8(s, d):
    r = reads(s, d)
    return scan.partners(r, cut_lineage(scan.prefilter(r, TARGETS), "candidates"))


@query("c8_partners_by_layout", "read_id s, pair_id s, mate s, read_index i, seq s, qual s", f"WITH {PARTNER} SELECT * FROM mates")
def c8_layout(s, d):
    laid_out = layout.save_by_pair(reads(s, d), f"reads_{uuid.uuid4().hex}")
    return layout.partners_by_pair(laid_out, cut_lineage(scan.prefilter(laid_out, TARGETS), "candidates"))


FULL = f"{PARTNER}, every AS (SELECT * FROM {_validated('cand', 'PRIMARY')} UNION ALL SELECT * FROM {_validated('mates', 'PAIRED_PARTNER')}), " + """
final AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY read_id, mate, target_position, orientation, frame
  ORDER BY CASE WHEN evidence_role = 'PRIMARY' THEN 1 ELSE 2 END, anchor_identity DESC, codon_min_qual DESC, read_codon_start) = 1)"""


@query("s2_positional_scan", EV_COLS, f"WITH {FULL} SELECT * FROM final")
def s2(s, d):
    return scan.positional_scan(reads(s, d), TARGETS, materialise=cut_lineage)["evidence"]


@query("d31_scan_position_summary", 
       "target_position i, total_hits i, unique_read_ids i, unique_reads i, M i, L i, P i, other i, reference_aa s, reference_matches i, pct_reference_aa d, mean_anchor_identity d, median_anchor_identity d, mean_codon_min_qual d, median_codon_min_qual d",
       f"""WITH {FULL}, t AS (SELECT * FROM (VALUES {', '.join(f"({x.position}, '{x.residue}')" for x in TARGETS)}) v(target_position, reference_aa)),
       g AS (SELECT target_position, count(*) AS total_hits, count(DISTINCT read_id) AS unique_read_ids, count(DISTINCT (read_id, mate)) AS unique_reads,
       {', '.join(f"count(*) FILTER (WHERE target_aa = '{a}') AS {a}" for a in 'MLP')}, count(*) FILTER (WHERE target_aa NOT IN ('M', 'L', 'P')) AS other,
       count(*) FILTER (WHERE target_aa = expected_reference_aa) AS reference_matches, avg(anchor_identity) AS mean_anchor_identity, median(anchor_identity) AS median_anchor_identity,
       avg(codon_min_qual) AS mean_codon_min_qual, median(codon_min_qual) AS median_codon_min_qual FROM final GROUP BY target_position)
       SELECT target_position, {', '.join(f"coalesce({c}, 0) AS {c}" for c in ('total_hits', 'unique_read_ids', 'unique_reads', 'M', 'L', 'P', 'other', 'reference_matches'))}, reference_aa,
       100.0 * reference_matches / nullif(total_hits, 0) AS pct_reference_aa, mean_anchor_identity, median_anchor_identity, mean_codon_min_qual, median_codon_min_qual FROM t LEFT JOIN g USING (target_position)""")
def d31s(s, d):
    e = scan.positional_scan(reads(s, d), TARGETS, materialise=cut_lineage)["evidence"]
    return position_summary(cut_lineage(e, "final"), {t.position: t.residue for t in TARGETS})


# ------------------------------------------------------------------ sources and sinks


@query("a1_read_fastq", "read_id s, pair_id s, mate s, read_index i, seq s, qual s",
       f"WITH {READS} SELECT read_id, pair_id, mate, row_number() OVER (PARTITION BY mate ORDER BY read_id) AS read_index, seq, qual FROM reads")
def a1(s, d):
    base = scratch_dir(s, "fastq")
    r = reads(s, d)
    out, parts = [], portions(s, d, 6) // 2
    for m in ("R1", "R2"):
        fastq.write_fastq(r.filter(F.col("mate") == m).repartitionByRange(parts, "read_id").sortWithinPartitions("read_id"), f"{base}/{m}")
        out.append(fastq.read_fastq(s, f"{base}/{m}/part-*", m, split_bytes=1024 * 1024))
    return fastq.with_read_index(cut_lineage(out[0].unionByName(out[1]), "landed"))


@query("e11_global_read_ordinal", "mate s, reads i, lowest i, highest i",
       f"WITH {READS} SELECT mate, count(*) AS reads, 1 AS lowest, count(*) AS highest FROM reads GROUP BY mate")
def e11(s, d):
    return a1(s, d).groupBy("mate").agg(F.count(F.lit(1)).alias("reads"), F.min("read_index").alias("lowest"), F.max("read_index").alias("highest"))


@query("a3_read_fasta", "name s, header s, seq s", f"WITH {PROTEINS} SELECT gene AS name, gene || ' | item ' || item_id AS header, seq FROM proteins")
def a3(s, d):
    path = scratch_dir(s, "fasta")
    p = proteins(s, d).withColumn("header", F.concat("gene", F.lit(" | item "), F.col("item_id").cast("string")))
    tables.write_fasta(p, path, width=60)
    return tables.require_records(tables.read_fasta(s, path))


@query("a4_write_fasta", "value s", f"WITH {PROTEINS} SELECT unnest(['>' || gene, seq]) AS value FROM proteins")
def a4(s, d):
    path = scratch_dir(s, "fasta")
    tables.write_fasta(proteins(s, d), path, header="gene")
    return s.read.text(path)


@query("a5_fastq_to_fasta", "header s, seq s", f"WITH {READS} SELECT read_id AS header, seq FROM reads")
def a5(s, d):
    base = scratch_dir(s, "derivative")
    fastq.write_fastq(reads(s, d), f"{base}/fq")
    tables.write_fasta(fastq.read_fastq(s, f"{base}/fq/part-*", "R1"), f"{base}/fa", header="read_id")
    return tables.read_fasta(s, f"{base}/fa")


HSP_SELECT = "gene AS qseqid, read_id AS sseqid, pident, length, mismatch, 0 AS gapopen, qstart, qend, sstart, send, evalue, bitscore"


def _hsp(s, d):
    return hits(s, d).select(
        F.col("gene").alias("qseqid"), F.col("read_id").alias("sseqid"), "pident", "length", "mismatch", F.lit(0).alias("gapopen"), "qstart", "qend",
        "sstart", "send", "evalue", "bitscore", "mate")


LANDED = r"/mate=([^/]+)_(R[12])\.tsv/"


def _land_hits(df, base):
    """One folder per mate, written in one pass over the hits; the reader takes gene and mate from the path."""
    folder = F.concat(F.lit("hits_"), "mate", F.lit(".tsv")).alias("mate")
    df.select(*[c for c in df.columns if c != "mate"], folder).write.option("sep", "\t").partitionBy("mate").csv(base)


@query("a6_read_hits", "qseqid s, sseqid s, pident d, length i, mismatch i, gapopen i, qstart i, qend i, sstart i, send i, evalue d, bitscore d, mate s",
       f"WITH {HITS} SELECT {HSP_SELECT}, mate FROM hits")
def a6(s, d):
    base = scratch_dir(s, "hits")
    _land_hits(_hsp(s, d), base)
    return tables.read_hits(s, f"{base}/*.tsv", name_pattern=LANDED, name_column="path")


@query("a7_read_hits_aligned", "sseqid s, bitscore d, qseq s, sseq s, mate s",
       f"WITH {HITS} SELECT read_id AS sseqid, bitscore, repeat('K', length) AS qseq, repeat('E', length) AS sseq, mate FROM hits")
def a7(s, d):
    base = scratch_dir(s, "hits")
    _land_hits(_hsp(s, d).withColumns({"qseq": F.repeat(F.lit("K"), F.col("length")), "sseq": F.repeat(F.lit("E"), F.col("length"))}).select(
        *[f.name for f in tables.HSP_ALIGNED.fields], "mate"), base)
    return tables.read_hits(s, f"{base}/*.tsv", aligned=True, name_pattern=LANDED, name_column="path")


OBS_CSV = T.StructType([T.StructField("pair", T.LongType()), T.StructField("position", T.IntegerType()), T.StructField("aa", T.StringType()), T.StructField("price", T.DoubleType())])
OBS_SQL = "SELECT l_orderkey AS pair, l_linenumber AS position, CASE WHEN l_returnflag = 'A' THEN 'T' WHEN l_returnflag = 'R' THEN 'F' END AS aa, l_extendedprice AS price FROM lineitem"


def _obs(s, d):
    aa = F.when(F.col("l_returnflag") == "A", "T").when(F.col("l_returnflag") == "R", "F")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("position"), aa.alias("aa"), F.col("l_extendedprice").alias("price"))


@query("a8_csv_scan", "pair i, position i, aa s, price d2", OBS_SQL)
def a8(s, d):
    path = scratch_dir(s, "csv")
    tables.write_table(_obs(s, d), path, null="NA")
    return tables.read_table(s, path, OBS_CSV)


@query("a9_delimiter_sniffing", "separator s, n_nationkey i, n_name s, n_regionkey i", "SELECT separator, n_nationkey, n_name, n_regionkey FROM (VALUES (';'), (chr(9)), (',')) v(separator), nation")
def a9(s, d):
    n = table(s, d, "nation")
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("n_regionkey", T.IntegerType())])
    out = []
    for sep in (";", "\t", ","):
        path = scratch_dir(s, "sniff")
        n.select(*schema.names).coalesce(1).write.option("header", True).option("sep", sep).csv(path)
        sniffed = tables.sniff_separator(s, path)
        out.append(tables.read_table(s, path, schema, sniffed).withColumn("separator", F.lit(sniffed)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("a10_csv_sink", "value s", "SELECT 'n_nationkey,n_name,n_regionkey' AS value UNION ALL SELECT concat_ws(',', n_nationkey, n_name, n_regionkey) FROM nation")
def a10(s, d):
    path = scratch_dir(s, "sink")
    tables.write_table(table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").coalesce(1), path)
    return s.read.text(path)


@query("a12_partitioned_chunk_scan", "chunk_id i, n i, total d2",
       "SELECT o_orderkey % 4 + 1 AS chunk_id, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY ALL")
def a12(s, d):
    base = scratch_dir(s, "chunks")
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", F.format_string("chunk_%06d.csv", F.col("o_orderkey") % 4 + 1).alias("chunk"))
    o.write.option("header", True).partitionBy("chunk").csv(base)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType())])
    got = tables.read_chunks(s, base, schema, pattern="chunk=chunk_*.csv")
    return got.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


@query("a13_report_sink", "value s", """SELECT '[orders] ' || rpad(o_orderstatus, 20, '.') || ' ' || count(*) AS value FROM orders GROUP BY o_orderstatus""")
def a13(s, d):
    path = scratch_dir(s, "report")
    m = table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("metric")).agg(F.count(F.lit(1)).alias("value")).withColumn("section", F.lit("orders"))
    metric_lines(m.orderBy("metric"), width=20).coalesce(1).write.text(path)
    return s.read.text(path)


@query("a14_target_table", "gene s, reference_path s, expected_aa_len i",
       "SELECT n_name AS gene, 'refs/' || n_nationkey || '.fasta' AS reference_path, 100 + n_regionkey AS expected_aa_len FROM nation")
def a14(s, d):
    path = scratch_dir(s, "targets")
    null = F.lit(None).cast("string")
    t = table(s, d, "nation").select(
        F.col("n_name").alias("gene"), F.concat(F.col("n_nationkey").cast("string"), F.lit(".fasta")).alias("reference_file"), F.lit("protein").alias("reference_type"),
        (100 + F.col("n_regionkey")).alias("expected_aa_len"), F.lit(300).alias("CDS_expected_bp_length"), null.alias("retrieval_strategy"), null.alias("strand"), null.alias("notes"))
    t.coalesce(1).write.option("header", True).option("sep", "\t").option("nullValue", "NA").csv(path)
    return tables.read_targets(s, path, "refs")


# ------------------------------------------------------------------ streaming


def _land(s, d, base):
    """Files of either mate, four or, with more reads, one for each so many bases; returns their number."""
    n = portions(s, d, 4)
    r = reads(s, d).select("read_index", "read_id", "pair_id", "mate", "seq", "qual")
    r.repartition(n, "mate", F.xxhash64("pair_id") % (n // 2)).write.parquet(f"{base}/landing")
    return n


@query("a15_incremental_ingest", EV_COLS, f"WITH {FULL} SELECT * FROM final")
def a15(s, d):
    base = scratch_dir(s, "ingest")
    n = _land(s, d, base)
    cfg = ingest.ScanConfig(tuple(TARGETS))
    # complete=False: the second mates of some made-up reads are too short to exist, and wait in the gate's state.
    ingest.ingest(s, f"{base}/landing", f"{base}/out", cfg, files_per_batch=n // 4, complete=False)
    ingest.ingest(s, f"{base}/landing", f"{base}/out", cfg, complete=False)  # nothing new: no batch runs
    return ingest.collected_evidence(s, f"{base}/out")


@query("s5_stateful_counters", "mate s, n i", f"WITH {READS} SELECT mate, count(*) AS n FROM reads GROUP BY mate")
def s5(s, d):
    base = scratch_dir(s, "counters")
    _land(s, d, base)
    q = ingest.running_counts(s, f"{base}/landing", ingest.READS, ["mate"], f"{base}/counts", f"{base}/checkpoint")
    q.awaitTermination()
    return s.read.parquet(f"{base}/counts")


def _ingested(s, d, rounds=1):
    base = scratch_dir(s, "ingest")
    n = _land(s, d, base)
    for _ in range(rounds):
        ingest.ingest(s, f"{base}/landing", f"{base}/out", ingest.ScanConfig(tuple(TARGETS)), files_per_batch=n // 2, complete=False)
    return f"{base}/out"


@query("s1_chunked_stream", "mate s, candidates i", f"WITH {COUNTS} SELECT mate, count(*) AS candidates FROM cand GROUP BY mate")
def s1(s, d):
    return s.read.parquet(f"{_ingested(s, d)}/candidates").groupBy("mate").agg(F.count(F.lit(1)).alias("candidates"))


@query("s3_exactly_once_resume", "records i, repeated i", f"WITH {COUNTS} SELECT count(*) AS records, 0 AS repeated FROM {_validated('cand', 'PRIMARY')}")
def s3(s, d):
    """Three runs over the same files: the second and third find nothing left to do."""
    p = s.read.parquet(f"{_ingested(s, d, rounds=3)}/primary")
    key = ["read_id", "target_position", "orientation", "frame", "read_codon_start"]
    return p.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("s4_global_dedup", "evidence_role s, n i", f"WITH {FULL} SELECT evidence_role, count(*) AS n FROM final GROUP BY evidence_role")
def s4(s, d):
    return ingest.collected_evidence(s, _ingested(s, d)).groupBy("evidence_role").agg(F.count(F.lit(1)).alias("n"))
