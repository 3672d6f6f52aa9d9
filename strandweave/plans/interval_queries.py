"""Predicates, joins, hit consolidation, windows and interval algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.joins import measured_join
from ..functions.reads import as_int, count_with_percent, first_available, range_label, strand
from ..operators import intervals as iv
from ..operators import ranking as rk
from ..operators.checks import codon_span_consistency, require_columns, unexpected_values
from ..operators.pairs import flank_support, gap_boundaries, mate_support, normalise_role, pair_geometry, pair_roles
from ..operators.recovery import best_hits, consolidate_reads, depth_statistics, gene_recovery
from ..operators.reshape import pack, spine, union_all, unpack
from ..operators.running import ordinal
from .adapters import (
    GENE_LENGTHS, HIT_ORDER, HIT_ORDER_SQL, HITS, INTERVALS, epoch_seconds, gene_lengths, hits, intervals, table,
)
from ..session import cut_lineage
from .registry import query

N_FLANK, C_FLANK = (120, 180), (220, 300)


def order_cols(names=HIT_ORDER):
    return [F.col(c) for c in names]


def nhits(s, d):
    return iv.normalise_hits(hits(s, d))


# ------------------------------------------------------------------ predicates (B)


@query("b1_hit_threshold_filter", "gene s, mate s, n i, mean_pident d",
       f"WITH {HITS} SELECT gene, mate, count(*) AS n, avg(pident) AS mean_pident FROM nhits WHERE length >= 20 AND pident >= 92 GROUP BY ALL")
def b1(s, d):
    return iv.filter_hits(nhits(s, d), 20, 92.0).groupBy("gene", "mate").agg(F.count(F.lit(1)).alias("n"), F.avg("pident").alias("mean_pident"))


@query("b2_coordinate_normalisation", "l_orderkey i, l_linenumber i, qstart_raw i, qend_raw i, sstart_raw i, send_raw i, qstart i, qend i, sstart i, send i",
       f"WITH {HITS} SELECT * FROM nhits")
def b2(s, d):
    return nhits(s, d)


@query("b3_strand", "gene s, strand s, n i",
       f"WITH {HITS} SELECT gene, CASE WHEN sstart < send THEN 'forward' ELSE 'reverse' END AS strand, count(*) AS n FROM hits GROUP BY ALL")
def b3(s, d):
    return hits(s, d).withColumn("strand", strand("sstart", "send")).groupBy("gene", "strand").agg(F.count(F.lit(1)).alias("n"))


@query("b4_point_in_interval", "gene s, covering i, n i",
       f"WITH {HITS} SELECT gene, count(*) FILTER (WHERE 200 BETWEEN qstart AND qend) AS covering, count(*) AS n FROM nhits GROUP BY gene")
def b4(s, d):
    return nhits(s, d).groupBy("gene").agg(F.count_if(iv.contains_point("qstart", "qend", F.lit(200))).alias("covering"), F.count(F.lit(1)).alias("n"))


@query("b14_codon_span_consistency", "gene s, consistent b, n i",
       f"""WITH {HITS} SELECT gene, abs(send - sstart) + 1 = 3 * (abs(qend - qstart) + 1) AS consistent, count(*) AS n FROM hits GROUP BY ALL""")
def b14(s, d):
    return hits(s, d).withColumn("consistent", codon_span_consistency(hits(s, d))).groupBy("gene", "consistent").agg(F.count(F.lit(1)).alias("n"))


@query("b15_bad_order_filter", "l_orderkey i, l_linenumber i, l_partkey i, qstart i, qend i", f"WITH {HITS} SELECT * FROM hits WHERE qstart > qend")
def b15(s, d):
    return hits(s, d).filter(F.col("qstart") > F.col("qend"))


@query("b10_role_normalisation", "event_id i, role s", """
SELECT event_id, CASE role0 WHEN 'N_flank' THEN 'N' WHEN 'C_flank' THEN 'C' ELSE role0 END AS role FROM (SELECT event_id,
 CASE event_type WHEN 'view' THEN 'N_flank' WHEN 'click' THEN 'C_flank' ELSE event_type END AS role0 FROM events)""")
def b10(s, d):
    e = table(s, d, "events").withColumn(
        "role", F.when(F.col("event_type") == "view", "N_flank").when(F.col("event_type") == "click", "C_flank").otherwise(F.col("event_type")))
    return e.withColumn("role", normalise_role("role"))


@query("b11_unexpected_values", "event_type s", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('view', 'click', 'purchase')")
def b11(s, d):
    return unexpected_values(table(s, d, "events"), "event_type", ["view", "click", "purchase"])


@query("b9_required_columns", "column_present s, rows i",
       "SELECT 'o_orderkey,o_custkey' AS column_present, count(*) AS rows FROM orders")
def b9(s, d):
    o = require_columns(table(s, d, "orders"), ["o_orderkey", "o_custkey"])
    return o.agg(F.count(F.lit(1)).alias("rows")).withColumn("column_present", F.lit("o_orderkey,o_custkey"))


@query("b12_first_available_column", "o_orderkey i, price d2", "SELECT o_orderkey, o_totalprice AS price FROM orders")
def b12(s, d):
    o = table(s, d, "orders")
    return o.select("o_orderkey", first_available(o, ["total_price", "o_totalprice", "o_price"]).alias("price"))


@query("b13_type_coercion", "o_orderkey i, rank i, word i",
       """SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS rank, coalesce(TRY_CAST(o_orderstatus AS INTEGER), -1) AS word FROM orders""")
def b13(s, d):
    return table(s, d, "orders").select(
        "o_orderkey", as_int(F.substring("o_orderpriority", 1, 1)).alias("rank"), F.coalesce(as_int("o_orderstatus"), F.lit(-1)).alias("word"))


@query("b17_subset_rename", "pair i, position i, coverage s",
       """SELECT l_orderkey AS pair, l_linenumber AS position, l_returnflag || l_linestatus AS coverage FROM lineitem""")
def b17(s, d):
    return table(s, d, "lineitem").select(
        F.col("l_orderkey").alias("pair"), F.col("l_linenumber").alias("position"), F.concat("l_returnflag", "l_linestatus").alias("coverage"))


@query("b18_display_strings", "gene s, query_range s, reverse_hits s",
       f"""WITH {HITS} SELECT gene, min(qstart) || '-' || max(qend) AS query_range,
       printf('%d (%.1f%%)', count(*) FILTER (WHERE sstart_raw > send_raw), 100.0 * count(*) FILTER (WHERE sstart_raw > send_raw) / count(*)) AS reverse_hits
       FROM nhits GROUP BY gene""")
def b18(s, d):
    g = nhits(s, d).groupBy("gene").agg(
        F.min("qstart").alias("a"), F.max("qend").alias("b"), F.count_if(F.col("sstart_raw") > F.col("send_raw")).alias("r"), F.count(F.lit(1)).alias("n"))
    return g.select("gene", range_label("a", "b").alias("query_range"), count_with_percent("r", "n").alias("reverse_hits"))


@query("b19_query_coverage", "l_orderkey i, l_linenumber i, l_partkey i, coverage_pct d2",
       f"WITH {HITS}, {GENE_LENGTHS} SELECT l_orderkey, l_linenumber, l_partkey, 100.0 * length / protein_length AS coverage_pct FROM hits JOIN gene_lengths USING (gene)")
def b19(s, d):
    return measured_join(hits(s, d), gene_lengths(s, d), ["gene"]).withColumn("coverage_pct", 100.0 * F.col("length") / F.col("protein_length"))


# ------------------------------------------------------------------ joins (C)


@query("c1_left_join_lookup", "l_orderkey i, l_linenumber i, l_partkey i, protein_length i",
       f"WITH {HITS}, {GENE_LENGTHS} SELECT l_orderkey, l_linenumber, l_partkey, protein_length FROM hits LEFT JOIN gene_lengths USING (gene)")
def c1(s, d):
    return measured_join(hits(s, d), gene_lengths(s, d), ["gene"], "left")


@query("c5_semi_join", "l_orderkey i, l_linenumber i, l_partkey i",
       "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def c5(s, d):
    urgent = table(s, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(s, d, "lineitem").join(urgent, "l_orderkey", "left_semi")


@query("c6_anti_join", "o_orderkey i", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def c6(s, d):
    li = table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(s, d, "orders").join(li, "o_orderkey", "left_anti")


@query("c10_range_join", "position i, n i, orders i",
       f"""WITH {HITS} SELECT p.position, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM nhits
       JOIN (SELECT unnest([150, 200, 250, 300, 350]) AS position) p ON p.position BETWEEN qstart AND qend GROUP BY p.position""")
def c10(s, d):
    pts = s.range(1).select(F.explode(F.array(*[F.lit(p) for p in (150, 200, 250, 300, 350)])).alias("position"))
    j = iv.points_in_intervals(pts, nhits(s, d), "position", "qstart", "qend")
    return j.groupBy("position").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_orderkey").alias("orders"))


@query("c10_interval_points_by_key", "key i, p i, n i",
       f"""WITH {INTERVALS}, pts AS (SELECT DISTINCT key, s + 7 AS p FROM intervals)
       SELECT pts.key, p, count(*) AS n FROM pts JOIN intervals i ON i.key = pts.key AND p BETWEEN i.s AND i.e GROUP BY ALL""")
def c10b(s, d):
    i = intervals(s, d)
    return iv.covering_counts(i.select("key", (F.col("start") + 7).alias("p")), i, "p", keys=["key"]).filter(F.col("n") > 0)


@query("c12_spine_join", "gene s, position i, n i",
       f"""WITH {HITS}, {GENE_LENGTHS}, c AS (SELECT gene, qstart AS position, count(*) AS n FROM nhits GROUP BY ALL),
       spine AS (SELECT gene, unnest(range(1, protein_length + 1)) AS position FROM gene_lengths)
       SELECT gene, position, coalesce(n, 0) AS n FROM spine LEFT JOIN c USING (gene, position)""")
def c12(s, d):
    c = nhits(s, d).groupBy("gene", F.col("qstart").alias("position")).agg(F.count(F.lit(1)).alias("n"))
    sp = spine(gene_lengths(s, d), ["gene"], F.lit(1), F.col("protein_length"))
    return sp.join(c, ["gene", "position"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("c17_order_restoring_join", "n_nationkey i, position i, suppliers i",
       """SELECT n_nationkey, row_number() OVER (ORDER BY n_name DESC) AS position, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation""")
def c17(s, d):
    n = table(s, d, "nation")
    wanted = ordinal(n.select("n_name", (-F.ascii("n_name")).alias("_b")), [], "_b", [F.desc("n_name")], "position")
    c = table(s, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("suppliers"))
    return (
        n.join(wanted, "n_name").join(c, "n_nationkey", "left")
        .select("n_nationkey", "position", F.coalesce("suppliers", F.lit(0)).alias("suppliers")).orderBy("position")
    )


# ------------------------------------------------------------------ windows and intervals (E)


@query("e1_row_number_in_group", "gene s, l_orderkey i, l_linenumber i, l_partkey i, l_suppkey i, hit_ordinal i",
       f"WITH {HITS} SELECT *, row_number() OVER (PARTITION BY gene ORDER BY {HIT_ORDER_SQL}) AS hit_ordinal FROM hits")
def e1(s, d):
    h = hits(s, d).withColumn("_b", F.floor(F.col("l_orderkey") / 4096))
    return ordinal(h, ["gene"], "_b", HIT_ORDER, "hit_ordinal")


@query("e2_top1_best_hit", "gene s, mate s, bitscore d, l_orderkey i, l_linenumber i, l_partkey i, qstart i, qend i",
       f"WITH {HITS} SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY gene, mate ORDER BY bitscore DESC, {HIT_ORDER_SQL}) = 1")
def e2(s, d):
    return best_hits(hits(s, d), ["gene", "mate"], order_cols())


@query("e4_duplicate_families", "event_id i, family s", """
WITH t AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS start FROM events),
f AS (SELECT *, CASE WHEN start - lag(start) OVER (PARTITION BY user_id, event_type ORDER BY start, event_id) <= 86400 THEN 0 ELSE 1 END AS o FROM t),
k AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY event_type, start, event_id ROWS UNBOUNDED PRECEDING) AS k FROM f)
SELECT event_id, event_type || '_F' || CAST(k AS BIGINT) AS family FROM k""")
def e4(s, d):
    e = table(s, d, "events").select("event_id", "user_id", "event_type", epoch_seconds("ts").alias("start"))
    return iv.families(e, ["user_id"], ["event_type"], "start", 86400, bucket_width=7 * 86400)


@query("e5_gaps_and_islands", "key i, gap_start i, gap_end i, length i", f"""
WITH {INTERVALS}, days AS (SELECT DISTINCT key, unnest(range(s, e + 1)) AS day FROM intervals),
empty AS (SELECT key, unnest(range(1, 4601)) AS day FROM (SELECT DISTINCT key FROM intervals) EXCEPT SELECT key, day FROM days),
runs AS (SELECT key, day, day - row_number() OVER (PARTITION BY key ORDER BY day) AS g FROM empty)
SELECT key, min(day) AS gap_start, max(day) AS gap_end, count(*) AS length FROM runs GROUP BY key, g""")
def e5(s, d):
    i = intervals(s, d)
    lens = i.select("key").distinct().withColumn("len", F.lit(4600))
    runs = iv.uncovered_intervals(i, ["key"], lens, "len")
    return runs.select("key", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"), "length")


@query("e6_depth_sweep", "gene s, position i, depth i", f"""
WITH {HITS}, {GENE_LENGTHS}, cov AS (SELECT gene, unnest(range(greatest(qstart, 1), least(qend, protein_length) + 1)) AS position
  FROM nhits JOIN gene_lengths USING (gene)),
spine AS (SELECT gene, unnest(range(1, protein_length + 1)) AS position FROM gene_lengths)
SELECT gene, position, count(cov.position) AS depth FROM spine LEFT JOIN cov USING (gene, position) GROUP BY gene, position""")
def e6(s, d):
    return iv.depth(nhits(s, d), ["gene"], gene_lengths(s, d), "protein_length", "qstart", "qend")


MERGE_SQL = """
o AS (SELECT {keys}, s, e, max(e) OVER (PARTITION BY {keys} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {src}),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o),
{name} AS (SELECT {keys}, g, min(s) AS seg_start, max(e) AS seg_end, count(*) AS n FROM g GROUP BY {keys}, g)
"""


@query("e7_interval_merge", "key i, seg_start i, seg_end i, n i",
       f"WITH {INTERVALS}, {MERGE_SQL.format(keys='key', src='intervals', name='m')} SELECT * FROM m")
def e7(s, d):
    return iv.merge_intervals(intervals(s, d), ["key"]).withColumnRenamed("n_intervals", "n")


@query("e8_share_of_total", "gene s, mate s, n i, percent d",
       f"WITH {HITS} SELECT gene, mate, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY gene) AS percent FROM hits GROUP BY gene, mate")
def e8(s, d):
    return rk.share_of_total(hits(s, d).groupBy("gene", "mate").agg(F.count(F.lit(1)).alias("n")), "n", by=["gene"])


@query("e9_first_occurrence", "l_orderkey i, l_linenumber i, l_partkey i, l_suppkey i",
       f"WITH {HITS} SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {HIT_ORDER_SQL}) = 1")
def e9(s, d):
    return rk.first_per_group(hits(s, d), ["l_orderkey"], order_cols())


@query("e10_evenly_spaced_pick", "gene s, l_orderkey i, rank i, o_totalprice d2", """
WITH o AS (SELECT o_orderstatus AS gene, o_orderkey AS l_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS rank,
  count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders),
picks AS (SELECT unnest(range(0, 8)) AS i)
SELECT DISTINCT gene, l_orderkey, rank, o_totalprice FROM o JOIN picks ON n <= 8 OR rank = CAST(round_even(1 + i * (n - 1) / 7.0, 0) AS BIGINT)""")
def e10(s, d):
    o = table(s, d, "orders").select(F.col("o_orderstatus").alias("gene"), F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return rk.evenly_spaced(o, ["gene"], "o_totalprice", "l_orderkey", 8)


# ------------------------------------------------------------------ consolidation


PER_READ = f"""{HITS}, qi AS (SELECT gene, mate, read_id, qstart AS s, qend AS e FROM nhits), si AS (SELECT gene, mate, read_id, sstart AS s, send AS e FROM nhits),
{MERGE_SQL.format(keys='gene, mate, read_id', src='qi', name='qm')},
{MERGE_SQL.format(keys='gene, mate, read_id', src='si', name='sm').replace('o AS', 'o2 AS').replace('FROM o)', 'FROM o2)').replace('g AS (SELECT *', 'g2 AS (SELECT *').replace('FROM g GROUP', 'FROM g2 GROUP')},
best AS (SELECT * FROM nhits QUALIFY row_number() OVER (PARTITION BY gene, mate, read_id ORDER BY bitscore DESC, {HIT_ORDER_SQL}) = 1),
q2 AS (SELECT gene, mate, read_id, sum(n) AS n_hsps, string_agg(CAST(seg_start AS VARCHAR), ';' ORDER BY seg_start) AS qstarts,
  string_agg(CAST(seg_end AS VARCHAR), ';' ORDER BY seg_start) AS qends, sum(seg_end - seg_start + 1) AS covered FROM qm GROUP BY ALL),
s2 AS (SELECT gene, mate, read_id, string_agg(CAST(seg_start AS VARCHAR), ';' ORDER BY seg_start) AS sstarts,
  string_agg(CAST(seg_end AS VARCHAR), ';' ORDER BY seg_start) AS sends FROM sm GROUP BY ALL),
per_read AS (SELECT q2.*, sstarts, sends, pident AS best_pident, evalue AS best_evalue, bitscore AS best_bitscore, read_id AS pair_id
  FROM q2 JOIN s2 USING (gene, mate, read_id) JOIN best USING (gene, mate, read_id))"""


def per_read(s, d):
    return consolidate_reads(nhits(s, d), order_cols()).withColumn("pair_id", F.col("read_id"))


@query("d1_read_consolidation", "gene s, mate s, read_id s, n_hsps i, qstarts s, qends s, covered i, sstarts s, sends s, best_pident d, best_evalue d, best_bitscore d",
       f"WITH {PER_READ} SELECT * FROM per_read")
def d1(s, d):
    return per_read(s, d).select(
        "gene", "mate", "read_id", "n_hsps", F.col("aa_covered_by_read").alias("covered"), "best_pident", "best_evalue", "best_bitscore",
        pack(F.col("query_segments"), "start").alias("qstarts"), pack(F.col("query_segments"), "end").alias("qends"),
        pack(F.col("subject_segments"), "start").alias("sstarts"), pack(F.col("subject_segments"), "end").alias("sends"))


D2_COLS = ("gene s, protein_length i, reads_r1 i, reads_r2 i, reads_total i, coverage_pct d, mean_depth d, median_depth d, min_depth i, max_depth i, "
           "pct_depth_ge_1 d, pct_depth_ge_5 d, pct_depth_ge_10 d, mean_pident d, median_pident d, min_pident d, max_pident d, min_evalue d, median_evalue d, "
           "max_evalue d, n_pairs_any i, n_pairs_both i, mate_concordance_pct d, observation_status s")


@query("d2_gene_recovery_summary", D2_COLS, f"""
WITH {PER_READ}, {GENE_LENGTHS},
seg AS (SELECT gene, mate, read_id, greatest(seg_start, 1) AS s, seg_end AS e FROM qm),
cov AS (SELECT gene, unnest(range(s, least(e, protein_length) + 1)) AS position FROM seg JOIN gene_lengths USING (gene)),
spine AS (SELECT gene, unnest(range(1, protein_length + 1)) AS position FROM gene_lengths),
dep AS (SELECT gene, position, count(cov.position) AS depth FROM spine LEFT JOIN cov USING (gene, position) GROUP BY ALL),
ds AS (SELECT gene, 100.0 * avg(CAST(depth >= 1 AS INTEGER)) AS coverage_pct, avg(depth) AS mean_depth, median(depth) AS median_depth, min(depth) AS min_depth,
  max(depth) AS max_depth, 100.0 * avg(CAST(depth >= 1 AS INTEGER)) AS pct_depth_ge_1, 100.0 * avg(CAST(depth >= 5 AS INTEGER)) AS pct_depth_ge_5,
  100.0 * avg(CAST(depth >= 10 AS INTEGER)) AS pct_depth_ge_10 FROM dep GROUP BY gene),
rd AS (SELECT gene, count(DISTINCT read_id) FILTER (WHERE mate = 'R1') AS reads_r1, count(DISTINCT read_id) FILTER (WHERE mate = 'R2') AS reads_r2,
  avg(best_pident) AS mean_pident, median(best_pident) AS median_pident, min(best_pident) AS min_pident, max(best_pident) AS max_pident,
  min(best_evalue) AS min_evalue, median(best_evalue) AS median_evalue, max(best_evalue) AS max_evalue, count(DISTINCT pair_id) AS n_pairs_any FROM per_read GROUP BY gene),
bo AS (SELECT gene, count(*) AS n_pairs_both FROM (SELECT gene, pair_id FROM per_read GROUP BY ALL HAVING count(DISTINCT mate) = 2) GROUP BY gene)
SELECT * EXCLUDE (n_pairs_both), coalesce(n_pairs_both, 0) AS n_pairs_both, reads_r1 + reads_r2 AS reads_total, 100.0 * coalesce(n_pairs_both, 0) / n_pairs_any AS mate_concordance_pct,
  CASE WHEN reads_r1 + reads_r2 = 0 THEN 'NO_SIGNIFICANT_SUPPORT' WHEN coverage_pct >= 100 THEN 'DETECTED_FULL_LENGTH_COVERAGE' ELSE 'DETECTED_PARTIAL_COVERAGE' END AS observation_status
FROM gene_lengths LEFT JOIN ds USING (gene) LEFT JOIN rd USING (gene) LEFT JOIN bo USING (gene)""")
def d2(s, d):
    return gene_recovery(cut_lineage(per_read(s, d), "per_read"), gene_lengths(s, d))


@query("d2_depth_statistics", "key i, coverage_pct d, mean_depth d, median_depth d, max_depth i", f"""
WITH {INTERVALS}, lens AS (SELECT DISTINCT key, 4600 AS len FROM intervals), cov AS (SELECT key, unnest(range(s, least(e, 4600) + 1)) AS position FROM intervals),
spine AS (SELECT key, unnest(range(1, len + 1)) AS position FROM lens),
dep AS (SELECT key, position, count(cov.position) AS depth FROM spine LEFT JOIN cov USING (key, position) GROUP BY ALL)
SELECT key, 100.0 * avg(CAST(depth >= 1 AS INTEGER)) AS coverage_pct, avg(depth) AS mean_depth, median(depth) AS median_depth, max(depth) AS max_depth FROM dep GROUP BY key""")
def d2b(s, d):
    i = intervals(s, d)
    lens = i.select("key").distinct().withColumn("len", F.lit(4600))
    return depth_statistics(iv.depth_runs(i, ["key"], lens, "len"), ["key"], (), "n")


@query("d48_mate_support", "gene s, n_pairs_any i, n_pairs_both i, mate_concordance_pct d", f"""
WITH {HITS}, p AS (SELECT gene, pair_id, count(DISTINCT mate) AS m FROM hits GROUP BY ALL)
SELECT gene, count(*) AS n_pairs_any, count(*) FILTER (WHERE m = 2) AS n_pairs_both, 100.0 * count(*) FILTER (WHERE m = 2) / count(*) AS mate_concordance_pct FROM p GROUP BY gene""")
def d48(s, d):
    return mate_support(hits(s, d), ["gene"])


@query("d55_gap_boundary_metrics", "gene s, max_n_end i, min_c_start i, missing_aa i", f"""
WITH {PER_READ} SELECT gene, max(seg_end) FILTER (WHERE seg_start <= {N_FLANK[1]}) AS max_n_end, min(seg_start) FILTER (WHERE seg_end >= {C_FLANK[0]}) AS min_c_start,
 min(seg_start) FILTER (WHERE seg_end >= {C_FLANK[0]}) - max(seg_end) FILTER (WHERE seg_start <= {N_FLANK[1]}) - 1 AS missing_aa FROM qm GROUP BY gene""")
def d55(s, d):
    merged = iv.merge_within(nhits(s, d), ["gene", "mate", "read_id"], "qstart", "qend", "_m")
    segments = merged.select("gene", F.inline("_m")).toDF("gene", "seg_start", "seg_end")
    return gap_boundaries(segments, N_FLANK[1], C_FLANK[0], ["gene"])


FLAGS = f"""fl AS (SELECT gene, mate, read_id, bool_or(seg_start <= {N_FLANK[1]} AND seg_end >= {N_FLANK[0]}) AS fn,
  bool_or(seg_start <= {C_FLANK[1]} AND seg_end >= {C_FLANK[0]}) AS fc FROM qm GROUP BY ALL)"""


@query("d56_flank_support_counts", "n_flank i, c_flank i, both_flanks i", f"""
WITH {PER_READ}, {FLAGS}, u AS (SELECT read_id, bool_or(fn) AS fn, bool_or(fc) AS fc FROM fl GROUP BY read_id)
SELECT count(*) FILTER (WHERE fn) AS n_flank, count(*) FILTER (WHERE fc) AS c_flank, count(*) FILTER (WHERE fn AND fc) AS both_flanks FROM u""")
def d56(s, d):
    return flank_support(per_read(s, d), "read_id", N_FLANK, C_FLANK)


@query("b5_interval_overlap_list", "gene s, mate s, touching i, n i", f"""
WITH {PER_READ}, {FLAGS} SELECT gene, mate, count(*) FILTER (WHERE fn) AS touching, count(*) AS n FROM fl GROUP BY gene, mate""")
def b5(s, d):
    return per_read(s, d).groupBy("gene", "mate").agg(
        F.count_if(iv.any_overlap("query_segments", F.lit(N_FLANK[0]), F.lit(N_FLANK[1]))).alias("touching"), F.count(F.lit(1)).alias("n"))


@query("h32_pair_roles", "pair_id s, n_mate s, c_mate s", f"""
WITH {PER_READ}, {FLAGS}, r AS (SELECT read_id AS pair_id, max_by(mate, gene || mate) FILTER (WHERE fn) AS n_mate, max_by(mate, gene || mate) FILTER (WHERE fc) AS c_mate FROM fl GROUP BY read_id)
SELECT * FROM r WHERE n_mate <> c_mate""")
def h32(s, d):
    return pair_roles(per_read(s, d), N_FLANK, C_FLANK, F.concat("gene", "mate"))


@query("h33_pair_geometry", "pair_id s, r2_qstart i, r2_qend i, r2_sstart i, r2_send i, r1_qstart i, r1_qend i, r1_sstart i, r1_send i, query_gap_aa i", f"""
WITH {PER_READ}, q AS (SELECT gene, mate, read_id, min(seg_start) AS a, min_by(seg_end, seg_start) AS b FROM qm GROUP BY ALL),
t AS (SELECT gene, mate, read_id, min(seg_start) AS a, min_by(seg_end, seg_start) AS b FROM sm GROUP BY ALL),
w AS (SELECT q.read_id AS pair_id, q.mate, q.gene, q.a AS qa, q.b AS qb, t.a AS sa, t.b AS sb FROM q JOIN t USING (gene, mate, read_id)
  QUALIFY row_number() OVER (PARTITION BY q.read_id, q.mate ORDER BY q.gene) = 1),
p AS (SELECT pair_id, max(qa) FILTER (WHERE mate = 'R2') AS r2_qstart, max(qb) FILTER (WHERE mate = 'R2') AS r2_qend, max(sa) FILTER (WHERE mate = 'R2') AS r2_sstart,
 max(sb) FILTER (WHERE mate = 'R2') AS r2_send, max(qa) FILTER (WHERE mate = 'R1') AS r1_qstart, max(qb) FILTER (WHERE mate = 'R1') AS r1_qend,
 max(sa) FILTER (WHERE mate = 'R1') AS r1_sstart, max(sb) FILTER (WHERE mate = 'R1') AS r1_send FROM w GROUP BY pair_id)
SELECT *, r1_qstart - r2_qend - 1 AS query_gap_aa FROM p WHERE r1_qstart IS NOT NULL AND r2_qstart IS NOT NULL""")
def h33(s, d):
    return pair_geometry(per_read(s, d), F.col("gene")).filter(F.col("r1_qstart").isNotNull() & F.col("r2_qstart").isNotNull())


@query("g9_pack_unpack", "gene s, packed s, total i, n i", f"""
WITH {HITS}, k AS (SELECT DISTINCT gene, qstart FROM nhits)
SELECT gene, string_agg(CAST(qstart AS VARCHAR), ';' ORDER BY qstart) AS packed, sum(qstart) AS total, count(*) AS n FROM k GROUP BY gene""")
def g9(s, d):
    k = nhits(s, d).select("gene", "qstart").distinct()
    p = k.groupBy("gene").agg(F.array_join(F.transform(F.array_sort(F.collect_list("qstart")), lambda x: x.cast("string")), ";").alias("packed"))
    back = unpack("packed")
    return p.withColumns({"total": F.aggregate(back, F.lit(0), lambda a, x: a + x), "n": F.size(back)})


# ------------------------------------------------------------------ sort, top-k, sampling, sets (F, G)


@query("f1_multi_key_sort", "position i, o_orderstatus s, o_orderpriority s, n i", """
WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY n DESC, o_orderstatus, o_orderpriority) AS position FROM c""")
def f1(s, d):
    from pyspark.sql import Window

    c = table(s, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    order = [F.desc("n"), F.asc("o_orderstatus"), F.asc("o_orderpriority")]
    return c.withColumn("position", F.row_number().over(Window.partitionBy().orderBy(*order))).orderBy(*order)


@query("f2_top_k", "l_orderkey i, l_linenumber i, l_partkey i, l_extendedprice d2",
       "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 30")
def f2(s, d):
    return table(s, d, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(30)


@query("f3_hash_sample", "o_orderkey i, o_custkey i", "SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('7|' || o_orderkey), o_orderkey LIMIT 1000")
def f3(s, d):
    return rk.hash_sample(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, seed=7)


@query("f4_prefix_cap", "o_orderkey i, o_custkey i", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey, o_custkey LIMIT 5000")
def f4(s, d):
    """A pilot of the first 5000 rows; the cap is the operator."""
    return rk.first_rows(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 5000, ["o_custkey"])


@query("g1_union_all", "source s, n i, total d2", """
SELECT source, count(*) AS n, sum(v) AS total FROM (SELECT 'order' AS source, o_totalprice AS v FROM orders UNION ALL SELECT 'line', l_extendedprice FROM lineitem) GROUP BY source""")
def g1(s, d):
    a = table(s, d, "orders").select(F.lit("order").alias("source"), F.col("o_totalprice").alias("v"))
    b = table(s, d, "lineitem").select(F.lit("line").alias("source"), F.col("l_extendedprice").alias("v"))
    return union_all([a, b]).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("g2_union_missing_columns", "key i, segment s, nation i", """
SELECT c_custkey AS key, c_mktsegment AS segment, -1 AS nation FROM customer UNION ALL SELECT s_suppkey, 'none', s_nationkey FROM supplier""")
def g2(s, d):
    a = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"))
    b = table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return union_all([a, b], allow_missing=True).fillna({"segment": "none", "nation": -1})


@query("g3_intersect_union", "side s, n i", """
WITH a AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
SELECT 'both' AS side, count(*) AS n FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT 'any', count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)""")
def g3(s, d):
    o = table(s, d, "orders").select("o_custkey", "o_orderstatus")
    a, b = (o.filter(F.col("o_orderstatus") == x).select("o_custkey") for x in ("F", "P"))
    both = a.intersect(b).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("both"))
    anyc = a.union(b).distinct().agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("any"))
    return both.unionByName(anyc)


@query("g4_set_difference", "k i", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def g4(s, d):
    o = table(s, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("k"))
    return table(s, d, "customer").select(F.col("c_custkey").alias("k")).subtract(o)


@query("g5_distinct", "l_suppkey i, l_returnflag s, l_linestatus s", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def g5(s, d):
    return table(s, d, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus").distinct()
