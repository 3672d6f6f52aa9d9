"""Hit tables to reads, reads to genes, and sequence extraction by coordinates or id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import _c, reverse_complement
from .intervals import depth_runs, merged_segments
from .once import once
from .pairs import mate_support
from .ranking import first_per_group

DEPTH_THRESHOLDS = (1, 5, 10)


def best_hits(hits: DataFrame, keys: list[str], tie: list[Column], score: str = "bitscore") -> DataFrame:
    """Highest score per group, first on ties."""
    return first_per_group(hits, keys, [F.col(score).desc(), *tie])


def consolidate_reads(hits: DataFrame, tie: list[Column], keys: tuple[str, ...] = ("gene", "mate", "read_id")) -> DataFrame:
    """Per (gene, mate, read): hit count, merged query and subject segments, covered residues, best hit.

    One shuffle. Coordinate pairs are collected as sets, deduplicated in each map task, so a read with
    very many hits still holds no more than the distinct spans of one read on one protein.
    """
    k = list(keys)
    spans = lambda a, b: F.array_sort(F.collect_set(F.struct(F.col(a).alias("start"), F.col(b).alias("end"))))
    covered = F.aggregate("query_segments", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"] + 1)
    best = F.min_by(F.struct("pident", "evalue", "bitscore"), F.struct((-F.col("bitscore")).alias("_score"), *tie))
    g = hits.groupBy(*k).agg(
        F.count(F.lit(1)).alias("n_hsps"), spans("qstart", "qend").alias("_q"), spans("sstart", "send").alias("_s"), best.alias("_best")
    )
    # Most reads have one hit on a protein: their one span is merged already.
    merged = lambda c: F.when(F.size(c) == 1, F.col(c)).otherwise(merged_segments(F.col(c)))
    g = once(g, {"query_segments": merged("_q"), "subject_segments": merged("_s")})
    return g.select(
        *k, "n_hsps", "query_segments", covered.alias("aa_covered_by_read"), "subject_segments",
        F.col("_best.pident").alias("best_pident"), F.col("_best.evalue").alias("best_evalue"), F.col("_best.bitscore").alias("best_bitscore"),
    )


def depth_statistics(depths: DataFrame, keys: list[str], thresholds=DEPTH_THRESHOLDS, positions: str | None = None) -> DataFrame:
    """Coverage %, mean / median / min / max depth and the share of positions at each depth; ``positions``: the column with the
    number of positions a row stands for, one each without it."""
    d = F.col("depth")
    c = depths.groupBy(*keys, "depth").agg((F.sum(positions) if positions else F.count(F.lit(1))).alias("_n"))
    n = F.sum("_n")
    return c.groupBy(*keys).agg(
        (100.0 * F.sum(F.when(d >= 1, F.col("_n")).otherwise(0)) / n).alias("coverage_pct"),
        (F.sum(d * F.col("_n")) / n).alias("mean_depth"),
        F.percentile("depth", 0.5, F.col("_n")).alias("median_depth"),
        F.min(d).alias("min_depth"),
        F.max(d).alias("max_depth"),
        *[(100.0 * F.sum(F.when(d >= t, F.col("_n")).otherwise(0)) / n).alias(f"pct_depth_ge_{t}") for t in thresholds],
    )


def _score_statistics(value: str, short: str) -> list[Column]:
    """Aggregates of one score. Its median counts equal values in each map task, so what meets is one entry a distinct value."""
    return [F.avg(value).alias(f"mean_{short}"), F.percentile(value, 0.5).alias(f"median_{short}"), F.min(value).alias(f"min_{short}"), F.max(value).alias(f"max_{short}")]


def gene_recovery(per_read: DataFrame, lengths: DataFrame, thresholds=DEPTH_THRESHOLDS, pair_ids_confirmed: bool = True,
                  gene: str = "gene", length: str = "protein_length") -> DataFrame:
    """One row per target gene, targets without reads included, from one row per gene, mate and read: reads by mate, depth
    statistics, identity and e-value statistics, mate concordance, observation status."""
    seg = per_read.select(gene, F.explode("query_segments").alias("_s")).select(gene, F.col("_s.start").alias("start"), F.col("_s.end").alias("end"))
    stats = depth_statistics(depth_runs(seg, [gene], lengths, length), [gene], thresholds, "n")
    reads = per_read.groupBy(gene).agg(
        F.count_if(F.col("mate") == "R1").alias("reads_r1"), F.count_if(F.col("mate") == "R2").alias("reads_r2"),
        *_score_statistics("best_pident", "pident"), *_score_statistics("best_evalue", "evalue"),
    )
    out = lengths.select(gene, length).join(stats, gene, "left").join(reads, gene, "left")
    if pair_ids_confirmed:
        out = out.join(mate_support(per_read, [gene]), gene, "left")
    out = out.fillna({"reads_r1": 0, "reads_r2": 0})
    status = (
        F.when(F.col("reads_total") == 0, "NO_SIGNIFICANT_SUPPORT")
        .when(F.col("coverage_pct") >= 100, "DETECTED_FULL_LENGTH_COVERAGE")
        .otherwise("DETECTED_PARTIAL_COVERAGE")
    )
    return out.withColumn("reads_total", F.col("reads_r1") + F.col("reads_r2")).withColumn("observation_status", status)


def extract_regions(hits: DataFrame, contigs: DataFrame, flank: int = 0, orient: bool = True, on: str = "contig") -> DataFrame:
    """Contig slice around each hit, clipped to the contig; reverse complemented for reverse hits when ``orient``."""
    j = hits.join(contigs.select(on, F.col("seq").alias("_contig")), on)
    lo = F.greatest(F.lit(1), F.least("sstart", "send") - flank)
    hi = F.least(F.length("_contig"), F.greatest("sstart", "send") + flank)
    j = j.withColumns({"region_start": lo, "region_end": hi})
    raw = F.substring(F.col("_contig"), F.col("region_start").cast("int"), (F.col("region_end") - F.col("region_start") + 1).cast("int"))
    seq = F.when(F.col("sstart") > F.col("send"), reverse_complement(raw)).otherwise(raw) if orient else raw
    return j.withColumn("region", seq).drop("_contig")


def extract_reads(reads: DataFrame, ids: DataFrame, order: Column, key: str = "pair_id") -> DataFrame:
    """First read per (id, mate) for the wanted ids.

    A semi-join filters the big side before anything else; Spark broadcasts the ids when their
    measured size allows and shuffles otherwise.
    """
    wanted = ids.select(key).distinct()
    return first_per_group(reads.join(wanted, key, "left_semi"), [key, "mate"], [order])


def extraction_report(ids: DataFrame, reads: DataFrame, key: str = "pair_id") -> DataFrame:
    """Per mate: ids asked for, found, missing, and duplicate records met."""
    wanted = ids.select(key).distinct()
    hit = reads.join(wanted, key, "left_semi").groupBy(key, "mate").agg(F.count(F.lit(1)).alias("_n"))
    asked = wanted.withColumn("mate", F.explode(F.array(F.lit("R1"), F.lit("R2"))))
    return asked.join(hit, [key, "mate"], "left").groupBy("mate").agg(
        F.count(F.lit(1)).alias("requested"), F.count("_n").alias("found"),
        F.count_if(F.col("_n").isNull()).alias("missing"), F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("duplicates"),
    )


def missing_ids(ids: DataFrame, reads: DataFrame, key: str = "pair_id") -> DataFrame:
    return ids.select(key).distinct().join(reads, key, "left_anti")
