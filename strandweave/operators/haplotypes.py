"""Phasing two positions, stratifying by quality, collapsing duplicate families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reads import haplotype_aa
from ..session import cut_lineage
from .ranking import first_per_group, share_of_total

QUALITY_THRESHOLDS = (0, 10, 15, 20, 25, 30)


def _sites(df: DataFrame, keys: list[str], positions: tuple[int, int], payload: dict[str, str]) -> DataFrame:
    """Two rows per key -> one row with ``<name>_<position>`` columns; keys lacking a position drop out."""
    a, b = positions
    cols = [
        F.max(F.when(F.col("target_position") == p, F.col(c))).alias(f"{n}_{p}") for p in (a, b) for c, n in payload.items()
    ]
    has = [F.bool_or(F.col("target_position") == p).alias(f"_has_{p}") for p in (a, b)]
    out = df.groupBy(*keys).agg(*cols, *has)
    return out.filter(F.col(f"_has_{a}") & F.col(f"_has_{b}")).drop(f"_has_{a}", f"_has_{b}")


def phase_pairs(evidence: DataFrame, positions: tuple[int, int], tie: list[Column], payload: dict[str, str] | None = None) -> DataFrame:
    """Pairs that carry both positions, using the best-quality record per position.

    Records are pivoted rather than self-joined: one shuffle on the pair.
    """
    a, b = positions
    payload = payload or {"codon": "codon", "translated_aa": "aa", "codon_min_qual": "qmin", "codon_mean_qual": "qmean",
                          "mate": "mate", "dup_family": "family"}
    here = evidence.filter(F.col("target_position").isin(a, b))
    best = first_per_group(here, ["pair_id", "target_position"], [F.col("codon_min_qual").desc(), *tie])
    out = _sites(best, ["pair_id"], positions, payload)
    return out.withColumns(
        {
            "haplotype_aa": haplotype_aa(f"aa_{a}", a, f"aa_{b}", b),
            "haplotype_codon": F.concat_ws("-", f"codon_{a}", f"codon_{b}"),
            "min_phred_both": F.least(f"qmin_{a}", f"qmin_{b}"),
            "mean_phred_both": F.round((F.col(f"qmean_{a}") + F.col(f"qmean_{b}")) / 2, 2),
        }
    )


def phase_reads(evidence: DataFrame, positions: tuple[int, int], order: list[Column], exactly_one: bool = False) -> DataFrame:
    """Single reads that carry both positions; ``exactly_one`` drops reads with repeated positions."""
    a, b = positions
    here = evidence.filter(F.col("target_position").isin(a, b))
    keys = ["read_id", "mate", "pair_id"]
    if exactly_one:
        n = here.groupBy(*keys, "target_position").agg(F.count(F.lit(1)).alias("_n"))
        bad = n.filter(F.col("_n") > 1).select(*keys).distinct()
        here = here.join(bad, keys, "left_anti")
    best = first_per_group(here, [*keys, "target_position"], order)
    out = _sites(best, keys, positions, {"target_aa": "aa", "target_codon": "codon"})
    return out.withColumns(
        {
            "haplotype_aa": haplotype_aa(f"aa_{a}", a, f"aa_{b}", b),
            "haplotype_codon": F.concat_ws("-", f"codon_{a}", f"codon_{b}"),
        }
    )


def haplotype_summary(phased: DataFrame, quality: str | None = "min_phred_both", count: str = "pair_count",
                      digits: int | None = 1) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(count)]
    if quality:
        aggs += [F.round(F.avg(quality), 2).alias("mean_qmin_both"), F.min(quality).alias("min_qmin_both"),
                 F.max(quality).alias("max_qmin_both")]
    return share_of_total(phased.groupBy("haplotype_aa", "haplotype_codon").agg(*aggs), count, digits=digits)


def by_threshold(df: DataFrame, value: str, thresholds, aggregates: list[Column], groups: list[str] | None = None) -> DataFrame:
    """Aggregates over the rows that pass each threshold; a row counts under every threshold it passes.

    Thresholds are a short parameter list, so each row is expanded to the thresholds it passes
    (no join), partially aggregated in its task, and empty thresholds come back from the list.
    """
    ts = sorted(thresholds)
    passed = F.filter(F.array(*[F.lit(t) for t in ts]), lambda t: t <= F.col(value))
    agg = df.withColumn("threshold", F.explode(passed)).groupBy("threshold", *(groups or [])).agg(*aggregates)
    base = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(t) for t in ts])).alias("threshold"))
    return base.join(agg, "threshold", "left")


def quality_stratification(phased: DataFrame, positions: tuple[int, int], major: tuple[str, str], minor_b: str,
                           thresholds=QUALITY_THRESHOLDS) -> DataFrame:
    """Pairs left and allele / joint counts and shares at each minimum-quality threshold."""
    a, b = positions
    x, y = F.col(f"aa_{a}"), F.col(f"aa_{b}")
    joint = F.col("haplotype_aa") == f"{major[0]}{a}-{major[1]}{b}"
    flags = {
        "site_a_major": x == major[0],
        "site_a_other": x != major[0],
        "site_b_major": y == major[1],
        "site_b_minor": y == minor_b,
        "site_b_other": ~y.isin(major[1], minor_b),
        "joint_major": joint,
        "joint_alternative": ~joint,
    }
    out = by_threshold(
        phased, "min_phred_both", thresholds,
        [F.count(F.lit(1)).alias("pairs_remaining"), *[F.count_if(c).alias(k) for k, c in flags.items()]],
    ).fillna(0)
    n = F.col("pairs_remaining")
    pct = {
        f"pct_{k}": F.when(n > 0, F.round(100.0 * F.col(k) / n, 1)).otherwise(0.0)
        for k in flags if k != "site_b_other"
    }
    return out.withColumns(pct)


def family_collapse(phased: DataFrame, positions: tuple[int, int], min_quality: int = 10) -> DataFrame:
    """Distinct pairs per (family A, family B, haplotype) at or above a quality."""
    a, b = positions
    keys = [f"family_{a}", f"family_{b}", "haplotype_aa"]
    kept = phased.filter(F.col("min_phred_both") >= min_quality)
    out = kept.select(*keys, "pair_id").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("pair_count"))
    return share_of_total(out, "pair_count", digits=1)


def family_metrics(phased: DataFrame, positions: tuple[int, int], alleles: dict[int, tuple[str, ...]],
                   min_quality: int = 10) -> DataFrame:
    """Long (metric, value): distinct families per site, per allele and distinct family combinations.

    The phased rows are read once: counts and flags are kept per combination of families, and the metrics come from those.
    """
    a, b = positions
    flag = lambda p, x: f"_{p}_{x}"
    combos = phased.filter(F.col("min_phred_both") >= min_quality).groupBy(f"family_{a}", f"family_{b}").agg(
        F.count(F.lit(1)).alias("_n"), *[F.bool_or(F.col(f"aa_{p}") == x).alias(flag(p, x)) for p in positions for x in alleles[p]]
    )
    combos = cut_lineage(combos, "family_combinations")
    whole = combos.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("phased_records"), F.count(F.lit(1)).alias("family_combinations"))
    frames = [whole.unpivot([], whole.columns, "metric", "value")]
    for p in positions:
        per = combos.groupBy(f"family_{p}").agg(*[F.bool_or(flag(p, x)).alias(f"_{x}") for x in alleles[p]])
        cols = [F.count(F.lit(1)).alias(f"families_{p}"), *[F.count_if(f"_{x}").alias(f"families_{p}_{x}") for x in alleles[p]]]
        one = per.agg(*cols)
        frames.append(one.unpivot([], one.columns, "metric", "value"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
