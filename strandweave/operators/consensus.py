"""Positional consensus and concordance over (pair, position, residue, role) observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import measured_join

CONCORDANCE_BANDS = ((95, ">=95%"), (90, "90-94.9%"), (75, "75-89.9%"))


def residue_counts(obs: DataFrame, by: list[str], residue: str = "aa", weight: str | None = None) -> DataFrame:
    """Count (or summed weight) per position and residue: the map-side step of every consensus."""
    n = F.sum(weight) if weight else F.count(F.lit(1))
    return obs.groupBy(*by, residue).agg(n.alias("n"))


def consensus(counts: DataFrame, by: list[str], residue: str = "aa") -> DataFrame:
    """Depth, distinct residues, dominant residue (smallest label on a tie) and the sorted residue list.

    ``counts`` has one row per position and residue, so a group is never larger than the alphabet.
    """
    out = counts.groupBy(*by).agg(
        F.sum("n").alias("coverage_depth"),
        F.count(F.lit(1)).alias("unique_aa_count"),
        F.min_by(residue, F.struct(-F.col("n"), F.col(residue))).alias("dominant_aa"),
        F.max("n").alias("dominant_count"),
        F.array_join(F.array_sort(F.collect_set(residue)), "/").alias("all_observed_aa"),
    )
    share = F.col("dominant_count") / F.col("coverage_depth")
    return out.withColumns(
        {"dominant_frequency": F.round(share, 4), "concordance_pct": F.round(share * 100, 1)}
    )


def concordance_class(pct) -> F.Column:
    p = F.col(pct) if isinstance(pct, str) else pct
    out = F.when(p == 100, "100%")
    for low, label in CONCORDANCE_BANDS:
        out = out.when(p >= low, label)
    return out.otherwise("<75%")


def classify_concordance(cons: DataFrame) -> DataFrame:
    bad = F.col("coverage_depth") - F.col("dominant_count")
    return cons.withColumns(
        {
            "discordant_count": bad,
            "discordance_pct": F.round(bad / F.col("coverage_depth") * 100, 1),
            "concordance_class": concordance_class("concordance_pct"),
        }
    )


def _pair_percent(df: DataFrame) -> DataFrame:
    return df.withColumn("pair_concordance_pct", F.round(F.col("concordant_positions") / F.col("positions_observed") * 100, 1))


def within_pair(obs: DataFrame, pair: str, position: str, residue: str = "aa") -> DataFrame:
    """Positions of a pair whose observations all show one residue.

    min = max per (pair, position) replaces a distinct count: constant-size buffers, combined map-side.
    """
    per_pos = obs.groupBy(pair, position).agg((F.min(residue) == F.max(residue)).alias("_one"))
    out = per_pos.groupBy(pair).agg(
        F.count(F.lit(1)).alias("positions_observed"),
        F.count_if("_one").alias("concordant_positions"),
        F.count_if(~F.col("_one")).alias("discordant_positions"),
    )
    return _pair_percent(out)


def against_consensus(obs: DataFrame, cons: DataFrame, by: list[str], position: str | list[str], residue: str = "aa") -> DataFrame:
    """Agreement of observations with the dominant residue, per pair (``by``) or per role."""
    pos = [position] if isinstance(position, str) else position
    joined = measured_join(obs, cons.select(*pos, "dominant_aa"), pos, "left")
    hit = F.col(residue) == F.col("dominant_aa")
    out = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("positions_observed"),
        F.count_if(hit).alias("concordant_positions"),
        F.count_if(~hit).alias("discordant_positions"),
    )
    return _pair_percent(out)


def coverage_rollup(cons_on_spine: DataFrame) -> DataFrame:
    """One row: covered / missing positions, mean depth, positions at >=90 and 100 %, variable positions."""
    d = F.col("coverage_depth")
    return cons_on_spine.agg(
        F.count_if(d.isNotNull()).alias("positions_covered"),
        F.count_if(d.isNull()).alias("positions_missing"),
        F.avg(d).alias("mean_depth"),
        F.count_if(F.col("concordance_pct") >= 90).alias("positions_ge_90"),
        F.count_if(F.col("concordance_pct") == 100).alias("positions_100"),
        F.count_if(F.col("unique_aa_count") > 1).alias("variable_positions"),
    )


def consensus_string(cons: DataFrame, position: str, by: list[str] | None = None, missing: str = "") -> DataFrame:
    """Dominant residues in position order; one entry per position, so the list is protein-sized."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.coalesce("dominant_aa", F.lit(missing)).alias("a"))))
    return cons.groupBy(*(by or [])).agg(
        F.array_join(F.transform(rows, lambda r: r["a"]), "").alias("consensus"), F.count(F.lit(1)).alias("n_positions")
    )


def resolve_pairs(obs: DataFrame, pair: str, position: str, order, residue: str = "aa", role: str = "role") -> DataFrame:
    """Per (pair, position): first N and C residue and the status of the two roles.

    ``order`` (a column) says which observation of a role comes first.
    """
    def first(r):
        mine = F.col(role) == r
        return F.min_by(F.when(mine, F.col(residue)), F.when(mine, order))

    out = obs.groupBy(pair, position).agg(
        F.coalesce(F.bool_or(F.col(role) == "N"), F.lit(False)).alias("has_n"),
        F.coalesce(F.bool_or(F.col(role) == "C"), F.lit(False)).alias("has_c"),
        first("N").alias("aa_n"),
        first("C").alias("aa_c"),
    )
    n, c = F.col("has_n"), F.col("has_c")
    status = (
        F.when(n & ~c, "N_only")
        .when(c & ~n, "C_only")
        .when(n & c & (F.col("aa_n") == F.col("aa_c")), "NC_concordant")
        .when(n & c & (F.col("aa_n") != F.col("aa_c")), "NC_conflict")
        .otherwise("Unknown")
    )
    return out.withColumn("status", status)


def conflicts(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("status") == "NC_conflict")


STATUSES = ("N_only", "C_only", "NC_concordant", "NC_conflict")


def status_counts(resolved: DataFrame, by: list[str]) -> DataFrame:
    return resolved.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pair_depth"),
        *[F.count_if(F.col("status") == s).alias(f"{s.lower()}_count") for s in STATUSES],
    )


def internal_concordance(resolved: DataFrame, pair: str) -> DataFrame:
    """Per pair: positions, status counts and agreement among positions seen by both roles."""
    out = status_counts(resolved, [pair]).withColumnRenamed("pair_depth", "positions_observed")
    both = F.col("nc_concordant_count") + F.col("nc_conflict_count")
    return out.withColumn(
        "internal_concordance_pct", F.when(both > 0, F.round(F.col("nc_concordant_count") / both * 100, 1))
    )


def weighted_consensus(resolved: DataFrame, position: str) -> DataFrame:
    """Each pair weighs 1 per position; a conflicting pair gives half to each residue."""
    half = F.array(
        F.struct(F.col("aa_n").alias("aa"), F.lit(0.5).alias("w")),
        F.struct(F.col("aa_c").alias("aa"), F.lit(0.5).alias("w")),
    )
    one = F.array(F.struct(F.coalesce("aa_n", "aa_c").alias("aa"), F.lit(1.0).alias("w")))
    votes = resolved.filter(F.col("status") != "Unknown").select(
        position, F.explode(F.when(F.col("status") == "NC_conflict", half).otherwise(one)).alias("_v")
    ).select(position, F.col("_v.aa").alias("aa"), F.col("_v.w").alias("w"))
    cons = consensus(residue_counts(votes, [position], weight="w"), [position])
    out = cons.select(
        position,
        "unique_aa_count",
        "dominant_aa",
        F.col("dominant_count").alias("dominant_pair_count"),
        F.col("coverage_depth").alias("total_weight"),
        "all_observed_aa",
        F.round(F.col("dominant_count") / F.col("coverage_depth") * 100, 1).alias("pair_concordance_pct"),
        (F.col("coverage_depth") - F.col("dominant_count")).alias("discordant_pair_count"),
        F.round((F.col("coverage_depth") - F.col("dominant_count")) / F.col("coverage_depth") * 100, 1).alias("discordance_pct"),
    )
    return status_counts(resolved, [position]).join(out, position, "left")
