"""Mates and roles of a read pair: concordance, roles, geometry, consolidation."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.reads import PAIR_RULES, pair_id_by_rule
from .intervals import any_overlap


def normalise_role(role) -> Column:
    r = F.col(role) if isinstance(role, str) else role
    return F.when(r == "N_flank", "N").when(r == "C_flank", "C").otherwise(r)


def mate_support(df: DataFrame, by: list[str], pair: str = "pair_id", mate: str = "mate") -> DataFrame:
    """Distinct pairs with any mate and with both mates, and the share of both."""
    per_pair = df.groupBy(*by, pair).agg(
        F.bool_or(F.col(mate) == "R1").alias("_r1"), F.bool_or(F.col(mate) == "R2").alias("_r2")
    )
    out = per_pair.groupBy(*by).agg(
        F.count_if(F.col("_r1") | F.col("_r2")).alias("n_pairs_any"),
        F.count_if(F.col("_r1") & F.col("_r2")).alias("n_pairs_both"),
    )
    return out.withColumn(
        "mate_concordance_pct", F.when(F.col("n_pairs_any") > 0, 100.0 * F.col("n_pairs_both") / F.col("n_pairs_any"))
    )


def _allele_list(flag: Column) -> Column:
    """Alleles in order of first appearance; ``_e`` holds one entry per distinct allele."""
    rows = F.array_sort(F.collect_list(F.when(flag, F.struct("_ord", "target_aa"))))
    return F.when(F.bool_or(flag), F.array_join(F.transform(rows, lambda r: r["target_aa"]), "/"))


def pair_call_status(r1, r2) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (r1, r2))
    return (
        F.when(a.isNull() & b.isNull(), "NO_POSITIONAL_EVIDENCE")
        .when(a.isNull(), "R2_ONLY_POSITIONAL_EVIDENCE")
        .when(b.isNull(), "R1_ONLY_POSITIONAL_EVIDENCE")
        .when(a == b, "BOTH_MATES_CONCORDANT")
        .otherwise("BOTH_MATES_DISCORDANT")
    )


def pair_calls(evidence: DataFrame, positions: list[int], order: Column) -> DataFrame:
    """Per pair: the alleles each mate shows at each position and how the mates agree."""
    alleles = evidence.groupBy("pair_id", "mate", "target_position", "target_aa").agg(F.min(order).alias("_ord"))
    cols = []
    for p in positions:
        for m in ("R1", "R2"):
            here = (F.col("mate") == m) & (F.col("target_position") == p)
            cols.append(_allele_list(here).alias(f"{m.lower()}_{p}"))
    wide = alleles.groupBy("pair_id").agg(*cols)
    return wide.withColumns({f"paired_{p}_status": pair_call_status(f"r1_{p}", f"r2_{p}") for p in positions})


def concordance_rate(calls: DataFrame, positions: list[int]) -> DataFrame:
    """Per position: status counts and concordant / (concordant + discordant)."""
    rows = F.explode(
        F.array(*[F.struct(F.lit(p).alias("target_position"), F.col(f"paired_{p}_status").alias("s")) for p in positions])
    )
    s = F.col("r.s")
    out = calls.select(rows.alias("r")).groupBy(F.col("r.target_position").alias("target_position")).agg(
        F.count_if(s == "BOTH_MATES_CONCORDANT").alias("concordant"),
        F.count_if(s == "BOTH_MATES_DISCORDANT").alias("discordant"),
        F.count_if(s == "R1_ONLY_POSITIONAL_EVIDENCE").alias("r1_only"),
        F.count_if(s == "R2_ONLY_POSITIONAL_EVIDENCE").alias("r2_only"),
    )
    both = F.col("concordant") + F.col("discordant")
    return out.withColumn("concordance_rate_pct", F.when(both > 0, F.round(100.0 * F.col("concordant") / both, 1)))


def pair_roles(per_read: DataFrame, n_flank: tuple[int, int], c_flank: tuple[int, int], order: Column,
               segments: str = "query_segments") -> DataFrame:
    """Which mate touches the N flank and which the C flank of a pair; different mates only.

    When several reads of a pair qualify the last in ``order`` wins.
    """
    df = per_read.withColumns(
        {
            "_n": any_overlap(segments, F.lit(n_flank[0]), F.lit(n_flank[1])),
            "_c": any_overlap(segments, F.lit(c_flank[0]), F.lit(c_flank[1])),
        }
    )
    out = df.groupBy("pair_id").agg(
        F.max_by(F.when(F.col("_n"), F.col("mate")), F.when(F.col("_n"), order)).alias("n_mate"),
        F.max_by(F.when(F.col("_c"), F.col("mate")), F.when(F.col("_c"), order)).alias("c_mate"),
    )
    return out.filter(F.col("n_mate") != F.col("c_mate"))


def flank_support(per_read: DataFrame, unit: str, n_flank: tuple[int, int], c_flank: tuple[int, int],
                  segments: str = "query_segments") -> DataFrame:
    """How many units (read ids or pair ids) touch the N flank, the C flank, both."""
    per_unit = per_read.groupBy(unit).agg(
        F.bool_or(any_overlap(segments, F.lit(n_flank[0]), F.lit(n_flank[1]))).alias("_n"),
        F.bool_or(any_overlap(segments, F.lit(c_flank[0]), F.lit(c_flank[1]))).alias("_c"),
    )
    return per_unit.agg(
        F.count_if("_n").alias("n_flank"), F.count_if("_c").alias("c_flank"),
        F.count_if(F.col("_n") & F.col("_c")).alias("both_flanks"),
    )


def gap_boundaries(segments: DataFrame, n_flank_max: int, c_flank_min: int, by: list[str] | None = None,
                   start: str = "seg_start", end: str = "seg_end") -> DataFrame:
    """Furthest N-side end, nearest C-side start, and the residues missing between them."""
    out = segments.groupBy(*(by or [])).agg(
        F.max(F.when(F.col(start) <= n_flank_max, F.col(end))).alias("max_n_end"),
        F.min(F.when(F.col(end) >= c_flank_min, F.col(start))).alias("min_c_start"),
    )
    return out.withColumn("missing_aa", F.col("min_c_start") - F.col("max_n_end") - 1)


def pair_geometry(per_read: DataFrame, order: Column) -> DataFrame:
    """First segment of each mate and the query distance between R2 and R1."""
    def pick(mate, seg, field):
        here = F.col("mate") == mate
        first = F.min_by(F.when(here, F.element_at(F.col(seg), 1)), F.when(here, order))
        return first[field]

    cols = []
    for m in ("R2", "R1"):
        for seg, q in (("query_segments", "q"), ("subject_segments", "s")):
            cols += [pick(m, seg, "start").alias(f"{m.lower()}_{q}start"), pick(m, seg, "end").alias(f"{m.lower()}_{q}end")]
    out = per_read.groupBy("pair_id").agg(*cols)
    return out.withColumn("query_gap_aa", F.col("r1_qstart") - F.col("r2_qend") - 1)


def role_problems(df: DataFrame, pair: str = "pair_id", role: str = "role") -> DataFrame:
    """Pairs that do not have exactly one N and one C row."""
    out = df.groupBy(pair).agg(
        F.count_if(F.col(role) == "N").alias("n_rows"), F.count_if(F.col(role) == "C").alias("c_rows")
    )
    return out.filter((F.col("n_rows") != 1) | (F.col("c_rows") != 1))


def merge_roles(df: DataFrame, payload: list[str], pair: str = "pair_id", role: str = "role") -> DataFrame:
    """N and C rows of a pair side by side (full outer by pair), one shuffle instead of a self-join."""
    cols = [F.max(F.when(F.col(role) == r, F.col(c))).alias(f"{r.lower()}_{c}") for r in ("N", "C") for c in payload]
    return df.filter(F.col(role).isin("N", "C")).groupBy(pair).agg(*cols)


def consolidate(merged: DataFrame, gap_start: int, gap_end: int) -> DataFrame:
    """Pair class, reach flags and the union span of the two tails."""
    n, c = F.col("n_evidence_class"), F.col("c_evidence_class")
    pair_class = (
        F.when((n == "A") & (c == "A"), "A/A")
        .when((n == "A") | (c == "A"), "A/other")
        .when((n == "D") & (c == "D"), "D/D")
        .when(n.isNotNull() & c.isNotNull(), "other")
    )
    n_ok = F.col("n_gap_position_start").isNotNull() & F.col("n_gap_position_end").isNotNull()
    c_ok = F.col("c_gap_position_start").isNotNull() & F.col("c_gap_position_end").isNotNull()
    out = merged.withColumns({"pair_class": pair_class, "n_reaches_gap": n_ok, "c_reaches_gap": c_ok,
                              "both_reach_gap": n_ok & c_ok})
    both = F.col("both_reach_gap")
    out = out.withColumns(
        {
            "pair_gap_start": F.when(both, F.least("n_gap_position_start", "c_gap_position_start")),
            "pair_gap_end": F.when(both, F.greatest("n_gap_position_end", "c_gap_position_end")),
        }
    )
    return out.withColumns(
        {
            "pair_gap_span_aa": F.col("pair_gap_end") - F.col("pair_gap_start") + 1,
            "full_gap": F.coalesce(both & (F.col("pair_gap_start") <= gap_start) & (F.col("pair_gap_end") >= gap_end), F.lit(False)),
        }
    )


def pair_rule_rates(reads: DataFrame, index: str = "read_index") -> DataFrame:
    """Share of row-aligned mates whose ids agree under each naming convention, all rules in one pass."""
    both = reads.groupBy(index).agg(
        F.max(F.when(F.col("mate") == "R1", F.col("read_id"))).alias("a"), F.max(F.when(F.col("mate") == "R2", F.col("read_id"))).alias("b")
    ).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    rates = both.agg(*[F.avg((pair_id_by_rule("a", r) == pair_id_by_rule("b", r)).cast("int")).alias(r) for r in PAIR_RULES])
    return rates.unpivot([], list(PAIR_RULES), "rule", "match_rate")


def confirmed_rule(rates: DataFrame) -> str | None:
    """First convention (in the fixed order) with a full match, or None: five values reach the driver."""
    got = {r["rule"]: r["match_rate"] for r in rates.collect()}
    return next((r for r in PAIR_RULES if got.get(r) == 1.0), None)
