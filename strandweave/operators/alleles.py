"""Evidence tables: deduplication, allele and position summaries, accounting, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import first_per_group, share_of_total

EVIDENCE_KEY = ["read_id", "mate", "target_position", "orientation", "frame"]


def usable_evidence(df: DataFrame, positions: list[int] | None = None) -> DataFrame:
    ok = (F.col("note") == "") & F.col("translated_aa").isNotNull() & (F.col("translated_aa") != "X")
    if positions is not None:
        ok = ok & F.col("target_position").isin(*positions)
    return df.filter(ok)


def deduplicate_evidence(df: DataFrame, ties: list[Column] | None = None) -> DataFrame:
    """One record per (read, mate, position, orientation, frame): primary before partner, then
    higher identity, then higher quality; ``ties`` settles what is still equal."""
    rank = F.when(F.col("evidence_role") == "PRIMARY", 1).otherwise(2)
    order = [rank, F.col("anchor_identity").desc(), F.col("codon_min_qual").desc(), *(ties or [])]
    return first_per_group(df, EVIDENCE_KEY, order)


def allele_summary(df: DataFrame, position: str = "target_position", aa: str = "translated_aa",
                   quality: str = "codon_min_qual", family: str = "dup_family") -> DataFrame:
    """Per (position, residue): reads, mean and minimum quality, independent families.

    Families are grouped first, so the distinct count is a plain row count.
    """
    per_family = df.groupBy(position, aa, family).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(quality).alias("_q"), F.min(quality).alias("_m")
    )
    return per_family.groupBy(position, aa).agg(
        F.sum("_n").alias("read_count"),
        F.round(F.sum("_q") / F.sum("_n"), 2).alias("mean_min_phred"),
        F.min("_m").alias("minimum_min_phred"),
        F.count_if(F.col(family).isNotNull() & (F.col(family) != "")).alias("independent_families"),
    )


def families_per_allele(df: DataFrame, position: str = "target_position", aa: str = "translated_aa",
                        family: str = "dup_family") -> DataFrame:
    return (
        df.filter(F.col(family).isNotNull() & (F.col(family) != ""))
        .select(position, aa, family).distinct()
        .groupBy(position, aa).agg(F.count(F.lit(1)).alias("independent_families"))
    )


def position_support(df: DataFrame, positions: list[int], usable: Column) -> DataFrame:
    """Per target position: candidate rows, usable rows, families, mean/min quality; zero rows kept."""
    fam = df.groupBy("target_position", "dup_family").agg(
        F.count(F.lit(1)).alias("_c"), F.count_if(usable).alias("_u"),
        F.sum(F.when(usable, F.col("codon_min_qual"))).alias("_q"), F.min(F.when(usable, F.col("codon_min_qual"))).alias("_m"),
    )
    agg = fam.groupBy("target_position").agg(
        F.sum("_c").alias("candidates"), F.sum("_u").alias("usable"),
        F.count_if((F.col("_u") > 0) & F.col("dup_family").isNotNull() & (F.col("dup_family") != "")).alias("families"),
        F.round(F.sum("_q") / F.sum("_u"), 2).alias("mean_min_phred"), F.min("_m").alias("min_min_phred"),
    )
    base = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in positions])).alias("target_position"))
    zero = {c: 0 for c in ("candidates", "usable", "families")}
    return base.join(agg, "target_position", "left").fillna(zero)


def position_summary(df: DataFrame, references: dict[int, str], alleles: tuple[str, ...] = ("M", "L", "P")) -> DataFrame:
    """Per target position: hits, distinct reads, allele counts, share of the reference residue,
    mean/median identity and quality. Positions without hits give a zero row.

    Medians take value counts first: identities and Phred scores have few distinct values.
    """
    aa = F.col("target_aa")
    reads = df.groupBy("target_position", "mate", "read_id").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(aa == a).alias(f"_{a}") for a in alleles],
        F.sum("anchor_identity").alias("_id"), F.sum("codon_min_qual").alias("_q"),
        F.count_if(aa == F.col("expected_reference_aa")).alias("_ref"),
    )
    ids = reads.groupBy("target_position", "read_id").agg(
        F.count(F.lit(1)).alias("_mates"), *[F.sum(c).alias(c) for c in ("_n", *[f"_{a}" for a in alleles], "_id", "_q", "_ref")]
    )
    main = ids.groupBy("target_position").agg(
        F.sum("_n").alias("total_hits"),
        F.count(F.lit(1)).alias("unique_read_ids"),
        F.sum("_mates").alias("unique_reads"),
        *[F.sum(f"_{a}").alias(a) for a in alleles],
        F.sum("_ref").alias("reference_matches"),
        (F.sum("_id") / F.sum("_n")).alias("mean_anchor_identity"),
        (F.sum("_q") / F.sum("_n")).alias("mean_codon_min_qual"),
    )

    def median(value, name):
        c = df.groupBy("target_position", value).agg(F.count(F.lit(1)).alias("_n"))
        return c.groupBy("target_position").agg(F.percentile(value, 0.5, F.col("_n")).alias(name))

    spec = [F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in references.items()]
    base = df.sparkSession.range(1).select(F.explode(F.array(*spec)).alias("_x")).select(
        F.col("_x.p").alias("target_position"), F.col("_x.r").alias("reference_aa")
    )
    out = (
        base.join(main, "target_position", "left")
        .join(median("anchor_identity", "median_anchor_identity"), "target_position", "left")
        .join(median("codon_min_qual", "median_codon_min_qual"), "target_position", "left")
    )
    counts = ["total_hits", "unique_read_ids", "unique_reads", *alleles, "reference_matches"]
    out = out.fillna({c: 0 for c in counts})
    other = F.col("total_hits") - sum((F.col(a) for a in alleles), F.lit(0))
    return out.withColumns(
        {"other": other,
         "pct_reference_aa": F.when(F.col("total_hits") > 0, 100.0 * F.col("reference_matches") / F.col("total_hits"))}
    )


def allele_contingency(df: DataFrame, dims: list[str], by: list[str], digits: int | None = None) -> DataFrame:
    """Full table over the observed values of each dimension with zero cells.

    The cells are the product of the dimensions' distinct values (mates, target positions, residues:
    small alphabets), built from the aggregated counts; percent is of the total over ``by``.
    """
    counts = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("hit_count"))
    grid = counts.agg(*[F.collect_set(d).alias(d) for d in dims])
    for d in dims:
        grid = grid.withColumn(d, F.explode(d))
    cells = grid.join(counts, dims, "left").withColumn("hit_count", F.coalesce("hit_count", F.lit(0)))
    out = share_of_total(cells, "hit_count", by=by, digits=digits)
    return out.withColumn("percent", F.coalesce("percent", F.lit(0.0)))


def allele_counts(df: DataFrame, dims: list[str], by: list[str], digits: int | None = 2) -> DataFrame:
    """Counts of the cells that occur, percent of the total over ``by``."""
    return share_of_total(df.groupBy(*dims).agg(F.count(F.lit(1)).alias("hit_count")), "hit_count", by=by, digits=digits)


def candidate_accounting(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every candidate read with the number and list of positions it gave evidence for."""
    keys = ["read_id", "mate", "pair_id"]
    seen = evidence.groupBy(*keys).agg(F.array_sort(F.collect_set("target_position")).alias("_p"))
    return (
        candidates.select(*keys).distinct().join(seen, keys, "left")
        .select(
            *keys,
            F.when(F.col("_p").isNull(), 0).otherwise(F.size("_p")).alias("n_positions"),
            F.coalesce(F.array_join(F.transform("_p", lambda x: x.cast("string")), ","), F.lit("")).alias("positions_detected"),
        )
    )


def compare_key_sets(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Overlap, missing, new-only and recovery percent of two key sets.

    One union with flags: a single shuffle, no full outer join.
    """
    tagged = old.select(*keys, F.lit(1).alias("_o"), F.lit(0).alias("_w")).unionByName(
        new.select(*keys, F.lit(0).alias("_o"), F.lit(1).alias("_w"))
    )
    k = tagged.groupBy(*keys).agg(F.max("_o").alias("o"), F.max("_w").alias("w"))
    out = k.agg(
        F.coalesce(F.sum("o"), F.lit(0)).alias("old_keys"),
        F.coalesce(F.sum("w"), F.lit(0)).alias("new_keys"),
        F.count_if((F.col("o") == 1) & (F.col("w") == 1)).alias("overlap"),
        F.count_if((F.col("o") == 1) & (F.col("w") == 0)).alias("missing_from_new"),
        F.count_if((F.col("o") == 0) & (F.col("w") == 1)).alias("new_only"),
    )
    return out.withColumn("recovery_pct", F.when(F.col("old_keys") > 0, 100.0 * F.col("overlap") / F.col("old_keys")))


def pair_audit(candidates: DataFrame, partners: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Per batch: candidate pairs by mate, how many have the other mate, validated partner records."""
    c = F.col("any_candidate")
    r1, r2 = F.col("mate") == "R1", F.col("mate") == "R2"
    per_pair = candidates.groupBy(batch, "pair_id").agg(
        F.bool_or(r1 & c).alias("c1"), F.bool_or(r2 & c).alias("c2"), F.bool_or(r1).alias("h1"), F.bool_or(r2).alias("h2")
    )
    left = per_pair.groupBy(batch).agg(
        F.count_if(F.col("c1") | F.col("c2")).alias("n_candidate_pairs"),
        F.count_if("c1").alias("n_r1_candidate_pairs"),
        F.count_if("c2").alias("n_r2_candidate_pairs"),
        F.count_if(F.col("c1") & F.col("h2")).alias("n_r1_with_r2_mate"),
        F.count_if(F.col("c2") & F.col("h1")).alias("n_r2_with_r1_mate"),
    )
    right = partners.groupBy(batch, "pair_id").agg(F.count(F.lit(1)).alias("_n")).groupBy(batch).agg(
        F.sum("_n").alias("n_partner_records"), F.count(F.lit(1)).alias("n_partner_pairs")
    )
    return left.join(right, batch, "left").fillna({"n_partner_records": 0, "n_partner_pairs": 0})
