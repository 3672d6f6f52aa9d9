"""Reads laid out by pair: a bucketed, sorted table, so that looking up mates moves no read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import first_per_group
from ..session import scratch_dir


def save_by_pair(reads: DataFrame, name: str, buckets: int | None = None, path: str | None = None) -> DataFrame:
    """Write ``reads`` once as table ``name`` in ``buckets`` buckets of pair_id, sorted by pair and mate, and return the table.

    The files lie below ``path``, by default a fresh folder of the shared scratch folder. Reads are dealt to their buckets
    before they are written, so each bucket is one file. Choose buckets so that one fits in a task (100 TB in 400,000 buckets
    are 250 MB each), and no fewer than ``spark.sql.shuffle.partitions``, the default: Spark shuffles a table of fewer buckets
    again to have that many tasks."""
    spark = reads.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = reads.repartition(buckets, "pair_id")
    dealt.write.bucketBy(buckets, "pair_id").sortBy("pair_id", "mate").option("path", path or scratch_dir(spark, "by-pair")).format("parquet").saveAsTable(name)
    return spark.table(name)


def partners_by_pair(laid_out: DataFrame, candidates: DataFrame) -> DataFrame:
    """The other mate of every candidate read, as :func:`..operators.scan.partners` gives it, from reads laid out by pair.

    Candidates become one row a pair with the mate or mates that are wanted, and meet the reads on the pair alone: that is how
    the table is bucketed, so the join and the choice of the first read need no exchange of reads. Only keys of candidates move."""
    first_mate = F.col("mate") == "R1"  # the partner of any other mate is R1
    wanted = candidates.groupBy("pair_id").agg(
        F.min(F.when(first_mate, F.col("read_index"))).alias("_for_r2"), F.min(F.when(first_mate, None).otherwise(F.col("read_index"))).alias("_for_r1"))
    joined = laid_out.join(wanted, "pair_id")
    index = F.when(F.col("mate") == "R1", F.col("_for_r1")).when(F.col("mate") == "R2", F.col("_for_r2"))
    found = joined.withColumn("_index", index).filter(F.col("_index").isNotNull()).drop("_for_r1", "_for_r2")
    first = first_per_group(found, ["pair_id", "mate"], [F.col("read_index"), F.col("read_id")])
    return first.withColumn("read_index", F.col("_index")).drop("_index")
