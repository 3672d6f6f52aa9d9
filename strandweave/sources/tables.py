"""FASTA, tabular hits, delimited tables and report lines. Schemas are always explicit: an inferred
column of residues ``T`` would turn into booleans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HSP = T.StructType(
    [
        T.StructField("qseqid", T.StringType()), T.StructField("sseqid", T.StringType()), T.StructField("pident", T.DoubleType()),
        T.StructField("length", T.IntegerType()), T.StructField("mismatch", T.IntegerType()), T.StructField("gapopen", T.IntegerType()),
        T.StructField("qstart", T.IntegerType()), T.StructField("qend", T.IntegerType()), T.StructField("sstart", T.IntegerType()),
        T.StructField("send", T.IntegerType()), T.StructField("evalue", T.DoubleType()), T.StructField("bitscore", T.DoubleType()),
    ]
)
HSP_ALIGNED = T.StructType([*HSP.fields, T.StructField("qseq", T.StringType()), T.StructField("sseq", T.StringType())])
TARGETS = T.StructType(
    [
        T.StructField("gene", T.StringType()), T.StructField("reference_file", T.StringType()),
        T.StructField("reference_type", T.StringType()), T.StructField("expected_aa_len", T.IntegerType()),
        T.StructField("CDS_expected_bp_length", T.IntegerType()), T.StructField("retrieval_strategy", T.StringType()),
        T.StructField("strand", T.StringType()), T.StructField("notes", T.StringType()),
    ]
)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records of a FASTA file or folder: name, header, seq (blanks removed, in upper case).

    A record begins at ``>`` at the start of a line; the first one of a file has no line break before it."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^\s*>", "").alias("value"))
    parts = F.split("value", "\n", 2)
    return (
        raw.filter(F.length(F.trim("value")) > 0)
        .select(F.rtrim(F.regexp_replace(parts[0], "\r", "")).alias("header"), F.regexp_replace(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), r"\s", "").alias("seq"))
        .withColumn("seq", F.upper("seq"))
        .select(F.regexp_replace("header", r"\s.*$", "").alias("name"), "header", "seq")
    )


def require_records(df: DataFrame, what: str = "FASTA") -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what} holds no record")
    return df


def fasta_lines(df: DataFrame, header: str = "header", seq: str = "seq", width: int | None = None) -> DataFrame:
    s = F.col(seq) if width is None else F.rtrim(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"))
    return df.select(F.concat(F.lit(">"), header, F.lit("\n"), s).alias("value"))


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq", width: int | None = None) -> None:
    fasta_lines(df, header, seq, width).write.text(path)


def read_hits(spark: SparkSession, path: str, aligned: bool = False, name_pattern: str = r"([^/]+)_(R[12])\.tsv",
              name_column: str = "name") -> DataFrame:
    """Header-less tabular hits; gene and mate come from the file name, or with
    ``name_column="path"`` from the folder that holds the part files.

    An empty file contributes no rows.
    """
    df = spark.read.schema(HSP_ALIGNED if aligned else HSP).option("sep", "\t").option("quote", "").option("mode", "FAILFAST").csv(path)
    name = F.col("_metadata.file_path" if name_column == "path" else "_metadata.file_name")
    return df.select(
        "*", F.regexp_extract(name, name_pattern, 1).alias("gene"), F.regexp_extract(name, name_pattern, 2).alias("mate")
    )


def read_table(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",", null: str = "NA") -> DataFrame:
    return (
        spark.read.schema(schema).option("header", True).option("sep", sep).option("nullValue", null).option("mode", "FAILFAST")
        .option("enforceSchema", False).csv(path)
    )


def sniff_separator(spark: SparkSession, path: str) -> str:
    """``;``, else tab, else ``,`` by the first line of a file."""
    first = spark.read.text(path).limit(1).first()
    line = first[0] if first else ""
    return ";" if ";" in line else "\t" if "\t" in line else ","


def read_targets(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """Target genes, separator detected, with the full path of each reference file."""
    df = read_table(spark, path, TARGETS, sniff_separator(spark, path))
    return df.withColumn("reference_path", F.concat(F.lit(folder.rstrip("/") + "/"), "reference_file"))


def read_chunks(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "chunk_*.csv") -> DataFrame:
    """Union of ``chunk_*.csv`` (files, or folders of part files), with the chunk number from the path."""
    df = read_table(spark, f"{folder.rstrip('/')}/{pattern}", schema)
    return df.withColumn("chunk_id", F.regexp_extract(F.col("_metadata.file_path"), r"chunk_0*(\d+)\.csv", 1).cast("int"))


def write_table(df: DataFrame, path: str, null: str = "") -> None:
    df.write.option("header", True).option("nullValue", null).option("emptyValue", "").csv(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Metric rows (section, metric, value) as text lines; small by construction, one file."""
    from ..operators.summaries import metric_lines

    metric_lines(metrics.orderBy("section", "metric")).coalesce(1).write.text(path)
