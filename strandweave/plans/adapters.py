"""Reads, hits, observations and evidence derived from the driver tables, as frames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.once import once
from ..functions.sequence import AA64, reverse_complement, translate_frame

# --- fixed values of the adapters ---------------------------------------------------------
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTER_TO_BASE = "ACGTACGTACGTACGTACGTACGNAN"
LETTER_TO_QUALITY = "#%()+-.0123456789:<>?@ABCD"
READ_LENGTH = 301
# Above the pairs of the longest text a string can hold.
READ_STRIDE = 10_000_000
POS_A, POS_B = 40, 85
GAP_START, GAP_END = 21, 50
# -------------------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Layout alone, never rows: a table of fewer splits than the cluster has slots (one row group cannot be split) is dealt
    out, since the kernels that follow would run as one task; a large table has more and passes through without a shuffle."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df


def portions(spark: SparkSession, sf_dir: str, least: int, letters: int = 64_000_000) -> int:
    """Number of files for the reads, so that a file has about as many bases whatever their total."""
    total = table(spark, sf_dir, "documents").agg(F.sum(F.length("text"))).first()[0] or 0
    return max(least, -(-total // letters))


def genes(spark: SparkSession, sf_dir: str) -> int:
    """Number of reference proteins: documents are dealt to all of them."""
    return max(1, table(spark, sf_dir, "benchmark").count())


def epoch_seconds(ts: str):
    return F.expr(f"timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})")


def _letters(text: str):
    return F.upper(F.regexp_replace(text, "[^A-Za-z]", ""))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's letters cut into reads of 301 bases; odd tiles are the reverse-complemented mate."""
    tiles = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", F.posexplode(F.regexp_extract_all(_letters("text"), F.lit(f".{{1,{READ_LENGTH}}}"), F.lit(0))).alias("t", "x")
    )
    r2 = F.col("t") % 2 == 1
    pair = F.concat(F.lit("D"), F.col("doc_id").cast("string"), F.lit(":"), F.floor(F.col("t") / 2).cast("string"))
    base = F.translate("x", ALPHABET, LETTER_TO_BASE)
    qual = F.translate("x", ALPHABET, LETTER_TO_QUALITY)
    mapped = once(
        tiles,
        {"seq": F.when(r2, reverse_complement(base)).otherwise(base), "qual": F.when(r2, F.reverse(qual)).otherwise(qual)},
    )
    return mapped.select(
        "doc_id", F.col("t").cast("long").alias("tile"),
        (F.col("doc_id") * READ_STRIDE + F.floor(F.col("t") / 2) + 1).alias("read_index"),
        F.concat(pair, F.when(r2, "/2").otherwise("/1")).alias("read_id"),
        pair.alias("pair_id"),
        F.when(r2, "R2").otherwise("R1").alias("mate"),
        "seq", "qual",
    )


def documents_dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per document: all its letters as bases."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", F.concat(F.lit("D"), F.col("doc_id").cast("string")).alias("name"), "lang", "source",
        F.translate(_letters("text"), ALPHABET, LETTER_TO_BASE).alias("seq"),
    )


def proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reference per benchmark item: gene, cds and its translation."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.translate(_letters("text"), ALPHABET, LETTER_TO_BASE).alias("cds"))
    b = once(b, {"seq": translate_frame("cds")})
    return b.select("item_id", F.concat(F.lit("B"), F.col("item_id").cast("string")).alias("gene"), "cds", "seq")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines joined with parts as a hit table: brand = gene, order = read pair."""
    li = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    n = F.col("l_quantity").cast("int")
    q0 = 1 + (F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 400
    s0 = 1 + (F.col("l_suppkey") * 11 + F.col("l_linenumber") * 5) % 150
    q1 = q0 + n - 1
    s1 = s0 + n * 3 - 1 + F.when(F.col("l_returnflag") == "A", 1).otherwise(0)
    swap, rev = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    read = F.concat(F.lit("L"), F.col("l_orderkey").cast("string"))
    return li.join(part, "l_partkey").select(
        F.col("p_brand").alias("gene"), F.concat(F.lit("R"), (1 + F.col("l_suppkey") % 2).cast("string")).alias("mate"),
        read.alias("read_id"), read.alias("pair_id"),
        (100 - F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100)).alias("pident"),
        n.alias("length"), F.round(F.col("l_discount") * 100).cast("int").alias("mismatch"),
        F.when(swap, q1).otherwise(q0).cast("int").alias("qstart"), F.when(swap, q0).otherwise(q1).cast("int").alias("qend"),
        F.when(rev, s1).otherwise(s0).cast("int").alias("sstart"), F.when(rev, s0).otherwise(s1).cast("int").alias("send"),
        F.round(F.col("l_tax") * 100).alias("evalue"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("bitscore"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity",
    )


HIT_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "pident", "evalue"]


def gene_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("gene")).distinct().withColumn(
        "protein_length", (300 + F.regexp_extract("gene", r"(\d+)", 1).cast("int") * 5)
    )


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"),
        "l_orderkey", "l_linenumber", "l_partkey",
    )


OBS_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residue observations: eight orders make a pair; 84 positions; N and C roles by line status."""
    return table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 8).alias("pair_id"),
        (649 + (F.col("l_linenumber") * 12 + F.col("l_suppkey")) % 84).cast("int").alias("position"),
        F.substring(F.lit("KKKKKKEEMLP"), (1 + F.col("l_partkey") % 11).cast("int"), F.lit(1)).alias("aa"),
        F.when(F.col("l_linestatus") == "O", "N").otherwise("C").alias("role"),
        F.struct(*OBS_ORDER).alias("ord"),
    )


EVIDENCE_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base-level evidence at two target positions."""
    k = F.col("l_partkey") % 5
    odd = F.col("l_linenumber") % 2 == 1
    pair = F.concat(F.lit("P"), F.col("l_orderkey").cast("string"))
    mate = (1 + F.col("l_suppkey") % 2).cast("string")
    aa = F.substring(F.lit("MLPKE"), (1 + k).cast("int"), F.lit(1))
    codon = F.substring(F.lit("ATGCTGCCGAAGGAA"), (1 + 3 * k).cast("int"), F.lit(3))
    q = (F.col("l_quantity").cast("int") % 42)
    return table(spark, sf_dir, "lineitem").select(
        pair.alias("pair_id"), F.concat(pair, F.lit("/"), mate).alias("read_id"), F.concat(F.lit("R"), mate).alias("mate"),
        F.when(odd, POS_A).otherwise(POS_B).alias("target_position"),
        F.when(F.col("l_linestatus") == "O", "fwd").otherwise("rev").alias("orientation"),
        (1 + F.col("l_partkey") % 3).cast("int").alias("frame"),
        F.when(F.col("l_returnflag") == "N", "PAIRED_PARTNER").otherwise("PRIMARY").alias("evidence_role"),
        codon.alias("codon"), codon.alias("target_codon"), aa.alias("translated_aa"), aa.alias("target_aa"),
        ((16 - F.round(F.col("l_discount") * 100).cast("int") % 5) / 16).alias("anchor_identity"),
        q.alias("codon_min_qual"), (q + F.round(F.col("l_tax") * 100)).cast("double").alias("codon_mean_qual"),
        (1 + F.col("l_partkey") % 280).cast("int").alias("codon_nt_start"),
        F.when(odd, "M").otherwise("L").alias("expected_reference_aa"),
        F.when(F.col("l_suppkey") % 17 == 0, "codon_off_read").otherwise("").alias("note"),
        (F.col("l_orderkey") % 8).alias("batch_id"), (F.col("l_quantity") > 10).alias("any_candidate"),
        *EVIDENCE_TIES,
    )


# ------------------------------------------------------------------ the same as SQL

RC = lambda x: f"reverse(translate({x}, 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN'))"


def sql_codon(c: str) -> str:
    d = lambda i: f"(instr('TCAG', substr({c}, {i}, 1)) - 1)"
    return (
        f"CASE WHEN {c} IS NULL THEN NULL WHEN regexp_matches({c}, '^[ACGT][ACGT][ACGT]$') "
        f"THEN substr('{AA64}', 16 * {d(1)} + 4 * {d(2)} + {d(3)} + 1, 1) ELSE 'X' END"
    )


def sql_translate(x: str, frame: str | int = 1) -> str:
    """Peptide of SQL expression ``x``."""
    return (
        f"coalesce(array_to_string(list_transform(list_transform(range(0, greatest((length({x}) - {frame} + 1) // 3, 0)), "
        f"lambda i: substr({x}, {frame} + 3 * i, 3)), lambda c: {sql_codon('c')}), ''), '')"
    )


def sql_match(a: str, b: str) -> str:
    """Equal characters over the shared length."""
    return (
        f"len(list_filter(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) = substr({b}, i, 1)))"
    )


READS = f"""
letters AS (SELECT doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM documents),
tiles AS (SELECT doc_id, l, unnest(range(0, (length(l) + {READ_LENGTH - 1}) // {READ_LENGTH})) AS tile FROM letters),
pieces AS (SELECT doc_id, tile, substr(l, {READ_LENGTH} * tile + 1, {READ_LENGTH}) AS x FROM tiles),
mapped AS (SELECT doc_id, tile, translate(x, '{ALPHABET}', '{LETTER_TO_BASE}') AS b,
  translate(x, '{ALPHABET}', '{LETTER_TO_QUALITY}') AS q FROM pieces),
reads AS (SELECT doc_id, tile, doc_id * {READ_STRIDE} + tile // 2 + 1 AS read_index,
  'D' || doc_id || ':' || (tile // 2) || CASE WHEN tile % 2 = 1 THEN '/2' ELSE '/1' END AS read_id,
  'D' || doc_id || ':' || (tile // 2) AS pair_id,
  CASE WHEN tile % 2 = 1 THEN 'R2' ELSE 'R1' END AS mate,
  CASE WHEN tile % 2 = 1 THEN {RC('b')} ELSE b END AS seq,
  CASE WHEN tile % 2 = 1 THEN reverse(q) ELSE q END AS qual FROM mapped)
"""

DOCS = f"""
docs AS (SELECT doc_id, 'D' || doc_id AS name, lang, source,
  translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{LETTER_TO_BASE}') AS seq FROM documents)
"""

PROTEINS = f"""
cds0 AS (SELECT item_id, translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{ALPHABET}', '{LETTER_TO_BASE}') AS cds
  FROM benchmark),
proteins AS (SELECT item_id, 'B' || item_id AS gene, cds, {sql_translate('cds')} AS seq FROM cds0)
"""

HITS = """
hit0 AS (SELECT *, CAST(l_quantity AS INTEGER) AS n, 1 + (l_partkey * 7 + l_linenumber * 13) % 400 AS q0,
  1 + (l_suppkey * 11 + l_linenumber * 5) % 150 AS s0 FROM lineitem JOIN part ON l_partkey = p_partkey),
hit1 AS (SELECT *, q0 + n - 1 AS q1, s0 + n * 3 - 1 + CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS s1 FROM hit0),
hits AS (SELECT p_brand AS gene, 'R' || (1 + l_suppkey % 2) AS mate, 'L' || l_orderkey AS read_id, 'L' || l_orderkey AS pair_id,
  100 - round(l_discount * 100) - round(l_tax * 100) AS pident, n AS length, CAST(round(l_discount * 100) AS INTEGER) AS mismatch,
  CASE WHEN l_returnflag = 'R' THEN q1 ELSE q0 END AS qstart, CASE WHEN l_returnflag = 'R' THEN q0 ELSE q1 END AS qend,
  CASE WHEN l_linestatus = 'F' THEN s1 ELSE s0 END AS sstart, CASE WHEN l_linestatus = 'F' THEN s0 ELSE s1 END AS send,
  round(l_tax * 100) AS evalue, floor(l_extendedprice / 1000) AS bitscore,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM hit1),
nhits AS (SELECT * EXCLUDE (qstart, qend, sstart, send), qstart AS qstart_raw, qend AS qend_raw, sstart AS sstart_raw, send AS send_raw,
  least(qstart, qend) AS qstart, greatest(qstart, qend) AS qend, least(sstart, send) AS sstart, greatest(sstart, send) AS send FROM hits)
"""
HIT_ORDER_SQL = ", ".join(HIT_ORDER)

GENE_LENGTHS = """
gene_lengths AS (SELECT DISTINCT p_brand AS gene, 300 + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) * 5 AS protein_length FROM part)
"""

INTERVALS = """
intervals AS (SELECT l_suppkey AS key, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS s,
  date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INTEGER) AS e,
  l_orderkey, l_linenumber, l_partkey FROM lineitem)
"""

OBS = """
obs AS (SELECT l_orderkey // 8 AS pair_id, 649 + (l_linenumber * 12 + l_suppkey) % 84 AS position,
  substr('KKKKKKEEMLP', 1 + l_partkey % 11, 1) AS aa, CASE WHEN l_linestatus = 'O' THEN 'N' ELSE 'C' END AS role,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS ord FROM lineitem)
"""

EVIDENCE = f"""
ev AS (SELECT 'P' || l_orderkey AS pair_id, 'P' || l_orderkey || '/' || (1 + l_suppkey % 2) AS read_id, 'R' || (1 + l_suppkey % 2) AS mate,
  CASE WHEN l_linenumber % 2 = 1 THEN {POS_A} ELSE {POS_B} END AS target_position,
  CASE WHEN l_linestatus = 'O' THEN 'fwd' ELSE 'rev' END AS orientation, 1 + l_partkey % 3 AS frame,
  CASE WHEN l_returnflag = 'N' THEN 'PAIRED_PARTNER' ELSE 'PRIMARY' END AS evidence_role,
  substr('ATGCTGCCGAAGGAA', 1 + 3 * (l_partkey % 5), 3) AS codon, substr('MLPKE', 1 + l_partkey % 5, 1) AS aa,
  (16 - CAST(round(l_discount * 100) AS INTEGER) % 5) / 16.0 AS anchor_identity,
  CAST(l_quantity AS INTEGER) % 42 AS q, CAST(l_quantity AS INTEGER) % 42 + round(l_tax * 100) AS qmean,
  1 + l_partkey % 280 AS codon_nt_start, CASE WHEN l_linenumber % 2 = 1 THEN 'M' ELSE 'L' END AS expected,
  CASE WHEN l_suppkey % 17 = 0 THEN 'codon_off_read' ELSE '' END AS note,
  l_orderkey % 8 AS batch_id, l_quantity > 10 AS any_candidate,
  l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity FROM lineitem)
"""
TIES_SQL = ", ".join(EVIDENCE_TIES)
