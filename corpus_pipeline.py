"""Corpus pipeline: language, near-duplicates, repeated passages, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents; extra columns travel along, whatever their names.

Null, empty and letterless texts leave with the first stage. Of near-duplicates, and of rows that repeat each other or share a
doc_id and nearly the text, one row stays: that of the least doc_id, then of the least hash of the text. Rows without doc_id
are no near-duplicates of anything. Empty tables stay empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.llm import language, minhash, mixing, packing, suffixes
from strandweave.llm.common import land, table
from strandweave.llm.queries_models import tokenizer_path
from strandweave.operators.running import ordinal

#: Bytes of a passage that is removed where it repeats; fifty words of prose are longer.
PASSAGE_BYTES = 200
#: Similarity of word shingles from which documents are near-duplicates here; the 0.85 of op9 is that query's own.
NEAR = 0.8


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def columns_kept(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with all columns besides those of documents under names of no operator's own, and given back as they were."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        aside = {c: f"__extra_{i}" for i, c in enumerate(docs.columns) if c not in COLUMNS}
        out = stage(spark, docs.withColumnsRenamed(aside), sf_dir)
        return out.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])

    return run


@columns_kept
def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what language identification rejects: no letters, or far from every learned language."""
    model = language.fit(docs, language.training_rows())
    return language.identify(docs, model, tuple(docs.columns)).where(~F.col("rejected"))


@columns_kept
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, that of the least doc_id, and one of its repeated rows.

    Where a doc_id stands with more than one row, rows are numbered in the order of doc_id and text and judged by number."""
    several = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    numbered = not several.limit(1).isEmpty()
    if numbered:
        run = F.struct(F.shiftright("doc_id", 12).alias("k"))
        order = docs.where("doc_id is not null").withColumns({"__run": run, "__hash": F.xxhash64("text"), "__all": F.lit(0)})
        order = ordinal(order, ["__all"], "__run", ["doc_id", "__hash"], "__number").drop("__all", "__run", "__hash")
        docs = land(order.unionByName(docs.where("doc_id is null").withColumn("__number", F.lit(None).cast("long"))), "numbered")
    own = "__number" if numbered else "doc_id"
    judged = minhash.near_duplicates(docs.select(F.col(own).cast("long").alias("doc_id"), "text"), NEAR)
    gone = judged.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(own) == F.col("__gone"), "left_anti")


@columns_kept
def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of passages go, the first stays; documents of which no character but white space is left go too."""
    carry = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    out = suffixes.remove_repeated_bytes(docs, PASSAGE_BYTES, keep_first=True, with_text=True, carry=carry)
    text = F.col("kept_text")
    out = out.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    cols = {"text": text.alias("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if "n_chars" in carry else None}
    return out.select(*[cols.get(c) if cols.get(c) is not None else c for c in docs.columns])


@columns_kept
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies by source, in the order of a global shuffle."""
    return mixing.mix(docs, mixing.target_rates(docs)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", keep_known_languages),
    ("near_dedup", drop_near_duplicates),
    ("passage_dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: SQL cannot express the first, fourth and fifth stage here; tests compare the stages with plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = land(stage(spark, docs, sf_dir), name)
    return docs
