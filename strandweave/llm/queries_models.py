"""Queries of language identification, packing and the license scan; SQL cannot express them, tests compare them with plain code."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import language, licenses, packing
from .common import table
from .registry import query


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_language_id")
def op3(spark, sf_dir):
    """Every document, by a model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, language.training_rows())
    out = language.identify(docs, model)
    return out.select("doc_id", (~language.training_rows()).alias("held_out"), "lang_pred", "score", "rejected")


@query("op6_packing")
def op6(spark, sf_dir):
    """All documents in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op8_license_scan")
def op8(spark, sf_dir):
    """Every document against the base phrases and the templates."""
    docs = table(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.build_index(docs)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))
