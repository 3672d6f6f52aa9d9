"""Gates that fail before or during a job instead of returning wrong rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import translate_codon


class SchemaMismatch(ValueError):
    pass


class ReferenceMismatch(ValueError):
    pass


class GateFailed(RuntimeError):
    pass


class Gate:
    """Counts of rows that break a rule, taken while the rows pass by, so that no further scan is needed.

    ``watch`` returns the same rows; once an action has run over them, ``require`` raises if a rule was broken. A row that must
    not even be written is for :func:`enforce`.
    """

    def __init__(self, name: str):
        self.name, self.observation = name, None

    def watch(self, df: DataFrame, **rules: Column) -> DataFrame:
        """``rules``: name = condition that all rows fulfil; null breaks it."""
        self.observation = Observation(self.name)
        broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in rules.items()]
        return df.observe(self.observation, F.count(F.lit(1)).alias("rows"), *broken)

    def require(self) -> dict[str, int]:
        """Counts of rows and of broken rules; an error if there are any of the latter."""
        found = dict(self.observation.get)
        broken = {k: v for k, v in found.items() if k != "rows" and v}
        if broken:
            raise GateFailed(f"{self.name}: " + ", ".join(f"{v} of {found['rows']} rows break {k}" for k, v in broken.items()))
        return found


def require_columns(df: DataFrame, required: T.StructType | list[str]) -> DataFrame:
    """Raise when a column is missing or has another type; reads the schema only."""
    have = {f.name: f.dataType for f in df.schema.fields}
    want = {f.name: f.dataType for f in required.fields} if isinstance(required, T.StructType) else dict.fromkeys(required)
    missing = [n for n in want if n not in have]
    wrong = [n for n, t in want.items() if n in have and t is not None and have[n] != t]
    if missing or wrong:
        raise SchemaMismatch(f"missing columns {missing}, columns of another type {wrong}")
    return df


def unexpected_values(df: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Distinct values outside the allowed set (null included)."""
    return df.filter(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(column).distinct()


def reference_lock(seq: str | Column, expected: dict[int, str]) -> Column:
    """True when the reference has the expected residue at each position."""
    s = F.col(seq) if isinstance(seq, str) else seq
    out = F.lit(True)
    for p, aa in expected.items():
        out = out & (F.substring(s, p, 1) == aa)
    return out


def require_reference(reference: str, expected: dict[int, str]) -> str:
    """The reference protein, or an error that names the positions without their expected residue."""
    wrong = [f"{p}: {reference[p - 1:p] or 'none'} for {aa}" for p, aa in sorted(expected.items()) if reference[p - 1:p] != aa]
    if wrong:
        raise ReferenceMismatch("the reference has other residues at " + ", ".join(wrong))
    return reference


def locked_references(df: DataFrame, seq: str, expected: dict[int, str], name: str) -> DataFrame:
    """Rows pass through; a reference without an expected residue stops the job and is named."""
    return enforce(df, reference_lock(seq, expected), F.concat(F.lit("the reference lock fails for "), F.coalesce(F.col(name).cast("string"), F.lit("null"))))


def enforce(df: DataFrame, condition: Column, message: str | Column) -> DataFrame:
    """Rows pass through; a row that breaks the condition fails the job."""
    ok = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(message if isinstance(message, Column) else F.lit(message)).cast("boolean"))
    return df.filter(ok)


def pairing_report(reads: DataFrame, index: str = "read_index", pair: str = "pair_id") -> DataFrame:
    """Row i of R1 must pair with row i of R2: matched, mismatched and one-sided rows."""
    per = reads.groupBy(index).agg(
        F.max(F.when(F.col("mate") == "R1", F.col(pair))).alias("a"), F.max(F.when(F.col("mate") == "R2", F.col(pair))).alias("b")
    )
    return per.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("a") == F.col("b")).alias("aligned"),
        F.count_if(F.col("a") != F.col("b")).alias("misaligned"),
        F.count_if(F.col("a").isNull() | F.col("b").isNull()).alias("one_sided"),
    )


def require_pairing(reads: DataFrame, index: str = "read_index", pair: str = "pair_id") -> None:
    """Stop unless row i of R1 pairs with row i of R2 for every i (see the stream's own gate for landed files)."""
    found = pairing_report(reads, index, pair).first()
    if found["aligned"] != found["rows"]:
        raise GateFailed(f"pairing: {found['misaligned']} rows with two ids and {found['one_sided']} with one side, of {found['rows']}")


def require_translation(df: DataFrame, codon: str, residue: str) -> DataFrame:
    """Rows pass through; one whose residue is not the translation of its codon stops the job."""
    said = lambda c: F.coalesce(F.col(c), F.lit("null"))
    return enforce(df, translate_codon(codon) == F.col(residue), F.concat(F.lit("codon "), said(codon), F.lit(" stored with residue "), said(residue)))


def translation_consistency(df: DataFrame, codon: str, residue: str) -> DataFrame:
    """Rows whose stored residue is not the translation of their stored codon."""
    ok = translate_codon(codon) == F.col(residue)
    return df.agg(
        F.count(F.lit(1)).alias("checked"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("inconsistent")
    )


def codon_span_consistency(df: DataFrame) -> Column:
    """Nucleotide span of a hit equals three times its protein span."""
    return F.abs(F.col("send") - F.col("sstart")) + 1 == 3 * (F.abs(F.col("qend") - F.col("qstart")) + 1)
