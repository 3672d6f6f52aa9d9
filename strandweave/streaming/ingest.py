"""Incremental scan: newly landed read files -> prefilter -> validation -> append, once per batch.

Mates may land in different files and different batches: partner evidence is found in a batch step over all candidates and
the reads of the files that the stream has taken, so it does not depend on how files were grouped.

Before the scan, a stream of its own over the same files checks the pairing. Reads whose mate has not come yet wait in keyed
state; a read index with two pair ids or one mate twice stops the run, and so does, at the end of the input, a side that ended
before the other.

The checkpoint remembers which files are done, so a restart continues where it stopped. Each batch
overwrites its own ``batch_id`` partition, so a batch replayed after a failure leaves no duplicates.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alleles import deduplicate_evidence
from ..operators.checks import require_reference, require_translation
from ..operators.scan import MAX_AA_MISMATCH, MIN_ANCHOR_IDENTITY, Target, partners, prefilter, validate_anchors

READS = T.StructType(
    [
        T.StructField("read_index", T.LongType()), T.StructField("read_id", T.StringType()), T.StructField("pair_id", T.StringType()),
        T.StructField("mate", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType()),
    ]
)


class ConfigurationChanged(RuntimeError):
    pass


class UnpairedReads(RuntimeError):
    pass


@dataclass(frozen=True)
class ScanConfig:
    """Everything that decides the evidence. ``require_pairs`` stops a run whose landed reads are not one R1 and one R2 of one
    pair for each read index; ``reference`` and ``expected`` (position, residue) stop one whose reference is another protein."""

    targets: tuple[Target, ...]
    max_mismatch: int = 1
    max_aa_mismatch: int = MAX_AA_MISMATCH
    min_identity: float = MIN_ANCHOR_IDENTITY
    qual_offset: int = 33
    overhang: bool = True
    require_pairs: bool = True
    reference: str | None = None
    expected: tuple[tuple[int, str], ...] = ()

    def __post_init__(self):
        if self.reference is not None:
            require_reference(self.reference, dict(self.expected))
            for t in self.targets:
                require_reference(self.reference, {t.anchor_start + i: aa for i, aa in enumerate(t.anchor)})

    def row(self, landing: str = "") -> str:
        own = {k: v for k, v in self.__dict__.items() if k != "targets"}
        return json.dumps({"targets": [[t.position, t.residue, t.anchor, t.offset, t.anchor_start] for t in self.targets], "landing": landing, **own}, sort_keys=True)

    def validate(self, reads: DataFrame, role: str = "PRIMARY") -> DataFrame:
        found = validate_anchors(reads, list(self.targets), role, self.max_aa_mismatch, self.min_identity, self.qual_offset)
        return require_translation(found, "target_codon", "target_aa")


def lock_configuration(spark: SparkSession, out: str, config: ScanConfig, landing: str = "") -> None:
    """Store the run's configuration beside its output; refuse to continue under another one."""
    path = f"{out}/run_config"
    row = spark.createDataFrame([(config.row(landing),)], "config string")
    if not _exists(spark, path):
        row.coalesce(1).write.json(path)
        return
    stored = spark.read.schema("config string").json(path)
    same = stored.join(row.withColumnRenamed("config", "_new"), F.col("config").eqNullSafe(F.col("_new")), "left_semi")
    if same.isEmpty():
        raise ConfigurationChanged(f"{out} was started with another configuration")


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _overwrite_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def scan_batch(batch: DataFrame, batch_id: int, out: str, config: ScanConfig) -> None:
    """Candidates and primary evidence of one batch of read files."""
    _overwrite_batch(prefilter(batch, list(config.targets), config.max_mismatch, config.overhang), f"{out}/candidates", batch_id)
    cand = batch.sparkSession.read.parquet(f"{out}/candidates/batch_id={batch_id}")
    _overwrite_batch(config.validate(cand), f"{out}/primary", batch_id)


def _latest(spark: SparkSession, out: str) -> int | None:
    """Number of the last batch that has candidates."""
    if not _exists(spark, f"{out}/candidates"):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out}/candidates")
    found = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)]
    return max((int(n.split("=")[1]) for n in found if n.startswith("batch_id=")), default=None)


#: Read indexes that follow each other share a state, and blocks of them are dealt to so many states: a state costs some
#: milliseconds in each batch, so their number must not grow with read indexes that lie far apart.
BUCKET, BUCKETS = 4096, 4096
WAITING = "read_index array<long>, mate array<string>, pair_id array<string>"
MARK = "unpaired reads: "


def unmatched(rows: pd.DataFrame) -> pd.DataFrame:
    """The reads of one bucket that still wait for their mate; an error names what can never pair."""
    rows = rows.sort_values(["read_index", "mate"], kind="stable", ignore_index=True)
    size = rows.groupby("read_index", dropna=False)["mate"].transform("size")
    known = rows["mate"].isin(["R1", "R2"]) & rows["read_index"].notna() & rows["pair_id"].notna()
    first = (size == 2) & ~rows.duplicated("read_index")
    one, two = rows[first].reset_index(drop=True), rows[first.shift(fill_value=False)].reset_index(drop=True)
    diverging = one[(one["mate"] == two["mate"]) | (one["pair_id"] != two["pair_id"])]
    wrong = [*rows[(size > 2) | ~known]["read_index"], *diverging["read_index"]]
    if wrong:
        raise ValueError(f"{MARK}not one R1 and one R2 of one pair at read index " + ", ".join(map(str, sorted(set(wrong), key=str)[:5])) + ";")
    return rows[size == 1]


def hold_mates(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keyed state of the pairing gate: the unpaired reads of a bucket. Pairs leave it as soon as they are whole."""
    waiting = state.get if state.exists else ([], [], [])
    held = pd.DataFrame(dict(zip(["read_index", "mate", "pair_id"], waiting, strict=True)))
    left = unmatched(pd.concat([held.astype({"read_index": "Int64"}), *[b[["read_index", "mate", "pair_id"]].astype({"read_index": "Int64"}) for b in batches]], ignore_index=True))
    if len(left):
        state.update(tuple(left[c].tolist() for c in ("read_index", "mate", "pair_id")))
    else:
        state.remove()
    yield pd.DataFrame({"bucket": pd.Series([key[0]], dtype="int64"), "waiting": pd.Series([len(left)], dtype="int64")})


def check_pairs(spark: SparkSession, landing: str, out: str, files_per_batch: int = 64, complete: bool = True) -> None:
    """Check the pairing of files not checked yet; ``complete``: no more files come, so waiting reads are an error."""
    reads = spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(landing).select("read_index", "mate", "pair_id")
    bucket = F.when(F.col("read_index").isNull(), -1).otherwise(F.pmod(F.xxhash64(F.floor(F.col("read_index") / BUCKET)), F.lit(BUCKETS)))
    checked = reads.withColumn("bucket", bucket).groupBy("bucket").applyInPandasWithState(hold_mates, "bucket long, waiting long", WAITING, "update", GroupStateTimeout.NoTimeout)
    query = checked.writeStream.outputMode("update").format("noop").option("checkpointLocation", f"{out}/pairing").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        text = str(e)
        if MARK in text:
            raise UnpairedReads(text[text.index(MARK) + len(MARK):].split(";")[0]) from e
        raise
    if complete and _exists(spark, f"{out}/pairing/state"):
        left = spark.read.format("statestore").load(f"{out}/pairing").select(F.inline(F.arrays_zip(*[F.col(f"value.groupState.{c}").alias(c) for c in ("read_index", "mate")])))
        first = left.orderBy("read_index").limit(5).collect()  # a few for the message
        if first:
            raise UnpairedReads("one side ended before the other; without a mate: " + ", ".join(f"{r['mate']} of read index {r['read_index']}" for r in first))


def _taken_files(spark: SparkSession, out: str) -> list[str]:
    """The files that the committed batches of the scan have read, from the log of its checkpoint."""
    log = spark.read.text(f"{out}/checkpoint/sources/0").where(F.col("value").startswith("{"))
    return [unquote(r["path"]) for r in log.select(F.from_json("value", "path string").getField("path").alias("path")).distinct().collect()]


def link_partners(spark: SparkSession, landing: str, out: str, config: ScanConfig) -> None:
    """Partner evidence of all candidates so far among the reads of the files taken so far; done once for each state of the candidates."""
    latest = _latest(spark, out)
    if latest is None or _exists(spark, f"{out}/partners/upto={latest}/_SUCCESS"):
        return
    mates = partners(spark.read.schema(READS).parquet(*_taken_files(spark, out)), spark.read.parquet(f"{out}/candidates").drop("batch_id"))
    config.validate(mates, "PAIRED_PARTNER").write.mode("overwrite").parquet(f"{out}/partners/upto={latest}")


def ingest(spark: SparkSession, landing: str, out: str, config: ScanConfig, files_per_batch: int = 64, complete: bool = True) -> None:
    """Process every file not seen yet, then stop. The result does not depend on ``files_per_batch``.

    ``complete=False`` says that more files will come, so that reads may still wait for their mates at the end of this call.
    """
    lock_configuration(spark, out, config, landing)
    if config.require_pairs:
        check_pairs(spark, landing, out, 16 * files_per_batch, complete)
    stream = spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = (
        stream.writeStream.foreachBatch(lambda df, i: scan_batch(df, i, out, config))
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    link_partners(spark, landing, out, config)


def collected_evidence(spark: SparkSession, out: str) -> DataFrame:
    """Deduplicated evidence over all batches. The order matters, so this is a batch step."""
    both = spark.read.parquet(f"{out}/primary").drop("batch_id").unionByName(spark.read.parquet(f"{out}/partners/upto={_latest(spark, out)}"))
    return deduplicate_evidence(both, [F.col("read_codon_start")])


def running_counts(spark: SparkSession, landing: str, schema: T.StructType, by: list[str], table: str, checkpoint: str):
    """Counters kept as streaming state; each trigger overwrites the table at the path ``table``. Returns the started query."""
    counts = spark.readStream.schema(schema).parquet(landing).groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return (
        counts.writeStream.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(table))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
