"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "strandweave", cores: str | int | None = None, shuffle_partitions: int | None = None,
                  **conf: str) -> SparkSession:
    """A session with the settings the library relies on. ``cores`` makes it a local one (tests, bench); without it the
    master and the memory are those of the submitted job."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if cores is not None:
        b = b.master(f"local[{cores}]").config("spark.driver.memory", os.environ.get("LOCAL_DRIVER_MEMORY", "12g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    The cluster names a folder every executor can reach in that setting; only where it is
    unset and the master is local (tests, a laptop) is a machine-local folder used, and then
    remembered in the session. It is an error on any other master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="spark-")
        try:
            spark.conf.set("spark.checkpoint.dir", base)
        except Exception:  # static on some deployments: keep the folder for this call only
            pass
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df, label: str, made: list[str] | None = None):
    """Materialise ``df`` as a table in the scratch folder and read it back.

    Used where one frame feeds several branches or a Python kernel must not run twice; the
    written files survive executor loss, unlike cached blocks. ``made`` gets the folder.
    """
    path = scratch_dir(df.sparkSession, label)
    if made is not None:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that ``cut_lineage`` made, by the file system that Spark finds them in."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
