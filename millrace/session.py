"""Session settings shared by jobs, tests and the benchmark."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive execution and Arrow; ``conf`` overrides win."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Only a single-process session without
    that setting, as in tests, gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="millrace-checkpoint-")
    return folder


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` through the checkpoint folder of the session."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    return df.checkpoint()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hash-partition by the keys a grouped Python step needs anyway, with a fixed count.

    Adaptive execution merges small shuffle partitions by their bytes, which would put
    cheap-to-store but slow-to-process groups into one task. The grouped step that
    follows reuses this partitioning, so there is still one shuffle.
    """
    return df.repartition(shuffle_width(df.sparkSession), *keys)


def read_table(spark: SparkSession, path: str, heavy: bool = False) -> DataFrame:
    """A Parquet table. ``heavy`` announces long work per row: a table stored in fewer
    splits than there are cores is dealt out first, a large one is left as it is."""
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if heavy and df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
