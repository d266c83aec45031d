"""Writers: step results, profile files, summaries and the chunk collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.chunks import upsert

SUMMARY_SCHEMA = (
    "machine_name string, machine_type string, n_events long, "
    "date_range struct<start:timestamp_ntz,end:timestamp_ntz,days:long>, "
    "product_types array<string>, "
    "signals array<struct<field:string,dtype:string,missing_pct:double,min:double,max:double,"
    "mean:double,std:double,median:double,unit_hint:string,categories:array<string>,"
    "n_unique:long>>, has_maintenance boolean, n_maintenance long, "
    "maintenance_types array<string>, "
    "wear_signals array<struct<signal:string,min:double,max:double,mean:double,"
    "maintenance_types:array<string>>>, temporal_columns array<string>, "
    "id_columns array<string>, target_columns array<string>, "
    "degradation_indicators array<string>")


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def step_result(spark: SparkSession, path: str, compute: Callable[[], DataFrame],
                partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The stored result of a step, computed and written only when it is absent.

    A finished write leaves ``_SUCCESS``; a folder without it is a broken attempt and
    is written again.
    """
    if not path_exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        compute().write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def write_profiles(events: DataFrame, path: str, profile: str = "profile") -> None:
    """CSV files, one folder per usage profile. Rows of a profile keep their tasks: a
    large profile is written as several files."""
    events.write.mode("overwrite").option("header", True).partitionBy(profile).csv(path)


def write_profile(events: DataFrame, folder: str, profile: str, prefix: str = "fleet") -> str:
    """One profile as a folder of CSV part files that ``scan_profiles`` finds; its path."""
    path = f"{folder.rstrip('/')}/{prefix}_events_{profile}.csv"
    events.write.mode("overwrite").option("header", True).option("nullValue", "NA").csv(path)
    return path


def save_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def load_summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SUMMARY_SCHEMA).json(path)


class ChunkCollection:
    """A stored chunk collection; every write makes a new version folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _versions(self) -> list[int]:
        if not path_exists(self.spark, self.path):
            return []
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit()
                      and path_exists(self.spark, f"{self.path}/{n}/_SUCCESS"))

    def read(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{versions[-1]}")

    def _write(self, chunks: DataFrame) -> None:
        following = (self._versions() or [0])[-1] + 1
        chunks.write.mode("overwrite").parquet(f"{self.path}/v{following}")

    def upsert(self, incoming: DataFrame, version: str) -> None:
        self._write(upsert(self.read(), incoming, version))

    def count(self) -> int:
        return self.read().agg(F.count(F.lit(1))).first()[0]

    def drop(self) -> None:
        """Leaves the collection empty; earlier versions stay on disk."""
        self._write(self.spark.createDataFrame([], self.schema))
