"""Registered queries: a callable over the tables of a folder, and its SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run
    return register


def table(spark: SparkSession, folder: str, name: str, heavy: bool = False) -> DataFrame:
    return read_table(spark, f"{folder.rstrip('/')}/{name}.parquet", heavy)
