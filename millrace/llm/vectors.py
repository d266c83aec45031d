"""Vectors as classes of equal ones: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import reliable_checkpoint


def usable(vector: str) -> Column:
    """Not null, not zero, no component null or not finite."""
    return F.expr(f"coalesce(size({vector}) > 0 and forall({vector}, x -> x is not null and not isnan(x) and "
                  f"abs(x) < double('Infinity')) and exists({vector}, x -> x != 0), false)")


def keyed(table: DataFrame) -> DataFrame:
    """vec_id, v (array of double), k1, k2 (128 bits that stand for the vector) of usable rows."""
    rows = table.where(usable("embedding")).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit(1), "v"))


def classes(rows: DataFrame, least: int = 1) -> DataFrame:
    """One row per distinct vector: c (its number), k1, k2, v, n (copies), ids (the ``least``
    smallest vec_ids). Copies meet after partial aggregation, so a hot vector is one row."""
    if least == 1:
        ids = F.array(F.min("vec_id"))
        grouped = rows.groupBy("k1", "k2")
    else:  # the smallest of each of some tens of parts first, so that no task holds all copies
        part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
        rank = F.row_number().over(Window.partitionBy("k1", "k2", "part").orderBy("vec_id"))
        counted = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
        few = rows.select("k1", "k2", "vec_id", part.alias("part")).distinct().withColumn("rank", rank) \
            .where(F.col("rank") <= least).groupBy("k1", "k2") \
            .agg(F.slice(F.array_sort(F.collect_list("vec_id")), 1, least).alias("ids"))
        return reliable_checkpoint(counted.join(few, ["k1", "k2"])
                                   .select(F.monotonically_increasing_id().alias("c"), "k1", "k2", "v", "n", "ids"))
    one = grouped.agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"), ids.alias("ids"))
    return reliable_checkpoint(one.select(F.monotonically_increasing_id().alias("c"), "k1", "k2", "v", "n", "ids"))


def matrix(rows) -> np.ndarray:
    """Rows of equal length as a matrix of doubles."""
    return np.array([np.asarray(r, np.float64) for r in rows])


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def planes(seed: int, dim: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, count))


def by_dimension(series: pd.Series):
    """(positions, matrix) for each length of vector in a batch."""
    lengths = series.map(len).to_numpy()
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, matrix(series.iloc[at])
