"""Online forms of checks that need no look-back, and of the wear level.

They take streaming DataFrames (``spark.readStream``) with the same columns as the
batch operators. Alarm rules and contract bounds are the batch ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import parse_range
from millrace.operators.health import threshold_alarms
from millrace.operators.quality import column_catalog


def alarm_stream(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows that raise an alarm; stateless."""
    return threshold_alarms(events, rules).filter("alarm")


def range_counts(events: DataFrame, contract: DataFrame, ts: str, window: str = "1 hour",
                 late: str = "2 hours") -> DataFrame:
    """(window, field, n, outside) per tumbling window; rows later than ``late`` are
    dropped by the watermark. ``contract`` is a static table of field ranges."""
    bounds = contract.select(F.col("field_name").alias("field"), parse_range(F.col("typical_range")).alias("r")) \
        .filter("r is not null").select("field", "r.lo", "r.hi")
    named = column_catalog(events).join(bounds.select("field").distinct(), "field", "left_semi").collect()  # columns at most
    if not named:
        raise ValueError("no contract field with a readable range is in the stream")
    values = [F.struct(F.lit(r["field"]).alias("field"), F.col(f"`{r['field']}`").cast("double").alias("value")) for r in named]
    long = (events.withWatermark(ts, late)
            .select(ts, F.inline(F.array(*values))).filter("value is not null and not isnan(value)")
            .join(bounds, "field"))
    return long.groupBy(F.window(ts, window), "field").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("outside"))


def wear_stream(events: DataFrame, unit: str, ts: str, amount: str, reset: str,
                late: str = "10 minutes") -> DataFrame:
    """(unit, ts, wear) after each micro-batch: the clamped sum since the last reset.

    The state of a unit is its level and the time of its last row. Rows of a batch are
    applied in time order; rows without a time or older than the watermark are dropped in the
    step, as the engine hands them over. A unit whose rows were all dropped reports nothing.
    """
    schema = T.StructType([events.schema[unit], T.StructField("micros", T.LongType()),
                           T.StructField("wear", T.DoubleType())])

    def advance(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (0.0, None)
        rows = pd.concat(list(batches))
        rows = rows[rows["micros"] >= state.getCurrentWatermarkMs() * 1000]
        if not len(rows):
            return
        rows = rows.sort_values("micros", kind="stable")
        for used, service in zip(rows["amount"], rows["service"]):
            level = 0.0 if service else min(1.0, level + (0.0 if pd.isna(used) else max(0.0, used)))
        newest = int(rows["micros"].iloc[-1])
        last = newest if last is None else max(last, newest)
        state.update((level, last))
        yield pd.DataFrame({unit: [key[0]], "micros": [last], "wear": [level]})

    prepared = events.withWatermark(ts, late).select(
        unit, F.col(ts).alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"),
        F.col(amount).cast("double").alias("amount"),
        F.coalesce(F.col(reset), F.lit(False)).alias("service"))
    worn = prepared.groupBy(unit).applyInPandasWithState(
        advance, schema, "level double, micros long", "update", "NoTimeout")
    return worn.select(unit, F.timestamp_micros("micros").alias("ts"), "wear")
