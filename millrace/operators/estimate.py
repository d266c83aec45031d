"""Observations, ensembles and remaining useful life."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import coerce_number
from millrace.operators.health import health_of
from millrace.operators.ordered import row_index
from millrace.operators.wear import PER_1000H, step_rate
from millrace.operators.wiring import output_map
from millrace.operators.quality import column_catalog

# Fixed values of the estimation.
MEMBERS, STRIDE, SEED = 100, 50, 42
SPREAD, LEAST_SPREAD = 0.01, 1e-3
DEFAULT_RATE = 1e-4


def observations(rows: DataFrame, unit: list[str], order: str, tie: list[str],
                 ports: DataFrame, ranges: int | None = None) -> DataFrame:
    """(unit, t, port, value): numbers seen at the model's output ports; ``t`` is the row
    position of the unit, also for rows without any number."""
    mapping = {r["field"]: r["port"] for r in output_map(column_catalog(rows), ports).collect()}
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fields = [c for c in rows.columns if c in mapping]
    placed = row_index(rows.select(*unit, order, *tie, *[c for c in fields
                                                         if c not in (*unit, order, *tie)]),
                       unit, order, tie, "t", ranges=ranges)
    return placed.select(*unit, "t", F.inline(F.array(*[
        F.struct(F.lit(mapping[c]).alias("port"), coerce_number(F.col(c), types[c]).alias("value"))
        for c in fields]))).filter("value is not null")


@dataclass(frozen=True)
class StateSpec:
    """One state of a component model under constant input.

    ``degradation`` loses rate x drive per step, ``accumulation`` gains it (a negative
    rate drains), ``tracking`` moves to ``target`` by the capped rate, ``static`` stays.
    """

    name: str
    state_type: str
    initial: float
    rate: float = 0.0
    drive: float = 1.0
    lo: float = 0.0
    hi: float = 1.0
    target: float = 0.0


def state_rates(states: DataFrame, parameters: DataFrame) -> DataFrame:
    """Adds ``rate`` per step and ``drive`` to specified states.

    An explicit ``<state>_rate`` parameter is per 1000 operating hours; else the rate is
    one over the parameter named as timescale; else the default. The driver's parameter
    default is the constant drive, 1.0 without one.
    """
    key = ["machine_id", "component"]
    known = parameters.select(*key, F.col("name").alias("_name"), F.col("default").alias("_value"))

    def parameter(name, alias):
        found = known.select(*key, F.col("_name").alias("_wanted"), F.col("_value").alias(alias))
        return lambda df: (df.withColumn("_wanted", name)
                           .join(found, [*key, "_wanted"], "left").drop("_wanted"))

    out = states
    for step in (parameter(F.concat("name", F.lit("_rate")), "_rate"),
                 parameter(F.col("degradation_timescale"), "_scale"),
                 parameter(F.col("driver"), "_drive")):
        out = step(out)
    return out.withColumns({
        "rate": F.when(F.col("_rate").isNotNull(), step_rate(F.col("_rate"), F.lit(PER_1000H)))
        .when(F.col("_scale") > 0, 1.0 / F.col("_scale")).otherwise(F.lit(DEFAULT_RATE)),
        "drive": F.coalesce("_drive", F.lit(1.0))}).drop("_rate", "_scale", "_drive")


# ------------------------------------------------------------------ deterministic normals

def _uniform(digest: Column, at: int) -> Column:
    number = F.conv(F.substring(digest, at, 8), 16, 10).cast("double")
    return (number + 0.5) / 4294967296.0


def hashed_normal(*parts: Column) -> Column:
    """Standard normal number from a digest of its coordinates: the same for any
    partitioning, and again when a task is repeated."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))
    u, v = _uniform(digest, 1), _uniform(digest, 9)
    return F.sqrt(-2.0 * F.log(u)) * F.cos(2.0 * math.pi * v)


def initial_members(units: DataFrame, specs: list[StateSpec], members: int = MEMBERS,
                    seed: int = SEED) -> DataFrame:
    """One row per unit and member with the perturbed start of each state (wide)."""
    spread = units.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(members - 1))))
    unit_text = F.concat_ws("/", *[F.col(c).cast("string") for c in units.columns
                                   if c != "n_steps"])
    return spread.withColumns({
        s.name: F.lit(float(s.initial)) + max(abs(s.initial) * SPREAD, LEAST_SPREAD)
        * hashed_normal(F.lit(seed), unit_text, F.col("member"), F.lit(s.name)) for s in specs})


# ------------------------------------------------------------------ summaries

def strided(samples: DataFrame, stride: int = STRIDE, step: str = "t") -> DataFrame:
    """Every ``stride``-th step from the first one after the start, which is step 0."""
    return samples.filter((F.col(step) >= 1) & ((F.col(step) - 1) % stride == 0))


def ensemble_summary(samples: DataFrame, unit: list[str], states: list[str]) -> DataFrame:
    """(unit, t, state, mean, std): mean and population deviation over the members."""
    wide = samples.groupBy(*unit, "t").agg(*[
        F.struct(F.lit(s).alias("state"), F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"))
        .alias(f"_{i}") for i, s in enumerate(states)])
    return wide.select(*unit, "t", F.inline(F.array(*[f"_{i}" for i in range(len(states))])))


def ensemble_health(samples: DataFrame, unit: list[str], events: list[dict]) -> DataFrame:
    """(unit, t, event, health): mean over the members whose states are all numbers; null without any."""
    def known(e):
        states = [F.col(s["state"]) for s in e["states"]]
        return reduce(and_, [x.isNotNull() & ~F.isnan(x) for x in states])

    wide = samples.groupBy(*unit, "t").agg(*[
        F.struct(F.lit(e["event"]).alias("event"), F.avg(F.when(known(e), health_of(e))).alias("health"))
        .alias(f"_{i}") for i, e in enumerate(events)])
    return wide.select(*unit, "t", F.inline(F.array(*[f"_{i}" for i in range(len(events))])))


def summarize_times(times: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: already triggered, or mean, population deviation, least and largest time, or
    beyond the horizon, from event times ``(keys, triggered, time)``, where a
    missing or infinite time means not within the horizon."""
    finite = F.when(F.abs("time") < float("inf"), F.col("time"))
    stats = times.groupBy(*keys).agg(
        F.max("triggered").alias("already_triggered"), F.avg(finite).alias("m"),
        F.stddev_pop(finite).alias("d"), F.min(finite).alias("l"), F.max(finite).alias("h"))
    hit = F.col("already_triggered")
    none = F.lit(None).cast("double")
    return stats.select(
        *keys, "already_triggered",
        F.when(hit, 0.0).otherwise(F.col("m")).alias("rul_mean"),
        F.when(hit, 0.0).otherwise(F.col("d")).alias("rul_std"),
        F.when(hit, none).otherwise(F.col("l")).alias("rul_min"),
        F.when(hit, none).otherwise(F.col("h")).alias("rul_max"),
        (~hit & F.col("m").isNull()).alias("beyond_horizon"))
