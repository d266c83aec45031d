"""Alarms, event health, derived outputs, drift and operation mix of telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import clip
from millrace.operators.ordered import row_index

# Upper ends of the vibration severity bands (mm/s).
SEVERITY_BANDS = ((1.8, "smooth"), (5.4, "acceptable"), (10.7, "rough"))
WORST_SEVERITY = "critical"
EARLY_LATE_SHARE = 0.2
TRIGGERED, DEGRADING = 0.0, 1.0


# ------------------------------------------------------------------ threshold alarms

def _alarm(rule: dict) -> Column:
    value, limit = F.col(rule["column"]).cast("double"), F.lit(float(rule["limit"]))
    if rule.get("drift"):  # a limit that tightens (or widens) with a drifting state
        limit = limit - F.col(rule["drift"]) * float(rule.get("drift_factor", 1.0))
    kind = rule["kind"]
    if kind == "above":
        return value > limit
    if kind == "below":
        return value < limit
    if kind == "magnitude":
        return F.abs(value) > limit
    if kind == "deviation":
        return F.abs(value - float(rule["nominal"])) > limit
    setpoint = F.col(rule["setpoint"]).cast("double")
    ratio = F.when(setpoint > 0, value / setpoint).otherwise(1.0)
    return ratio > limit if kind == "ratio_above" else ratio < limit


def threshold_alarms(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Adds one boolean per rule and ``alarm``, their OR. A pure projection."""
    flags = {r["alarm"]: F.coalesce(_alarm(r), F.lit(False)) for r in rules}
    out = events.withColumns(flags)
    any_alarm = F.lit(False)
    for name in flags:
        any_alarm = any_alarm | F.col(name)
    return out.withColumn("alarm", any_alarm)


def first_failure(rules: list[dict]) -> Column:
    """Name of the first rule that holds, in rule order; null for none."""
    return F.coalesce(*[F.when(_alarm(r), F.lit(r["alarm"])) for r in rules])


def severity(value: Column) -> Column:
    case = F.when(value <= SEVERITY_BANDS[0][0], SEVERITY_BANDS[0][1])
    for limit, name in SEVERITY_BANDS[1:]:
        case = case.when(value <= limit, name)
    return F.when(value.isNotNull(), case.otherwise(WORST_SEVERITY))


# ------------------------------------------------------------------ event health

def health_of(spec: dict) -> Column:
    """Health in [0, 1] of one event over state columns of the row.

    ``spec``: event, states (list of {state, form, threshold}), combine ``any`` or
    ``all``. form ``limit``: (thr - x)/thr; ``wearout``: (x - thr)/(1 - thr).
    """
    parts = []
    for s in spec["states"]:
        x, thr = F.col(s["state"]), float(s["threshold"])
        parts.append(clip((thr - x) / thr if s["form"] == "limit" else (x - thr) / (1.0 - thr)))
    if len(parts) == 1:
        return parts[0]
    # Any of several causes: the worst counts. All needed: the best counts.
    return F.least(*parts) if spec.get("combine", "any") == "any" else F.greatest(*parts)


def event_health(states: DataFrame, specs: list[dict], keys: list[str]) -> DataFrame:
    """(keys, event, health, triggered, degrading) per row of wide states; no shuffle."""
    rows = F.inline(F.array(*[F.struct(F.lit(s["event"]).alias("event"),
                                       health_of(s).alias("health")) for s in specs]))
    return states.select(*keys, rows).withColumns({
        "triggered": F.col("health") <= TRIGGERED, "degrading": F.col("health") < DEGRADING})


def derived_outputs(states: DataFrame, rules: DataFrame, keys: list[str]) -> DataFrame:
    """The rows with one column per output rule ``(output, sql)`` over the states.

    Every rule becomes a column, so the rules are as many as the result is wide."""
    pairs = [(r["output"], r["sql"]) for r in rules.select("output", "sql").orderBy("output").collect()]
    return states.select(*keys, *[F.expr(sql).alias(name) for name, sql in pairs])


# ------------------------------------------------------------------ mix and drift

def operation_mix(events: DataFrame, type_column: str, flags: dict[str, Column]) -> DataFrame:
    """Rows, share and flag rates per operation type; one aggregation."""
    counts = events.groupBy(F.col(type_column).alias("operation_type")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c.cast("double")).alias(n) for n, c in flags.items()])
    total = counts.agg(F.sum("n").alias("_total")).withColumn("_one", F.lit(1))
    return (counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one")
            .withColumn("share", F.col("n") / F.col("_total")).drop("_one", "_total"))


def drift_early_late(events: DataFrame, unit: list[str], order: str, tie: list[str],
                     metrics: list[str], least_rows: int = 0,
                     ranges: int | None = None) -> DataFrame:
    """(unit, metric, n, early_mean, late_mean, early_std, late_std): the first and last
    fifth of each unit's rows, null where a fifth is no row. Units with ``least_rows`` rows
    or fewer are left out."""
    placed = row_index(events.select(*unit, order, *tie, *metrics), unit, order, tie, "_t",
                       total="_n", ranges=ranges)
    part = F.floor(F.col("_n") * F.lit(EARLY_LATE_SHARE))
    ends = placed.filter(F.col("_n") > least_rows).withColumns({
        "_early": F.col("_t") < part, "_late": F.col("_t") >= F.col("_n") - part})
    long = ends.select(*unit, "_n", "_early", "_late", F.inline(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("_v"))
        for m in metrics])))
    early, late = F.when(F.col("_early"), F.col("_v")), F.when(F.col("_late"), F.col("_v"))
    return long.groupBy(*unit, "metric").agg(
        F.max("_n").alias("n"), F.avg(early).alias("early_mean"), F.avg(late).alias("late_mean"),
        F.stddev_samp(early).alias("early_std"), F.stddev_samp(late).alias("late_std"))
