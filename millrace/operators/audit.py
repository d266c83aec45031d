"""Audits of state histories ``(unit, t, state, state_type, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numeric import is_bad

# Fixed values of the checks.
FULL_DRIFT, LEAST_DRIFT = 0.9, 1e-6
OSCILLATION_STEPS, OSCILLATION_LIMIT = 100, 100.0
STATIC_TOLERANCE = 1e-9


def first_bad_step(history: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, t, states): the earliest step with NaN or infinity and the states bad then.

    Per (unit, state) the first bad step is a pre-aggregated minimum; a unit then has
    one row per state at most.
    """
    per_state = (history.filter(is_bad(F.col("value"))).groupBy(*unit, "state")
                 .agg(F.min("t").alias("t")))
    first = per_state.groupBy(*unit).agg(F.min("t").alias("t"))
    return (per_state.join(first, [*unit, "t"])
            .groupBy(*unit, "t").agg(F.array_sort(F.collect_set("state")).alias("states")))


def usable_history(history: DataFrame, unit: list[str]) -> DataFrame:
    """Steps before the unit's first bad one, without null values."""
    first = first_bad_step(history, unit).select(*unit, F.col("t").alias("_bad"))
    return (history.join(first, unit, "left")
            .filter((F.col("_bad").isNull() | (F.col("t") < F.col("_bad")))
                    & F.col("value").isNotNull()).drop("_bad"))


def _ends(history, unit):
    return history.groupBy(*unit, "state", "state_type").agg(
        F.min_by("value", "t").alias("initial"), F.max_by("value", "t").alias("final"),
        F.count(F.lit(1)).alias("points"))


def state_movement(history: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, state, initial, final, changed) over the history."""
    return _ends(history, unit).select(
        *unit, "state", "initial", "final",
        (F.abs(F.col("final") - F.col("initial")) > STATIC_TOLERANCE).alias("changed"))


def audit_states(history: DataFrame, unit: list[str]) -> DataFrame:
    """(unit, state, severity, rule, detail): bad numbers, drift of degradation states and
    oscillation of tracking states.

    ``history`` has one row per (unit, state, t). Each unit's first bad step is found by one
    aggregation and met with its rows; a second one, by (unit, state), decides all rules: both
    ends, the number of points and the first ``OSCILLATION_STEPS`` values, at most one a step.
    Steps are whole numbers from 0; null values take no part.
    """
    wrong = is_bad(F.col("value"))
    first = history.filter(wrong).groupBy(*unit).agg(F.min("t").alias("_bad"))
    placed = history.join(first, unit, "left")
    usable = (F.col("_bad").isNull() | (F.col("t") < F.col("_bad"))) & F.col("value").isNotNull()
    wears = usable & (F.col("state_type") == "degradation")
    tracks = usable & (F.col("state_type") == "tracking")
    early = F.when(tracks & F.col("t").between(0, OSCILLATION_STEPS), F.struct("t", "value"))
    state = placed.groupBy(*unit, "state").agg(
        F.min(F.when(wrong & (F.col("t") == F.col("_bad")), F.col("t"))).alias("bad_at"),
        F.min_by("value", F.when(wears, F.col("t"))).alias("initial"),
        F.max_by("value", F.when(wears, F.col("t"))).alias("final"),
        F.count_if(wears).alias("worn_points"), F.count_if(tracks).alias("tracked_points"),
        F.array_sort(F.collect_list(early)).alias("early"))

    def found(when: Column, severity: str, rule: str, detail: Column) -> Column:
        return F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                                     detail.cast("double").alias("detail")))

    delta = F.col("initial") - F.col("final")
    drifts = F.col("worn_points") >= 2
    jump = F.array_max(F.transform("early", lambda at, i: F.abs(
        at["value"] - F.get(F.col("early"), i - 1)["value"])))
    rules = F.array(
        found(F.col("bad_at").isNotNull(), "issue", "bad number", F.col("bad_at")),
        F.coalesce(found(drifts & (delta <= 0), "issue", "did not degrade", delta),
                   found(drifts & (delta > FULL_DRIFT), "issue", "degraded too fast", delta),
                   found(drifts & (delta < LEAST_DRIFT), "warning", "barely changed", delta)),
        found((F.col("tracked_points") >= OSCILLATION_STEPS) & (jump > OSCILLATION_LIMIT),
              "warning", "oscillating", jump))
    return state.select(*unit, "state", F.inline(F.filter(rules, lambda rule: rule.isNotNull())))
