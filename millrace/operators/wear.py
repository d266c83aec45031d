"""Usage-driven wear, restoration, tracking and accumulation states, maintenance due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordered import Last, SumSince, affine_fold, order_number, running_sum, scan

# Operating hours behind one unit of each rate basis, and the largest
# tracking coefficient.
PER_EVENT, PER_HOUR, PER_1000H = "per_event", "per_hour", "per_1000h"
TRACKING_CAP = 0.5


def step_rate(rate: Column, basis: Column) -> Column:
    """Rate per step of one hour (or one event)."""
    return F.when(basis == PER_1000H, rate / 1000.0).otherwise(rate)


def wear_index(events: DataFrame, unit: list[str], order: str, tie: list[str], rate: float,
               driver: str, reset: str, basis: str = PER_EVENT, name: str = "wear",
               ranges: int | None = None) -> DataFrame:
    """Linear wear of each unit: rate x driver summed since the last ``reset`` row,
    limited to [0, 1]. Equals the step-by-step clamped update, also in its last bits, as
    limits are compared with it."""
    used = events.withColumn("_use", step_rate(F.lit(float(rate)), F.lit(basis))
                             * F.greatest(F.col(driver).cast("double"), F.lit(0.0)))
    out = running_sum(used, unit, order, tie, "_use", reset, "_sum", ranges)
    return out.withColumn(name, F.least(F.lit(1.0), F.col("_sum"))).drop("_use", "_sum")


# ------------------------------------------------------------------ affine state steps
# Each builder gives the step columns of ``affine_fold``.

def _step(a, b, lo=0.0, hi=1.0) -> dict[str, Column]:
    def number(x):
        return x.cast("double") if isinstance(x, Column) else F.lit(float(x))
    return {"a": number(a), "b": number(b), "lo": number(lo), "hi": number(hi)}


def accelerating_step(use: Column, k: float = 0.0) -> dict[str, Column]:
    """w + use * (1 + k*w), limited to [0, 1]; ``use`` is rate x driver. A factor from
    another, already known state is part of ``use``."""
    return _step(1 + use * k, use)


def restoring_step(kind: Column, factor: Column) -> dict[str, Column]:
    """scale: w*(1-f); reset: 0; add: min(1, w+f); anything else leaves w alone."""
    return _step(F.when(kind == "scale", 1 - factor).when(kind == "reset", 0.0).otherwise(1.0),
                 F.when(kind == "add", factor).otherwise(0.0))


def tracking_step(coefficient: Column, target: Column, dt: Column, lo=float("-inf"),
                  hi=float("inf")) -> dict[str, Column]:
    """x + min(c, 0.5) * (target - x) * dt, limited."""
    pull = F.least(coefficient, F.lit(TRACKING_CAP)) * dt
    return _step(1 - pull, pull * target, lo, hi)


def accumulation_step(change: Column, capacity) -> dict[str, Column]:
    """x + change, limited to [0, capacity]; a negative change drains."""
    return _step(1.0, change, 0.0, capacity)


def choose_step(condition: Column, yes: dict[str, Column], no: dict[str, Column]):
    return {k: F.when(condition, yes[k]).otherwise(no[k]) for k in ("a", "b", "lo", "hi")}


def fold_states(rows: DataFrame, keys: list[str], order: str, tie: list[str],
                steps: dict[str, Column], start: Column, name: str = "level",
                ranges: int | None = None) -> DataFrame:
    """State after each row of each key for affine ``steps``; hot keys fold in parallel."""
    prepared = rows.withColumns({**steps, "_from": start.cast("double")})
    return affine_fold(prepared, keys, order, tie, "_from", name, ranges) \
        .drop("a", "b", "lo", "hi", "_from")


def merge_maintenance(events: DataFrame, maintenance: DataFrame) -> DataFrame:
    """Events and maintenance in one ordered stream; ``_kind`` 0 puts maintenance first
    among equal times."""
    return (maintenance.withColumn("_kind", F.lit(0))
            .unionByName(events.withColumn("_kind", F.lit(1)), allowMissingColumns=True))


# ------------------------------------------------------------------ maintenance due

def maintenance_due(events: DataFrame, unit: list[str], order: str, tie: list[str],
                    rules: list[dict], service: str, first_only: bool = False,
                    ranges: int | None = None) -> DataFrame:
    """(input keys, rule): rows where a rule asks for maintenance.

    ``service`` is a boolean column of service rows. A rule is a dict with ``rule``,
    ``kind`` and ``limit``: ``hours`` since the last service (or the unit's first row),
    ``count`` of rows since then, or ``level`` with the ``column`` that must exceed the
    limit. All matches, or only the first in rule order.
    """
    marked = F.col(service)
    noted = events.withColumns({"_us": order_number(events, order), "_one": F.lit(1.0)}).withColumn("_mark", F.when(marked, F.col("_us")))
    seen = scan(noted, unit, order, tie, [
        Last("_since_us", "_mark", noted.schema["_us"].dataType.simpleString(), first="_us"),
        SumSince("_since_t", "_one", service, first=True)], ranges)
    hours = (F.col("_us") - F.col("_since_us")) / 3_600_000_000
    count = F.col("_since_t")
    tests = []
    for r in rules:
        if r["kind"] == "hours":
            hit = hours >= r["limit"]
        elif r["kind"] == "count":
            hit = count >= r["limit"]
        else:
            hit = F.col(r["column"]) > r["limit"]
        tests.append(F.when(F.coalesce(hit, F.lit(False)), F.lit(r["rule"])))
    due = F.array(F.coalesce(*tests)) if first_only else F.array(*tests)
    kept = [c for c in events.columns]
    return (seen.filter(~marked).select(*kept, F.explode(due).alias("rule"))
            .filter("rule is not null"))
