"""Wear, alarms, audits, observations, ensembles and remaining life over the events table.

Unit = user, operation type = event type, service = signup, order = (ts, event_id).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.numeric import nearly, round_half
from millrace.operators import audit, estimate, health, wear
from millrace.operators.ordered import row_index
from millrace.plans.registry import query, table

UNIT, ORDER, TIE = ["user_id"], "ts", ["event_id"]
RATE = 0.0008


def events(spark, folder):
    return table(spark, folder, "events").drop("props").withColumn(
        "service", F.col("event_type") == "signup")


def worn_events(spark, folder):
    return wear.wear_index(events(spark, folder), UNIT, ORDER, TIE, RATE, "value", "service")


def unit_rows(spark, folder):
    return row_index(events(spark, folder), UNIT, ORDER, TIE, "t")


_WEAR = f"""WITH ev AS (SELECT *, event_type = 'signup' AS service FROM events),
ep AS (SELECT *, sum(CASE WHEN service THEN 1 ELSE 0 END) OVER w AS epoch, row_number() OVER w - 1 AS t FROM ev
       WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
worn AS (SELECT *, least(1.0::DOUBLE, sum(CASE WHEN service THEN 0.0::DOUBLE ELSE {RATE}::DOUBLE * value END) OVER (
           PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)) AS wear FROM ep)"""


@query("wear_index", _WEAR + " SELECT event_id, user_id, round(wear, 6) AS wear FROM worn")
def wear_index(spark, folder):
    return worn_events(spark, folder).select("event_id", "user_id", round_half("wear", 6).alias("wear"))


# ------------------------------------------------------------------ operation mix, drift

@query("operation_mix", """
SELECT event_type AS operation_type, count(*) AS n, round(avg(CASE WHEN value > 200 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS alarm_rate,
  round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1""")
def operation_mix(spark, folder):
    mix = health.operation_mix(events(spark, folder), "event_type", {"alarm_rate": F.col("value") > 200})
    return mix.select("operation_type", "n", round_half("alarm_rate", 6).alias("alarm_rate"),
                      round_half("share", 6).alias("share"))


@query("drift_early_late", """
WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn,
             count(*) OVER (PARTITION BY user_id) AS n FROM events),
p AS (SELECT *, floor(n * 0.2::DOUBLE) AS part FROM r)
SELECT user_id, 'value' AS metric, n, round(avg(value) FILTER (rn <= part), 6) AS early_mean, round(avg(value) FILTER (rn > n - part), 6) AS late_mean,
  round(stddev_samp(value) FILTER (rn <= part), 6) AS early_std, round(stddev_samp(value) FILTER (rn > n - part), 6) AS late_std
FROM p GROUP BY user_id, n""")
def drift_early_late(spark, folder):
    drift = health.drift_early_late(events(spark, folder), UNIT, ORDER, TIE, ["value"])
    return drift.select("user_id", "metric", "n", *[round_half(c, 6).alias(c) for c in (
        "early_mean", "late_mean", "early_std", "late_std")])


# ------------------------------------------------------------------ alarms, maintenance due

ALARM_RULES = [
    {"alarm": "hot", "kind": "above", "column": "value", "limit": 250},
    {"alarm": "low", "kind": "below", "column": "value", "limit": 2},
    {"alarm": "vibration", "kind": "magnitude", "column": "value", "limit": 300},
    {"alarm": "off_nominal", "kind": "deviation", "column": "value", "nominal": 50, "limit": 120},
    {"alarm": "flow_high", "kind": "ratio_above", "column": "value", "setpoint": "setpoint", "limit": 3.0},
    {"alarm": "flow_low", "kind": "ratio_below", "column": "value", "setpoint": "setpoint", "limit": 0.1},
    {"alarm": "drifting", "kind": "above", "column": "value", "limit": 240, "drift": "wear", "drift_factor": 100},
]


@query("threshold_alarms", _WEAR + """,
s AS (SELECT *, user_id - 50 AS setpoint FROM worn),
f AS (SELECT event_id, value > 250 AS hot, value < 2 AS low, abs(value) > 300 AS vibration, abs(value - 50) > 120 AS off_nominal,
  CASE WHEN setpoint > 0 THEN value / setpoint ELSE 1.0::DOUBLE END > 3.0::DOUBLE AS flow_high,
  CASE WHEN setpoint > 0 THEN value / setpoint ELSE 1.0::DOUBLE END < 0.1::DOUBLE AS flow_low, value > 240 - wear * 100 AS drifting,
  CASE WHEN value <= 1.8 THEN 'smooth' WHEN value <= 5.4 THEN 'acceptable' WHEN value <= 10.7 THEN 'rough' ELSE 'critical' END AS severity FROM s)
SELECT *, hot OR low OR vibration OR off_nominal OR flow_high OR flow_low OR drifting AS alarm,
  CASE WHEN hot THEN 'hot' WHEN low THEN 'low' WHEN vibration THEN 'vibration' WHEN off_nominal THEN 'off_nominal'
    WHEN flow_high THEN 'flow_high' WHEN flow_low THEN 'flow_low' WHEN drifting THEN 'drifting' END AS first_failure FROM f""")
def threshold_alarms(spark, folder):
    rows = worn_events(spark, folder).withColumn("setpoint", F.col("user_id") - 50)
    out = health.threshold_alarms(rows, ALARM_RULES)
    return out.select("event_id", *[r["alarm"] for r in ALARM_RULES], "alarm",
                      health.severity(F.col("value")).alias("severity"),
                      health.first_failure(ALARM_RULES).alias("first_failure"))


DUE_RULES = [{"rule": "scheduled", "kind": "hours", "limit": 72},
             {"rule": "level", "kind": "level", "column": "wear", "limit": 0.3},
             {"rule": "count", "kind": "count", "limit": 8}]
_DUE = _WEAR + """,
s AS (SELECT *, last_value(CASE WHEN service OR t = 0 THEN epoch_us(ts) END IGNORE NULLS) OVER w AS since_us,
        last_value(CASE WHEN service OR t = 0 THEN t END IGNORE NULLS) OVER w AS since_t FROM worn
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
due AS (SELECT event_id, 'scheduled' AS rule, 1 AS ord FROM s WHERE NOT service AND (epoch_us(ts) - since_us) / 3600000000.0::DOUBLE >= 72
        UNION ALL SELECT event_id, 'level', 2 FROM s WHERE NOT service AND wear > 0.3::DOUBLE
        UNION ALL SELECT event_id, 'count', 3 FROM s WHERE NOT service AND t - since_t >= 8)"""


@query("maintenance_due", _DUE + " SELECT event_id, rule FROM due")
def maintenance_due(spark, folder):
    return wear.maintenance_due(worn_events(spark, folder), UNIT, ORDER, TIE, DUE_RULES,
                                "service").select("event_id", "rule")


@query("first_maintenance_due", _DUE + " SELECT event_id, arg_min(rule, ord) AS rule FROM due GROUP BY 1")
def first_maintenance_due(spark, folder):
    return wear.maintenance_due(worn_events(spark, folder), UNIT, ORDER, TIE, DUE_RULES,
                                "service", first_only=True).select("event_id", "rule")


# ------------------------------------------------------------------ event health, outputs

EVENT_SPECS = [
    {"event": "worn", "states": [{"state": "wear", "form": "limit", "threshold": 0.3}]},
    {"event": "weak", "states": [{"state": "margin", "form": "wearout", "threshold": 0.4}]},
    {"event": "both", "combine": "all", "states": [
        {"state": "wear", "form": "limit", "threshold": 0.3},
        {"state": "margin", "form": "wearout", "threshold": 0.4}]},
    {"event": "either", "states": [{"state": "wear", "form": "limit", "threshold": 0.5},
                                   {"state": "margin", "form": "wearout", "threshold": 0.2}]},
]


def wide_states(spark, folder):
    """Per event: the wear level and the remaining reading margin."""
    return worn_events(spark, folder).withColumn("margin", 1 - F.col("value") / 500)


_HEALTH = _WEAR + """,
w AS (SELECT *, 1 - value / 500 AS margin FROM worn),
c AS (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.3::DOUBLE - wear) / 0.3::DOUBLE)) AS a, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (margin - 0.4::DOUBLE) / 0.6::DOUBLE)) AS b,
        least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.5::DOUBLE - wear) / 0.5::DOUBLE)) AS c, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (margin - 0.2::DOUBLE) / 0.8::DOUBLE)) AS d FROM w),
h AS (SELECT event_id, user_id, t, 'worn' AS event, a AS health FROM c UNION ALL SELECT event_id, user_id, t, 'weak', b FROM c
      UNION ALL SELECT event_id, user_id, t, 'both', greatest(a, b) FROM c UNION ALL SELECT event_id, user_id, t, 'either', least(c, d) FROM c)"""


@query("event_health", _HEALTH + " SELECT event_id, event, round(health, 6) AS health, health <= 0 AS triggered, health < 1 AS degrading FROM h")
def event_health(spark, folder):
    out = health.event_health(wide_states(spark, folder), EVENT_SPECS, ["event_id"])
    return out.withColumn("health", round_half("health", 6))


@query("start_health", _HEALTH + " SELECT user_id, event, round(health, 6) AS health FROM h WHERE t = 0 AND NOT abs(health - 1) < 1e-6")
def start_health(spark, folder):
    placed = row_index(wide_states(spark, folder), UNIT, ORDER, TIE, "t").filter("t = 0")
    out = health.event_health(placed, EVENT_SPECS, ["user_id"])
    return out.filter(~nearly(F.col("health"), 1.0)).select(
        "user_id", "event", round_half("health", 6).alias("health"))


OUTPUT_RULES = [("pressure", "round(6.0 + 2.0 * (1 - wear), 6)"), ("valve", "CASE WHEN margin < 0.7 THEN 'closed' ELSE 'open' END"),
                ("overheated", "wear > 0.3 AND value > 100"), ("noise", "round(0.5 + 10.0 * wear, 6)")]


@query("derived_outputs", _WEAR + """, w AS (SELECT *, 1 - value / 500 AS margin FROM worn)
SELECT event_id, round(6.0::DOUBLE + 2.0::DOUBLE * (1 - wear), 6) AS pressure, CASE WHEN margin < 0.7::DOUBLE THEN 'closed' ELSE 'open' END AS valve,
  wear > 0.3::DOUBLE AND value > 100 AS overheated, round(0.5::DOUBLE + 10.0::DOUBLE * wear, 6) AS noise FROM w""")
def derived_outputs(spark, folder):
    rules = spark.createDataFrame(OUTPUT_RULES, "output string, sql string")
    return health.derived_outputs(wide_states(spark, folder), rules, ["event_id"])


# ------------------------------------------------------------------ folds

_SEQ = """WITH RECURSIVE seq AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
fold AS (SELECT user_id, event_id, rn, {first} FROM seq WHERE rn = 1
  UNION ALL SELECT s.user_id, s.event_id, s.rn, {step} FROM fold f JOIN seq s ON s.user_id = f.user_id AND s.rn = f.rn + 1)
SELECT event_id, {out} FROM fold"""


def _fold_sql(start: dict, step: dict, digits: int | None = 6) -> str:
    """A recursion over row numbers; ``{p}`` in a step is the state before it."""
    first = ", ".join(f"{step[s].replace('{p.', '{').format(**{k: f'{v}::DOUBLE' for k, v in start.items()})} AS {s}"
                      .replace("s.value", "value").replace("s.event_type", "event_type") for s in start)
    later = ", ".join(f"{step[s].replace('{p.', '{').format(**{k: f'f.{k}' for k in start})}" for s in start)
    return _SEQ.format(first=first, step=later, out=", ".join(
        f"round({s}, {digits}) AS {s}" if digits else s for s in start))


_AFFINE_STEP = ("CASE event_type WHEN 'signup' THEN {p.level} * (1 - 0.9::DOUBLE) WHEN 'error' THEN least(1.0::DOUBLE, {p.level} + 0.1::DOUBLE) "
                "ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, (1 + s.value * 0.0005::DOUBLE * 2.0::DOUBLE) * {p.level} + s.value * 0.0005::DOUBLE)) END")


@query("wear_fold", _fold_sql({"level": 0.0}, {"level": _AFFINE_STEP.replace("CASE event_type", "CASE s.event_type")}))
def wear_fold(spark, folder):
    """Self-accelerating wear with partial restoration at service and a jump at errors."""
    kind = F.col("event_type")
    steps = wear.choose_step(
        kind.isin("signup", "error"),
        wear.restoring_step(F.when(kind == "signup", "scale").otherwise("add"),
                            F.when(kind == "signup", 0.9).otherwise(0.1)),
        wear.accelerating_step(F.col("value") * 0.0005, 2.0))
    out = wear.fold_states(events(spark, folder), UNIT, ORDER, TIE, steps, F.lit(0.0))
    return out.select("event_id", round_half("level", 6).alias("level"))


@query("tracking_fold", _fold_sql({"level": 25.0}, {"level": (
    "least(120.0::DOUBLE, greatest(20.0::DOUBLE, (1 - 0.1::DOUBLE) * {p.level} + 0.1::DOUBLE * (25 + s.value / 2)))")}, digits=None))
def tracking_fold(spark, folder):
    steps = wear.tracking_step(F.lit(0.1), 25 + F.col("value") / 2, F.lit(1.0), 20.0, 120.0)
    out = wear.fold_states(events(spark, folder), UNIT, ORDER, TIE, steps, F.lit(25.0))
    return out.select("event_id", "level")


@query("accumulation_fold", _fold_sql({"level": 50.0}, {"level": (
    "least(200.0::DOUBLE, greatest(0.0::DOUBLE, {p.level} + CASE WHEN s.event_type IN ('click', 'view') THEN s.value * 0.5::DOUBLE ELSE -s.value * 0.4::DOUBLE END))")}))
def accumulation_fold(spark, folder):
    fills = F.col("event_type").isin("click", "view")
    change = F.when(fills, F.col("value") * 0.5).otherwise(-F.col("value") * 0.4)
    steps = wear.accumulation_step(change, 200.0)
    out = wear.fold_states(events(spark, folder), UNIT, ORDER, TIE, steps, F.lit(50.0))
    return out.select("event_id", round_half("level", 6).alias("level"))


# ------------------------------------------------------------------ audits

_HISTORY = """WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t,
    CASE WHEN event_type = 'error' AND value > 150 THEN CAST('nan' AS DOUBLE) WHEN value > 330 THEN CAST('inf' AS DOUBLE) ELSE value END AS value FROM events),
hist AS (SELECT user_id, t, 'reading' AS state, 'tracking' AS state_type, value FROM r
         UNION ALL SELECT user_id, t, 'margin', 'degradation', 1 - value / 300 FROM r),
bad AS (SELECT user_id, t, state FROM hist WHERE isnan(value) OR isinf(value)),
firstbad AS (SELECT user_id, min(t) AS t FROM bad GROUP BY 1),
good AS (SELECT h.* FROM hist h LEFT JOIN firstbad f ON h.user_id = f.user_id WHERE f.t IS NULL OR h.t < f.t),
ends AS (SELECT user_id, state, state_type, arg_min(value, t) AS initial, arg_max(value, t) AS final, count(*) AS points FROM good GROUP BY ALL),
jump AS (SELECT user_id, state, abs(value - lag(value) OVER (PARTITION BY user_id, state ORDER BY t)) AS j, t FROM good WHERE state_type = 'tracking'),
found AS (
  SELECT b.user_id, b.state, 'issue' AS severity, 'bad number' AS rule, CAST(b.t AS DOUBLE) AS detail FROM bad b JOIN firstbad f ON b.user_id = f.user_id AND b.t = f.t
  UNION ALL SELECT user_id, state, CASE WHEN initial - final <= 0 OR initial - final > 0.9 THEN 'issue' ELSE 'warning' END,
    CASE WHEN initial - final <= 0 THEN 'did not degrade' WHEN initial - final > 0.9 THEN 'degraded too fast' ELSE 'barely changed' END, initial - final
  FROM ends WHERE state_type = 'degradation' AND points >= 2 AND (initial - final <= 0 OR initial - final > 0.9 OR initial - final < 1e-6)
  UNION ALL SELECT j.user_id, j.state, 'warning', 'oscillating', max(j.j) FROM jump j JOIN ends e ON e.user_id = j.user_id AND e.state = j.state
  WHERE j.t <= 100 AND e.points >= 100 GROUP BY ALL HAVING max(j.j) > 100)"""


def histories(spark, folder):
    value = F.col("value")
    rows = unit_rows(spark, folder).withColumn("value", F.when(
        (F.col("event_type") == "error") & (value > 150), float("nan"))
        .when(value > 330, float("inf")).otherwise(value))
    return rows.select("user_id", "t", F.inline(F.array(
        F.struct(F.lit("reading").alias("state"), F.lit("tracking").alias("state_type"), value.alias("value")),
        F.struct(F.lit("margin").alias("state"), F.lit("degradation").alias("state_type"),
                 (1 - value / 300).alias("value")))))


@query("state_audit", _HISTORY + " SELECT user_id, state, severity, rule, round(detail, 6) AS detail FROM found")
def state_audit(spark, folder):
    return audit.audit_states(histories(spark, folder), UNIT).withColumn("detail", round_half("detail", 6))


@query("first_bad_step", _HISTORY + """ SELECT b.user_id, b.t, string_agg(DISTINCT b.state, ',' ORDER BY b.state) AS states
FROM bad b JOIN firstbad f ON b.user_id = f.user_id AND b.t = f.t GROUP BY ALL""")
def first_bad_step(spark, folder):
    return audit.first_bad_step(histories(spark, folder), UNIT).withColumn(
        "states", F.array_join("states", ",")).withColumn("t", F.col("t").cast("long"))


@query("audit_status", _HISTORY + """, c AS (SELECT user_id, count(*) FILTER (severity = 'issue') AS issues, count(*) FILTER (severity = 'warning') AS warnings FROM found GROUP BY 1)
SELECT u.user_id, coalesce(issues, 0) AS issues, coalesce(warnings, 0) AS warnings, CASE WHEN issues > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS status
FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c ON u.user_id = c.user_id""")
def audit_status(spark, folder):
    from millrace.operators.model import status_rollup
    history = histories(spark, folder)
    return status_rollup(audit.audit_states(history, UNIT), history, UNIT)


@query("state_movement", _HISTORY + " SELECT user_id, state, initial, final, abs(final - initial) > 1e-9 AS changed FROM ends")
def state_movement(spark, folder):
    return audit.state_movement(audit.usable_history(histories(spark, folder), UNIT), UNIT)


# ------------------------------------------------------------------ observations

PORTS = [(0, "grinder.value"), (1, "boiler.value"), (2, "pump.event_type"), (3, "pump.user_id"), (4, "pump.pressure")]


@query("observations", """
WITH r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value FROM events)
SELECT user_id, t, 'grinder.value' AS port, value FROM r UNION ALL SELECT user_id, t, 'pump.user_id', CAST(user_id AS DOUBLE) FROM r""")
def observations(spark, folder):
    ports = spark.createDataFrame(PORTS, "ord int, port string")
    return estimate.observations(events(spark, folder), UNIT, ORDER, TIE, ports) \
        .withColumn("t", F.col("t").cast("long"))


# ------------------------------------------------------------------ ensembles and RUL

STATES = [
    estimate.StateSpec("seal", "degradation", 1.0, rate=0.0008),
    estimate.StateSpec("drawer", "accumulation", 0.2, rate=0.004, hi=1.0),
    estimate.StateSpec("heat", "tracking", 0.1, rate=0.02, target=0.9, hi=1.0),
    estimate.StateSpec("frame", "static", 0.5),
]
NAMES = [s.name for s in STATES]


def members(spark, folder):
    """100 perturbed starts per unit; a unit runs for as many steps as it has events."""
    units = table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_steps"))
    return estimate.initial_members(units, STATES)


def _normal_sql(name):
    digest = f"md5('42|' || user_id || '|' || member || '|{name}')"
    u = f"(CAST(CAST('0x' || substring({digest}, 1, 8) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    v = f"(CAST(CAST('0x' || substring({digest}, 9, 8) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
    return f"sqrt(-2.0::DOUBLE * ln({u})) * cos(2.0::DOUBLE * pi() * ({v}))"


_MEMBERS = ("WITH u AS (SELECT user_id, count(*) AS n_steps FROM events GROUP BY 1), "
            "m AS (SELECT user_id, n_steps, CAST(member AS INTEGER) AS member FROM u CROSS JOIN range(100) r(member)), "
            "mem AS (SELECT user_id, n_steps, member, " + ", ".join(
                f"{s.initial}::DOUBLE + {max(abs(s.initial) * 0.01, 1e-3)}::DOUBLE * ({_normal_sql(s.name)}) AS {s.name}"
                for s in STATES) + " FROM m)")


@query("initial_members", _MEMBERS + " SELECT user_id, member, " + ", ".join(
    f"round({n}, 6) AS {n}" for n in NAMES) + " FROM mem")
def initial_members(spark, folder):
    return members(spark, folder).select("user_id", "member", *[round_half(n, 6).alias(n) for n in NAMES])


# Members of an ensemble are the users of a profile, the event type; a member's rows are its steps.
ENSEMBLE_STRIDE = 3
_SAMPLES = _WEAR + f""",
m AS (SELECT event_type, user_id, event_id, wear, CASE WHEN value <= 330 THEN 1 - value / 500 END AS margin,
        row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) - 1 AS t FROM worn),
sampled AS (SELECT * FROM m WHERE t >= 1 AND (t - 1) % {ENSEMBLE_STRIDE} = 0)"""


def ensemble_samples(spark, folder):
    rows = wide_states(spark, folder).withColumn("margin", F.when(F.col("value") <= 330, F.col("margin")))
    placed = row_index(rows.select("event_type", *UNIT, ORDER, *TIE, "wear", "margin"), ["event_type", *UNIT], ORDER, TIE, "t")
    return estimate.strided(placed, ENSEMBLE_STRIDE)


@query("strided_steps", _SAMPLES + " SELECT event_type, user_id, event_id, t, round(wear, 6) AS wear FROM sampled")
def strided_steps(spark, folder):
    return ensemble_samples(spark, folder).select("event_type", "user_id", "event_id", "t", round_half("wear", 6).alias("wear"))


@query("ensemble_states", _SAMPLES + """
SELECT event_type, t, 'wear' AS state, round(avg(wear), 6) AS mean, round(stddev_pop(wear), 6) AS std FROM sampled GROUP BY ALL
UNION ALL SELECT event_type, t, 'margin', round(avg(margin), 6), round(stddev_pop(margin), 6) FROM sampled GROUP BY ALL""")
def ensemble_states(spark, folder):
    out = estimate.ensemble_summary(ensemble_samples(spark, folder), ["event_type"], ["wear", "margin"])
    return out.withColumns({"mean": round_half("mean", 6), "std": round_half("std", 6)})


@query("ensemble_health", _SAMPLES + """,
e AS (SELECT event_type, t, least(1.0::DOUBLE, greatest(0.0::DOUBLE, (0.3::DOUBLE - wear) / 0.3::DOUBLE)) AS worn,
  CASE WHEN margin IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (margin - 0.4::DOUBLE) / 0.6::DOUBLE)) END AS weak FROM sampled)
SELECT event_type, t, 'worn' AS event, round(avg(worn), 6) AS health FROM e GROUP BY ALL
UNION ALL SELECT event_type, t, 'weak', round(avg(weak), 6) FROM e GROUP BY ALL""")
def ensemble_health(spark, folder):
    out = estimate.ensemble_health(ensemble_samples(spark, folder), ["event_type"], EVENT_SPECS[:2])
    return out.withColumn("health", round_half("health", 6))


@query("event_times", """
WITH t AS (SELECT user_id, event_type AS event, CASE WHEN value < 200 THEN value END AS time, value < 0.05 AS triggered FROM events),
s AS (SELECT user_id, event, bool_or(triggered) AS hit, avg(time) AS m, stddev_pop(time) AS d, min(time) AS l, max(time) AS h FROM t GROUP BY ALL)
SELECT user_id, event, hit AS already_triggered, round(CASE WHEN hit THEN 0.0::DOUBLE ELSE m END, 6) AS rul_mean, round(CASE WHEN hit THEN 0.0::DOUBLE ELSE d END, 6) AS rul_std,
  CASE WHEN NOT hit THEN l END AS rul_min, CASE WHEN NOT hit THEN h END AS rul_max, NOT hit AND m IS NULL AS beyond_horizon FROM s""")
def event_times(spark, folder):
    """Summary of event times that come as a table: readings stand for times."""
    times = table(spark, folder, "events").select(
        "user_id", F.col("event_type").alias("event"), (F.col("value") < 0.05).alias("triggered"),
        F.when(F.col("value") < 200, F.col("value")).otherwise(float("inf")).alias("time"))
    out = estimate.summarize_times(times, ["user_id", "event"])
    return out.withColumns({"rul_mean": round_half("rul_mean", 6), "rul_std": round_half("rul_std", 6)})
