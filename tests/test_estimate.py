import pytest
from pyspark.sql import functions as F

from millrace.operators import audit, estimate, health
from millrace.operators.estimate import StateSpec

SPECS = [StateSpec("wear", "degradation", 1.0, rate=0.01), StateSpec("fill", "accumulation", 0.2, rate=0.03),
         StateSpec("heat", "tracking", 0.1, rate=0.9, target=0.8), StateSpec("still", "static", 0.5)]


@pytest.fixture(scope="module")
def members(spark):
    units = spark.createDataFrame([(1, 260), (2, 1), (3, 30)], "unit int, n_steps long")
    return estimate.initial_members(units, SPECS, members=20).cache()


def test_members_are_spread_and_repeatable(members):
    again = estimate.initial_members(members.select("unit", "n_steps").distinct().repartition(3),
                                     SPECS, members=20)
    key = lambda r: (r.unit, r.member)
    assert sorted(members.collect(), key=key) == sorted(again.collect(), key=key)
    many = members.select(((F.col("wear") - 1.0) / 0.01).alias("z")).agg(
        F.avg("z"), F.stddev_pop("z")).first()
    assert abs(many[0]) < 0.5 and 0.6 < many[1] < 1.4


def test_summary_uses_population_deviation(spark):
    rows = spark.createDataFrame([(1, 1, 1.0), (1, 1, 3.0), (1, 51, 2.0)],
                                 "unit int, t int, wear double")
    out = {r.t: (r["mean"], r["std"]) for r in
           estimate.ensemble_summary(rows, ["unit"], ["wear"]).collect()}
    assert out == {1: (2.0, 1.0), 51: (2.0, 0.0)}


def test_health_skips_members_without_number(spark):
    rows = spark.createDataFrame([(1, 1, 0.3, 1.0), (1, 1, None, 0.5), (1, 1, float("nan"), 0.0), (1, 1, 0.0, 1.0), (1, 2, None, None), (2, 1, 0.6, 0.2)],
                                 "unit int, t int, wear double, margin double")
    events = [{"event": "worn", "states": [{"state": "wear", "form": "limit", "threshold": 0.6}]},
              {"event": "weak", "states": [{"state": "margin", "form": "wearout", "threshold": 0.0}]}]
    out = {(r.unit, r.t, r.event): r.health for r in estimate.ensemble_health(rows, ["unit"], events).collect()}
    assert out == {(1, 1, "worn"): 0.75, (1, 1, "weak"): 0.625, (1, 2, "worn"): None, (1, 2, "weak"): None,
                   (2, 1, "worn"): 0.0, (2, 1, "weak"): 0.2}


def test_strided_steps(spark):
    rows = spark.range(25).withColumnRenamed("id", "t")
    assert [r.t for r in estimate.strided(rows, 10).orderBy("t").collect()] == [1, 11, 21]
    assert [r.t for r in estimate.strided(rows).collect()] == [1]


def test_rul_cases(spark):
    times = spark.createDataFrame(
        [("a", True, 5.0), ("b", False, 2.0), ("b", False, 4.0), ("c", False, float("inf")),
         ("c", False, 8.0), ("d", False, None), ("d", False, float("inf"))],
        "event string, triggered boolean, time double")
    out = {r.event: tuple(r)[1:] for r in estimate.summarize_times(times, ["event"]).collect()}
    assert out["a"] == (True, 0.0, 0.0, None, None, False)
    assert out["b"] == (False, 3.0, 1.0, 2.0, 4.0, False)
    assert out["c"] == (False, 8.0, 0.0, 8.0, 8.0, False)
    assert out["d"] == (False, None, None, None, None, True)


def test_health_forms(spark):
    rows = spark.createDataFrame([(0.0, 1.0), (0.15, 0.65), (0.3, 0.3), (2.0, 0.0)], "w double, m double")
    specs = [{"event": "limit", "states": [{"state": "w", "form": "limit", "threshold": 0.3}]},
             {"event": "out", "states": [{"state": "m", "form": "wearout", "threshold": 0.3}]}]
    out = health.event_health(rows, specs, ["w"]).collect()
    got = {(r.w, r.event): (round(r.health, 6), r.triggered, r.degrading) for r in out}
    assert got[(0.0, "limit")] == (1.0, False, False)
    assert got[(0.15, "out")] == (0.5, False, True)
    assert got[(0.3, "limit")] == (0.0, True, True) and got[(2.0, "out")] == (0.0, True, True)


def test_audit_findings(spark):
    def series(state, kind, values):
        return [("u", t, state, kind, v) for t, v in enumerate(values)]
    rows = (series("flat", "degradation", [0.5] * 5) + series("fast", "degradation", [1, 0.5, 0.05, 0.0, 0.0])
            + series("slow", "degradation", [1, 1, 1, 1, 1 - 1e-8]) + series("fine", "degradation", [1, .9, .8, .7, .6]))
    jumpy = [("v", t, "temp", "tracking", 200.0 * (t % 2)) for t in range(120)]
    short = [("w", t, "temp", "tracking", 200.0 * (t % 2)) for t in range(60)]
    broken = [("x", t, "a", "degradation", float("nan") if t == 3 else 1 - t / 10) for t in range(6)]
    broken += [("x", t, "b", "static", float("inf") if t == 3 else None) for t in range(6)]
    frame = spark.createDataFrame(
        [(u, t, s, k, None if v is None else float(v)) for u, t, s, k, v in rows + jumpy + short + broken],
        "unit string, t int, state string, state_type string, value double")
    found = {(r.unit, r.state, r.severity, r.rule) for r in audit.audit_states(frame, ["unit"]).collect()}
    assert found == {
        ("u", "flat", "issue", "did not degrade"), ("u", "fast", "issue", "degraded too fast"),
        ("u", "slow", "warning", "barely changed"), ("v", "temp", "warning", "oscillating"),
        ("x", "a", "issue", "bad number"), ("x", "b", "issue", "bad number")}
    first = audit.first_bad_step(frame, ["unit"]).collect()
    assert [(r.unit, r.t, r.states) for r in first] == [("x", 3, ["a", "b"])]


def test_audit_looks_at_the_first_hundred_steps(spark):
    late = [("a", t, "temp", "tracking", 500.0 if t > 100 else 1.0) for t in range(150)]
    edge = [("b", t, "temp", "tracking", 500.0 if t > 99 else 1.0) for t in range(150)]
    holes = [("c", t, "temp", "tracking", None if t == 1 else 300.0 if t == 2 else 1.0) for t in range(130)]
    none = [("d", t, "temp", "tracking", None) for t in range(130)]
    cut = [("e", t, "temp", "tracking", 500.0 * (t % 2)) for t in range(130)]
    cut += [("e", 99, "other", "static", float("nan"))]
    frame = spark.createDataFrame(
        late + edge + holes + none + cut, "unit string, t int, state string, state_type string, value double")
    found = audit.audit_states(frame, ["unit"])
    assert {(r.unit, r.state, r.rule, r.detail) for r in found.collect()} == {
        ("b", "temp", "oscillating", 499.0), ("c", "temp", "oscillating", 299.0), ("e", "other", "bad number", 99.0)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.find("Initial Plan"):].count("Exchange hashpartitioning") <= 3
    assert audit.audit_states(frame.limit(0), ["unit"]).collect() == []
