"""Rows are cut into ranges; the result must not depend on them and must equal a Python loop."""

import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from millrace.operators import ordered, wear

START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(3)
    data, event = [], 0
    for unit, n in ((1, 400), (2, 40), (3, 1), (4, 25)):  # unit 1 holds most rows
        for _ in range(n):
            at = START + dt.timedelta(seconds=rng.randint(0, 40_000))  # equal times occur
            kind = rng.choices(["use", "service", "idle"], [6, 1, 1])[0]
            data.append((unit, at, event, kind, round(rng.uniform(0, 2), 3)))
            event += 1
    rng.shuffle(data)
    return spark.createDataFrame(
        data, "unit int, ts timestamp_ntz, event int, kind string, value double").cache()


def by_unit(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.unit, r.ts, r.event)):
        out.setdefault(r.unit, []).append(r)
    return out


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_row_index(rows, ranges):
    out = ordered.row_index(rows, ["unit"], "ts", ["event"], "t", "n", ranges).collect()
    want = {r.event: (i, len(rs)) for rs in by_unit(rows).values() for i, r in enumerate(rs)}
    assert {r.event: (r.t, r.n) for r in out} == want


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_running_last(rows, ranges):
    out = ordered.running_last(rows, ["unit"], "ts", ["event"], {
        "last": F.when(F.col("kind") == "service", F.col("event"))}, ranges).collect()
    want = {}
    for rs in by_unit(rows).values():
        last = None
        for r in rs:
            last = r.event if r.kind == "service" else last
            want[r.event] = last
    assert {r.event: r.last for r in out} == want


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_wear_index_equals_clamped_loop(rows, ranges):
    marked = rows.withColumn("service", F.col("kind") == "service")
    out = wear.wear_index(marked, ["unit"], "ts", ["event"], 0.05, "value", "service",
                          ranges=ranges).collect()
    got = {r.event: r.wear for r in out}
    for rs in by_unit(rows).values():
        level = 0.0
        for r in rs:
            level = 0.0 if r.kind == "service" else min(1.0, level + 0.05 * r.value)
            assert got[r.event] == pytest.approx(level, abs=1e-9)


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_affine_fold_with_restoration(rows, ranges):
    kind = F.col("kind")
    steps = wear.choose_step(
        kind == "use", wear.accelerating_step(F.col("value") * 0.02, 2.0),
        wear.restoring_step(F.when(kind == "service", "scale").otherwise("add"), F.lit(0.4)))
    out = wear.fold_states(rows, ["unit"], "ts", ["event"], steps, F.lit(0.1), ranges=ranges)
    got = {r.event: r.level for r in out.collect()}
    for rs in by_unit(rows).values():
        level = 0.1
        for r in rs:
            if r.kind == "use":
                level = min(1.0, level + r.value * 0.02 * (1 + 2 * level))
            elif r.kind == "service":
                level *= 1 - 0.4
            else:
                level = min(1.0, level + 0.4)
            assert got[r.event] == pytest.approx(level, abs=1e-9)


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_tracking_cap_and_negative_pull(rows, ranges):
    # dt 3 makes the step overshoot (factor 1 - 1.5), which flips the bounds when composed.
    steps = wear.tracking_step(F.lit(0.9), F.col("value"), F.lit(3.0), -1.0, 1.5)
    out = wear.fold_states(rows, ["unit"], "ts", ["event"], steps, F.lit(0.0), ranges=ranges)
    got = {r.event: r.level for r in out.collect()}
    for rs in by_unit(rows).values():
        level = 0.0
        for r in rs:
            level = min(1.5, max(-1.0, level + 0.5 * (r.value - level) * 3.0))
            assert got[r.event] == pytest.approx(level, abs=1e-7)


@pytest.mark.parametrize("ranges", [1, 7, 64])
@pytest.mark.parametrize("first_only", [False, True])
def test_maintenance_due(rows, ranges, first_only):
    rules = [{"rule": "hours", "kind": "hours", "limit": 1.5},
             {"rule": "count", "kind": "count", "limit": 4},
             {"rule": "level", "kind": "level", "column": "value", "limit": 1.8}]
    marked = rows.withColumn("service", F.col("kind") == "service")
    out = wear.maintenance_due(marked, ["unit"], "ts", ["event"], rules, "service", first_only,
                               ranges)
    want = set()
    for rs in by_unit(rows).values():
        since_ts, since_i = rs[0].ts, 0
        for i, r in enumerate(rs):
            if r.kind == "service":
                since_ts, since_i = r.ts, i
                continue
            hits = [n for n, hit in (
                ("hours", (r.ts - since_ts).total_seconds() / 3600 >= 1.5),
                ("count", i - since_i >= 4), ("level", r.value > 1.8)) if hit]
            want |= {(r.event, n) for n in (hits[:1] if first_only else hits)}
    assert {(r.event, r.rule) for r in out.collect()} == want


def test_maintenance_first_among_equal_times(spark):
    events = spark.createDataFrame([(1, 5, 0.5)], "unit int, ts int, value double")
    log = spark.createDataFrame([(1, 5, "clean")], "unit int, ts int, maintenance_type string")
    both = wear.merge_maintenance(events, log).orderBy("ts", "_kind").collect()
    assert [r.maintenance_type for r in both] == ["clean", None]
    assert both[0].value is None


def test_rows_without_key_or_order_survive(spark):
    data = [(None if i % 3 == 0 else 1, None if i % 5 == 0 else i % 17, i, float(i % 4)) for i in range(90)]
    df = spark.createDataFrame(data, "unit int, ts int, event int, value double").withColumn(
        "service", F.col("event") % 7 == 0)
    runs = []
    for ranges in (1, 7, 64):
        placed = ordered.row_index(df, ["unit"], "ts", ["event"], "t", "n", ranges)
        worn = wear.wear_index(placed, ["unit"], "ts", ["event"], 0.01, "value", "service", ranges=ranges)
        folded = wear.fold_states(worn, ["unit"], "ts", ["event"], wear.accumulation_step(
            F.col("value") - 1.5, 3.0), F.lit(1.0), ranges=ranges)
        runs.append({r.event: (r.t, r.n, r.wear, r.level) for r in folded.collect()})
    assert len(runs[0]) == 90 and runs[0] == runs[1] == runs[2]
    assert sorted(t for t, n, _, _ in runs[0].values() if n == 30) == list(range(30))


@pytest.fixture(scope="module")
def hot(spark):
    """One unit of 6,000 rows at three times, one of null, and small ones, in two columns of key."""
    rng = random.Random(8)
    data = []
    for i in range(7000):
        unit = ("hot", 1) if i < 6000 else (None, 2) if i < 6300 else (f"u{i % 40}", None)
        data.append((*unit, rng.choice([None, 5, 6]), i % 900, rng.random() < 0.01, rng.choice([0.1, 1e-9, 3.7, None, -2.5]), f"x{i}"))
    rng.shuffle(data)
    return spark.createDataFrame(data, "a string, b int, ts int, tie int, mark boolean, value double, name string").cache()


def in_order(df):
    out = {}
    digests = {r.name: r.d for r in df.select("name", F.xxhash64(*df.columns).alias("d")).collect()}
    for r in sorted(df.collect(), key=lambda r: (r.ts is not None, r.ts or 0, r.tie, digests[r.name])):
        out.setdefault((r.a, r.b), []).append(r)
    return out


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_hot_key_among_equal_times(hot, ranges):
    df = hot.withColumns({"one": F.lit(1.0), "seen": F.when(F.col("mark"), F.col("name"))})
    steps = [ordered.Position("t"), ordered.Last("last", "seen", "string", first="name"), ordered.Last("plain", "seen", "string"),
             ordered.SumSince("total", "value", "mark"), ordered.SumSince("rows", "one", "mark", first=True)]
    got = {r.name: r for r in ordered.scan(df, ["a", "b"], "ts", ["tie"], steps, ranges).collect()}
    assert len(got) == 7000
    for rows in in_order(df).values():
        total, since, last, plain = Fraction(0), 0, None, None
        for i, r in enumerate(rows):
            total = Fraction(0) if r.mark else total + Fraction(r.value or 0.0)
            since = 0 if r.mark or i == 0 else since + 1
            last = r.name if r.mark or i == 0 else last
            plain = r.name if r.mark else plain
            x = got[r.name]
            assert (x.t, x.rows, x["last"], x.plain) == (i, since, last, plain)
            assert x.total == pytest.approx(float(total), abs=1e-12)


def test_sums_have_the_same_bits(hot):
    runs = [{r.name: r.total for r in ordered.sum_since_reset(hot, ["a", "b"], "ts", ["tie"], "value", "mark", "total", n).collect()}
            for n in (1, 7, 64)]
    assert runs[0] == runs[1] == runs[2]


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_running_sum_has_the_bits_of_a_loop(hot, ranges):
    out = ordered.running_sum(hot, ["a", "b"], "ts", ["tie"], "value", "mark", "total", ranges)
    got = {r.name: r.total for r in out.collect()}
    for rows in in_order(hot).values():
        level = 0.0
        for r in rows:
            level = 0.0 if r.mark else level + (r.value or 0.0)
            assert got[r.name] == level


def test_wear_at_its_limit(spark):
    df = spark.createDataFrame([(1, i, 12.5) for i in range(30)], "unit int, ts int, value double").withColumn("mark", F.lit(False))
    worn = wear.wear_index(df, ["unit"], "ts", [], 0.0008, "value", "mark")
    due = wear.maintenance_due(worn, ["unit"], "ts", [], [{"rule": "level", "kind": "level", "column": "wear", "limit": 0.3}], "mark")
    level, want = 0.0, 0
    for _ in range(30):
        level += 0.0008 * 12.5
        want += level > 0.3
    assert due.count() == want == 1


def test_running_sum_of_a_long_key_without_reset(spark):
    df = spark.range(20_000).select(F.lit(1).alias("unit"), "id", F.lit(0.1).alias("value"), F.lit(False).alias("mark"))
    for ranges in (1, 3):
        out = ordered.running_sum(df, ["unit"], "id", [], "value", "mark", "total", ranges).collect()
        assert max(abs(r.total - 0.1 * (r.id + 1)) for r in out) < 1e-8


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_long_fold_in_lanes(hot, ranges):
    steps = wear.choose_step(F.col("mark"), wear.restoring_step(F.lit("scale"), F.lit(0.5)),
                             wear.tracking_step(F.lit(0.3), F.coalesce("value", F.lit(0.0)), F.lit(1.0), -1.0, 3.0))
    got = {r.name: r.level for r in wear.fold_states(hot, ["a", "b"], "ts", ["tie"], steps, F.lit(0.7), ranges=ranges).collect()}
    prepared = hot.withColumns({**steps, "_from": F.lit(0.7)})
    for rows in in_order(prepared).values():
        level = 0.7
        for r in rows:
            level = min(1.0, max(0.0, level * 0.5)) if r.mark else min(3.0, max(-1.0, 0.7 * level + 0.3 * (r.value or 0.0)))
            assert got[r.name] == pytest.approx(level, abs=1e-9)


def test_sums_of_large_and_infinite_amounts(spark):
    df = spark.createDataFrame([(1, i, v, i == 4) for i, v in enumerate([1e300, 1.0, float("inf"), 2.0, 7.0, 5e12, 0.25])],
                               "unit int, ts int, value double, mark boolean")
    for ranges in (1, 3, 7):
        got = [r.total for r in ordered.sum_since_reset(df, ["unit"], "ts", [], "value", "mark", "total", ranges).orderBy("ts").collect()]
        assert got == [1e300, 1e300, float("inf"), float("inf"), 0.0, 5e12, 5e12 + 0.25]


def test_empty_table(spark):
    df = spark.createDataFrame([], "unit int, ts int, value double, mark boolean")
    assert ordered.row_index(df, ["unit"], "ts", [], "t", "n").collect() == []
    assert ordered.sum_since_reset(df, ["unit"], "ts", [], "value", "mark", "s").columns == ["unit", "ts", "value", "mark", "s"]
