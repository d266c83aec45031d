import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import profiling, quality
from millrace.plans.summary import data_summary
from millrace.sources import scan, sinks


def write(path, text):
    path.write_text(text)
    return str(path)


def test_profiles(spark, tmp_path):
    write(tmp_path / "m_events_heavy.csv", "a,b\n1,x\n2,NA\n")
    write(tmp_path / "m_events_light.csv", "b,c\ny,2.5\n,null\n")
    write(tmp_path / "m_events_night.csv", "a,b\n3,z\n")
    write(tmp_path / "maintenance_events_heavy.csv", "a,b\n9,q\n")
    contract = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("c", T.DoubleType())])
    rows = scan.scan_profiles(spark, str(tmp_path), contract).collect()
    got = sorted(((r.profile, r.a, r.b, r.c) for r in rows), key=str)
    assert got == sorted([("heavy", 1, "x", None), ("heavy", 2, None, None), ("light", None, "y", 2.5),
                          ("light", None, None, None), ("night", 3, "z", None)], key=str)
    with pytest.raises(FileNotFoundError):
        scan.scan_profiles(spark, str(tmp_path / "none"))


def test_profiles_of_part_files(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"x,{i}", None if i % 2 else "a \"b\"") for i in range(40)], "a int, b string, c string")
    sinks.write_profile(rows.select("a", "b").repartition(5), str(tmp_path), "heavy load")
    sinks.write_profile(rows.select("c", "a").repartition(3), str(tmp_path), "50%+1")
    write(tmp_path / "m_events_.csv", "")  # no header, no rows
    got = scan.scan_profiles(spark, str(tmp_path), T.StructType([T.StructField("a", T.IntegerType())])).collect()
    assert sorted((r.profile, r.a, r.b, r.c) for r in got if r.profile == "heavy load") == [
        ("heavy load", i, f"x,{i}", None) for i in range(40)]
    assert sorted((r.a, r.b, r.c) for r in got if r.profile == "50%+1") == [
        (i, None, None if i % 2 else 'a "b"') for i in range(40)] and len(got) == 80
    empty = tmp_path / "empty"
    empty.mkdir()
    write(empty / "m_events_x.csv", "")
    assert scan.scan_profiles(spark, str(empty)).columns == ["profile"]


def test_maintenance_is_optional(spark, tmp_path):
    path = write(tmp_path / "log.csv", "timestamp,maintenance_type\n2024-01-01,clean\n")
    log, there = scan.scan_maintenance(spark, path)
    assert there and log.count() == 1
    log, there = scan.scan_maintenance(spark, str(tmp_path / "none.csv"))
    assert not there and log.count() == 0


def test_model_json(spark, tmp_path):
    folder = tmp_path / "furnace"
    folder.mkdir()
    write(folder / "model.json", json.dumps({
        "machine_type": "f", "components": [{"name": "tube"}, {"name": "pump"}],
        "flow_paths": [{"substance": "gas", "boundary_signals": [
            {"from": "pump", "to": "tube", "signal_name": "flow", "unit": None}]}]}, indent=1))
    components, flows = scan.read_models(spark, str(folder / "model.json"))
    assert sorted((r.machine_id, r.component) for r in components.collect()) == [
        ("furnace", "pump"), ("furnace", "tube")]
    assert [(r.src, r.dst, r.signal_name, r.unit) for r in flows.collect()] == [("pump", "tube", "flow", None)]
    write(folder / "contract.json", json.dumps([{"field_name": "t", "source_pages": [1, 2]}, {"field_name": "p"}]))
    contract = scan.read_contract(spark, str(folder / "contract.json")).orderBy("ord").collect()
    assert [(r.ord, r.field_name, r.source_pages) for r in contract] == [(0, "t", [1, 2]), (1, "p", None)]


def test_component_specs(spark, tmp_path):
    from millrace.operators.estimate import state_rates
    folder = tmp_path / "press" / "specs"
    folder.mkdir(parents=True)
    write(folder / "filter.json", json.dumps({
        "component_name": "filter", "inputs": [{"name": "air"}], "outputs": [{"name": "flow", "unit": "l/s"}],
        "states": [{"name": "condition", "state_type": "degradation", "initial_value": 1.0, "min_value": 0, "max_value": 1,
                    "degradation_timescale": "life", "driver": "dust"},
                   {"name": "seal", "state_type": "degradation", "initial_value": 1.0},
                   {"name": "level", "state_type": "static", "initial_value": 0.5}],
        "events": [{"name": "choked", "event_severity": "warning", "threshold_states": ["condition"]}],
        "parameters": [{"name": "life", "default": 8000.0}, {"name": "dust", "default": 2.0}, {"name": "seal_rate", "default": 0.5}]}))
    tables = scan.read_specs(spark, str(folder / "*.json"))
    assert [(r.machine_id, r.component, r.name, r.threshold_states) for r in tables["events"].collect()] == [
        ("press", "filter", "choked", ["condition"])]
    assert sorted((r.direction, r.name) for r in tables["ports"].collect()) == [("input", "air"), ("output", "flow")]
    rated = state_rates(tables["states"], tables["parameters"]).orderBy("pos").collect()
    assert [(r["name"], r["rate"], r["drive"]) for r in rated] == [
        ("condition", 1 / 8000, 2.0), ("seal", 0.0005, 1.0), ("level", 1e-4, 1.0)]


def test_manifest_falls_back_to_all_files(spark):
    available = spark.createDataFrame([("b.pdf",), ("a.pdf",)], "filename string")
    listed = spark.createDataFrame([(0, "x.pdf", None)], "ord int, filename string, source_type string")
    present, missing = scan.corpus_manifest(listed, available)
    assert [(r.filename, r.doc_ord) for r in present.orderBy("doc_ord").collect()] == [("a.pdf", 0), ("b.pdf", 1)]
    assert [r.filename for r in missing.collect()] == ["x.pdf"]


def test_catalogue_names_what_is_missing(spark):
    rows = spark.createDataFrame([("m1", "schema", 0, "t", "q", 5), ("m2", "simulate", 0, "t", "q", 4),
                                  ("m1", "simulate", 0, "t", "q", 4)],
                                 "machine_id string, phase string, ord int, topic string, query string, k int")
    assert scan.query_catalogue(rows, [("simulate", "")]).count() == 3
    with pytest.raises(ValueError, match="m2/schema"):
        scan.query_catalogue(rows, [("schema", "")])


def test_step_result_runs_once(spark, tmp_path):
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert sinks.step_result(spark, str(tmp_path / "step"), compute).count() == 3
    assert len(calls) == 1


def test_profile_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("heavy", 1), ("light", 2)], "profile string, a int")
    sinks.write_profiles(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert sorted((r.profile, r.a) for r in back.collect()) == [("heavy", "1"), ("light", "2")]


def test_collection(spark, tmp_path):
    schema = ("chunk_id string, text string, framework string, domain string, type string, pattern string, "
              "source string, v int")
    store = sinks.ChunkCollection(spark, str(tmp_path / "chunks"), schema)
    assert store.count() == 0
    store.upsert(spark.createDataFrame([("a", "1", *"fdtps", 1), ("b", "1", *"fdtps", 1)], schema), "v")
    store.upsert(spark.createDataFrame([("a", "2", *"fdtps", 2)], schema), "v")
    assert store.count() == 2
    assert {r.chunk_id: r.text for r in store.read().collect()} == {"a": "2", "b": "1"}
    store.drop()
    assert store.count() == 0


@pytest.fixture(scope="module")
def coffee(spark):
    """Synthetic events of a coffee machine; only structure and counts are asserted."""
    rng = random.Random(42)
    rows = [(i, f"2024-01-01 {i // 6:02d}:{i % 6}0:00", "CM_001", rng.choice(["latte", "espresso"]), rng.randint(1, 9),
             rng.gauss(18, .5), rng.gauss(93, 1.5), rng.random() < .97, None if rng.random() < .9 else "E01") for i in range(100)]
    events = spark.createDataFrame(rows, "n int, event_timestamp string, machine_id string, product_type string, "
                                   "grinder_position int, coffee_dose_weight double, water_temperature_brewing double, "
                                   "event_success boolean, error_code string")
    log = spark.createDataFrame([("t", "clean", .1, .2, .3, .4), ("t", "descale", .5, .6, None, .8)],
                                "timestamp string, maintenance_type string, grinder_wear_before double, "
                                "brewing_wear_before double, coffee_buildup_before double, scale_buildup_before double")
    return events, log


def test_summary_round_trip(spark, tmp_path, coffee):
    events, log = coffee
    summary = data_summary(events, "machine", "n", log)
    sinks.save_summary(summary, str(tmp_path / "summary"))
    back = sinks.load_summary(spark, str(tmp_path / "summary")).first()
    assert back.machine_type == "coffee" and back.n_events == 100 and back.has_maintenance
    assert len(back.wear_signals) == 4 and back.n_maintenance == 2
    assert back.temporal_columns == ["event_timestamp"] and back.id_columns == ["machine_id"]
    assert back.target_columns == ["event_success", "error_code"] and back.degradation_indicators == []
    assert [s.field for s in back.signals] == [c for c in events.columns if c not in ("event_timestamp", "machine_id")]
    assert sorted(back.product_types) == ["espresso", "latte"] and back.date_range.days == 0
    by_name = {w.signal: w.maintenance_types for w in back.wear_signals}
    assert by_name["coffee_buildup_before"] == ["clean"] and by_name["scale_buildup_before"] == ["clean", "descale"]


def test_columns_of_nulls_are_reported(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "a", None)], "n int, kind string, note string")
    found = {(r.field, r.category, r.position, r.n_unique)
             for r in profiling.categorical_profile(df, "n", ["kind", "note"]).collect()}
    assert found == {("kind", "a", 1, 2), ("kind", "b", 2, 2), ("note", None, None, 0)}
    signals = {s.field: s for s in data_summary(df, "machine", "n").first().signals}
    assert signals["note"].categories == [] and signals["note"].n_unique == 0 and signals["note"].missing_pct == 100
    assert signals["kind"].categories == ["a", "b"]


def test_medians_without_holding_values(spark):
    rng = random.Random(2)
    for n, size in ((1, 4096), (2, 8), (9, 8), (500, 8), (500, 4096), (20_000, 64)):
        xs = [rng.choice([rng.gauss(0, 1e6), rng.random(), 5.0]) for _ in range(n)]
        df = spark.createDataFrame([(x, -x) for x in xs], "x double, y double")
        got = profiling.exact_medians(df, {"x": F.col("x"), "y": F.col("y")}, size)
        want = sorted(xs)[(n - 1) // 2] / 2 + sorted(xs)[n // 2] / 2
        assert got == {"x": want, "y": -want}
    df = spark.createDataFrame([(float(i % 7), None) for i in range(50)], "x double, y double")
    x, y = profiling.numeric_profile(df, ["x", "y"]).orderBy("field").collect()
    assert x.median == 3.0 and y.median is None
    inf = float("inf")
    cases = [([inf, 1.0, 2.0], 2.0), ([-inf, -inf, 4.0], -inf), ([1.0, inf], inf), ([inf], inf), ([-inf, 0.0, 3.0, inf], 1.5),
             ([-1.5e308, 0.0, 3.0, 1.5e308], 1.5), ([1.7e308, 1.7e308, -1.7e308], 1.7e308), ([1.7e308, 1.6e308], 1.7e308 / 2 + 1.6e308 / 2),
             ([4.0] * 30, 4.0), ([None, 7.0], 7.0), ([None], None)]
    frame = spark.createDataFrame([tuple(c[i] if i < len(c) else None for c, _ in cases) for i in range(30)],
                                  ", ".join(f"x{i} double" for i in range(len(cases))))
    got = profiling.exact_medians(frame, {f"x{i}": F.col(f"x{i}") for i in range(len(cases))})
    assert [got[f"x{i}"] for i in range(len(cases))] == [want for _, want in cases]


def test_range_audit_edges(spark):
    df = spark.createDataFrame([(1.0, True, None, "a"), (float("nan"), False, None, "b"), (5.0, None, None, "c")],
                               "x double, flag boolean, empty double, name string")
    contract = spark.createDataFrame([(0, "x", "0-2"), (1, "flag", "1-1"), (2, "empty", "0-1"), (3, "name", "0-1"),
                                      (4, "gone", "0-1")], "ord int, field_name string, typical_range string")
    got = {r.field: (r.observed_min, r.observed_max, r.out_of_range_pct) for r in quality.range_audit(df, contract).collect()}
    assert got == {"x": (1.0, 5.0, 0.5), "flag": (0.0, 1.0, 0.5)}
    many = spark.range(100_000).select(F.col("id").cast("int").alias("ord"), F.when(F.col("id") % 50_000 == 7, "x").when(
        F.col("id") == 3, "flag").otherwise(F.concat(F.lit("f"), F.col("id").cast("string"))).alias("field_name"),
        F.when(F.col("id") > 7, "0-0.5").otherwise("1-5").alias("typical_range"))
    report = [(r.field, r.typical_range, r.out_of_range_pct) for r in quality.range_audit(df, many).collect()]
    assert report == [("x", "0-0.5", 1.0), ("flag", "1-5", 0.5), ("x", "1-5", 0.0)]
    tied = spark.createDataFrame([(0, "x", "0-9"), (1, "flag", "0-1")], "ord int, field_name string, typical_range string")
    assert [r.field for r in quality.range_audit(df, tied).collect()] == ["x", "flag"]
    rules = spark.range(60_000).select(F.col("id").cast("string").alias("operation_type"), F.lit("x").alias("field")).unionByName(
        spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "gone")], "operation_type string, field string"))
    assert [(r.operation_type, r.value) for r in quality.null_rule_violations(df.filter("x = 1"), rules, "name", ["flag"]).collect()] == [("a", "1.0")]
    nulls = {r.field: round(r.null_fraction, 4) for r in quality.null_fraction(df).collect()}
    assert nulls == {"x": 0.3333, "flag": 0.3333, "empty": 1.0, "name": 0.0}
