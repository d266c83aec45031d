
from millrace.operators import model, name_merge, wiring

# Recorded contract of a coffee machine (fixture data): field name -> runs that saw it.
COUNTS = (
    "product_button_pressed 3, dispensing_start_time 2, dispensing_stop_time 1, water_quantity_ticks 1, "
    "water_quantity_seconds 1, milk_quantity_seconds 1, cake_thickness 5, tamping_pressure 5, pre_infusion_time 5, "
    "relax_time 5, second_tamping 3, extraction_time 5, water_temperature 5, stop_temperature 4, foam_texture 5, "
    "milk_delay_time 5, coffee_cycles 4, bypass_quantity 4, powder_water_quantity 4, bean_hopper_selection 2, "
    "product_button_selected 1, water_quantity 4, hot_water_quantity_seconds 1, milk_quantity 4, manual_stop_pressed 1, "
    "product_key_name 1, product_type 1, hot_water_quantity 2, milk_temperature_setting 1, double_product 1, "
    "manual_stop_triggered 3, learned_quantity_ticks 2, hot_water_duration 1, second_tamping_depth 2, "
    "milk_stop_temperature 1, powder_density 2, dispensing_end_time 1, bean_hopper_selected 1, learned_quantity 1")
GROUPS = {
    "product_button_pressed": {"product_button_selected"},
    "water_quantity": {"hot_water_quantity", "hot_water_quantity_seconds", "learned_quantity", "learned_quantity_ticks",
                       "powder_water_quantity", "water_quantity_seconds", "water_quantity_ticks"},
    "milk_quantity": {"milk_quantity_seconds"}, "second_tamping": {"second_tamping_depth"},
    "stop_temperature": {"milk_stop_temperature"}, "bean_hopper_selection": {"bean_hopper_selected"},
}


def test_recorded_field_merge(spark):
    rows = [("m", *item.split(), 0, i) for i, item in enumerate(COUNTS.split(", "))]
    counts = spark.createDataFrame([(s, n, int(c), r, o) for s, n, c, r, o in rows],
                                   "scope string, name string, n_runs int, first_run int, first_ord int")
    merged = name_merge.merge_names(counts, name_merge.similar_names(counts)).collect()
    got = {}
    for r in merged:
        got.setdefault(r.canonical, set())
        if r.name != r.canonical:
            got[r.canonical].add(r.name)
    assert len(merged) == 39 and len(got) == 27
    assert {k: v for k, v in got.items() if v} == GROUPS


# Ports and flow signals recorded for the same machine: component direction name typical.
PORTS = """ceramic_grinders input bean_flow -|ceramic_grinders output ground_coffee 24|brewing_chamber input ground_coffee 24
brewing_chamber input brewing_water -|brewing_chamber input cake_thickness 14.0|brewing_chamber output brewed_coffee -
coffee_boiler input water_supply 2.5-4|coffee_boiler input water_quantity 0 to 1000|coffee_boiler output brewing_water -
steam_boiler input water_supply 2.5-4|steam_boiler output steam_flow 0.8|water_pump output water_supply 2.5-4
milk_system input steam_flow 0.8|milk_system input stop_temperature 65°c|milk_system output frothed_milk -
milk_system input milk_temperature_setting warm|powder_unit input powder_density 5.0 +/- 1"""
SIGNALS = "bean_flow ground_coffee brewing_water brewed_coffee steam_flow frothed_milk water_supply water_supply".split()


def test_recorded_wiring(spark):
    rows, order = [], {}
    for line in PORTS.replace("\n", "|").split("|"):
        component, direction, name, typical = line.split(" ", 3)
        rows.append(("m", component, order.setdefault(component, len(order)), direction, name,
                     None if typical == "-" else typical))
    ports = spark.createDataFrame(rows, "machine_id string, component string, ord int, direction string, name string, typical_value string")
    flows = spark.createDataFrame([("m", s) for s in SIGNALS], "machine_id string, signal_name string")
    proposed = wiring.propose_connections(flows, ports)
    edges = wiring.connections(proposed)
    assert {(r.source, r.signal_name, r.target) for r in edges.collect()} == {
        ("ceramic_grinders", "ground_coffee", "brewing_chamber"), ("coffee_boiler", "brewing_water", "brewing_chamber"),
        ("steam_boiler", "steam_flow", "milk_system"), ("water_pump", "water_supply", "steam_boiler")}
    reasons = {(r.signal_name, r.reason) for r in proposed.collect() if r.reason}
    assert reasons == {("bean_flow", "no source"), ("brewed_coffee", "no target"), ("frothed_milk", "no target")}
    supplied = spark.createDataFrame([("m", "milk_system", "milk_temperature_setting", "65.0")],
                                     "machine_id string, component string, name string, value string")
    values = {(r.component, r.name): (r.value, r.origin) for r in
              wiring.external_inputs(wiring.open_inputs(ports, edges), supplied).collect()}
    assert values[("coffee_boiler", "water_supply")] == (3.25, "range")
    assert values[("coffee_boiler", "water_quantity")] == (500.0, "range")
    assert values[("powder_unit", "powder_density")] == (3.0, "range")
    assert values[("milk_system", "milk_temperature_setting")] == (65.0, "supplied")
    assert values[("ceramic_grinders", "bean_flow")] == (1.0, "fallback")
    assert ("steam_boiler", "water_supply") not in values


def test_merge_and_flag(spark):
    components = spark.createDataFrame([("m", "a", "x"), ("m", "b", "y")], "machine_id string, component string, category string")
    physics = spark.createDataFrame(
        [("m", "a", "z", [("t", "", None, None)], [])],
        "machine_id string, component string, category string, operating_ranges array<struct<signal_name:string,unit:string,"
        "typical_value:string,min_value:string>>, degradation_mechanisms array<struct<what_degrades:string,driven_by:string>>")
    merged = model.flag_simple(model.merge_physics(components, physics))
    got = {r.component: (r.category, r.has_physics, r.physics_class) for r in merged.collect()}
    assert got == {"a": ("z", True, "full_component"), "b": ("y", False, "simple_state")}
    resolved = spark.createDataFrame([("m", "t", "bar", "high")], "machine_id string, signal_name string, unit string, confidence string")
    fixed = {r.component: r.operating_ranges for r in model.apply_units(merged, resolved).collect()}
    assert fixed["a"][0].unit == "bar" and fixed["b"] is None


def test_priority_and_overrides(spark):
    triage = spark.createDataFrame(
        [("m", "low", "full_component", "low", "r"), ("m", "kept", "full_component", "low", "r"),
         ("m", "null", "full_component", None, "r"), ("m", "up", "simple_state", None, None),
         ("m", "out", "full_component", "high", "r"), ("m", "both", "exclude", "low", "r")],
        "machine_id string, component string, decision string, priority string, reasoning string")
    marks = spark.createDataFrame([("m", c, a) for c, a in (
        ("kept", "include"), ("up", "include"), ("out", "exclude"), ("both", "include"), ("both", "exclude"))],
        "machine_id string, component string, action string")
    got = {r.component: (r.priority, r.reasoning) for r in model.filter_triage(triage, marks).collect()}
    assert got == {"kept": ("low", "r"), "null": (None, "r"), "up": ("high", " [manually included]")}


def test_status(spark):
    findings = spark.createDataFrame([("a", "issue"), ("b", "warning")], "unit string, severity string")
    subjects = spark.createDataFrame([("a",), ("b",), ("c",)], "unit string")
    got = {r.unit: r.status for r in model.status_rollup(findings, subjects, ["unit"]).collect()}
    assert got == {"a": "fail", "b": "warn", "c": "pass"}


def test_status_needs_no_join(spark):
    findings = spark.createDataFrame([("a", "issue"), ("b", "warning"), ("a", "issue"), ("x", "issue")], "unit string, severity string")
    subjects = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "unit string")
    out = model.status_rollup(findings, subjects, ["unit"])
    assert {tuple(r) for r in out.collect()} == {("a", 2, 0, "fail"), ("b", 0, 1, "warn"), ("c", 0, 0, "pass")}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
