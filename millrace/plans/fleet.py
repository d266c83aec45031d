"""Machine-model queries. An order is a machine, its lines are components: the tables of
components, physics, flow signals, ports and triage come from lineitem and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import model, wiring
from millrace.plans.registry import query, table
from millrace.session import reliable_checkpoint

LINES = """one AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity,
  min(l_discount) AS l_discount, max(l_tax) AS l_tax, min(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus
  FROM lineitem GROUP BY ALL),
lines AS (SELECT l_orderkey AS machine_id, l_linenumber AS n, 'unit_' || l_linenumber AS component,
  lower(p_type) AS kind, l.*, p_name, p_size FROM one l JOIN part ON l_partkey = p_partkey)"""


def lines(spark, folder):
    """One component per (order, line number): a position listed twice is one component
    with the extreme values of its rows. Letters are folded as numbers, so the whole
    aggregation is fixed-width and combines before the shuffle. Every table below is read from
    these rows, so they are worked out once and kept in the checkpoint folder."""
    items, parts = table(spark, folder, "lineitem"), table(spark, folder, "part")
    one = items.groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("l_partkey"), F.max("l_quantity").alias("l_quantity"),
        F.min("l_discount").alias("l_discount"), F.max("l_tax").alias("l_tax"),
        F.char(F.min(F.ascii("l_returnflag"))).alias("l_returnflag"),
        F.char(F.max(F.ascii("l_linestatus"))).alias("l_linestatus"))
    return reliable_checkpoint(one.join(parts, one["l_partkey"] == parts["p_partkey"]).select(
        F.col("l_orderkey").alias("machine_id"), F.col("l_linenumber").alias("n"),
        F.concat(F.lit("unit_"), F.col("l_linenumber").cast("string")).alias("component"),
        F.lower("p_type").alias("kind"), "l_quantity", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "p_size"))


def quantity():
    return F.col("l_quantity").cast("int").cast("string")


def _some(condition, *items, like):
    return F.when(condition, F.array(*items)).otherwise(F.array().cast(like))


def physics(rows):
    """Pass-2 records: some components have none, and some records are orphans."""
    ranges = _some(F.col("l_quantity") >= 10, F.struct(
        F.col("kind").alias("signal_name"),
        F.when(F.col("l_discount") >= 0.01, "mm").otherwise("").alias("unit"),
        F.when(F.col("l_tax") >= 0.01, quantity()).alias("typical_value"),
        F.when(F.col("l_returnflag") == "A", "0").alias("min_value")),
        like="array<struct<signal_name:string,unit:string,typical_value:string,min_value:string>>")
    wear = _some(F.col("l_tax") >= 0.02, F.struct(
        F.lit("seal").alias("what_degrades"),
        F.when(F.col("l_discount") >= 0.03, "load").alias("driven_by")),
        like="array<struct<what_degrades:string,driven_by:string>>")
    faults = _some(F.col("l_quantity") < 45, F.struct(
        F.lit("jam").alias("name"), F.when(F.col("l_tax") > 0.005, "stuck").alias("description")),
        like="array<struct<name:string,description:string>>")
    actions = _some(F.col("l_discount") < 0.09, F.struct(F.lit("clean").alias("name")),
                    like="array<struct<name:string>>")
    orphan = F.col("l_tax") > 0.075
    return rows.filter((F.col("l_returnflag") != "A") | (F.col("l_linestatus") != "F")
                       | orphan).select(
        "machine_id", F.when(orphan, F.concat(F.lit("spare_"), F.col("n").cast("string")))
        .otherwise(F.col("component")).alias("component"),
        ranges.alias("operating_ranges"), wear.alias("degradation_mechanisms"),
        faults.alias("fault_conditions"), actions.alias("maintenance_actions"))


def flows(rows):
    following = F.concat(F.lit("unit_"), (F.col("n") + 1).cast("string"))
    return rows.select(
        "machine_id", F.col("n").alias("pos"), F.col("kind").alias("substance"),
        F.when(F.col("l_returnflag") == "R", "external").otherwise(F.col("component")).alias("src"),
        F.when(F.col("l_discount") < 0.1, following).otherwise("").alias("dst"),
        F.col("kind").alias("signal_name"),
        F.when(F.col("l_discount") >= 0.01, "bar").alias("unit"),
        quantity().alias("typical_value"))


def ports(rows):
    """A line puts out a signal of its part's type and feeds the next line with it."""
    out = F.struct(F.lit("output").alias("direction"), F.col("component").alias("component"),
                   F.col("n").alias("ord"), F.col("kind").alias("name"))
    into = F.struct(F.lit("input").alias("direction"),
                    F.concat(F.lit("unit_"), (F.col("n") + 1).cast("string")).alias("component"),
                    (F.col("n") + 1).alias("ord"), F.col("kind").alias("name"))
    own = F.struct(F.lit("input").alias("direction"), F.col("component").alias("component"),
                   F.col("n").alias("ord"), F.concat("kind", F.lit("_level")).alias("name"))
    typical = (F.when(F.col("l_tax") < 0.03, F.concat(quantity(), F.lit(" to 60")))
               .when(F.col("l_tax") < 0.06, quantity()))
    return rows.select("machine_id", F.inline(F.array(out, into, own)),
                       typical.alias("typical_value"))


_MODEL = f"""WITH {LINES},
phys AS (SELECT machine_id, CASE WHEN l_tax > 0.075 THEN 'spare_' || n ELSE component END AS component, * EXCLUDE (machine_id, component)
         FROM lines WHERE l_returnflag <> 'A' OR l_linestatus <> 'F' OR l_tax > 0.075),
m AS (SELECT c.machine_id, c.component, c.kind, p.machine_id IS NOT NULL AS has, p.l_quantity AS q, p.l_tax AS t, p.l_discount AS d, p.l_returnflag AS rf,
        CASE WHEN p.machine_id IS NULL OR (p.l_quantity < 10 AND p.l_tax < 0.02) THEN 'simple_state' ELSE 'full_component' END AS physics_class
      FROM lines c LEFT JOIN phys p ON c.machine_id = p.machine_id AND c.component = p.component),
fl AS (SELECT machine_id, n AS pos, kind AS substance, CASE WHEN l_returnflag = 'R' THEN 'external' ELSE component END AS src,
        CASE WHEN l_discount < 0.1 THEN 'unit_' || (n + 1) ELSE '' END AS dst, kind AS signal_name,
        CASE WHEN l_discount >= 0.01 THEN 'bar' END AS unit, CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS typical_value FROM lines),
findings AS (
  SELECT machine_id, component, 'warning' AS severity, 'no operating ranges' AS rule, '' AS detail FROM m WHERE physics_class = 'full_component' AND q < 10
  UNION ALL SELECT machine_id, component, 'issue', 'range without unit', kind FROM m WHERE physics_class = 'full_component' AND q >= 10 AND d < 0.01
  UNION ALL SELECT machine_id, component, 'warning', 'range without values', kind FROM m WHERE physics_class = 'full_component' AND q >= 10 AND t < 0.01 AND rf <> 'A'
  UNION ALL SELECT machine_id, component, 'warning', 'no degradation mechanisms', '' FROM m WHERE physics_class = 'full_component' AND t < 0.02
  UNION ALL SELECT machine_id, component, 'warning', 'degradation without driver', 'seal' FROM m WHERE physics_class = 'full_component' AND t >= 0.02 AND d < 0.03
  UNION ALL SELECT machine_id, component, 'warning', 'no fault conditions', '' FROM m WHERE physics_class = 'full_component' AND q >= 45
  UNION ALL SELECT machine_id, component, 'issue', 'fault without description', 'jam' FROM m WHERE physics_class = 'full_component' AND q < 45 AND t <= 0.005
  UNION ALL SELECT machine_id, component, 'warning', 'no maintenance actions', '' FROM m WHERE physics_class = 'full_component' AND d >= 0.09
  UNION ALL SELECT machine_id, component, 'issue', 'component without physics', '' FROM m WHERE NOT has
  UNION ALL SELECT p.machine_id, p.component, 'issue', 'physics without component', '' FROM phys p WHERE l_tax > 0.075
  UNION ALL SELECT machine_id, 'flow ' || substance, 'issue', 'flow signal without unit', signal_name FROM fl WHERE unit IS NULL
  UNION ALL SELECT e.machine_id, 'flow ' || substance, 'warning', 'unknown flow endpoint', e.c FROM (
      SELECT machine_id, substance, src AS c FROM fl UNION ALL SELECT machine_id, substance, dst FROM fl) e
    WHERE e.c NOT IN ('', 'external') AND NOT EXISTS (SELECT 1 FROM lines l WHERE l.machine_id = e.machine_id AND l.component = e.c))"""


def _model(spark, folder):
    rows = lines(spark, folder)
    records = physics(rows)
    merged = model.flag_simple(model.merge_physics(rows.select("machine_id", "component", "kind"), records))
    return rows, records, merged


@query("merged_model", _MODEL + " SELECT machine_id, component, kind, has AS has_physics, physics_class FROM m")
def merged_model(spark, folder):
    return _model(spark, folder)[2].select("machine_id", "component", "kind", "has_physics",
                                           "physics_class")


def findings(spark, folder):
    rows, records, merged = _model(spark, folder)
    return model.audit_model(merged, records, flows(rows), rows)


@query("model_audit", _MODEL + " SELECT * FROM findings")
def model_audit(spark, folder):
    return findings(spark, folder)


@query("model_coverage", _MODEL + """ SELECT machine_id, count(*) AS n_components, count(*) FILTER (physics_class = 'full_component') AS n_full,
  count(*) FILTER (physics_class = 'full_component' AND q >= 10) AS with_ranges,
  count(*) FILTER (physics_class = 'full_component' AND t >= 0.02) AS with_degradation,
  count(*) FILTER (physics_class = 'full_component' AND q < 45) AS with_faults,
  count(*) FILTER (physics_class = 'full_component' AND d < 0.09) AS with_maintenance FROM m GROUP BY machine_id""")
def model_coverage(spark, folder):
    return model.coverage(_model(spark, folder)[2])


@query("model_status", _MODEL + """, c AS (SELECT machine_id, count(*) FILTER (severity = 'issue') AS issues,
  count(*) FILTER (severity = 'warning') AS warnings FROM findings GROUP BY 1),
s AS (SELECT DISTINCT machine_id FROM lines)
SELECT s.machine_id, coalesce(issues, 0) AS issues, coalesce(warnings, 0) AS warnings,
  CASE WHEN issues > 0 THEN 'fail' WHEN warnings > 0 THEN 'warn' ELSE 'pass' END AS status FROM s LEFT JOIN c ON s.machine_id = c.machine_id""")
def model_status(spark, folder):
    rows, records, merged = _model(spark, folder)
    return model.status_rollup(model.audit_model(merged, records, flows(rows), rows), rows, ["machine_id"])


def resolved_units(rows):
    return rows.filter("l_quantity > 25").groupBy(
        "machine_id", F.col("kind").alias("signal_name")).agg(
        F.lit("kg").alias("unit"), F.when(F.max("l_tax") > 0.04, "high").otherwise("low").alias("confidence"))


_RESOLVED = """, res AS (SELECT machine_id, kind AS signal_name, CASE WHEN max(l_tax) > 0.04 THEN 'high' ELSE 'low' END AS confidence
  FROM lines WHERE l_quantity > 25 GROUP BY ALL)"""


@query("missing_units", _MODEL + """
SELECT machine_id, component AS owner, kind AS signal_name, CASE WHEN t >= 0.01 THEN CAST(CAST(q AS INTEGER) AS VARCHAR) END AS typical_value
FROM m WHERE q >= 10 AND d < 0.01
UNION ALL SELECT machine_id, 'flow_path (' || substance || ')', signal_name, typical_value FROM fl WHERE unit IS NULL""")
def missing_units(spark, folder):
    rows, _, merged = _model(spark, folder)
    return model.missing_units(merged, flows(rows))


@query("resolved_ranges", _MODEL + _RESOLVED + """
SELECT m.machine_id, component, CAST(0 AS INTEGER) AS pos, m.kind AS signal_name,
  CASE WHEN d >= 0.01 THEN 'mm' WHEN res.machine_id IS NOT NULL THEN 'kg' ELSE '' END AS unit,
  CASE WHEN d < 0.01 THEN res.confidence END AS unit_confidence
FROM m LEFT JOIN res ON m.machine_id = res.machine_id AND m.kind = res.signal_name WHERE q >= 10""")
def resolved_ranges(spark, folder):
    rows, _, merged = _model(spark, folder)
    return model.resolve_range_units(merged, resolved_units(rows)).select(
        "machine_id", "component", "pos", "signal_name", "unit", "unit_confidence")


@query("resolved_flows", _MODEL + _RESOLVED + """
SELECT fl.machine_id, pos, fl.signal_name, CASE WHEN unit IS NOT NULL THEN unit WHEN res.machine_id IS NOT NULL THEN 'kg' END AS unit,
  CASE WHEN unit IS NULL THEN res.confidence END AS unit_confidence
FROM fl LEFT JOIN res ON fl.machine_id = res.machine_id AND fl.signal_name = res.signal_name""")
def resolved_flows(spark, folder):
    rows = lines(spark, folder)
    return model.resolve_flow_units(flows(rows), resolved_units(rows)).select(
        "machine_id", "pos", "signal_name", "unit", "unit_confidence")


@query("model_units", _MODEL + _RESOLVED + """
SELECT m.machine_id, component, CASE WHEN q >= 10 THEN CASE WHEN d >= 0.01 THEN 'mm' WHEN res.machine_id IS NOT NULL THEN 'kg' ELSE '' END END AS unit
FROM m LEFT JOIN res ON m.machine_id = res.machine_id AND m.kind = res.signal_name""")
def model_units(spark, folder):
    rows, _, merged = _model(spark, folder)
    updated = model.apply_units(merged, resolved_units(rows))
    return updated.select("machine_id", "component", F.get("operating_ranges", 0)["unit"].alias("unit"))


# ------------------------------------------------------------------ wiring

_PORTS = f"""WITH {LINES},
ports AS (
  SELECT machine_id, 'output' AS direction, component, n AS ord, kind AS name, l_tax, l_quantity FROM lines
  UNION ALL SELECT machine_id, 'input', 'unit_' || (n + 1), n + 1, kind, l_tax, l_quantity FROM lines
  UNION ALL SELECT machine_id, 'input', component, n, kind || '_level', l_tax, l_quantity FROM lines),
own AS (SELECT machine_id, direction, name, arg_max(component, ord) AS owner FROM ports GROUP BY ALL),
sig AS (SELECT DISTINCT machine_id, kind AS signal_name FROM lines
        UNION SELECT DISTINCT machine_id, kind || '_level' FROM lines WHERE l_returnflag = 'R'
        UNION SELECT DISTINCT machine_id, kind || '_vent' FROM lines WHERE l_returnflag = 'A'),
prop AS (SELECT s.machine_id, s.signal_name, o.owner AS source, i.owner AS target,
    CASE WHEN o.owner IS NULL THEN 'no source' WHEN i.owner IS NULL THEN 'no target' WHEN o.owner = i.owner THEN 'same component' END AS reason
  FROM sig s LEFT JOIN own o ON o.machine_id = s.machine_id AND o.name = s.signal_name AND o.direction = 'output'
  LEFT JOIN own i ON i.machine_id = s.machine_id AND i.name = s.signal_name AND i.direction = 'input'),
open AS (SELECT p.* FROM ports p WHERE direction = 'input' AND NOT EXISTS (SELECT 1 FROM prop r
    WHERE r.reason IS NULL AND r.machine_id = p.machine_id AND r.target = p.component AND r.signal_name = p.name))"""


def signals(rows):
    """Flow signals by name, with some that only one side knows."""
    more = F.when(F.col("l_returnflag") == "R", F.concat("kind", F.lit("_level"))).when(
        F.col("l_returnflag") == "A", F.concat("kind", F.lit("_vent")))
    return rows.select("machine_id", F.explode(F.array_compact(F.array("kind", more)))
                       .alias("signal_name"))


def _wired(spark, folder):
    rows = lines(spark, folder)
    p = ports(rows)
    return rows, p, wiring.propose_connections(signals(rows), p)


@query("proposed_connections", _PORTS + " SELECT * FROM prop")
def proposed_connections(spark, folder):
    return _wired(spark, folder)[2]


@query("connections", _PORTS + " SELECT machine_id, signal_name, source, target FROM prop WHERE reason IS NULL")
def connections(spark, folder):
    return wiring.connections(_wired(spark, folder)[2])


@query("skipped_signals", _PORTS + """, allsig AS (SELECT machine_id, kind AS signal_name FROM lines
  UNION ALL SELECT machine_id, kind || '_level' FROM lines WHERE l_returnflag = 'R'
  UNION ALL SELECT machine_id, kind || '_vent' FROM lines WHERE l_returnflag = 'A')
SELECT a.machine_id, a.signal_name, reason FROM allsig a JOIN prop p ON a.machine_id = p.machine_id AND a.signal_name = p.signal_name
WHERE reason IS NOT NULL""")
def skipped_signals(spark, folder):
    rows, _, proposed = _wired(spark, folder)
    return wiring.skipped_signals(signals(rows), proposed)


_EXTERNAL = _PORTS + """,
d AS (SELECT machine_id, 'unit_' || n AS component, kind || '_level' AS name,
        max(CASE WHEN l_discount < 0.05 THEN CAST(p_size AS VARCHAR) ELSE 'unknown' END) AS given FROM lines WHERE l_discount < 0.08 GROUP BY ALL),
ext AS (SELECT o.machine_id, o.component, o.name,
    coalesce(CASE WHEN l_tax < 0.03 THEN (CAST(l_quantity AS INTEGER) + 60) / 2.0::DOUBLE WHEN l_tax < 0.06 THEN CAST(CAST(l_quantity AS INTEGER) AS DOUBLE) END,
             try_cast(given AS DOUBLE), 1.0::DOUBLE) AS value,
    CASE WHEN l_tax < 0.06 THEN 'range' WHEN try_cast(given AS DOUBLE) IS NOT NULL THEN 'supplied' ELSE 'fallback' END AS origin
  FROM open o LEFT JOIN d ON o.machine_id = d.machine_id AND o.component = d.component AND o.name = d.name)"""


def _external(spark, folder):
    rows, p, proposed = _wired(spark, folder)
    supplied = rows.filter("l_discount < 0.08").groupBy(
        "machine_id", "component", F.concat("kind", F.lit("_level")).alias("name")).agg(
        F.max(F.when(F.col("l_discount") < 0.05, F.col("p_size").cast("string"))
              .otherwise("unknown")).alias("value"))
    return rows, wiring.external_inputs(wiring.open_inputs(p, wiring.connections(proposed)), supplied)


@query("open_inputs", _PORTS + " SELECT machine_id, component, name FROM open")
def open_inputs(spark, folder):
    _, p, proposed = _wired(spark, folder)
    return wiring.open_inputs(p, wiring.connections(proposed)).select("machine_id", "component", "name")


@query("external_inputs", _EXTERNAL + " SELECT * FROM ext")
def external_inputs(spark, folder):
    return _external(spark, folder)[1]


@query("valid_inputs", _EXTERNAL + """ SELECT machine_id, component, name, value FROM ext e
WHERE EXISTS (SELECT 1 FROM lines l WHERE l.machine_id = e.machine_id AND l.component = e.component AND l.kind || '_level' = e.name AND l.l_quantity > 20)""")
def valid_inputs(spark, folder):
    rows, values = _external(spark, folder)
    accepted = rows.filter("l_quantity > 20").select(
        "machine_id", "component", F.concat("kind", F.lit("_level")).alias("name"))
    return wiring.valid_inputs(values, accepted).select("machine_id", "component", "name", "value")


# ------------------------------------------------------------------ triage and specs

_TRIAGE = f"""WITH {LINES},
tri AS (SELECT machine_id, component, CASE l_returnflag WHEN 'N' THEN 'full_component' WHEN 'R' THEN 'simple_state' ELSE 'connection_only' END AS decision,
    CASE WHEN l_tax < 0.02 THEN 'low' WHEN l_tax < 0.05 THEN 'medium' WHEN l_tax < 0.07 THEN 'high' END AS priority, kind AS reasoning,
    l_discount >= 0.095 AS inc, l_quantity >= 48 AS exc FROM lines)"""


def triage(rows):
    return rows.select(
        "machine_id", "component",
        F.when(F.col("l_returnflag") == "N", "full_component")
        .when(F.col("l_returnflag") == "R", "simple_state").otherwise("connection_only").alias("decision"),
        F.when(F.col("l_tax") < 0.02, "low").when(F.col("l_tax") < 0.05, "medium")
        .when(F.col("l_tax") < 0.07, "high").alias("priority"), F.col("kind").alias("reasoning"))


def overrides(rows):
    include = rows.filter("l_discount >= 0.095").select("machine_id", "component", F.lit("include").alias("action"))
    exclude = rows.filter("l_quantity >= 48").select("machine_id", "component", F.lit("exclude").alias("action"))
    ghost = rows.filter("l_quantity >= 50").select("machine_id", F.lit("ghost").alias("component"),
                                                   F.lit("include").alias("action"))
    return include.unionByName(exclude).unionByName(ghost)


@query("triage_filter", _TRIAGE + """
SELECT machine_id, component, 'full_component' AS decision, CASE WHEN inc AND decision <> 'full_component' THEN 'high' ELSE priority END AS priority,
  CASE WHEN inc AND decision <> 'full_component' THEN reasoning || ' [manually included]' ELSE reasoning END AS reasoning
FROM tri WHERE (inc OR (decision = 'full_component' AND priority IS DISTINCT FROM 'low')) AND NOT exc""")
def triage_filter(spark, folder):
    rows = lines(spark, folder)
    return model.filter_triage(triage(rows), overrides(rows))


@query("unknown_includes", f"WITH {LINES} SELECT DISTINCT machine_id, 'ghost' AS component FROM lines WHERE l_quantity >= 50")
def unknown_includes(spark, folder):
    rows = lines(spark, folder)
    return model.unknown_includes(triage(rows), overrides(rows))


@query("decision_counts", _TRIAGE + " SELECT machine_id, decision, count(*) AS n FROM tri GROUP BY ALL")
def decision_counts(spark, folder):
    return model.decision_counts(triage(lines(spark, folder)))


def assignments(rows):
    return rows.select(
        "machine_id", F.when(F.col("l_discount") < 0.08, F.concat(F.lit("unit_"), (F.col("n") % 3).cast("string")))
        .alias("component"), F.when(F.col("l_returnflag") == "N", "input").otherwise("output").alias("signal_type"),
        F.col("n").alias("ord"), F.col("kind").alias("field_name"), F.lit("mm").alias("unit"),
        quantity().alias("typical_range"))


@query("component_fields", f"""WITH {LINES} SELECT machine_id, 'unit_' || (n % 3) AS component,
  CASE WHEN l_returnflag = 'N' THEN 'input' ELSE 'output' END AS signal_type, n AS ord, kind AS name, 'mm' AS unit,
  CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS typical_range FROM lines WHERE l_discount < 0.08""")
def component_fields(spark, folder):
    return model.component_fields(assignments(lines(spark, folder)))


@query("nested_component_fields", f"""WITH {LINES} SELECT machine_id, 'unit_' || (n % 3) AS component,
  coalesce(string_agg(kind, ',' ORDER BY n) FILTER (l_returnflag = 'N'), '') AS inputs,
  coalesce(string_agg(kind, ',' ORDER BY n) FILTER (l_returnflag <> 'N'), '') AS outputs FROM lines WHERE l_discount < 0.08 GROUP BY ALL""")
def nested_component_fields(spark, folder):
    nested = model.nested_component_fields(assignments(lines(spark, folder)))
    return nested.select("machine_id", "component", F.array_join("inputs.name", ",").alias("inputs"),
                         F.array_join("outputs.name", ",").alias("outputs"))


@query("port_lock", f"""WITH {LINES},
a AS (SELECT DISTINCT machine_id, component, CASE WHEN l_returnflag = 'N' THEN 'input' ELSE 'output' END AS direction, kind AS name FROM lines),
b AS (SELECT DISTINCT machine_id, component, CASE WHEN l_returnflag = 'N' THEN 'input' ELSE 'output' END AS direction,
        CASE WHEN l_tax > 0.07 THEN kind || '_x' ELSE kind END AS name FROM lines WHERE l_discount < 0.09)
SELECT coalesce(a.machine_id, b.machine_id) AS machine_id, coalesce(a.component, b.component) AS component,
  coalesce(a.direction, b.direction) AS direction, coalesce(a.name, b.name) AS name,
  CASE WHEN b.name IS NULL THEN a.direction || ' missing from spec' ELSE 'extra ' || b.direction || ' in spec' END AS problem
FROM a FULL JOIN b ON a.machine_id = b.machine_id AND a.component = b.component AND a.direction = b.direction AND a.name = b.name
WHERE (a.name IS NULL OR b.name IS NULL)
  AND (coalesce(a.machine_id, b.machine_id), coalesce(a.component, b.component)) IN (SELECT (machine_id, component) FROM b)""")
def port_lock(spark, folder):
    rows = lines(spark, folder)
    direction = F.when(F.col("l_returnflag") == "N", "input").otherwise("output").alias("direction")
    triaged = rows.select("machine_id", "component", direction, F.col("kind").alias("name"))
    spec = rows.filter("l_discount < 0.09").select(
        "machine_id", "component", direction,
        F.when(F.col("l_tax") > 0.07, F.concat("kind", F.lit("_x"))).otherwise(F.col("kind")).alias("name"))
    return model.port_lock(triaged, spec)


@query("missing_members", f"""WITH {LINES}
SELECT machine_id, component, 'state' AS kind, kind AS name, 'missing' AS problem FROM lines WHERE l_tax > 0.06
UNION ALL SELECT machine_id, component, 'state', kind, 'null' FROM lines WHERE l_tax <= 0.06 AND l_discount < 0.01""")
def missing_members(spark, folder):
    rows = lines(spark, folder)
    state = F.lit("state").alias("kind")
    expected = rows.select("machine_id", "component", state, F.col("kind").alias("name"))
    actual = rows.filter("l_tax <= 0.06").select(
        "machine_id", "component", state, F.col("kind").alias("name"),
        F.when(F.col("l_discount") >= 0.01, F.col("l_quantity")).alias("value"))
    return model.missing_members(expected, actual)


@query("rate_constants", """
SELECT p_partkey AS machine_id, 'bearing_wear_rate' AS name, CAST(p_size AS DOUBLE) AS value FROM part
UNION ALL SELECT p_partkey, 'critical_level', 1.5::DOUBLE FROM part
UNION ALL SELECT p_partkey, 'rated_power', CAST(-p_size AS DOUBLE) FROM part""")
def rate_constants(spark, folder):
    size = F.col("p_size").cast("string")
    text = F.concat(
        F.lit("class Config:\n    # rates\n    bearing_wear_rate: float = 0.5\n    size = "), size,
        F.lit("\n    critical_level=1.5  # limit\n    rated_power: float = -"), size,
        F.lit("\n    base_threshold = none\n    bearing_wear_rate = "), size, F.lit("\n"))
    return model.rate_constants(table(spark, folder, "part").select(
        F.col("p_partkey").alias("machine_id"), text.alias("text")))


@query("degradation_drivers", """
SELECT p_partkey AS machine_id, CAST(0 AS INTEGER) AS pos, replace(p_name, ' ', '_') AS state, lower(p_type) AS driver FROM part
UNION ALL SELECT p_partkey, CAST(1 AS INTEGER), 'wear', p_brand FROM part WHERE p_size > 20""")
def degradation_drivers(spark, folder):
    entry = F.struct(F.regexp_replace("p_name", " ", "_").alias("state_variable"),
                     F.lower("p_type").alias("accumulates_from"))
    wear = F.struct(F.lit("wear").alias("state_variable"), F.col("p_brand").alias("accumulates_from"))
    return model.degradation_drivers(table(spark, folder, "part").select(
        F.col("p_partkey").alias("machine_id"),
        F.when(F.col("p_size") > 20, F.array(entry, wear)).otherwise(F.array(entry)).alias("degradation_model")))
