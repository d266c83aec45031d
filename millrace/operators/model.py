"""Machine models as tables: components, physics, flow signals, triage, specs.

All tables carry ``machine_id``, so one job covers a fleet. A component row holds its
short lists (ranges, mechanisms, faults, actions) as arrays of structs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["machine_id", "component"]
FULL, SIMPLE = "full_component", "simple_state"


def _blank(column: Column) -> Column:
    return column.isNull() | (column == "")


def _length(column: str | Column) -> Column:
    return F.coalesce(F.greatest(F.size(column), F.lit(0)), F.lit(0))


def merge_physics(components: DataFrame, physics: DataFrame) -> DataFrame:
    """Components with their physics record; its columns win where a record exists."""
    c, p = components.alias("c"), physics.withColumn("_has", F.lit(True)).alias("p")
    joined = c.join(p, [F.col(f"c.{k}") == F.col(f"p.{k}") for k in KEY], "left")
    has = F.coalesce(F.col("p._has"), F.lit(False))
    names = [n for n in components.columns if n not in physics.columns]
    return joined.select(
        *[F.col(f"c.{k}").alias(k) for k in KEY], *[F.col(f"c.{n}").alias(n) for n in names],
        *[(F.when(has, F.col(f"p.{n}")).otherwise(F.col(f"c.{n}")) if n in components.columns
           else F.col(f"p.{n}")).alias(n) for n in physics.columns if n not in KEY],
        has.alias("has_physics"))


def missing_units(model: DataFrame, flows: DataFrame) -> DataFrame:
    """(machine_id, owner, signal_name, typical_value) of ranges and flow signals
    without a unit."""
    ranges = model.select("machine_id", F.col("component").alias("owner"),
                          F.inline("operating_ranges"))
    signals = flows.withColumn(
        "owner", F.concat(F.lit("flow_path ("), "substance", F.lit(")")))
    wanted = ["machine_id", "owner", "signal_name", "typical_value"]
    return (ranges.filter(_blank(F.col("unit"))).select(*wanted)
            .unionByName(signals.filter(_blank(F.col("unit"))).select(*wanted)))


def resolve_range_units(model: DataFrame, resolved: DataFrame) -> DataFrame:
    """(machine_id, component, pos, signal_name, unit, unit_confidence): every range, with
    the resolved unit where its own is missing. The signal name alone decides, so a
    resolution reaches every component of the machine."""
    ranges = model.select(*KEY, F.posexplode("operating_ranges").alias("pos", "r"))
    flat = ranges.select(*KEY, "pos", F.col("r.signal_name").alias("signal_name"),
                         F.col("r.unit").alias("unit"))
    return _with_resolution(flat, resolved)


def resolve_flow_units(flows: DataFrame, resolved: DataFrame) -> DataFrame:
    return _with_resolution(flows, resolved)


def _with_resolution(signals, resolved):
    known = resolved.select("machine_id", "signal_name", F.col("unit").alias("_unit"),
                            F.col("confidence").alias("_confidence"), F.lit(True).alias("_known"))
    joined = signals.join(known, ["machine_id", "signal_name"], "left")
    take = _blank(F.col("unit")) & F.coalesce(F.col("_known"), F.lit(False))
    return joined.withColumns({
        "unit_confidence": F.when(take, F.col("_confidence")),
        "unit": F.when(take, F.col("_unit")).otherwise(F.col("unit")),
    }).drop("_unit", "_confidence", "_known")


def apply_units(model: DataFrame, resolved: DataFrame) -> DataFrame:
    """The model with resolved units written back into ``operating_ranges``."""
    units = resolve_range_units(model, resolved).groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.struct("pos", "unit"))).alias("_units"))
    return (model.join(units, KEY, "left")
            .withColumn("operating_ranges", F.when(
                F.col("_units").isNotNull(),
                F.transform("operating_ranges", lambda r, i: r.withField(
                    "unit", F.col("_units")[i]["unit"]))).otherwise(F.col("operating_ranges")))
            .drop("_units"))


def flag_simple(model: DataFrame) -> DataFrame:
    """physics_class: simple_state without ranges and mechanisms, else the given class or
    full_component."""
    nothing = _length("operating_ranges") + _length("degradation_mechanisms") == 0
    given = F.col("physics_class") if "physics_class" in model.columns else F.lit(None)
    return model.withColumn("physics_class", F.when(nothing, SIMPLE).otherwise(
        F.coalesce(given, F.lit(FULL))))


def _finding(severity, rule, detail):
    return F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"),
                    detail.cast("string").alias("detail"))


def audit_model(model: DataFrame, physics: DataFrame, flows: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(machine_id, component, severity, rule, detail) of every issue and warning.

    ``model`` is the merged (``merge_physics``) and flagged model, ``physics`` the pass-2
    records by name. The per-component rules are one projection over the component row;
    only the cross-checks (orphans, endpoints) join, on equality. They need only the names of
    the components: ``components`` gives them where the model is still a join.
    """
    none = F.array().cast("array<struct<severity:string,rule:string,detail:string>>")

    def when_empty(column, rule):
        return F.when(_length(column) == 0, F.array(_finding("warning", rule, F.lit("")))) \
            .otherwise(none)

    def each(column, test, severity, rule, detail):
        items = F.coalesce(F.col(column), F.array().cast(model.schema[column].dataType))
        return F.transform(F.filter(items, test), lambda x: _finding(severity, rule, detail(x)))

    rules = F.concat(
        when_empty("operating_ranges", "no operating ranges"),
        each("operating_ranges", lambda r: _blank(r["unit"]), "issue", "range without unit",
             lambda r: r["signal_name"]),
        each("operating_ranges", lambda r: r["typical_value"].isNull() & r["min_value"].isNull(),
             "warning", "range without values", lambda r: r["signal_name"]),
        when_empty("degradation_mechanisms", "no degradation mechanisms"),
        each("degradation_mechanisms", lambda d: _blank(d["driven_by"]), "warning",
             "degradation without driver", lambda d: F.coalesce(d["what_degrades"], F.lit("?"))),
        when_empty("fault_conditions", "no fault conditions"),
        each("fault_conditions", lambda f: _blank(f["description"]), "issue",
             "fault without description", lambda f: F.coalesce(f["name"], F.lit("?"))),
        when_empty("maintenance_actions", "no maintenance actions"))
    # All findings of a component leave in one reading of the model.
    unmatched = F.array(_finding("issue", "component without physics", F.lit("")))
    own = model.select("machine_id", "component", F.inline(F.concat(
        F.when(F.col("physics_class") != SIMPLE, rules).otherwise(none),
        F.when(~F.col("has_physics"), unmatched).otherwise(none))))

    def listed(df, severity, rule, detail):
        return df.select("machine_id", "component", F.lit(severity).alias("severity"),
                         F.lit(rule).alias("rule"), detail.alias("detail"))

    blank = F.lit("")
    path = F.concat(F.lit("flow "), F.coalesce("substance", F.lit("?")))
    unitless = listed(flows.filter(_blank(F.col("unit"))).withColumn("component", path),
                      "issue", "flow signal without unit", F.col("signal_name"))
    # Whatever must name a component meets the components once: records (without a path), and ends of flows.
    named = physics.select(*KEY, F.lit(None).cast("string").alias("_path"))
    ends = flows.select("machine_id", F.explode(F.array("src", "dst")).alias("component"), path.alias("_path")).filter(
        ~_blank(F.col("component")) & (F.col("component") != "external")).select(*KEY, "_path")
    orphan = F.col("_path").isNull()
    unknown = named.unionByName(ends).join((model if components is None else components).select(*KEY), KEY, "left_anti").select(
        "machine_id", F.when(orphan, F.col("component")).otherwise(F.col("_path")).alias("component"),
        F.when(orphan, "issue").otherwise("warning").alias("severity"),
        F.when(orphan, "physics without component").otherwise("unknown flow endpoint").alias("rule"),
        F.when(orphan, blank).otherwise(F.col("component")).alias("detail"))
    return own.unionByName(unitless).unionByName(unknown)


def coverage(model: DataFrame) -> DataFrame:
    """Full components per machine and how many have each kind of physics."""
    full = F.col("physics_class") != SIMPLE

    def having(column):
        return F.count_if(full & (_length(column) > 0))

    return model.groupBy("machine_id").agg(
        F.count(F.lit(1)).alias("n_components"), F.count_if(full).alias("n_full"),
        having("operating_ranges").alias("with_ranges"),
        having("degradation_mechanisms").alias("with_degradation"),
        having("fault_conditions").alias("with_faults"),
        having("maintenance_actions").alias("with_maintenance"))


def status_rollup(findings: DataFrame, subjects: DataFrame, keys: list[str]) -> DataFrame:
    """fail with any issue, else warn with any warning, else pass; plus the counts."""
    no = F.lit(False)
    marks = findings.select(*keys, (F.col("severity") == "issue").alias("_issue"), (F.col("severity") == "warning").alias("_warning"),
                            no.alias("_subject")).unionByName(
        subjects.select(*keys, no.alias("_issue"), no.alias("_warning"), F.lit(True).alias("_subject")))
    return marks.groupBy(*keys).agg(
        F.count_if("_issue").alias("issues"), F.count_if("_warning").alias("warnings"), F.max("_subject").alias("_subject")
    ).filter("_subject").drop("_subject").withColumn(
        "status", F.when(F.col("issues") > 0, "fail").when(F.col("warnings") > 0, "warn").otherwise("pass"))


# ------------------------------------------------------------------ triage and specs

def component_fields(assignments: DataFrame) -> DataFrame:
    """(machine_id, component, signal_type, ord, name, unit, typical_range) of assigned
    fields; fields without a component are dropped. One row per field: a component may
    own many."""
    return assignments.filter(~_blank(F.col("component"))).select(
        *KEY, "signal_type", "ord", F.col("field_name").alias("name"), "unit", "typical_range")


def nested_component_fields(assignments: DataFrame) -> DataFrame:
    """The same per component as ``inputs`` and ``outputs`` arrays, for export."""
    field = F.struct("ord", "name", "unit", "typical_range")
    return component_fields(assignments).groupBy(*KEY).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("signal_type") == kind, field))).alias(f"{kind}s")
        for kind in ("input", "output")])


def decision_counts(triage: DataFrame) -> DataFrame:
    return triage.groupBy("machine_id", "decision").agg(F.count(F.lit(1)).alias("n"))


def filter_triage(triage: DataFrame, overrides: DataFrame) -> DataFrame:
    """Components that get a full model.

    ``overrides(machine_id, component, action)`` includes or excludes by hand: an
    included component of any other decision becomes full with high priority, an
    included full one is kept even at low priority, an excluded one goes last of all.
    A missing priority counts as not low.
    """
    marks = overrides.groupBy(*KEY).agg(
        F.max(F.col("action") == "include").alias("_in"),
        F.max(F.col("action") == "exclude").alias("_out"))
    joined = triage.join(marks, KEY, "left").withColumns({
        "_in": F.coalesce("_in", F.lit(False)), "_out": F.coalesce("_out", F.lit(False))})
    full = F.col("decision") == FULL
    promoted = F.col("_in") & ~F.coalesce(full, F.lit(False))
    kept = joined.filter((full & (~F.col("priority").eqNullSafe("low") | F.col("_in")))
                         | F.col("_in")).filter(~F.col("_out"))
    return kept.withColumns({
        "decision": F.lit(FULL),
        "priority": F.when(promoted, "high").otherwise(F.col("priority")),
        "reasoning": F.when(promoted, F.concat(
            F.coalesce("reasoning", F.lit("")), F.lit(" [manually included]")))
        .otherwise(F.col("reasoning"))}).drop("_in", "_out")


def unknown_includes(triage: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual inclusions that name no triaged component."""
    return (overrides.filter("action = 'include'").select(*KEY).distinct()
            .join(triage.select(*KEY), KEY, "left_anti"))


def port_lock(triaged: DataFrame, specified: DataFrame) -> DataFrame:
    """(machine_id, component, direction, name, problem): ports on one side only."""
    on = [*KEY, "direction", "name"]
    sides = triaged.select(*on, F.lit(1).alias("side")).unionByName(specified.select(*on, F.lit(2).alias("side")))
    # 1, 2 or 3: where the port is; the same for its component, as each shuffle holds narrow rows
    ports = sides.groupBy(*on).agg(F.bit_or("side").alias("port"))
    both = sides.groupBy(*KEY).agg(F.bit_or("side").alias("known")).filter("known = 3")
    problem = F.when(F.col("port") == 1, F.concat("direction", F.lit(" missing from spec"))) \
        .otherwise(F.concat(F.lit("extra "), "direction", F.lit(" in spec")))
    # A component without a specification at all is not compared.
    return ports.filter("port <> 3").join(both, KEY, "left_semi").select(*on, problem.alias("problem"))


def missing_members(expected: DataFrame, actual: DataFrame, value: str = "value") -> DataFrame:
    """(machine_id, component, kind, name, problem): expected states and outputs that are
    absent, and present ones whose value is null."""
    on = [*KEY, "kind", "name"]
    absent = expected.select(*on).join(actual.select(*on), on, "left_anti") \
        .withColumn("problem", F.lit("missing"))
    empty = actual.filter(F.col(value).isNull()).select(*on).withColumn("problem", F.lit("null"))
    return absent.unionByName(empty)


def rate_constants(sources: DataFrame) -> DataFrame:
    """(machine_id, name, value): number assignments that look like rates, thresholds or
    critical limits in ``sources(machine_id, text)``; the last assignment wins."""
    lines = sources.select("machine_id", F.posexplode(F.split("text", r"\r\n|\n|\r"))
                           .alias("line_no", "line"))
    pattern = r"^\s*([a-zA-Z_]\w*)\s*(?::\s*[\w\[\], ]+)?\s*=\s*([-+0-9.eE]+)"
    found = lines.select(
        "machine_id", "line_no", F.regexp_extract("line", pattern, 1).alias("name"),
        F.regexp_extract("line", pattern, 2).try_cast("double").alias("value"))
    wanted = (F.col("name").contains("rate") | F.col("name").contains("threshold")
              | F.col("name").startswith("critical_"))
    return (found.filter(wanted & F.col("value").isNotNull())
            .groupBy("machine_id", "name").agg(F.max_by("value", "line_no").alias("value")))


def degradation_drivers(plans: DataFrame) -> DataFrame:
    """(machine_id, pos, state, driver) from ``degradation_model`` arrays."""
    return plans.select("machine_id", F.posexplode("degradation_model").alias("pos", "d")).select(
        "machine_id", "pos", F.col("d.state_variable").alias("state"),
        F.col("d.accumulates_from").alias("driver"))
