"""Contract checks and profiles bound to the lineitem, orders and events tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import keywords, numeric
from millrace.operators import profiling, quality
from millrace.plans.registry import query, table
from millrace.session import checkpoint_folder
from millrace.sources import scan, sinks

LINE_CONTRACT = [
    (0, "l_quantity", "5-45"), (1, "l_extendedprice", "1000.0-50000.0"),
    (2, "l_discount", "0.0-0.05"), (3, "l_tax", "0.02-0.06"), (4, "l_linenumber", "1-4"),
    (5, "l_returnflag", "0-1"), (6, "l_absent", "0-1"), (7, "l_suppkey", "0 to 1000"),
    (8, "l_partkey", "-5-1000"), (9, "l_linestatus", "warm"),
]
_LINE_VALUES = ", ".join(f"({o}, '{f}', '{r}')" for o, f, r in LINE_CONTRACT)
EVENT_CONTRACT = ["event_id", "ts", "value", "pressure", "event_type", "water_temp"]
NULL_RULES = [("signup", "props"), ("view", "value"), ("error", "event_type"), ("view", "gone")]


def line_contract(spark):
    return spark.createDataFrame(LINE_CONTRACT, "ord int, field_name string, typical_range string")


def ruled_events(spark, folder):
    """Events with the values an operation type does not have set to null."""
    kind = F.col("event_type")
    return table(spark, folder, "events").withColumns({
        "value": F.when(kind != "view", F.col("value")),
        "props": F.when(~kind.isin("error", "click", "signup"), F.col("props"))})


_RANGE_SQL = f"""
WITH c(ord, field, typical_range) AS (VALUES {_LINE_VALUES}),
p AS (SELECT *, CAST(regexp_extract(typical_range, '^(-?[0-9.]+)-(-?[0-9.]+)$', 1) AS DOUBLE) AS lo,
             CAST(regexp_extract(typical_range, '^(-?[0-9.]+)-(-?[0-9.]+)$', 2) AS DOUBLE) AS hi
      FROM c WHERE regexp_matches(typical_range, '^(-?[0-9.]+)-(-?[0-9.]+)$')),
v AS (""" + " UNION ALL ".join(
    f"SELECT '{f}' AS field, CAST({f} AS DOUBLE) AS v FROM lineitem" for f in
    ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey")) + """)
SELECT p.field, p.typical_range, round(min(v), 4) AS observed_min, round(max(v), 4) AS observed_max,
       round(avg(CASE WHEN v < lo OR v > hi THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS out_of_range_pct
FROM p JOIN v ON p.field = v.field GROUP BY p.field, p.typical_range"""


@query("range_audit", _RANGE_SQL)
def range_audit(spark, folder):
    return quality.range_audit(table(spark, folder, "lineitem"), line_contract(spark))


@query("contract_diff", """
WITH c(ord, field) AS (VALUES """ + ", ".join(
    f"({i}, '{f}')" for i, f in enumerate(EVENT_CONTRACT)) + """),
a AS (SELECT row_number() OVER () - 1 AS ord, column_name AS field FROM (DESCRIBE events)),
d AS (SELECT 'missing' AS status, field, ord FROM c WHERE field NOT IN (SELECT field FROM a)
      UNION ALL
      SELECT 'extra', field, ord FROM a WHERE field NOT IN (SELECT field FROM c))
SELECT status, field, CAST(ord AS BIGINT) AS ord, (SELECT count(*) FROM events) AS row_count,
       (SELECT count(*) FROM a) AS column_count FROM d""")
def contract_diff(spark, folder):
    contract = spark.createDataFrame(list(enumerate(EVENT_CONTRACT)),
                                     "ord int, field_name string")
    return quality.contract_diff(table(spark, folder, "events"), contract)


_RULED_SQL = """SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_type <> 'view' THEN value END AS value,
  CASE WHEN event_type NOT IN ('error', 'click', 'signup') THEN props END AS props FROM events"""
_NULL_SQL = f"WITH r AS ({_RULED_SQL}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS field, avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS null_fraction FROM r"
    for c in ("event_id", "ts", "user_id", "event_type", "value", "props"))


@query("null_fraction", _NULL_SQL)
def null_fraction(spark, folder):
    return quality.null_fraction(ruled_events(spark, folder))


@query("problem_fields", f"""
SELECT * FROM (SELECT 'null' AS kind, field, null_fraction AS share FROM ({_NULL_SQL})
  WHERE null_fraction > 0.5 ORDER BY share DESC, field LIMIT 5)
UNION ALL
SELECT * FROM (SELECT 'range' AS kind, field, out_of_range_pct AS share FROM ({_RANGE_SQL})
  WHERE out_of_range_pct > 0.05 ORDER BY share DESC, field LIMIT 5)""")
def problem_fields(spark, folder):
    nulls = quality.worst_fields(null_fraction(spark, folder), "null_fraction", 0.5)
    ranges = quality.worst_fields(range_audit(spark, folder), "out_of_range_pct", 0.05)
    return (nulls.select(F.lit("null").alias("kind"), "field", F.col("null_fraction").alias("share"))
            .unionByName(ranges.select(F.lit("range").alias("kind"), "field",
                                       F.col("out_of_range_pct").alias("share"))))


@query("null_rule_violations", """
WITH r(operation_type, field) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in NULL_RULES) + """),
l AS (SELECT event_id, event_type AS operation_type, 'props' AS field, props AS value FROM events
      UNION ALL SELECT event_id, event_type, 'value', CAST(value AS VARCHAR) FROM events
      UNION ALL SELECT event_id, event_type, 'event_type', event_type FROM events)
SELECT event_id, l.operation_type, l.field, l.value FROM l JOIN r USING (operation_type, field)
WHERE value IS NOT NULL""")
def null_rule_violations(spark, folder):
    rules = spark.createDataFrame(NULL_RULES, "operation_type string, field string")
    return quality.null_rule_violations(table(spark, folder, "events"), rules, "event_type",
                                        ["event_id"])


_LINE_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
               "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
               "l_discount": "double", "l_tax": "double"}


def _unit_case(name):
    return "CASE " + " ".join(f"WHEN contains({name}, '{w}') THEN '{u}'"
                              for w, u in keywords.UNIT_HINTS) + " END"


def _any(name, words):
    return " OR ".join(f"contains({name}, '{w}')" for w in words)


def _role_case(name):
    affix = " OR ".join(f"starts_with({name}, '{w}') OR ends_with({name}, '{w}')"
                        for w in keywords.TEMPORAL_AFFIXES)
    return (f"CASE WHEN {affix} OR {name} IN ('time', 'week') THEN 'temporal' "
            f"WHEN {_any(name, keywords.ID_WORDS)} THEN 'id' "
            f"WHEN {_any(name, keywords.TARGET_WORDS)} THEN 'target' "
            f"WHEN {_any(name, keywords.DEGRADATION_WORDS)} THEN 'degradation' ELSE 'signal' END")


@query("numeric_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS field, '{t}' AS dtype,
  round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
  round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max,
  round(avg(CAST({c} AS DOUBLE)), 4) AS mean, round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std,
  round(median(CAST({c} AS DOUBLE)), 4) AS median, {_unit_case(f"'{c}'")} AS unit_hint FROM lineitem"""
    for c, t in _LINE_TYPES.items()))
def numeric_profile(spark, folder):
    return profiling.numeric_profile(table(spark, folder, "lineitem"))


@query("categorical_profile", f"""
WITH l AS (SELECT o_orderkey AS ord, 'o_orderstatus' AS field, o_orderstatus AS category FROM orders
           UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders),
v AS (SELECT field, category, min(ord) AS first_seen FROM l WHERE category IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY first_seen, category) AS position,
             count(*) OVER (PARTITION BY field) AS n_unique FROM v)
SELECT field, category, CAST(position AS INTEGER) AS position, n_unique FROM r WHERE position <= 20""")
def categorical_profile(spark, folder):
    return profiling.categorical_profile(table(spark, folder, "orders"), "o_orderkey")


@query("category_cap", """
WITH v AS (SELECT c_name AS category, min(c_custkey) AS first_seen FROM customer GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY first_seen, category) AS position, count(*) OVER () AS n_unique FROM v)
SELECT 'c_name' AS field, category, CAST(position AS INTEGER) AS position, n_unique FROM r WHERE position <= 20""")
def category_cap(spark, folder):
    return profiling.categorical_profile(table(spark, folder, "customer"), "c_custkey", ["c_name"])


@query("date_range", """
SELECT 'o_orderdate' AS field, min(o_orderdate) AS start, max(o_orderdate) AS end,
  CAST(floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000.0) AS BIGINT) AS days
FROM orders""")
def date_range(spark, folder):
    return profiling.date_range(table(spark, folder, "orders"))


@query("column_roles", """
WITH c AS (SELECT row_number() OVER () - 1 AS ord, column_name AS field FROM (DESCRIBE events)),
n AS (SELECT * FROM (""" + _NULL_SQL + f"""))
SELECT CAST(c.ord AS INTEGER) AS ord, c.field, {_role_case('c.field')} AS role,
  {_unit_case('c.field')} AS unit_hint, n.null_fraction FROM c JOIN n ON c.field = n.field""")
def column_roles(spark, folder):
    events = ruled_events(spark, folder)
    return (profiling.column_roles(events).drop("dtype")
            .join(quality.null_fraction(events), "field")
            .select("ord", "field", "role", "unit_hint", "null_fraction"))


@query("product_types", """
SELECT c_mktsegment AS product, min(c_custkey) AS first_seen FROM customer
WHERE c_mktsegment IS NOT NULL GROUP BY 1""")
def product_types(spark, folder):
    customers = table(spark, folder, "customer").withColumnRenamed("c_mktsegment", "product")
    return profiling.product_types(customers, "c_custkey")


@query("summary_header", """
SELECT 'line' AS machine_name, 'industrial' AS machine_type, count(*) AS n_events,
  min(l_shipdate) AS start, max(l_shipdate) AS end,
  CAST(floor((epoch_us(max(l_shipdate)) - epoch_us(min(l_shipdate))) / 86400000000.0) AS BIGINT) AS days,
  CAST(10 AS INTEGER) AS n_signals FROM lineitem""")
def summary_header(spark, folder):
    from millrace.plans.summary import data_summary
    summary = data_summary(table(spark, folder, "lineitem"), "line", "l_orderkey")
    return summary.select("machine_name", "machine_type", "n_events", "date_range.start",
                          "date_range.end", "date_range.days",
                          F.size("signals").alias("n_signals"))


_NUMERIC_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS field, '{t}' AS dtype, round((count(*) - count({c})) / count(*) * 100, 2) AS missing_pct,
  round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max, round(avg(CAST({c} AS DOUBLE)), 4) AS mean,
  round(stddev_samp(CAST({c} AS DOUBLE)), 4) AS std, round(median(CAST({c} AS DOUBLE)), 4) AS median,
  CAST(NULL AS VARCHAR) AS categories, CAST(NULL AS BIGINT) AS n_unique FROM lineitem""" for c, t in _LINE_TYPES.items())
_CATEGORY_SQL = " UNION ALL ".join(
    f"""SELECT '{c}', 'string', (SELECT round(avg(CASE WHEN {c} IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100, 2) FROM lineitem),
  NULL, NULL, NULL, NULL, NULL, string_agg({c}, ',' ORDER BY seen, {c}), count(*)
FROM (SELECT {c}, min(l_orderkey) AS seen FROM lineitem WHERE {c} IS NOT NULL GROUP BY 1)""" for c in ("l_returnflag", "l_linestatus"))


@query("summary_signals", f"{_NUMERIC_SQL} UNION ALL {_CATEGORY_SQL}")
def summary_signals(spark, folder):
    """The nested signals of the data summary, one row each."""
    from millrace.plans.summary import data_summary
    summary = data_summary(table(spark, folder, "lineitem"), "line", "l_orderkey")
    return summary.select(F.inline("signals")).drop("unit_hint").withColumn("categories", F.array_join("categories", ","))


@query("summary_lists", """
WITH w AS (SELECT event_type AS kind, count(*) AS n, min(value) AS lo, max(value) AS hi, sum(value) AS total, count(value) AS seen FROM events GROUP BY 1)
SELECT 'product' AS list, c_mktsegment AS item, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS mean,
  CAST(NULL AS VARCHAR) AS types FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 2
UNION ALL SELECT 'maintenance', kind, NULL, NULL, NULL, NULL FROM w
UNION ALL SELECT 'wear', 'grinder_wear_before', round(min(lo), 4), round(max(hi), 4), round(sum(total) / sum(seen), 4),
  string_agg(kind, ',' ORDER BY kind) FROM w WHERE seen > 0""")
def summary_lists(spark, folder):
    """Products, maintenance types and wear signals of the data summary, one row each."""
    from millrace.plans.summary import data_summary
    customers = table(spark, folder, "customer").withColumnRenamed("c_mktsegment", "product")
    log = table(spark, folder, "events").select(F.col("event_type").alias("maintenance_type"), F.col("value").alias("grinder_wear_before"))
    summary = data_summary(customers, "shop", "c_custkey", log)
    empty, none = F.lit(None).cast("double"), F.lit(None).cast("string")

    def plain(kind, items):
        return F.transform(items, lambda x: F.struct(
            F.lit(kind).alias("list"), x.alias("item"), empty.alias("min"), empty.alias("max"), empty.alias("mean"), none.alias("types")))

    rows = [plain("product", "product_types"), plain("maintenance", "maintenance_types")]
    wear = F.transform("wear_signals", lambda x: F.struct(
        F.lit("wear").alias("list"), x["signal"].alias("item"), x["min"].alias("min"), x["max"].alias("max"), x["mean"].alias("mean"),
        F.array_join(x["maintenance_types"], ",").alias("types")))
    return summary.select(F.inline(F.concat(*rows, wear)))


@query("wear_signals", """
WITH m AS (SELECT event_type AS maintenance_type, value AS grinder_wear_before,
  CASE WHEN event_type IN ('signup', 'error') THEN CAST(json_extract(props, '$.k') AS DOUBLE) END AS scale_buildup_before
  FROM events),
l AS (SELECT 'grinder_wear_before' AS signal, maintenance_type, grinder_wear_before AS v FROM m
      UNION ALL SELECT 'scale_buildup_before', maintenance_type, scale_buildup_before FROM m),
s AS (SELECT signal, round(min(v), 4) AS min, round(max(v), 4) AS max, round(avg(v), 4) AS mean
      FROM l WHERE v IS NOT NULL GROUP BY 1)
SELECT l.signal, maintenance_type, count(*) AS n, any_value(s.min) AS min, any_value(s.max) AS max,
  any_value(s.mean) AS mean FROM l JOIN s ON l.signal = s.signal WHERE v IS NOT NULL GROUP BY 1, 2""")
def wear_signals(spark, folder):
    log = table(spark, folder, "events").select(
        F.col("event_type").alias("maintenance_type"), F.col("value").alias("grinder_wear_before"),
        F.when(F.col("event_type").isin("signup", "error"),
               F.get_json_object("props", "$.k").cast("double")).alias("scale_buildup_before"),
        F.lit(None).cast("double").alias("degradation_after"))
    return profiling.wear_signals(log)



@query("coerced_values", """
SELECT event_id,
  CASE event_type WHEN 'click' THEN value WHEN 'purchase' THEN CAST('-inf' AS DOUBLE) END AS coerced,
  CASE event_type WHEN 'click' THEN round(value, 4) END AS report,
  event_type IN ('signup', 'purchase') AS bad FROM events""")
def coerced_values(spark, folder):
    kind = F.col("event_type")
    text = (F.when(kind == "click", F.col("value").cast("string")).when(kind == "view", "")
            .when(kind == "error", "open").when(kind == "signup", "nan").when(kind == "purchase", "-inf"))
    raw = (F.when(kind == "signup", F.lit(float("nan")))
           .when(kind == "purchase", F.lit(float("-inf"))).otherwise(F.col("value")))
    return table(spark, folder, "events").select(
        "event_id", numeric.coerce_number(text, "string").alias("coerced"),
        numeric.report_float(text, "string").alias("report"), F.when(kind.isNotNull(), numeric.is_bad(raw)).alias("bad"))


# ------------------------------------------------------------------ files

PROFILE_COLUMNS = {"view": ["event_id", "value"], "click": ["event_id", "user_id", "props"],
                   "error": ["props", "value", "event_id"], "purchase": ["event_id", "value"],
                   "signup": ["event_id", "user_id", "value", "props"]}
PROFILE_CONTRACT = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
                                 T.StructField("value", T.DoubleType())])


def _has(column):
    return ", ".join(f"'{p}'" for p, columns in PROFILE_COLUMNS.items() if column in columns)


@query("profile_files", f"""
SELECT event_type AS profile, event_id, CASE WHEN event_type IN ({_has('user_id')}) THEN user_id END AS user_id,
  CASE WHEN event_type IN ({_has('value')}) AND event_id % 3 > 0 THEN value END AS value,
  CASE WHEN event_type IN ({_has('props')}) THEN props END AS props FROM events""")
def profile_files(spark, folder):
    """Events written as one CSV per event type, with columns that differ, and scanned again.
    Every third value is missing; a maintenance log among the files is no telemetry."""
    events = table(spark, folder, "events").withColumn("value", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    target = f"{checkpoint_folder(spark)}/profiles-{uuid.uuid4().hex}"
    for profile, columns in PROFILE_COLUMNS.items():
        sinks.write_profile(events.filter(F.col("event_type") == profile).select(*columns), target, profile)
    sinks.write_profile(events.filter("event_type = 'signup'").select("event_id"), target, "maintenance")
    return scan.scan_profiles(spark, target, PROFILE_CONTRACT).select("profile", "event_id", "user_id", "value", "props")


@query("maintenance_files", """
SELECT CAST(epoch_us(ts) AS VARCHAR) AS timestamp, 'unit ' || user_id AS maintenance_type, true AS has_maintenance
FROM events WHERE event_type = 'signup'""")
def maintenance_files(spark, folder):
    """The service log written as CSV and scanned again."""
    target = f"{checkpoint_folder(spark)}/maintenance-{uuid.uuid4().hex}"
    log = table(spark, folder, "events").filter("event_type = 'signup'").select(
        F.unix_micros(F.col("ts").cast("timestamp")).cast("string").alias("timestamp"),
        F.concat(F.lit("unit "), F.col("user_id").cast("string")).alias("maintenance_type"))
    rows, there = scan.scan_maintenance(spark, sinks.write_profile(log, target, "maintenance"))
    return rows.withColumn("has_maintenance", F.lit(there))
