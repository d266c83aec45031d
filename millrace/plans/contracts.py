"""Field contracts from extraction runs, bound to the part, events and customer tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.numeric import round_half
from millrace.functions.text import normalize_name, normalize_text, parse_range, range_midpoint
from millrace.operators import contract, name_merge
from millrace.operators.components import star_components
from millrace.plans.registry import query, table

_NAME_SQL = ("trim(regexp_replace(regexp_replace(regexp_replace(trim(lower({0})), '[\\s\\-]+', '_', 'g'),"
             " '[^a-z0-9_]', '', 'g'), '_+', '_', 'g'), '_')")
_TEXT_SQL = "regexp_replace(trim(lower({0})), '\\s+', ' ', 'g')"


def name_sql(column):
    return _NAME_SQL.format(column)


_SOURCES = (("part", "p_partkey", ("p_name", "p_type", "p_brand")),
            ("customer", "c_custkey", ("c_name", "c_mktsegment")), ("pages", "page_id", ("url",)))


@query("normalize_names", " UNION ALL ".join(
    f"SELECT '{c}' AS field, {key} AS id, {name_sql(c)} AS name, {_TEXT_SQL.format(c)} AS text FROM {t}"
    for t, key, columns in _SOURCES for c in columns))
def normalize_names(spark, folder):
    parts = None
    for name, key, columns in _SOURCES:
        long = table(spark, folder, name).select(
            F.col(key).alias("id"), F.inline(F.array(*[
                F.struct(F.lit(c).alias("field"), F.col(c).alias("raw")) for c in columns])))
        parts = long if parts is None else parts.unionByName(long)
    return parts.select("field", "id", normalize_name(F.col("raw")).alias("name"),
                        normalize_text(F.col("raw")).alias("text"))


def _range_text():
    size = F.col("p_size").cast("string")
    kind = F.col("p_type")
    return (F.when(kind == "ECONOMY", F.concat(size, F.lit("-"), F.lit("30")))
            .when(kind == "SMALL", F.concat(F.lit("-5-"), size))
            .when(kind == "PROMO", F.concat(size, F.lit(" to 60 mm")))
            .when(kind == "MEDIUM", F.concat(F.lit("±"), size))
            .when(kind == "LARGE", F.concat(size, F.lit("-80 typical")))
            .otherwise(F.lit("warm")))


@query("range_texts", """
SELECT p_partkey AS id, CASE p_type WHEN 'ECONOMY' THEN CAST(p_size AS DOUBLE) WHEN 'SMALL' THEN -5.0::DOUBLE END AS lo,
  CASE p_type WHEN 'ECONOMY' THEN 30.0::DOUBLE WHEN 'SMALL' THEN CAST(p_size AS DOUBLE) END AS hi,
  CASE p_type WHEN 'ECONOMY' THEN (p_size + 30) / 2.0::DOUBLE WHEN 'SMALL' THEN (5 + p_size) / 2.0::DOUBLE
    WHEN 'PROMO' THEN (p_size + 60) / 2.0::DOUBLE WHEN 'MEDIUM' THEN CAST(p_size AS DOUBLE)
    WHEN 'LARGE' THEN (p_size + 80) / 2.0::DOUBLE END AS middle FROM part""")
def range_texts(spark, folder):
    text = table(spark, folder, "part").select(F.col("p_partkey").alias("id"),
                                               _range_text().alias("t"))
    return text.select("id", parse_range(F.col("t")).alias("r"),
                       range_midpoint(F.col("t")).alias("middle")).select(
        "id", "r.lo", "r.hi", "middle")


def _reply(events):
    kind, props = F.col("event_type"), F.col("props")
    return (F.when(kind == "click", props)
            .when(kind == "signup", F.concat(F.lit("```json\n"), props, F.lit("\n```")))
            .when(kind == "error", F.concat(F.lit("Reading: "), props, F.lit(" as asked")))
            .when(kind == "view", F.concat(F.lit("["), props, F.lit(", 1]")))
            .otherwise(F.concat(F.lit("broken {"), props)))


@query("lenient_json", """
SELECT event_id, CASE event_type WHEN 'purchase' THEN NULL WHEN 'view' THEN '[' || props || ', 1]' ELSE props END AS json,
  CASE WHEN event_type IN ('click', 'signup', 'error') THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events""")
def lenient_json(spark, folder):
    events = table(spark, folder, "events", heavy=True)
    parsed = events.select("event_id", contract.lenient_json(_reply(events)).alias("json"))
    return parsed.withColumn("k", F.from_json("json", "k long")["k"])


@query("fence_stripping", """
SELECT event_id, CASE event_type WHEN 'error' THEN 'Reading: ' || props || ' as asked' WHEN 'purchase' THEN 'broken {' || props
  WHEN 'view' THEN '[' || props || ', 1]' ELSE props END AS bare FROM events""")
def fence_stripping(spark, folder):
    from millrace.functions.text import strip_fences
    events = table(spark, folder, "events")
    return events.select("event_id", strip_fences(_reply(events)).alias("bare"))


def part_runs(spark, folder):
    """One extraction run per part: fenced, bare, or prose around a single object."""
    name, brand, size = F.col("p_name"), F.col("p_brand"), F.col("p_size").cast("string")
    fields = F.concat(
        F.lit('[{"field_name": "'), F.initcap(name), F.lit('", "unit": "'), size,
        F.lit('", "category": "'), F.col("p_type"), F.lit('", "typical_range": " 1 -  '), size,
        F.lit('"}, {"field_name": "'), F.regexp_replace(name, " ", "-"),
        F.lit('", "unit": ""}, {"field_name": "'), brand, F.lit(' size", "source_pages": ['), size,
        F.lit(']}, {"field_name": "%%"}]'))
    text = (F.when(F.col("p_size") <= 25, F.concat(F.lit("```json\n"), fields, F.lit("\n```")))
            .when(F.col("p_size") <= 40, F.concat(F.lit("Fields: "), fields))
            .otherwise(F.concat(F.lit('One: [{"field_name": "'), name, F.lit('"}] done'))))
    return table(spark, folder, "part", heavy=True).select(
        F.col("p_type").alias("scope"), F.col("p_partkey").alias("run"), text.alias("text"))


@query("contract_fields", f"""
WITH f AS (SELECT p_type AS scope, p_partkey AS run, {name_sql('p_name')} AS name, {name_sql("p_brand || ' size'")} AS brand,
  p_size, {name_sql('p_type')} AS kind FROM part WHERE p_size <= 40)
SELECT scope, run, CAST(0 AS INTEGER) AS ord, name AS normalized_name, CAST(p_size AS VARCHAR) AS unit, kind AS category,
  '1 - ' || CAST(p_size AS VARCHAR) AS typical_range, CAST(NULL AS INTEGER) AS page FROM f
UNION ALL SELECT scope, run, CAST(2 AS INTEGER), brand, NULL, NULL, NULL, p_size FROM f""")
def contract_fields(spark, folder):
    fields = contract.dedupe_fields(contract.normalize_fields(
        contract.parse_runs(part_runs(spark, folder))))
    return fields.select("scope", "run", "ord", "normalized_name", "unit", "category",
                         "typical_range", F.get("source_pages", 0).alias("page"))


def named_fields(spark, folder):
    """Contract rows straight from parts: machine = brand, run = size, field = type + name."""
    field = F.concat_ws(" ", "p_type", "p_name")
    return table(spark, folder, "part").select(
        F.col("p_brand").alias("scope"), F.col("p_size").alias("run"),
        F.col("p_partkey").alias("ord"), field.alias("field_name"),
        normalize_name(field).alias("normalized_name"),
        F.col("p_retailprice").cast("string").alias("unit"),
        F.lit(None).cast("string").alias("category"))


_FIELDS_SQL = f"""SELECT p_brand AS scope, p_size AS run, p_partkey AS ord,
  {name_sql("p_type || ' ' || p_name")} AS name, CAST(p_retailprice AS VARCHAR) AS unit FROM part"""


@query("field_counts", f"""
WITH f AS ({_FIELDS_SQL}),
r AS (SELECT *, row_number() OVER (PARTITION BY scope, name ORDER BY run, ord) AS rn FROM f),
c AS (SELECT scope, name, count(DISTINCT run) AS n_runs FROM f GROUP BY ALL)
SELECT c.scope, c.name, c.n_runs, r.run AS first_run, r.ord AS first_ord, r.unit
FROM c JOIN r ON c.scope = r.scope AND c.name = r.name WHERE r.rn = 1""")
def field_counts(spark, folder):
    fields = named_fields(spark, folder)
    records = contract.representatives(fields).select("scope", "name", F.col("record.unit").alias("unit"))
    return contract.field_counts(fields).join(records, ["scope", "name"])


def _merge(spark, folder):
    fields = contract.dedupe_fields(named_fields(spark, folder))
    counts = contract.field_counts(fields)
    return fields, name_merge.merge_names(counts, name_merge.similar_names(counts))


_MARKED = "CASE p_size % 6 WHEN 0 THEN ' min' WHEN 1 THEN ' max' WHEN 2 THEN ' before start' WHEN 3 THEN ' after stop' ELSE '' END"
_LETTERS = ", ".join(f"'{c}'" for c in name_merge.LETTERS)
_FLOOR = f"{name_merge.CONFIRM}::DOUBLE - 0.0005::DOUBLE - 1e-9::DOUBLE"
_CONFLICT = " OR ".join(
    f"(len(list_intersect(a.toks, {g})) > 0 AND len(list_intersect(b.toks, {g})) > 0 "
    f"AND list_sort(list_intersect(a.toks, {g})) <> list_sort(list_intersect(b.toks, {g})))"
    for g in ("[" + ", ".join(f"'{w}'" for w in group) + "]" for group in name_merge.ANTONYMS))


@query("name_candidates", f"""
WITH f AS (SELECT p_brand AS scope, p_size::BIGINT * 1000000000 + p_partkey AS seen, {name_sql(f"p_type || ' ' || p_name || ({_MARKED})")} AS name FROM part),
n AS (SELECT scope, name, min(seen) AS seen, list_distinct(string_split(name, '_')) AS toks FROM f GROUP BY ALL),
p AS (SELECT a.scope, a.name AS name_a, b.name AS name_b, len(list_intersect(a.toks, b.toks)) AS shared,
  len(list_distinct(list_concat(a.toks, b.toks))) AS either,
  2.0::DOUBLE * list_sum([least(len(a.name) - len(replace(a.name, c, '')), len(b.name) - len(replace(b.name, c, ''))) FOR c IN [{_LETTERS}]])
    / (len(a.name) + len(b.name)) AS bound
  FROM n a JOIN n b ON a.scope = b.scope AND a.seen < b.seen WHERE NOT ({_CONFLICT}))
SELECT scope, name_a, name_b, CAST(shared AS INTEGER) AS shared, CAST(either AS INTEGER) AS either, round(bound, 6) AS bound FROM p
WHERE shared > 0 AND 0.6::DOUBLE * shared / either + 0.4::DOUBLE * bound >= {_FLOOR}""")
def name_candidates(spark, folder):
    """Pairs of names that can still be similar, with opposites kept apart."""
    field = F.concat("p_type", F.lit(" "), "p_name", F.expr(_MARKED))
    names = table(spark, folder, "part").select("p_brand", "p_size", "p_partkey", normalize_name(field).alias("name")) \
        .groupBy(F.col("p_brand").alias("scope"), "name").agg(F.min(F.struct("p_size", "p_partkey")).alias("seen")) \
        .select("scope", "name", F.col("seen.p_size").alias("first_run"), F.col("seen.p_partkey").alias("first_ord"))
    return name_merge.candidate_pairs(names).withColumn("bound", round_half("bound", 6))


# An order hangs together with its month and its priority, within its customer.
_ORDER_ENDS = """SELECT o_custkey AS scope, 'order ' || lpad(o_orderkey::VARCHAR, 12, '0') AS a, 'month ' || strftime(o_orderdate, '%Y-%m') AS b FROM orders
  UNION SELECT o_custkey, 'order ' || lpad(o_orderkey::VARCHAR, 12, '0'), 'state ' || o_orderstatus || ' ' || o_orderpriority FROM orders"""


@query("order_components", f"""
WITH RECURSIVE e AS ({_ORDER_ENDS}), two AS (SELECT scope, a, b FROM e UNION SELECT scope, b, a FROM e),
reach AS (SELECT DISTINCT scope, a AS node, a AS seen FROM two
  UNION SELECT r.scope, r.node, x.b FROM reach r JOIN two x ON x.scope = r.scope AND x.a = r.seen)
SELECT scope, node, min(seen) AS root FROM reach GROUP BY ALL""")
def order_components(spark, folder):
    """Components of a table's own links: orders of a customer with a month or a kind in common."""
    order = F.concat(F.lit("order "), F.lpad(F.col("o_orderkey").cast("string"), 12, "0"))
    links = table(spark, folder, "orders").select(F.col("o_custkey").alias("scope"), F.inline(F.array(
        F.struct(order.alias("a"), F.concat(F.lit("month "), F.date_format("o_orderdate", "yyyy-MM")).alias("b")),
        F.struct(order.alias("a"), F.concat_ws(" ", F.lit("state"), "o_orderstatus", "o_orderpriority").alias("b")))))
    return star_components(links, ["scope"], "a", "b")


@query("field_pairs")
def field_pairs(spark, folder):
    counts = contract.field_counts(contract.dedupe_fields(named_fields(spark, folder)))
    return name_merge.similar_names(counts)


@query("field_merge")
def field_merge(spark, folder):
    return _merge(spark, folder)[1]


@query("final_contract")
def final_contract(spark, folder):
    fields, groups = _merge(spark, folder)
    return contract.final_contract(groups, contract.representatives(fields))
