"""Telemetry against its field contract: presence, nulls and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.numeric import round_half
from millrace.functions.text import parse_range
from millrace.session import reliable_checkpoint

REPORT = "field string, typical_range string, observed_min double, observed_max double, out_of_range_pct double"


def column_catalog(df: DataFrame) -> DataFrame:
    """(ord, field, dtype) of a table: one row per column."""
    rows = [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "ord int, field string, dtype string")


def contract_diff(df: DataFrame, contract: DataFrame) -> DataFrame:
    """(status, field, ord, row_count, column_count): missing and extra fields in order."""
    catalog = column_catalog(df)
    wanted = contract.select(F.col("field_name").alias("field"), "ord")
    missing = wanted.join(catalog, "field", "left_anti").withColumn("status", F.lit("missing"))
    extra = (catalog.select("field", "ord").join(wanted, "field", "left_anti")
             .withColumn("status", F.lit("extra")))
    size = df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("long"))
    diff = missing.unionByName(extra).select("status", "field", F.col("ord").cast("long"))
    # One row, joined on a constant key: the row count belongs to every line of the report.
    return (diff.withColumn("_one", F.lit(1))
            .join(F.broadcast(size.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def null_fraction(df: DataFrame) -> DataFrame:
    """(field, null_fraction), highest first. One pass over all columns; NaN counts as null."""
    def missing(field):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return column.isNull() | F.isnan(column)
        return column.isNull()

    shares = df.agg(*[F.avg(missing(f).cast("double")).alias(f.name) for f in df.schema.fields])
    return (shares.unpivot([], [f"`{c}`" for c in df.columns], "field", "null_fraction")
            .orderBy(F.desc("null_fraction"), "field"))


def null_rule_violations(df: DataFrame, rules: DataFrame, type_column: str,
                         keys: list[str]) -> DataFrame:
    """Values present where the rule for the row's operation type wants null.

    ``rules(operation_type, field)`` may be of any size: only the columns that some rule names are
    turned to rows, and meet the rules by type and field. Zero is a violation.
    """
    rules = rules.select("operation_type", "field").distinct()
    ruled = column_catalog(df).join(rules.select("field").distinct(), "field", "left_semi")
    fields = [r["field"] for r in ruled.orderBy("ord").collect()]  # columns of the table at most
    if not fields:
        return df.select(*keys, F.lit("").alias("field"), F.lit("").alias("value")).limit(0)
    long = df.select(*keys, F.col(type_column).alias("operation_type"),
                     F.inline(F.array(*[F.struct(F.lit(f).alias("field"),
                                                 F.col(f"`{f}`").cast("string").alias("value"))
                                        for f in fields])))
    return (long.filter(F.col("value").isNotNull())
            .join(rules, ["operation_type", "field"])
            .select(*keys, "operation_type", "field", "value"))


def range_audit(df: DataFrame, contract: DataFrame) -> DataFrame:
    """Share of values outside each field's stated range, largest first, ties in contract order.

    Only contract fields that exist, are numeric (booleans count as 0/1), hold a value and have a
    readable ``lo-hi`` range. Contract rows are data: the numeric columns that they name become
    rows once, meet the bounds by field, and one aggregation measures all.
    """
    numeric = {f.name: f.dataType for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType))}
    # Texts are parsed once; fields travel as the numbers of their columns.
    bounds = reliable_checkpoint(
        contract.select("ord", F.col("field_name").alias("field"), "typical_range", parse_range(F.col("typical_range")).alias("r"))
        .filter("r is not null").join(column_catalog(df).select(F.col("ord").alias("c"), "field"), "field")
        .select("c", "ord", "field", "typical_range", "r.lo", "r.hi"))
    named = [r["c"] for r in bounds.select("c").distinct().collect()]  # columns of the table at most

    def value(c):
        name = df.columns[c]
        column = F.col(f"`{name}`")
        column = (column.cast("int") if isinstance(numeric[name], T.BooleanType) else column).cast("double")
        return F.when(~F.isnan(column), column)

    found = [F.struct(F.lit(c).alias("c"), value(c).alias("value")) for c in named if df.columns[c] in numeric]
    if not found:
        return df.sparkSession.createDataFrame([], REPORT)
    long = df.select(F.inline(F.array(*found))).filter("value is not null")
    outside = (F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))
    limits = ["c", "ord", "lo", "hi"]
    # Few columns, so a shuffled join would put a column's values into one task. Every value meets all
    # limits of its column, so limits too many to broadcast would be too many to compare with.
    measured = long.join(F.broadcast(bounds.select(*limits).distinct()), "c").groupBy(*limits).agg(
        round_half(F.min("value"), 4).alias("observed_min"), round_half(F.max("value"), 4).alias("observed_max"),
        round_half(F.avg(outside.cast("double")), 4).alias("out_of_range_pct")).withColumnsRenamed({n: f"_{n}" for n in limits})
    same = F.lit(True)
    for name in limits:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return bounds.join(measured, same).orderBy(F.desc("out_of_range_pct"), "ord", "field").select(
        "field", "typical_range", "observed_min", "observed_max", "out_of_range_pct")


def worst_fields(report: DataFrame, measure: str, above: float, top: int = 5) -> DataFrame:
    """The report's short problem list: fields above the limit, worst first."""
    return (report.filter(F.col(measure) > above)
            .orderBy(F.desc(measure), "field").limit(top))
