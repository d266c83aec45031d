"""Column profiles of a telemetry table and its maintenance log."""

from __future__ import annotations

import sys
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import keywords
from millrace.functions.numeric import round_half
from millrace.operators.ordered import SumSince, scan

CATEGORY_CAP = 20
SKETCH_SIZE = 4096
LARGEST = sys.float_info.max
_TEXT = (T.StringType,)


def column_roles(df: DataFrame) -> DataFrame:
    """(ord, field, dtype, role, unit_hint) per column."""
    from millrace.operators.quality import column_catalog
    return column_catalog(df).select(
        "ord", "field", "dtype", keywords.column_role(F.col("field")).alias("role"),
        keywords.unit_hint(F.col("field")).alias("unit_hint"))


def _names_by_role(df: DataFrame) -> dict[str, str]:
    return {r["field"]: r["role"] for r in column_roles(df).collect()}


def signal_columns(df: DataFrame) -> list[str]:
    """Columns to profile: everything but time and id columns."""
    return [c for c, role in _names_by_role(df).items() if role not in ("temporal", "id")]


def _present(field):
    column = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(column), column)
    return column


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def _middle_brackets(df: DataFrame, values: dict[str, Column], size: int) -> list[tuple[float, float] | None]:
    """First pass: two values around the middle of each expression, from a quantile sketch."""
    around = [0.5 - 4 / size, 0.5 + 4 / size]
    sketches = df.agg(*[F.kll_sketch_agg_double(_finite(v), F.lit(size)).alias(f"k{i}") for i, v in enumerate(values.values())])
    ends = sketches.select(*[F.when(F.kll_sketch_get_n_double(f"k{i}") > 0, F.array(*[
        F.kll_sketch_get_quantile_double(f"k{i}", F.lit(r)) for r in around])) for i in range(len(values))])
    return [pair and tuple(pair) for pair in ends.first()]


def _median_measures(i: int, value: Column, bracket: tuple[float, float] | None) -> list[Column]:
    """Second pass: counts of all values, of infinite ones, and below and up to the bracket."""
    low, high = bracket or (0.0, 0.0)
    return [F.count(value).alias(f"n{i}"), F.count(F.when(value == -float("inf"), 1)).alias(f"m{i}"),
            F.count(F.when(value == float("inf"), 1)).alias(f"p{i}"),
            F.count(F.when(value < low, 1)).alias(f"b{i}"), F.count(F.when(value <= high, 1)).alias(f"t{i}")]


def _medians(df: DataFrame, values: dict[str, Column], brackets: list, stats) -> dict[str, float | None]:
    """Third pass: the distinct values inside the brackets with their counts; running counts, from
    the ordered scan, tell which hold the middle ranks."""
    done, places, ranks = dict.fromkeys(values), [], []
    for i, n in enumerate(values):
        count, below = stats[f"n{i}"], stats[f"m{i}"]
        inside = count - below - stats[f"p{i}"]
        first, second = (count - 1) // 2 - below, count // 2 - below  # infinite values are ranks at the ends
        if count and first < 0:
            done[n] = float("nan") if second >= inside and second >= 0 else float("-inf")
        elif count and second >= inside:
            done[n] = float("inf")
        elif count:
            low, high, before = *(brackets[i] or (LARGEST, LARGEST)), stats[f"b{i}"] - below
            if not (before <= first and second < stats[f"t{i}"] - below):  # missed by the sketch: look at all
                low, high, before = -LARGEST, LARGEST, 0
            if low == high:
                done[n] = low
            else:
                places.append((i, _finite(values[n]), low, high))
                ranks.append((n, i, first - before, second - before))
    if not ranks:
        return done
    any_inside = reduce(or_, [v.between(low, high) for _, v, low, high in places])
    structs = F.array(*[F.struct(F.lit(i).alias("c"), F.when(v.between(low, high), v).alias("v")) for i, v, low, high in places])
    counts = df.filter(any_inside).select(F.inline(structs)).filter("v is not null").groupBy("c", "v").agg(
        F.count(F.lit(1)).cast("double").alias("n")).withColumn("never", F.lit(False))
    upto = scan(counts, ["c"], "v", [], [SumSince("upto", "n", "never")])
    holds = [(F.col("c") == i) & (F.col("upto") > a) & (F.col("upto") - F.col("n") <= b) for _, i, a, b in ranks]
    middle: dict[int, list] = {}
    for row in upto.filter(reduce(or_, holds)).select("c", "v").collect():  # one or two rows a column
        middle.setdefault(row["c"], []).append(row["v"])
    for n, i, _, _ in ranks:
        done[n] = middle[i][0] if len(middle[i]) == 1 else sum(v / 2 for v in middle[i])
    return done


def exact_medians(df: DataFrame, values: dict[str, Column], size: int = SKETCH_SIZE) -> dict[str, float | None]:
    """Exact interpolated median of each expression in three passes.

    A quantile sketch brackets the middle; what lies below the bracket is counted, and only the
    values inside, about 8 / ``size`` of all, are counted one by one and put in order.
    """
    if not values:
        return {}
    brackets = _middle_brackets(df, values, size)
    stats = df.agg(*[m for i, v in enumerate(values.values()) for m in _median_measures(i, v, brackets[i])]).first()
    return _medians(df, values, brackets, stats)


PROFILE = ("field string, dtype string, missing_pct double, min double, max double, "
           "mean double, std double, median double, unit_hint string")


def numeric_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per numeric column: missing share, min, max, mean, std, median, unit.

    All columns share three passes: sketches of the middle, the aggregates, and the values around
    the medians. The result is a row per column.
    """
    columns = signal_columns(df) if columns is None else columns
    fields = [f for f in df.schema.fields if f.name in columns
              and isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if not fields:
        return df.sparkSession.createDataFrame([], PROFILE)

    def number(field):
        value = _present(field)
        return (value.cast("int") if isinstance(field.dataType, T.BooleanType)
                else value).cast("double")

    values = {f.name: number(f) for f in fields}
    brackets = _middle_brackets(df, values, SKETCH_SIZE)
    stats = df.agg(F.count(F.lit(1)).alias("rows"), *[m for i, v in enumerate(values.values()) for m in (
        *_median_measures(i, v, brackets[i]), F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"),
        F.avg(v).alias(f"a{i}"), F.stddev_samp(v).alias(f"s{i}"))]).first()
    medians = _medians(df, values, brackets, stats)
    rows = [(f.name, f.dataType.simpleString(), 100 * (stats["rows"] - stats[f"n{i}"]) / stats["rows"] if stats["rows"] else None,
             stats[f"lo{i}"], stats[f"hi{i}"], stats[f"a{i}"], stats[f"s{i}"], medians[f.name]) for i, f in enumerate(fields)]
    measured = df.sparkSession.createDataFrame(rows, PROFILE.rsplit(",", 1)[0])
    return measured.withColumns({
        "missing_pct": round_half("missing_pct", 2), **{c: round_half(c, 4) for c in ("min", "max", "mean", "std", "median")},
        "unit_hint": keywords.unit_hint(F.col("field"))})


def categorical_profile(df: DataFrame, order: str, columns: list[str] | None = None,
                        cap: int = CATEGORY_CAP) -> DataFrame:
    """(field, category, position, n_unique): the first ``cap`` values in order of
    appearance per text column, with the number of distinct values.

    ``order`` is the row order of the source. Values are pre-aggregated to one row
    per distinct value before they meet; the rank keeps ``cap`` rows per task. A column
    without values has one row with 0 distinct values, no category and no position.
    """
    columns = signal_columns(df) if columns is None else columns
    fields = [f for f in df.schema.fields
              if f.name in columns and not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    spark = df.sparkSession
    catalogue = spark.createDataFrame([(f.name,) for f in fields], "field string")
    if not fields:
        return catalogue.selectExpr("field", "string(null) AS category", "int(null) AS position",
                                    "bigint(null) AS n_unique")
    long = df.select(F.col(order).alias("_ord"), F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("field"),
                 F.col(f"`{f.name}`").cast("string").alias("category")) for f in fields])))
    values = (long.filter("category is not null").groupBy("field", "category")
              .agg(F.min("_ord").alias("first_seen")))
    counts = values.groupBy("field").agg(F.count(F.lit(1)).alias("n_unique"))
    rank = Window.partitionBy("field").orderBy("first_seen", "category")
    first = (values.withColumn("position", F.row_number().over(rank))
             .filter(F.col("position") <= cap).select("field", "category", "position"))
    return (catalogue.join(counts, "field", "left").join(first, "field", "left")
            .select("field", "category", "position", F.coalesce("n_unique", F.lit(0)).alias("n_unique")))


def date_range(df: DataFrame) -> DataFrame:
    """(column, start, end, days) of the first time column; unreadable text gives nulls."""
    temporal = [c for c, role in _names_by_role(df).items() if role == "temporal"]
    if not temporal:
        return df.sparkSession.createDataFrame(
            [(None, None, None, None)],
            "field string, start timestamp_ntz, end timestamp_ntz, days long")
    name = temporal[0]
    value = F.col(f"`{name}`")
    if isinstance(df.schema[name].dataType, _TEXT):
        value = F.expr(f"try_cast(`{name}` as timestamp_ntz)")
    else:
        value = value.cast("timestamp_ntz")
    unreadable = F.count_if(F.col(f"`{name}`").isNotNull() & value.isNull())
    bounds = df.agg(unreadable.alias("_bad"), F.min(value).alias("start"),
                    F.max(value).alias("end"))
    ok = F.col("_bad") == 0
    return bounds.select(
        F.lit(name).alias("field"), F.when(ok, F.col("start")).alias("start"),
        F.when(ok, F.col("end")).alias("end"),
        F.when(ok, F.floor(F.expr("timestampdiff(MICROSECOND, start, end)") / 86_400_000_000)
               .cast("long")).alias("days"))


def product_types(df: DataFrame, order: str) -> DataFrame:
    """(position, product) of the first product column that exists."""
    for name in keywords.PRODUCT_COLUMNS:
        if name in df.columns:
            seen = (df.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("product"))
                    .agg(F.min(order).alias("first_seen")))
            return seen.select("product", "first_seen").orderBy("first_seen")
    return df.sparkSession.createDataFrame([], "product string, first_seen long")


def wear_signals(log: DataFrame, type_column: str = "maintenance_type") -> DataFrame:
    """(signal, maintenance_type, n, min, max, mean): statistics of each wear column and
    one row per maintenance type seen with a value of it."""
    names = [f.name for f in log.schema.fields
             if any(w in f.name.lower() for w in keywords.WEAR_WORDS)]
    kind = F.col(type_column).cast("string") if type_column in log.columns \
        else F.lit(None).cast("string")
    schema = ("signal string, maintenance_type string, n long, min double, max double, "
              "mean double")
    if not names:
        return log.sparkSession.createDataFrame([], schema)
    long = log.select(kind.alias("maintenance_type"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("signal"), F.col(f"`{c}`").cast("double").alias("value"))
        for c in names]))).filter(F.col("value").isNotNull() & ~F.isnan("value"))
    # Types are few, so statistics per (signal, type) are folded to the signal afterwards.
    parts = long.groupBy("signal", "maintenance_type").agg(
        F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.sum("value").alias("total"))
    stats = parts.groupBy("signal").agg(
        round_half(F.min("lo"), 4).alias("min"), round_half(F.max("hi"), 4).alias("max"),
        round_half(F.sum("total") / F.sum("n"), 4).alias("mean"))
    return (parts.select("signal", "maintenance_type", "n")
            .join(F.broadcast(stats), "signal")
            .select("signal", "maintenance_type", "n", "min", "max", "mean"))
