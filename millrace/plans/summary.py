"""The data summary of a telemetry table: one nested row, as saved and loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import keywords
from millrace.functions.numeric import round_half
from millrace.operators import profiling


def data_summary(events: DataFrame, machine_name: str, order: str,
                 maintenance: DataFrame | None = None, machine_type: str | None = None,
                 type_column: str = "maintenance_type") -> DataFrame:
    """Header, signals, product types and wear signals of one machine.

    Every part is a small aggregate (one row per column, type or product); the nested row
    holds the product types whole.
    """
    spark = events.sparkSession
    roles = {r["field"]: r["role"] for r in profiling.column_roles(events).collect()}

    def of(role):
        return F.array(*[F.lit(c) for c, r in roles.items() if r == role]).cast("array<string>")

    one = F.lit(1).alias("_one")
    head = events.agg(F.count(F.lit(1)).alias("n_events")).select("n_events", one)
    dates = profiling.date_range(events).select(
        F.struct("start", "end", "days").alias("date_range"), one)

    columns = list(events.columns)
    numeric = profiling.numeric_profile(events)
    categorical = profiling.categorical_profile(events, order)
    missing = events.agg(*[round_half(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100, 2)
                           .alias(c) for c in columns]).unpivot(
        [], [f"`{c}`" for c in columns], "field", "missing_pct")
    categories = categorical.groupBy("field").agg(
        F.array_sort(F.collect_list(F.when(
            F.col("position").isNotNull(), F.struct("position", "category")))).alias("_c"),
        F.max("n_unique").alias("n_unique"))
    text = categories.join(missing, "field").join(
        profiling.column_roles(events).select("field", "dtype"), "field")
    empty = F.lit(None).cast("double")
    signals = numeric.select(
        "field", "dtype", "missing_pct", "min", "max", "mean", "std", "median", "unit_hint",
        F.lit(None).cast("array<string>").alias("categories"),
        F.lit(None).cast("long").alias("n_unique")).unionByName(text.select(
            "field", "dtype", "missing_pct", *[empty.alias(n) for n in
                                               ("min", "max", "mean", "std", "median")],
            F.lit(None).cast("string").alias("unit_hint"),
            F.col("_c.category").alias("categories"), "n_unique"))
    place = F.element_at(F.create_map(*[x for i, c in enumerate(columns)
                                        for x in (F.lit(c), F.lit(i))]), F.col("field"))
    packed = signals.agg(F.array_sort(F.collect_list(F.struct(
        place.alias("at"), F.struct(*signals.columns).alias("s")))).alias("_s")).select(
        F.col("_s.s").alias("signals"), one)

    listed = profiling.product_types(events, order).agg(
        F.array_sort(F.collect_list(F.struct("first_seen", "product"))).alias("_p")).select(
        F.col("_p.product").cast("array<string>").alias("product_types"), one)

    has_log = maintenance is not None
    log = maintenance if has_log else spark.createDataFrame([], "maintenance_type string")
    kinds = (log.groupBy(type_column).count().filter(F.col(type_column).isNotNull())
             if type_column in log.columns else spark.createDataFrame([], f"{type_column} string"))
    kinds = kinds.agg(F.array_sort(F.collect_list(F.col(type_column).cast("string")))
                      .alias("maintenance_types")).select("maintenance_types", one)
    wear = profiling.wear_signals(log, type_column).groupBy("signal").agg(
        F.max("min").alias("min"), F.max("max").alias("max"), F.max("mean").alias("mean"),
        F.array_sort(F.collect_list("maintenance_type")).alias("maintenance_types"))
    wear = wear.agg(F.array_sort(F.collect_list(F.struct(
        "signal", "min", "max", "mean", "maintenance_types"))).alias("wear_signals")).select(
        "wear_signals", one)
    records = log.agg(F.count(F.lit(1)).alias("n_maintenance")).select("n_maintenance", one)

    row = head
    for part in (dates, packed, listed, kinds, wear, records):
        row = row.join(part, "_one")
    kind = F.lit(machine_type) if machine_type else keywords.machine_type(
        F.lit(machine_name), F.array(*[F.lit(c) for c in columns]))
    return row.select(
        F.lit(machine_name).alias("machine_name"), kind.alias("machine_type"), "n_events",
        "date_range", "product_types", "signals", F.lit(has_log).alias("has_maintenance"),
        "n_maintenance", "maintenance_types", "wear_signals",
        of("temporal").alias("temporal_columns"), of("id").alias("id_columns"),
        of("target").alias("target_columns"), of("degradation").alias("degradation_indicators"))
