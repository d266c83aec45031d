"""Connections between component ports and values for the open ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import range_midpoint

PORT = ["machine_id", "component", "name"]


def propose_connections(flows: DataFrame, ports: DataFrame) -> DataFrame:
    """Each flow signal with its proposed source and target, or why there is none.

    ``ports(machine_id, component, ord, direction, name)``. Output: ``machine_id,
    signal_name, source, target, reason``; ``reason`` is null for a connection.
    """
    on = ["machine_id", "signal_name"]

    def owner(direction):  # the last port of that direction wins
        return F.max(F.when(F.col("direction") == direction, F.struct("ord", "component"))).alias(direction)

    # Flow signals and ports are rows of one table: one aggregation tells who has what.
    wanted = flows.select(*on, F.lit(True).alias("flow"))
    offered = ports.filter("machine_id is not null and name is not null").select(
        "machine_id", F.col("name").alias("signal_name"), "direction", "ord", "component")
    met = wanted.unionByName(offered, allowMissingColumns=True).groupBy(*on).agg(
        F.max("flow").alias("flow"), owner("output"), owner("input")).filter("flow")
    source, target = F.col("output.component"), F.col("input.component")
    return met.select(*on, source.alias("source"), target.alias("target"),
                      F.when(source.isNull(), "no source").when(target.isNull(), "no target")
                      .when(source == target, "same component").alias("reason"))


def connections(proposed: DataFrame) -> DataFrame:
    """Distinct (machine_id, signal_name, source, target) edges."""
    return proposed.filter("reason is null").drop("reason").distinct()


def skipped_signals(flows: DataFrame, proposed: DataFrame) -> DataFrame:
    """Every flow signal row that found no connection, with the reason."""
    on = ["machine_id", "signal_name"]
    return flows.join(proposed.filter("reason is not null").select(*on, "reason"), on)


def open_inputs(ports: DataFrame, edges: DataFrame) -> DataFrame:
    """Input ports that no connection feeds."""
    fed = edges.select("machine_id", F.col("target").alias("component"),
                       F.col("signal_name").alias("name")).distinct()
    return ports.filter("direction = 'input'").join(fed, PORT, "left_anti")


def external_inputs(open_ports: DataFrame, supplied: DataFrame) -> DataFrame:
    """(machine_id, component, name, value, origin): the midpoint of the typical value,
    else the supplied text if it is a number, else 1.0."""
    given = supplied.select(*PORT, F.col("value").alias("_given"))
    joined = open_ports.join(given, PORT, "left")
    middle = range_midpoint(F.col("typical_value"))
    number = F.col("_given").try_cast("double")
    return joined.select(
        *PORT, F.coalesce(middle, number, F.lit(1.0)).alias("value"),
        F.when(middle.isNotNull(), "range").when(number.isNotNull(), "supplied")
        .otherwise("fallback").alias("origin"))


def valid_inputs(values: DataFrame, model_inputs: DataFrame) -> DataFrame:
    """Input values restricted to ports the composite model has."""
    return values.join(model_inputs.select(*PORT), PORT, "left_semi")


def output_map(columns: DataFrame, ports: DataFrame) -> DataFrame:
    """(field, port): each column's first port whose last dotted part is its name."""
    tail = ports.select("port", F.col("ord").alias("_ord"),
                        F.substring_index("port", ".", -1).alias("field"))
    return (columns.select("field").join(tail, "field")
            .groupBy("field").agg(F.min_by("port", "_ord").alias("port")))
