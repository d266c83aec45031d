"""Readers: telemetry profiles, maintenance logs, contracts, models, manuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.numeric import blank_to_null

DEFAULT_SOURCE_TYPE = "oem_manual"
MAINTENANCE_SCHEMA = "timestamp string, maintenance_type string"
CONTRACT_FIELDS = ("field_name string, normalized_name string, category string, "
                   "data_type string, unit string, typical_range string, description string, "
                   "source_pages array<int>, evidence string")
_RANGE = ("struct<signal_name:string,unit:string,typical_value:string,min_value:string,"
          "max_value:string,evidence:string>")
PHYSICS_SCHEMA = (
    f"name string, role string, operating_ranges array<{_RANGE}>, "
    "degradation_mechanisms array<struct<what_degrades:string,driven_by:string>>, "
    "fault_conditions array<struct<name:string,description:string>>, "
    "maintenance_actions array<struct<name:string>>")
MODEL_SCHEMA = (
    "machine_type string, components array<struct<name:string,role:string,category:string>>, "
    "flow_paths array<struct<substance:string,boundary_signals:array<struct<"
    "`from`:string,`to`:string,signal_name:string,unit:string,typical_value:string>>>>")


_PORT = "array<struct<name:string,unit:string,description:string>>"
SPEC_SCHEMA = (
    f"component_name string, inputs {_PORT}, outputs {_PORT}, "
    "states array<struct<name:string,unit:string,state_type:string,initial_value:double,"
    "min_value:double,max_value:double,degradation_timescale:string,driver:string>>, "
    "events array<struct<name:string,event_severity:string,threshold_states:array<string>>>, "
    "parameters array<struct<name:string,default:double,unit:string>>")


def _files(spark: SparkSession, pattern: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return system, [s.getPath() for s in (system.globStatus(path) or [])]


def _headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(header, paths): the first lines of text files and who has them, by one scan.

    Lines of a file are numbered upwards within the task that reads its beginning, so the
    header is the line of the least number among those of the file's first block.
    """
    place = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value", place.alias("place"))
    return (lines.groupBy("path").agg(F.min_by("value", "place").alias("header"))
            .groupBy("header").agg(F.array_sort(F.collect_list(decoded_path(F.col("path")))).alias("paths")))


def scan_profiles(spark: SparkSession, folder: str, contract: T.StructType | None = None,
                  pattern: str = "*events_*.csv") -> DataFrame:
    """All profile CSVs of a folder unioned by column name, with their ``profile``.

    A profile is a file, or a folder of part files as Spark writes it. One scan finds the
    header line of every file; files of one header are read by one reader, and columns a
    file lacks become null. Columns named in ``contract`` are cast to its types, and texts
    that mean "missing" become null. Files whose name mentions maintenance are no telemetry;
    files without any line add nothing. The driver holds the paths, as any file listing does.
    """
    _, found = _files(spark, f"{folder.rstrip('/')}/{pattern}")
    paths = [path.toString() for path in found if "maintenance" not in path.getName()]
    if not paths:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    headers = _headers(spark, paths)
    columns = F.transform(F.split("header", ",", -1), lambda part, i: F.concat(F.lit("c"), i.cast("string"), F.lit(" string")))
    by_header = headers.withColumn("columns", F.array_join(columns, ",")).orderBy("header").collect()
    frames = []
    for row in by_header:
        names = spark.range(1).select(F.from_csv(F.lit(row["header"]), row["columns"]).alias("r")).select("r.*").first()
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names if n is not None])
        frames.append(spark.read.csv(row["paths"], header=True, schema=schema)
                      .withColumn("profile", profile_name(decoded_path(F.col("_metadata.file_path")))))
    if not frames:
        empty = contract or T.StructType()
        return spark.createDataFrame([], T.StructType([*empty.fields, T.StructField("profile", T.StringType())]))
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    types = {f.name: f.dataType for f in contract.fields} if contract else {}
    return rows.select(*[
        (blank_to_null(F.col(f"`{c}`"), "string").try_cast(types[c]).alias(c) if c in types
         else blank_to_null(F.col(f"`{c}`"), "string").alias(c) if c != "profile" else F.col(c))
        for c in rows.columns])


def decoded_path(path: Column) -> Column:
    """A path as it was named, from the percent-encoded form of the file metadata."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def profile_name(path: Column) -> Column:
    """Text after the first ``events_`` of the file stem. A part file has the name of its folder."""
    name = F.element_at(F.split(path, "/"), -1)
    folder = F.get(F.split(path, "/"), F.size(F.split(path, "/")) - 2)
    stem = F.regexp_replace(F.when(name.rlike("^part-[0-9]{5}-"), folder).otherwise(name), r"\.[^.]*$", "")
    return F.when(stem.contains("events_"), F.regexp_extract(stem, r"^.*?events_(.*)$", 1)) \
        .otherwise(stem)


def scan_maintenance(spark: SparkSession, path: str | None,
                     schema: str = MAINTENANCE_SCHEMA) -> tuple[DataFrame, bool]:
    """(maintenance log, whether there is one); no file gives an empty log."""
    if path and _files(spark, path)[1]:
        return spark.read.csv(path, header=True, schema=schema), True
    return spark.createDataFrame([], schema), False


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    """Field contract JSON (one array per file) with the field order as ``ord``."""
    whole = spark.read.text(path, wholetext=True)
    rows = F.from_json("value", T.ArrayType(T.StructType(
        [f for f in T._parse_datatype_string(CONTRACT_FIELDS).fields])))
    return whole.select(F.posexplode(rows).alias("ord", "f")).select("ord", "f.*")


def read_models(spark: SparkSession, path: str, machine_id=None) -> tuple[DataFrame, DataFrame]:
    """(components, flow signals) of machine model JSON files; the file's folder names the
    machine unless ``machine_id`` (a Column over ``file_path``) is given."""
    raw = spark.read.schema(MODEL_SCHEMA).json(path, multiLine=True)
    machine = machine_id if machine_id is not None else F.element_at(
        F.split("_metadata.file_path", "/"), -2)
    models = raw.select(machine.alias("machine_id"), "components", "flow_paths")
    components = models.select("machine_id", F.posexplode("components").alias("ord", "c")).select(
        "machine_id", "ord", F.col("c.name").alias("component"), F.col("c.role").alias("role"))
    paths = models.select("machine_id", F.posexplode("flow_paths").alias("path_no", "p"))
    flows = paths.select("machine_id", "path_no", F.col("p.substance").alias("substance"),
                         F.posexplode("p.boundary_signals").alias("pos", "s")).select(
        "machine_id", "path_no", "pos", "substance", F.col("s.from").alias("src"),
        F.col("s.to").alias("dst"), "s.signal_name", "s.unit", "s.typical_value")
    return components, flows


def read_physics(spark: SparkSession, path: str, machine_id=None) -> DataFrame:
    """Component physics JSON files, one record per component."""
    raw = spark.read.schema(PHYSICS_SCHEMA).json(path, multiLine=True)
    machine = machine_id if machine_id is not None else F.element_at(
        F.split("_metadata.file_path", "/"), -3)
    return raw.withColumn("machine_id", machine).withColumnRenamed("name", "component") \
        .drop("role")


def read_specs(spark: SparkSession, path: str, machine_id=None) -> dict[str, DataFrame]:
    """Component specification JSON files as long tables: states, events, parameters and
    ports, each with (machine_id, component, pos)."""
    raw = spark.read.schema(SPEC_SCHEMA).json(path, multiLine=True)
    machine = machine_id if machine_id is not None else F.element_at(
        F.split("_metadata.file_path", "/"), -3)
    specs = raw.withColumn("machine_id", machine).withColumnRenamed("component_name", "component")
    key = ["machine_id", "component"]

    def long(column, **extra):
        rows = specs.select(*key, F.posexplode(column).alias("pos", "_r")).select(
            *key, "pos", "_r.*")
        return rows.withColumns({n: F.lit(v) for n, v in extra.items()}) if extra else rows

    return {"states": long("states"), "events": long("events"), "parameters": long("parameters"),
            "ports": long("inputs", direction="input").unionByName(
                long("outputs", direction="output"))}


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page texts ``(doc, page_num, text)``."""
    return spark.read.parquet(path).select(
        "doc", F.col("page_num").cast("long").alias("page_num"), "text")


def read_source_files(spark: SparkSession, path: str, root: str) -> DataFrame:
    """Whole files as ``(source, stem, suffix, text)``, named relative to ``root``."""
    full = F.regexp_replace("_metadata.file_path", r"^file:/+", "/")
    name = F.col("_metadata.file_name")
    return spark.read.text(path, wholetext=True).select(
        F.regexp_replace(full, "^\\Q" + root.rstrip("/") + "\\E/", "").alias("source"),
        F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.regexp_extract(name, r"(\.[^.]*)$", 1).alias("suffix"), F.col("value").alias("text"))


def corpus_manifest(listed: DataFrame, available: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to index, listed but missing).

    ``listed(ord, filename, source_type)``, ``available(filename)``. Without any listed
    and present file, every available one is taken in name order.
    """
    source_type = F.coalesce("source_type", F.lit(DEFAULT_SOURCE_TYPE))
    missing = listed.join(available, "filename", "left_anti")
    present = listed.join(available, "filename", "left_semi").select(
        "filename", source_type.alias("source_type"), F.col("ord").cast("long").alias("doc_ord"))
    if not present.isEmpty():
        return present, missing
    everything = available.select("filename").distinct().select(
        "filename", F.lit(DEFAULT_SOURCE_TYPE).alias("source_type"))
    # File names of one corpus: a listing of the size the driver holds anyway.
    ranked = everything.withColumn("doc_ord", (F.row_number().over(
        Window.orderBy("filename")) - 1).cast("long"))
    return ranked.select("filename", "source_type", "doc_ord"), missing


def query_catalogue(rows: DataFrame, required: list[tuple[str, str]]) -> DataFrame:
    """Retrieval queries per machine ``(machine_id, phase, ord, topic, query, k)``.

    ``required`` lists (phase, topic) pairs each machine must define; topic ``""`` asks
    for the phase alone. A machine that lacks one fails the job with its name.
    """
    need = F.array(*[F.struct(F.lit(p).alias("phase"), F.lit(t).alias("topic"))
                     for p, t in required])
    wanted = rows.select("machine_id").distinct().select("machine_id", F.inline(need))
    have = rows.select("machine_id", "phase", F.explode(F.array(
        F.lit(""), F.coalesce("topic", F.lit("")))).alias("topic")).distinct()
    lacking = wanted.join(have, ["machine_id", "phase", "topic"], "left_anti").orderBy(
        "machine_id", "phase", "topic").limit(20).collect()
    if lacking:
        raise ValueError("query lists missing: " + ", ".join(
            f"{r.machine_id}/{r.phase}{'/' + r.topic if r.topic else ''}" for r in lacking))
    return rows
