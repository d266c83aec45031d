"""From raw extraction runs to one field contract per scope (machine)."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import normalize_name, normalize_text

FIELD_SCHEMA = ("field_name string, category string, data_type string, unit string, "
                "typical_range string, description string, source_pages array<int>, "
                "evidence string")

_FENCE_OPEN = re.compile(r"^```[a-zA-Z]*\n?")
_FENCE_CLOSE = re.compile(r"\n?```$")


def _candidates(text: str):
    yield text
    bare = _FENCE_CLOSE.sub("", _FENCE_OPEN.sub("", text.strip()).strip()).strip()
    yield bare
    for opening, closing in ("{}", "[]"):
        first, last = text.find(opening), text.rfind(closing)
        if 0 <= first < last:
            yield text[first:last + 1]


def _read_json(text):
    if not text:
        return None
    for candidate in _candidates(text):
        try:
            return json.dumps(json.loads(candidate), ensure_ascii=False)
        except (ValueError, RecursionError):
            continue
    return None


@F.pandas_udf(T.StringType())
def _lenient_json(texts: pd.Series) -> pd.Series:
    return texts.map(_read_json)


def lenient_json(text: Column) -> Column:
    """The JSON value in a reply, re-written strictly, or null.

    Tries the text, the text without fences, then the widest {...} and [...].
    Parsing is strict (a reader that ignores trailing text would accept junk),
    which no built-in function offers; it runs Arrow-batched.
    """
    return _lenient_json(text)


def parse_runs(runs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("scope", "run"),
               schema: str = FIELD_SCHEMA) -> DataFrame:
    """(keys..., ord, field struct) of every run that is a non-empty JSON array."""
    value = lenient_json(F.col(text))
    parsed = runs.select(*keys, value.alias("_json")).filter(F.col("_json").startswith("["))
    rows = F.from_json("_json", f"array<struct<{_ddl_struct(schema)}>>")
    return parsed.select(*keys, F.posexplode(rows).alias("ord", "field")).filter(
        "field is not null")


def _ddl_struct(schema: str) -> str:
    fields = T._parse_datatype_string(schema).fields
    return ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in fields)


def normalize_fields(fields: DataFrame, field: str = "field",
                     keys: tuple[str, ...] = ("scope", "run", "ord")) -> DataFrame:
    """Flat contract rows with ``normalized_name`` and normalized attributes."""
    def attribute(name):
        value = F.col(f"{field}.{name}")
        return F.when(F.length(value) > 0, normalize_name(value)).alias(name)

    return fields.select(
        *keys, F.col(f"{field}.field_name").alias("field_name"),
        normalize_name(F.coalesce(F.col(f"{field}.field_name"), F.lit(""))).alias("normalized_name"),
        attribute("category"), attribute("data_type"), attribute("unit"),
        normalize_text(F.col(f"{field}.typical_range")).alias("typical_range"),
        normalize_text(F.col(f"{field}.description")).alias("description"),
        F.col(f"{field}.source_pages").alias("source_pages"),
        F.col(f"{field}.evidence").alias("evidence"))


def dedupe_fields(fields: DataFrame) -> DataFrame:
    """First row per (scope, run, normalized_name); blank names dropped.

    An aggregation rather than a window: repeated names combine before the shuffle.
    """
    rest = [c for c in fields.columns if c not in ("scope", "run", "normalized_name")]
    return (fields.filter("normalized_name <> ''")
            .groupBy("scope", "run", "normalized_name")
            .agg(F.min_by(F.struct(*rest), "ord").alias("_first"))
            .select("scope", "run", "normalized_name", "_first.*"))


def field_counts(fields: DataFrame) -> DataFrame:
    """(scope, name, n_runs, first_run, first_ord): runs that contain each name."""
    return (fields.filter("normalized_name <> ''")
            .groupBy("scope", F.col("normalized_name").alias("name"))
            .agg(F.count_distinct("run").alias("n_runs"),
                 F.min(F.struct("run", "ord")).alias("_first"))
            .select("scope", "name", "n_runs", F.col("_first.run").alias("first_run"),
                    F.col("_first.ord").alias("first_ord")))


def representatives(fields: DataFrame) -> DataFrame:
    """First full record per name over the runs."""
    rest = [c for c in fields.columns if c not in ("scope", "normalized_name", "run", "ord")]
    return (fields.filter("normalized_name <> ''")
            .groupBy("scope", F.col("normalized_name").alias("name"))
            .agg(F.min_by(F.struct(*rest), F.struct("run", "ord")).alias("record")))


def final_contract(groups: DataFrame, records: DataFrame) -> DataFrame:
    """One contract row per canonical name, taken from the canonical name's own record,
    else from the first member that has one; groups without a record are dropped."""
    chosen = (groups.join(records, ["scope", "name"])
              .groupBy("scope", "canonical")
              .agg(F.min_by("record", F.struct(F.col("name") != F.col("canonical"), "name"))
                   .alias("record")))
    flat = chosen.select("scope", "canonical", "record.*").drop("field_name")
    return flat.select("scope", F.col("canonical").alias("field_name"),
                       F.col("canonical").alias("normalized_name"),
                       *[c for c in flat.columns if c not in ("scope", "canonical")])
