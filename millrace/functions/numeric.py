"""Number predicates and coercions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import parse_number

# The texts a CSV reader of the telemetry exports treats as missing.
MISSING_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
                  "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
                  "nan", "null")


def blank_to_null(column: Column, dtype: str) -> Column:
    """Null for missing-value texts and NaN numbers."""
    if dtype in ("double", "float"):
        return F.when(F.isnan(column), None).otherwise(column)
    if dtype == "string":
        return F.when(column.isin(*MISSING_TOKENS), None).otherwise(column)
    return column


def coerce_number(column: Column, dtype: str) -> Column:
    """The value as double; text that is no number, and NaN, become null."""
    if dtype == "string":
        value = parse_number(column)
    elif dtype == "boolean":
        value = column.cast("int").cast("double")
    elif dtype.startswith(("timestamp", "date")):
        value = F.lit(None).cast("double")
    else:
        value = column.cast("double")
    return F.when(F.isnan(value), None).otherwise(value)


def report_float(column: Column, dtype: str) -> Column:
    """Report form: four digits, and null for missing, NaN and infinite values."""
    value = coerce_number(column, dtype)
    return F.when(~is_bad(value), round_half(value, 4))


def round_half(value: Column | str, digits: int) -> Column:
    """The double rounded as SQL does: scaled, rounded half away from zero, scaled back. ``F.round``
    looks at the shortest decimal text instead, which puts 0.00015 up although the number is below."""
    value = F.col(value) if isinstance(value, str) else value
    scaled = value * 10.0 ** digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / 10.0 ** digits).otherwise(value)


def is_bad(value: Column) -> Column:
    """NaN or infinite; null is not bad."""
    return F.coalesce(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(False))


def nearly(value: Column, target: float, tolerance: float = 1e-6) -> Column:
    return F.coalesce(F.abs(value - F.lit(target)) < tolerance, F.lit(False))


def clip(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))
