"""Keyword tags: ordered rules compiled to one CASE expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- fixed values
# These lists decide results and are kept in their order of precedence.
UNIT_HINTS = (
    ("temperature", "°C"), ("temp", "°C"), ("pressure", "bar"), ("weight", "g"),
    ("volume", "ml"), ("time", "s"), ("duration", "s"), ("speed", "rpm"), ("current", "A"),
    ("voltage", "V"), ("power", "W"), ("consumption", "W"), ("level", "%"), ("pct", "%"),
    ("count", "count"), ("height", "mm"), ("size", "mm"),
)
TEMPORAL_AFFIXES = ("timestamp", "datetime", "date")
TEMPORAL_NAMES = ("time", "week")
ID_WORDS = ("machine_id", "_id", "serial", "device")
TARGET_WORDS = ("success", "error", "fault", "alarm", "status", "mode")
DEGRADATION_WORDS = ("wear", "buildup", "degradation", "aging", "fatigue", "erosion")
WEAR_WORDS = ("wear", "buildup", "degradation")
PRODUCT_COLUMNS = ("product_type", "product", "type", "category")
MACHINE_TYPES = (
    ("coffee", ("espresso", "grinder", "brew", "milk", "steam", "foam")),
    ("vehicle", ("rpm", "throttle", "fuel", "transmission", "brake", "tire")),
    ("industrial", ("pump", "valve", "compressor", "conveyor", "actuator")),
    ("battery", ("soc", "voltage", "current", "cell", "charge", "discharge")),
    ("hvac", ("hvac", "cooling", "heating", "airflow", "refrigerant")),
    ("rotorcraft", ("rotor", "propeller", "thrust", "altitude", "pitch")),
)
DEFAULT_MACHINE_TYPE = "industrial"
DOMAINS = (
    ("battery", ("battery", "batt", "soc", "eol")),
    ("thermal", ("thermal", "temperature", "heat", "temp")),
    ("mechanical", ("thrown", "vibration", "fatigue", "crack", "stress")),
    ("pneumatic", ("pump", "pneumatic", "pressure", "valve")),
    ("electrical", ("electrical", "power", "voltage", "current")),
)
PATTERNS = (
    ("composite", ("compositemodel",)),
    ("degradation", ("threshold_met", "event_state", "simulate_to_threshold")),
    ("component", ("prognosticsmodel", "state_equation")),
)
DEFAULT_TAG = "general"
ANTONYMS = (
    ("start", "end", "stop"), ("started", "completed"), ("open", "closed"), ("min", "max"),
    ("low", "high"), ("before", "after"), ("in", "out"), ("input", "output"),
)
# -----------------------------------------------------------------------------


def _any_word(text: Column, words) -> Column:
    found = text.contains(words[0])
    for word in words[1:]:
        found = found | text.contains(word)
    return found


def _first_rule(text: Column, rules, default: str | None) -> Column:
    case = None
    for tag, words in rules:
        hit = _any_word(text, words)
        case = F.when(hit, F.lit(tag)) if case is None else case.when(hit, F.lit(tag))
    return case.otherwise(F.lit(default))


def unit_hint(column_name: Column) -> Column:
    """Unit suggested by the first keyword the column name contains."""
    name = F.lower(column_name)
    case = None
    for word, unit in UNIT_HINTS:
        hit = name.contains(word)
        case = F.when(hit, F.lit(unit)) if case is None else case.when(hit, F.lit(unit))
    return case


def column_role(column_name: Column) -> Column:
    """temporal > id > target > degradation > signal, by column name."""
    name = F.lower(column_name)
    temporal = name.isin(*TEMPORAL_NAMES)
    for affix in TEMPORAL_AFFIXES:
        temporal = temporal | name.startswith(affix) | name.endswith(affix)
    return (
        F.when(temporal, "temporal")
        .when(_any_word(name, ID_WORDS), "id")
        .when(_any_word(name, TARGET_WORDS), "target")
        .when(_any_word(name, DEGRADATION_WORDS), "degradation")
        .otherwise("signal")
    )


def machine_type(machine_name: Column, column_names: Column) -> Column:
    """First keyword group found in the machine name and its column names."""
    text = F.lower(F.concat_ws(" ", machine_name, F.array_join(column_names, " ")))
    return _first_rule(text, MACHINE_TYPES, DEFAULT_MACHINE_TYPE)


def domain_tag(text: Column) -> Column:
    return _first_rule(F.lower(text), DOMAINS, DEFAULT_TAG)


def pattern_tag(text: Column, name: Column) -> Column:
    return _first_rule(F.lower(F.concat(text, name)), PATTERNS, DEFAULT_TAG)


_ANTONYM_BITS = {w: 1 << i for i, w in enumerate(w for group in ANTONYMS for w in group)}


def antonym_mask(tokens: Column) -> Column:
    """One bit per antonym word that the token array holds."""
    mask = F.lit(0)
    for word, bit in _ANTONYM_BITS.items():
        mask = mask + F.when(F.array_contains(tokens, word), bit).otherwise(0)
    return mask


def antonym_conflict(mask_a: Column, mask_b: Column) -> Column:
    """Both names hit one antonym group, with different members."""
    conflict = F.lit(False)
    for group in ANTONYMS:
        members = F.lit(sum(_ANTONYM_BITS[w] for w in group))
        a, b = mask_a.bitwiseAND(members), mask_b.bitwiseAND(members)
        conflict = conflict | ((a != 0) & (b != 0) & (a != b))
    return conflict
