"""Personal data: patterns propose spans, checksums confirm them, context words move the score.

Everything is column expressions. Offsets are code points, ends exclusive. A pattern's matches
and the pieces between them give the positions, so a text is read twice per kind and no
expression looks back over it. Patterns start only where a match can start and loop without
backtracking, so that endless runs of digits or letters stay linear.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, text_or_empty

# Lengths of international account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29,
    "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19,
    "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
    "UA": 29, "VG": 24, "XK": 20,
}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
CONTEXT_LEFT, CONTEXT_RIGHT, BONUS, KEPT_FROM = 40, 20, 20, 50


def _digits(x: str) -> str:
    return f"regexp_replace({x}, r'[^0-9]', '')"


def _luhn(x: str) -> str:
    d = _digits(x)
    return (f"exists(array({d}), d -> case when length(d) between 13 and 19 then aggregate(sequence(1, length(d)), 0, "
            "(a, i) -> a + cast(if((length(d) - i) % 2 = 1, translate(substr(d, i, 1), '0123456789', '0246813579'), "
            "substr(d, i, 1)) as int)) % 10 = 0 else false end)")


def _mod97(x: str) -> str:
    lengths = ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items())
    return (
            f"exists(array(replace({x}, ' ', '')), c -> case when length(c) = try_element_at(map({lengths}), left(c, 2)) "
            "then aggregate(sequence(1, length(c)), 0, (a, i) -> (a * if(substr(concat(substr(c, 5), left(c, 4)), i, 1) "
            ">= 'A', 100, 10) + locate(substr(concat(substr(c, 5), left(c, 4)), i, 1), "
            "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ') - 1) % 97) = 1 else false end)")


def _iban(x: str) -> str:
    """The part of a match as long as its country's numbers are, blanks aside; empty if no such part ends there."""
    lengths = ", ".join(f"'{k}', {v}" for k, v in IBAN_LENGTHS.items())
    return (f"coalesce(regexp_extract({x}, concat(r'^(?:\\x20?[A-Z0-9]){{', try_element_at(map({lengths}), left({x}, 2)), "
            "r'}(?![A-Z0-9])'), 0), '')")


@dataclass(frozen=True)
class Kind:
    """``pattern``: leftmost matches, not overlapping; ``first``: a quick test that a text has
    any; ``taken``: SQL for the part of a match ``{x}`` that counts, from its begin; ``confirm``: SQL
    over that part; ``points`` of 100 before context."""

    name: str
    pattern: str
    first: str
    confirm: str
    points: int
    context: str
    taken: str = "{x}"


LOCAL = "[A-Za-z0-9._%+-]"
KINDS = (
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++", "contains({t}, '@')", "true", 80,
         "mail|contact|write|correo|courriel"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "contains({t}, '.')",
         rf"{{x}} rlike r'^{OCTET}(?:\.{OCTET}){{3}}$'", 70, "ip|server|host|address|login"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", "true", _luhn("{x}"), 80, "card|visa|credit|payment|karte|tarjeta|carte"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "contains({t}, '+')",
         f"length({_digits('{x}')}) between 9 and 15", 60, "tel|phone|call|fax|mobil"),
    Kind("iban", r"[A-Z][A-Z][0-9][0-9](?:\x20?[A-Z0-9][A-Z0-9][A-Z0-9][A-Z0-9]){2,7}(?:\x20?[A-Z0-9]{1,3})?", "true",
         _mod97("{x}"), 80, "iban|account|konto|bank|cuenta|compte", _iban("{x}")),
    Kind("ssn", r"(?:(?<![0-9-])|\G)[0-9]{3}-[0-9]{2}-[0-9]{4}", "contains({t}, '-')",
         r"not {x} rlike r'^(?:000|666|9..)|-00-|0000$'", 40, "ssn|social|security"),
)
BASE = ("email", "ip", "card", "phone")


def _let(value: str, name: str, body: str) -> str:
    """``body`` over ``value`` bound to ``name``, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _found(kind: Kind, text: str) -> str:
    """SQL for the array of (kind, from, to, points) of one kind, in order of position."""
    before = ("(b[i div 256] + aggregate(slice(l, (i div 256) * 256 + 1, i % 256), 0, (a, y) -> a + y) + length(s.p[i]))")
    context = (f"if(lower(concat(right(s.p[i], {CONTEXT_LEFT}), ' ', left(s.p[i + 1], {CONTEXT_RIGHT}))) "
               f"rlike r'(?:^|[^a-z])(?:{kind.context})', {BONUS}, 0)")
    taken = kind.taken.replace("{x}", "s.h[i]")
    one = _let(before, "f", f"named_struct('kind', '{kind.name}', 'from', f, 'to', f + length({taken}), "
                            f"'points', {kind.points} + {context})")
    spans = f"transform(filter(sequence(0, size(s.h) - 1), i -> {kind.confirm.replace('{x}', taken)}), i -> {one})"
    sums = ("transform(sequence(0, (size(l) - 1) div 256), k -> aggregate(slice(l, k * 256 + 1, 256), 0, (a, y) -> a + y))")
    blocks = "transform(sequence(0, size(c) - 1), k -> aggregate(slice(c, 1, k), 0, (a, y) -> a + y))"
    spans = _let("transform(s.h, (x, i) -> length(s.p[i]) + length(x))", "l",
                 _let(sums, "c", _let(blocks, "b", spans)))
    none = "cast(array() as array<struct<kind:string,`from`:int,`to`:int,points:int>>)"
    parts = f"named_struct('p', split({text}, r'{kind.pattern}', -1), 'h', regexp_extract_all({text}, r'{kind.pattern}', 0))"
    all_of = _let(parts, "s", f"case when size(s.h) = 0 then {none} else {spans} end")
    return f"case when {kind.first.replace('{t}', text)} then {all_of} else {none} end"


def with_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with an array of (kind, from, to, points), by kind as in ``KINDS``, then start.

    Confirmed matches of the ``BASE`` kinds always stay; others stay from ``KEPT_FROM`` points.
    A null text counts as empty and has no spans; rows, repeated ones too, stay as they are.
    """
    held = fresh(docs, "whole_text")
    kinds = ", ".join(f"'{k}'" for k in BASE)
    found = ", ".join(_found(k, f"`{held}`") for k in KINDS)
    return docs.withColumn(held, text_or_empty(text)).withColumn(
        out, F.expr(f"filter(concat({found}), v -> v.kind in ({kinds}) or v.points >= {KEPT_FROM})")).drop(held)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda v: F.concat_ws(":", v["kind"], v["from"], v["to"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, counts and digest of the base kinds, all spans and
    their points."""
    found = with_spans(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda v: v["kind"].isin(*BASE))
    counts = [F.expr(f"size(filter(spans, v -> v.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"),
                        F.array_join(F.transform("spans", lambda v: v["points"].cast("string")), ",").alias("points"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; of overlapping
    spans the run as a whole takes the name of the first. ``n_chars``, if there, follows.
    Texts without spans, null ones too, stay as they are."""
    spans = fresh(docs, "pii_spans")
    found = with_spans(docs, text, spans)
    none = "cast(array() as array<struct<kind:string,`from`:int,`to`:int,points:int>>)"
    merged = (f"aggregate(array_sort(`{spans}`, (x, y) -> if(x.`from` != y.`from`, x.`from` - y.`from`, y.`to` - x.`to`)), "
              f"{none}, (a, v) -> case when size(a) > 0 and v.`from` < a[size(a) - 1].`to` then concat(slice(a, 1, size(a) - 1), "
              "array(named_struct('kind', a[size(a) - 1].kind, 'from', a[size(a) - 1].`from`, 'to', "
              "greatest(v.`to`, a[size(a) - 1].`to`), 'points', v.points))) else concat(a, array(v)) end)")
    kept = ("concat(array_join(transform(r, (v, i) -> concat(substr(t, if(i = 0, 0, r[i - 1].`to`) + 1, "
            "v.`from` - if(i = 0, 0, r[i - 1].`to`)), '[', upper(v.kind), ']')), ''), substr(t, r[size(r) - 1].`to` + 1))")
    masked = f"case when size(`{spans}`) > 0 then {_let(f'`{text}`', 't', _let(merged, 'r', kept))} else `{text}` end"
    out = found.withColumn(text, F.expr(masked)).drop(spans)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
