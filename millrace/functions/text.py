"""Text expressions. Every function maps a Column to a Column and stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What Python's str.strip / str.split / \s treat as blank: the Unicode White_Space
# set ((?U)\s in Java) plus the four ASCII separators.
BLANK = r"[\s\x1c-\x1f]"
BLANK_CHARACTERS = "".join(map(chr, (
    *range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
    0x2028, 0x2029, 0x202f, 0x205f, 0x3000)))
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


def strip_blank(text: Column) -> Column:
    """Drop leading and trailing blanks of every Unicode kind."""
    return F.btrim(text, F.lit(BLANK_CHARACTERS))


def text_lines(text: Column) -> Column:
    """The lines of a text, empty ones too, at every kind of line end."""
    return F.split(text, LINE_END, -1)


def normalize_name(text: Column) -> Column:
    """Field-name form: lower case words joined by single underscores."""
    joined = F.regexp_replace(strip_blank(F.lower(text)), rf"(?U)({BLANK}|-)+", "_")
    kept = F.regexp_replace(joined, "[^a-z0-9_]", "")
    return F.regexp_replace(F.regexp_replace(kept, "_+", "_"), "^_|_$", "")


def normalize_text(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.regexp_replace(strip_blank(F.lower(text)), rf"(?U){BLANK}+", " ")


def strip_fences(text: Column) -> Column:
    """Remove one leading ```lang and one trailing ``` fence; null becomes empty."""
    opened = F.regexp_replace(strip_blank(F.coalesce(text, F.lit(""))), r"\A```[a-zA-Z]*\n?", "")
    return strip_blank(F.regexp_replace(strip_blank(opened), r"\n?```\z", ""))


def parse_number(text: Column) -> Column:
    """A plain decimal literal as double, else null ("5f", "1d" and "" are not numbers)."""
    bare = strip_blank(text)
    named = F.lower(bare)
    return (
        F.when(bare.rlike(_NUMBER), F.regexp_replace(bare, "_", "").try_cast("double"))
        .when(named.rlike(r"^[+-]?(inf|infinity)$"),
              F.when(named.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .when(named.rlike(r"^[+-]?nan$"), F.lit(float("nan")))
    )


def parse_range(text: Column) -> Column:
    """``"lo-hi"`` as struct<lo,hi>; null unless exactly two numbers around one hyphen.

    The separating hyphen follows a digit, so a negative low bound parses.
    """
    parts = F.split(strip_blank(text), r"(?<=[0-9])-")
    low, high = parse_number(F.get(parts, 0)), parse_number(F.get(parts, 1))
    return F.when((F.size(parts) == 2) & low.isNotNull() & high.isNotNull(),
                  F.struct(low.alias("lo"), high.alias("hi")))


def range_midpoint(text: Column) -> Column:
    """Mean of the first two unsigned numbers in the text, or the only one."""
    numbers = F.regexp_extract_all(text, F.lit(r"(\d+\.?\d*)"), 1)
    first, second = F.get(numbers, 0).cast("double"), F.get(numbers, 1).cast("double")
    return F.when(F.size(numbers) >= 2, (first + second) / 2).when(F.size(numbers) == 1, first)


def approx_tokens(text: Column) -> Column:
    """Token estimate: one token per four characters."""
    return F.floor(F.length(text) / 4).cast("long")


def chunk_key(source: Column, name: Column, part: Column, text: Column) -> Column:
    """Stable chunk id over source, name, part number and text."""
    return F.md5(F.concat_ws("::", source, name, part.cast("string"), text).cast("binary"))


def valid_section(token: Column) -> Column:
    """True for ``major.minor`` section numbers: 1-20, 0-30, no zero-padded minor."""
    bare = F.regexp_replace(token, r"\.+$", "")
    major = F.regexp_extract(bare, r"^(\d+)\.(\d+)$", 1).try_cast("long")
    minor_text = F.regexp_extract(bare, r"^(\d+)\.(\d+)$", 2)
    minor = minor_text.try_cast("long")
    return F.coalesce(
        major.between(1, 20) & (minor <= 30) & ~minor_text.rlike(r"^0\d"), F.lit(False)
    )


def is_toc_page(text: Column) -> Column:
    """A contents page: at least 3 lines with leaders and a page number, and over 30 %."""
    lines = F.filter(F.transform(text_lines(text), strip_blank), lambda line: line != "")
    entries = F.filter(
        lines,
        lambda line: line.rlike(r"\.{3,}|\. \. \.") & line.rlike(rf"(?U){BLANK}\d{{1,3}}$"),
    )
    return F.coalesce(
        (F.size(entries) >= 3) & (F.size(entries) / F.greatest(F.size(lines), F.lit(1)) > 0.3),
        F.lit(False),
    )


def name_query(name: Column, *suffixes: str) -> Column:
    """Retrieval query texts for a component or signal name, one per suffix."""
    words = F.regexp_replace(name, "_", " ")
    return F.array(*[F.concat_ws(" ", words, F.lit(s)) if s else words for s in suffixes])
