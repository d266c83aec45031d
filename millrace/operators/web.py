"""Raw chunks from HTML pages and RST guides."""

from __future__ import annotations

import re
from html.entities import html5
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import keywords
from millrace.functions.text import LINE_END, strip_blank

# Where a page keeps its main text (first match wins), what is noise
# otherwise, and the size limits of sections.
MAIN_PLACES = (("article", "role", "main"), ("div", "class", "body"), ("main", None, None),
               ("div", "id", "main-content"))
NOISE_TAGS = frozenset(("nav", "header", "footer", "script", "style"))
HIDDEN_TAGS = frozenset(("script", "style", "template"))
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SECTION_MIN_CHARS, HEADER_MAX_CHARS = 100, 80
RST_MIN_CHARS = 50


class _PageText(HTMLParser):
    """Text nodes of a page, kept once per main place and once for the noise-free body."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.data = [], []
        self.found = [None] * len(MAIN_PLACES)  # lines of the first match of each place
        self.body = []

    def _flush(self):
        text = "".join(self.data).strip()
        self.data = []
        if not text or any(tag in HIDDEN_TAGS for tag, _ in self.open):
            return
        for place in {p for _, places in self.open for p in places}:
            self.found[place].append(text)
        if not any(tag in NOISE_TAGS for tag, _ in self.open):
            self.body.append(text)

    def handle_starttag(self, tag, attrs):
        self._flush()
        attrs, places = dict(attrs), []
        for i, (name, key, value) in enumerate(MAIN_PLACES):
            given = attrs.get(key) or ""
            hit = key is None or (value in given.split() if key == "class" else given == value)
            if tag == name and hit and self.found[i] is None:
                self.found[i] = []
                places.append(i)
        if tag not in VOID_TAGS:
            self.open.append((tag, places))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                return

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self._flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def content(self, html: str) -> str:
        self.feed(html)
        self.close()
        self._flush()
        lines = next((f for f in self.found if f is not None), self.body)
        return "\n".join(lines)


_AMPERSAND = re.compile(r"&(?!#(?:[0-9]+|[xX][0-9a-fA-F]+);)([A-Za-z][A-Za-z0-9]*;)?")


def _ended_references(html: str) -> str:
    """The page with every ``&`` escaped that opens no reference ending in a semicolon."""
    return _AMPERSAND.sub(lambda m: m[0] if m[1] in html5 else f"&amp;{m[1] or ''}", html)


def main_content(pages: DataFrame, html: str = "html", bare_references: bool = True) -> DataFrame:
    """Replaces the HTML column by ``content``: the main text, one line per text node. With
    ``bare_references`` old names such as ``&amp`` count without a semicolon too, as in browsers;
    else they stay as text, as where a title was cut in the middle of a reference."""
    kept = [f for f in pages.schema.fields if f.name != html]
    schema = T.StructType([*kept, T.StructField("content", T.StringType())])

    def parse(batches):
        for pdf in batches:
            texts = [_PageText().content(h if bare_references else _ended_references(h)) if h else "" for h in pdf[html]]
            yield pdf.drop(columns=[html]).assign(content=texts)

    return pages.mapInPandas(parse, schema)


# A line that opens a section: short, not all in capitals, no opening bracket first.
_OPENING = (rf"(?U)(?=[^\S\n]*[^\s\x1c-\x1f(](?:[^\n]{{0,{HEADER_MAX_CHARS - 3}}}[^\s\x1c-\x1f])?[^\S\n]*(?:\n|\z))"
            r"(?:(?=[^\n]*[\p{IsLowercase}\p{Lt}])|(?![^\n]*\p{IsUppercase}))")


def guide_sections(text: Column) -> Column:
    """Sections that open at header-like lines; runs of 100 characters or less are lost."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), LINE_END, "\n")
    runs = F.transform(F.split(plain, rf"\n(?={_OPENING})", -1), strip_blank)
    return F.filter(runs, lambda run: F.length(run) > SECTION_MIN_CHARS)


def page_chunks(content: DataFrame) -> DataFrame:
    """Raw chunks of ``content(source, name, chunk_type, content)``: an api page stays
    whole, a guide gives one chunk per section. Tags come from each chunk's own text."""
    api = F.col("chunk_type") == "api"
    parts = F.when(api, F.array("content")).otherwise(guide_sections(F.col("content")))
    exploded = content.select("source", "chunk_type", F.col("name").alias("page_name"),
                              F.posexplode(parts).alias("section", "text"))
    return exploded.select(
        "source", F.when(api, "api").otherwise("guide").alias("chunk_type"),
        F.when(api, F.col("page_name")).otherwise(
            F.concat("page_name", F.lit("_section_"), F.col("section").cast("string"))).alias("name"),
        "text", keywords.domain_tag(F.col("text")).alias("domain"),
        keywords.pattern_tag(F.col("text"), F.col("page_name")).alias("pattern"))


def rst_chunks(files: DataFrame) -> DataFrame:
    """One raw chunk per underlined section of ``files(source, stem, text)``."""
    pieces = F.split("text", "\n(?=[^\n]+\n[=\\-~]{3,}\n)", -1)
    exploded = files.select("source", "stem", F.posexplode(pieces).alias("section", "piece"))
    body = strip_blank(F.col("piece"))
    return (exploded.withColumn("text", body).filter(F.length("text") >= RST_MIN_CHARS)
            .select("source", F.lit("guide").alias("chunk_type"),
                    F.concat("stem", F.lit("_section_"), F.col("section").cast("string")).alias("name"),
                    "text", keywords.domain_tag(F.col("piece")).alias("domain"),
                    keywords.pattern_tag(F.col("piece"), F.col("stem")).alias("pattern")))
