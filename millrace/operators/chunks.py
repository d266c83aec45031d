"""Text chunks: packing, dedup, tags, audits and idempotent upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import keywords
from millrace.functions.text import BLANK, approx_tokens, chunk_key, strip_blank

# Token limits of a chunk.
MAX_TOKENS, MIN_TOKENS = 2500, 30
REQUIRED = ("framework", "domain", "type", "pattern", "source")


def pack_text(text: Column, max_tokens: int = MAX_TOKENS, delimiter: str = "\n\n") -> Column:
    """Array of parts: paragraphs packed in order while they fit, then hard slices.

    The fold over the paragraphs runs inside the row, in the JVM.
    """
    d = F.lit(delimiter)
    start = F.struct(
        F.array().cast("array<string>").alias("parts"), F.lit("").alias("open"),
        F.lit(0).cast("long").alias("tokens"), F.lit(False).alias("any"))

    def step(acc, paragraph):
        size = approx_tokens(paragraph)
        full = (acc["tokens"] + size > max_tokens) & acc["any"]
        return F.struct(
            F.when(full, F.concat(acc["parts"], F.array(acc["open"])))
            .otherwise(acc["parts"]).alias("parts"),
            F.when(full | ~acc["any"], paragraph)
            .otherwise(F.concat(acc["open"], d, paragraph)).alias("open"),
            F.when(full, size).otherwise(acc["tokens"] + size).alias("tokens"),
            F.lit(True).alias("any"))

    quoted = F.concat(F.lit("\\Q"), d, F.lit("\\E"))
    packed = F.aggregate(
        F.split(text, quoted, -1), start, step,
        lambda acc: F.concat(acc["parts"], F.array(acc["open"])))
    limit = max_tokens * 4
    sliced = F.flatten(F.transform(packed, lambda part: F.when(
        approx_tokens(part) > max_tokens,
        F.transform(F.sequence(F.lit(0), F.length(part) - 1, F.lit(limit)),
                    lambda at: F.substring(part, at + 1, F.lit(limit))),
    ).otherwise(F.array(part))))
    return F.when(approx_tokens(text) <= max_tokens, F.array(text)).otherwise(sliced)


def make_chunks(raw: DataFrame, framework: str, max_tokens: int = MAX_TOKENS,
                min_tokens: int = MIN_TOKENS, delimiter: str = "\n\n") -> DataFrame:
    """Final chunks of ``raw(text, source, chunk_type, name, domain, pattern)``.

    Part numbers count all parts; parts under ``min_tokens`` are dropped afterwards.
    """
    parts = raw.select(
        "source", "name", "chunk_type", "domain", "pattern",
        F.posexplode(pack_text(F.col("text"), max_tokens, delimiter)).alias("part", "text"))
    return (parts.filter(approx_tokens(F.col("text")) >= min_tokens)
            .select(chunk_key(F.col("source"), F.col("name"), F.col("part"), F.col("text"))
                    .alias("chunk_id"),
                    "text", F.lit(framework).alias("framework"), "domain",
                    F.col("chunk_type").alias("type"), "pattern", "source", "name", "part"))


def tag_chunks(raw: DataFrame) -> DataFrame:
    """Adds ``domain`` and ``pattern`` found in text and name."""
    return raw.withColumns({
        "domain": keywords.domain_tag(F.col("text")),
        "pattern": keywords.pattern_tag(F.col("text"), F.col("name"))})


def missing_metadata(chunks: DataFrame) -> DataFrame:
    """(chunk_id, missing): one row per chunk and required key that is absent."""
    return (chunks.select("chunk_id", F.explode(F.array(*[
        F.when(F.col(k).isNull() if k in chunks.columns else F.lit(True), F.lit(k))
        for k in REQUIRED])).alias("missing")).filter("missing is not null"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(kind, value, n): chunks by type and by domain, in one pass."""
    return (chunks.select(F.inline(F.array(
        F.struct(F.lit("type").alias("kind"), F.col("type").alias("value")),
        F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("value")))))
        .groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")))


def normalized_digest(text: Column) -> Column:
    """Digest of the text in lower case with single spaces; null for blank text."""
    norm = F.regexp_replace(F.lower(strip_blank(text)), rf"(?U){BLANK}+", " ")
    return F.when(norm != "", F.sha2(norm, 256))


def dedupe_chunks(chunks: DataFrame, order: str, text: str = "text",
                  scope: tuple[str, ...] = ()) -> DataFrame:
    """First chunk (by the unique ``order``) of each normalized text; blank dropped.

    Only digests are grouped, so a text with very many copies combines before the
    shuffle and full texts are shuffled at most once.
    """
    keyed = chunks.select(*scope, order, normalized_digest(F.col(text)).alias("_digest"))
    first = (keyed.filter("_digest is not null").groupBy(*scope, "_digest")
             .agg(F.min(order).alias(order)).drop("_digest"))
    return chunks.join(first, [*scope, order], "left_semi")


def pending(chunks: DataFrame, indexed: DataFrame) -> DataFrame:
    """Chunks whose id is not indexed yet."""
    return chunks.join(indexed.select("chunk_id"), "chunk_id", "left_anti")


def upsert(indexed: DataFrame, incoming: DataFrame, version: str) -> DataFrame:
    """The collection after writing ``incoming``: one row per id, latest version wins.

    Rows without the required metadata fail the write, as a partial index is worse
    than none. Re-applying the same input changes nothing.
    """
    present = F.lit(True)
    for key in REQUIRED:
        present = present & F.col(key).isNotNull()
    rest = [c for c in incoming.columns if c != "chunk_id"]
    checked = incoming.withColumn("chunk_id", F.when(present, F.col("chunk_id")).otherwise(
        F.raise_error(F.concat(F.lit("chunk without required metadata: "), "chunk_id"))))
    newest = (checked.groupBy("chunk_id")
              .agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
              .select("chunk_id", "_row.*"))
    return indexed.join(newest.select("chunk_id"), "chunk_id", "left_anti").unionByName(newest)

