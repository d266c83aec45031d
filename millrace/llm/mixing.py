"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot n of the mix belongs to the source in whose interval of cumulative weights the point
frac(n * golden ratio) falls, so every stretch of the mix holds the sources in proportion. The
k-th slot of a source takes its block k: a run of equally many words of the source's documents in
shuffled order, which begin again past their end. The last block ends where the source's target
is reached, so slots decide the order, not how much of a source is taken.

Sizes are summed per (source, bucket of the shuffle key) before positions are given out, so no
task holds a source: what one task orders is a bucket of narrow rows, 1/4096 of a source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh, text_or_empty
from millrace.session import reliable_checkpoint

GOLDEN = 0.6180339887498949
SLOTS = 1 << 16
CELLS = 1024
MOST_USES = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def shuffle_key() -> Column:
    return F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """Narrow rows: doc_id, source, sk (the source as a key that is never null), size, key, bucket, h."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("sk"),
        word_count(text_or_empty()).alias("size"), shuffle_key().alias("key"), F.xxhash64(text_or_empty()).alias("h")) \
        .withColumn("bucket", F.substring("key", 1, 3))


def source_targets(sizes: DataFrame) -> DataFrame:
    """sk, source, source_size, weight, target of one row per source (sk, source, source_size).

    Weights 1, 2, 3 repeat by code point, null last. Sources are filled to a common level of
    words per weight, and stop at ``MOST_USES`` times their size: with the sources ordered by
    the level where they stop, the level is that of the first source that isn't full at it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_stop = Window.orderBy("stop", "weight", F.col("source").asc_nulls_last())
    earlier = by_stop.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("weight", 1 + (F.row_number().over(by_name) - 1) % 3) \
        .withColumn("cap", MOST_USES * F.col("source_size")).withColumn("stop", F.col("cap") / F.col("weight"))
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(earlier), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(earlier), F.lit(0)))
    at = ranked.withColumn("place", F.row_number().over(by_stop)).withColumn("level", level)
    first = F.min(F.when(F.col("stop") >= F.col("level"), F.struct("place", "level"))).over(whole)
    return at.withColumn("first", first).select(
        "sk", "source", "source_size", "weight",
        F.when(F.col("place") < F.col("first.place"), F.col("cap").cast("double"))
        .otherwise(F.col("first.level") * F.col("weight")).alias("target"))


def whole_targets(targets: DataFrame) -> DataFrame:
    """``targets`` with ``words``: targets in whole words, each less than a word off and together as
    many as the tables have."""
    before = Window.orderBy(F.col("source").asc_nulls_last())
    high = F.floor(F.round(F.sum("target").over(before.rowsBetween(Window.unboundedPreceding, 0)), 3) + 0.5)
    return targets.withColumn("to", high).withColumn(
        "words", F.least(F.col("to") - F.coalesce(F.lag("to").over(before), F.lit(0)), MOST_USES * F.col("source_size"))).drop("to")


def schedule(targets: DataFrame, total: int, block: int) -> DataFrame:
    """sk, turn, slot: the places of a source's blocks in the mix, its last and shorter one
    included. The mix is in order of slot, sk, turn.

    Points that fall to a source beyond its last block stay unused. A source that meets too few
    points, as one of less than a block may, has its other blocks spread evenly, half a slot on.
    """
    before = Window.orderBy(F.col("source").asc_nulls_last())
    count = math.ceil(total / block)
    high = F.sum("target").over(before.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(float(max(total, 1)))
    bounds = targets.withColumn("high", high).withColumn("low", F.coalesce(F.lag("high").over(before), F.lit(0.0))) \
        .withColumn("high", F.when(F.lead("sk").over(before).isNull(), 2.0).otherwise(F.col("high"))) \
        .withColumn("blocks", F.ceil(F.col("words") / block)).where("blocks > 0")
    cells = bounds.select("sk", "low", "high", "blocks", F.explode(F.sequence(
        F.floor(F.col("low") * CELLS), F.floor(F.least("high", F.lit(0.9999999)) * CELLS))).alias("cell"))
    point = F.col("id") * F.lit(GOLDEN) - F.floor(F.col("id") * F.lit(GOLDEN))
    slots = targets.sparkSession.range(count).withColumn("x", point).withColumn("cell", F.floor(F.col("x") * CELLS))
    placed = slots.join(cells, "cell").where("low <= x and x < high")
    ranked = placed.withColumn("turn", (F.row_number().over(Window.partitionBy("sk").orderBy("id")) - 1).cast("long")) \
        .where(F.col("turn") < F.col("blocks")).select("sk", "turn", F.col("id").cast("double").alias("slot"))
    ranked = reliable_checkpoint(ranked)
    met = ranked.groupBy("sk").agg(F.count(F.lit(1)).alias("met"))
    rest = bounds.select("sk", "blocks").join(met, "sk", "left").withColumn("met", F.coalesce("met", F.lit(0).cast("long"))) \
        .where("met < blocks").select("sk", "blocks", F.explode(F.sequence("met", F.col("blocks") - 1)).alias("turn"))
    return ranked.union(rest.select(
        "sk", "turn", F.floor((F.col("turn") + 0.5) * count / F.col("blocks")).cast("double") + 0.5))


def mix(docs: DataFrame, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(documents, pieces). ``documents``: one narrow row per row of ``docs`` with sk, bucket, rn
    (together its key), doc_id, source, size, source_size, target, h. ``pieces``: the mix itself,
    the words [first, last) of a document that a slot takes: sk, bucket, rn, slot, turn, use
    (passes over the source before), first, last.

    The mix has about ``slots`` slots of equally many words, which fix its order only: a source
    gives its target to the word, however large a slot is. A null text has size 0, a null source
    is a source of its own, rows that agree in doc_id are ordered by size and text, equal rows are
    documents of their own. An empty table, or one without words, has no pieces.
    """
    rows = reliable_checkpoint(sized(docs))
    buckets = rows.groupBy("sk", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source"))
    sizes = reliable_checkpoint(buckets.groupBy("sk").agg(F.first("source").alias("source"),
                                                          F.sum("bucket_size").alias("source_size")))
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    block = max(1, -(-total // slots))
    targets = reliable_checkpoint(whole_targets(source_targets(sizes)))
    begins = Window.partitionBy("sk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("sk", "bucket", F.coalesce(F.sum("bucket_size").over(begins), F.lit(0)).alias("offset")) \
        .join(targets.select("sk", "source_size", "target", "words"), "sk")
    inside = Window.partitionBy("sk", "bucket").orderBy("key", "doc_id", "size", "h")
    placed = rows.withColumn("rn", F.row_number().over(inside)) \
        .withColumn("begin", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")) \
        .join(offsets, ["sk", "bucket"]).withColumn("begin", F.col("begin") + F.col("offset"))
    documents = placed.select("sk", "bucket", "rn", "doc_id", "source", "size", "source_size", "target", "h", "begin")
    passes = placed.where("size > 0").select(
        "sk", "bucket", "rn", "begin", "size", "source_size", "words", F.explode(F.sequence(F.lit(0), F.lit(MOST_USES - 1))).alias("use")) \
        .withColumn("start", F.col("use") * F.col("source_size") + F.col("begin")) \
        .withColumn("end", F.least(F.col("start") + F.col("size"), F.col("words"))).where("start < end")
    cut = passes.select("sk", "bucket", "rn", "use", "start", "end", F.explode(F.sequence(
        F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))).alias("turn"))
    pieces = cut.join(schedule(targets, total, block), ["sk", "turn"]).select(
        "sk", "bucket", "rn", "slot", "turn", "use",
        (F.greatest(F.col("start"), F.col("turn") * block) - F.col("start")).alias("first"),
        (F.least(F.col("end"), (F.col("turn") + 1) * block) - F.col("start")).alias("last"))
    return documents, pieces


def taken_words(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (words the mix takes), h per row."""
    documents, pieces = mix(docs, slots)
    key = ["sk", "bucket", "rn"]
    taken = pieces.groupBy(*key).agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    return documents.join(taken, key, "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "h")


def mixed_documents(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """The documents of the mix with the columns of ``docs``, each as many times as the mix takes
    its words (rounded, half up); a document without words weighs nothing and stays once. Rows
    that agree in doc_id, source and text share what the mix takes of them."""
    names = {c: fresh(docs, c) for c in ("text_hash", "taken_id", "taken_hash", "source_key", "taken_key", "copies", "copy")}
    times = F.floor(F.sum("taken") / F.greatest(F.sum("size"), F.lit(1)) + 0.5)
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))
    copies = taken_words(docs, slots).groupBy("doc_id", source.alias("k"), "h").agg(
        F.when(F.sum("size") == 0, F.lit(1)).otherwise(times).cast("int").alias("n")).where("n > 0") \
        .select(F.col("doc_id").alias(names["taken_id"]), F.col("k").alias(names["taken_key"]),
                F.col("h").alias(names["taken_hash"]), F.col("n").alias(names["copies"]))
    rows = docs.withColumn(names["text_hash"], F.xxhash64(text_or_empty())).withColumn(names["source_key"], source)
    same = (F.col(names["text_hash"]) == F.col(names["taken_hash"])) & (
        F.col(names["source_key"]) == F.col(names["taken_key"])) & F.col("doc_id").eqNullSafe(F.col(names["taken_id"]))
    return rows.join(copies, same).withColumn(names["copy"], F.explode(F.sequence(F.lit(1), F.col(names["copies"])))) \
        .select(*docs.columns)
