"""Chat formatting: every participant's view of a dialogue, with masks of what to learn.

For each speaker of a conversation the turns are rendered with that speaker as assistant and
all others as users by name. Turns are dealt out by their order, cut anywhere; counts and
lengths per (range, conversation) carry positions across the cuts, so a conversation may be of
any length. A view comes in blocks of ``BLOCK`` turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import reliable_checkpoint, shuffle_width

BLOCK = 64
SYSTEM, ASSISTANT, USER = "system", "assistant", "user"
END = "<|end|>\n"


def header(role: Column, viewer: Column) -> Column:
    return F.when(role == SYSTEM, F.lit(f"<|{SYSTEM}|>\n")).when(role == viewer, F.lit(f"<|{ASSISTANT}|>\n")) \
        .otherwise(F.concat(F.lit(f"<|{USER} name="), role, F.lit("|>\n")))


def placed_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, pid (range of the global order), seq (order in it)."""
    order = ["conv_id", "turn", "role", "digest", "text"]
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"))
    once = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies")) \
        .withColumn("digest", F.xxhash64("text"))
    ranged = once.repartitionByRange(shuffle_width(conversations.sparkSession), *order).sortWithinPartitions(*order)
    return reliable_checkpoint(ranged.withColumn("seq", F.monotonically_increasing_id())
                               .withColumn("pid", F.shiftright("seq", 33).cast("int")))


def views(conversations: DataFrame) -> DataFrame:
    """One row per (conversation, viewer, turn): conv_id, viewer, position, turn, speaker, segment,
    begin, mask_begin, mask_end (offsets in the view, in code points), learned, copies.

    A turn whose speaker is the viewer is learned: its text and end mark, not its header. The
    system is nobody's viewer; a null role speaks as "unknown"; a null text is empty; turns are
    ordered by turn (null first), then role and text; an exactly repeated turn is one with its
    ``copies``; rows of null conv_id are one conversation; one without speakers has no views.
    """
    turns = placed_turns(conversations).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    viewers = turns.where(F.col("role") != SYSTEM).groupBy("key", F.col("role").alias("viewer")).agg(
        F.count(F.lit(1)).alias("said"))
    seen = turns.join(viewers.drop("said"), "key").withColumn("head", header(F.col("role"), F.col("viewer")))
    seen = seen.withColumn("length", F.length("head") + F.length("text") + len(END))
    by_range = ["key", "viewer", "pid"]
    sums = seen.groupBy(*by_range).agg(F.count(F.lit(1)).alias("turns"), F.sum("length").alias("chars"))
    earlier = Window.partitionBy("key", "viewer").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by_range, F.coalesce(F.sum("turns").over(earlier), F.lit(0)).alias("turns_before"),
                          F.coalesce(F.sum("chars").over(earlier), F.lit(0)).alias("chars_before"))
    inside = Window.partitionBy(*by_range).orderBy("seq")
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    at = seen.withColumn("position", F.row_number().over(inside) - 1) \
        .withColumn("begin", F.sum("length").over(so_far) - F.col("length")).join(offsets, by_range) \
        .withColumn("position", F.col("position") + F.col("turns_before")) \
        .withColumn("begin", F.col("begin") + F.col("chars_before"))
    learned = F.col("role") == F.col("viewer")
    return at.select(
        "conv_id", "viewer", "position", "turn", F.col("role").alias("speaker"),
        F.concat("head", "text", F.lit(END)).alias("segment"), "begin",
        (F.col("begin") + F.length("head")).alias("mask_begin"),
        (F.col("begin") + F.col("length") - 1).alias("mask_end"), learned.alias("learned"), "copies")


def dialogues(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per (conversation, viewer, block of ``block`` turns): conv_id, viewer, block, turns,
    begin, text, masks ("from:to" of what to learn, in code points of the whole view, joined)."""
    rows = views(conversations).withColumn("block", F.floor(F.col("position") / block))
    turns = F.array_sort(F.collect_list(F.struct("position", "begin", "segment", "mask_begin", "mask_end", "learned")))
    grouped = rows.groupBy("conv_id", "viewer", "block").agg(turns.alias("turns"))
    masks = F.transform(F.filter("turns", lambda t: t["learned"]),
                        lambda t: F.concat_ws(":", t["mask_begin"], t["mask_end"]))
    return grouped.select(
        "conv_id", "viewer", "block", F.size("turns").alias("n_turns"), F.col("turns")[0]["begin"].alias("begin"),
        F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"),
        F.array_join(masks, ",").alias("masks"))


#: DuckDB SQL for ``dialogues`` of the table ``conversations``.
SQL = f"""
WITH once AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations GROUP BY ALL),
viewers AS (SELECT DISTINCT conv_id, role AS viewer FROM once WHERE role <> '{SYSTEM}'),
seen AS (SELECT o.*, v.viewer, CASE WHEN role = '{SYSTEM}' THEN '<|{SYSTEM}|>' || chr(10)
    WHEN role = viewer THEN '<|{ASSISTANT}|>' || chr(10)
    ELSE '<|{USER} name=' || role || '|>' || chr(10) END AS head
  FROM once o JOIN viewers v ON o.conv_id IS NOT DISTINCT FROM v.conv_id),
placed AS (SELECT *, length(head) + length(text) + {len(END)} AS n, row_number() OVER w - 1 AS position,
    sum(length(head) + length(text) + {len(END)}) OVER w - length(head) - length(text) - {len(END)} AS off
  FROM seen WINDOW w AS (PARTITION BY conv_id, viewer ORDER BY turn NULLS FIRST, role, text
    ROWS UNBOUNDED PRECEDING))
SELECT conv_id, viewer, CAST(position // {BLOCK} AS BIGINT) AS block, CAST(count(*) AS INTEGER) AS n_turns,
  CAST(min(off) AS BIGINT) AS "begin", string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY position) AS text,
  coalesce(string_agg(CASE WHEN role = viewer THEN CAST(off + length(head) AS BIGINT) || ':' || CAST(off + n - 1 AS BIGINT) END,
    ',' ORDER BY position), '') AS masks
FROM placed GROUP BY conv_id, viewer, position // {BLOCK}
"""
