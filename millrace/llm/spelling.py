"""Spelling variants: words one edit apart, joined on asymmetric chunks.

Of two words one contributes its two disjoint chunks, its halves, and the other its positional
grams of the same lengths. One edit leaves a half as it was, and that half stands in the other
word at its own place or, if the edit lies before it, shifted by the difference in length, which
is one at most. So the words meet on (length, which half, its letters), and only grams at
that place can meet a chunk.

Half a short word is a weak key: three letters open some thousand words. What the kept half
leaves of both words is again one edit apart, so the rule is applied to it once more, and the key
is the half and a half of the rest. Pairs that meet are verified by their edit distance in
the join itself.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column_parts, slices, text_or_empty
from millrace.session import reliable_checkpoint

RUN = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT = 7, 2
DROP_EVERY = 31
FORM_FACTOR = 10
HELD_WORDS = 400_000
PART_CHARS = 2_000_000


def text_words(text: str, doc_id: int | None, least: int = LEAST_LENGTH) -> Counter:
    """Occurrences of the words of one text (A-Z already lower-cased) with at least ``least`` letters.

    A word whose crc32 of ``<doc_id>:<word>`` is a multiple of 31 loses the letter at crc32 mod length.
    """
    run, gap, found = re.compile(f"[{RUN}]{{{least},}}"), re.compile(f"[^{RUN}]"), Counter()
    for part in slices(text, gap):
        found.update(run.findall(part))
    start, words = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()), Counter()
    for word, n in found.items():
        h = zlib.crc32(word.encode(), start)
        if h % DROP_EVERY == 0:
            word = word[:h % len(word)] + word[h % len(word) + 1:]
        if len(word) >= least:
            words[word] += n
    return words


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """word, n (occurrences in all texts). Tasks add up what they hold before the shuffle and let go
    of it whenever it exceeds ``HELD_WORDS`` words, so a frequent word is a few rows a task."""
    def counted(words: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            ids, at = batch.column(0).to_pylist(), 0
            for texts in column_parts(batch.column(1), PART_CHARS):
                for data in texts:
                    held.update(text_words(data.lower().decode("utf-8", "replace"), ids[at], least))  # lower() of bytes: A-Z only
                    at += 1
                    if len(held) > HELD_WORDS:
                        yield counted(held)
                        held.clear()
        yield counted(held)

    rows = docs.select(F.col("doc_id"), text_or_empty().cast("binary").alias("data"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _rests(length: Column) -> list[tuple[Column, Column]]:
    """(from, to) of the part that a key leaves out: the second and first half of either half. The
    other half is the kept chunk, the rest of this half the chunk kept of what is left."""
    half = F.floor(length / 2)
    first, second = F.floor(half / 2), half + F.floor((length - half) / 2)
    cuts = [F.lit(0), first, half, second, length]
    return [(a.cast("int"), b.cast("int")) for a, b in zip(cuts, cuts[1:])]


def _keys(word: Column, own: Column, length: Column) -> Column:
    """Keys under which a word of length ``own`` meets chunks of words of ``length`` letters: the
    grams that stand where those chunks would, counted from the nearer side of the edit."""
    return F.array(*[F.xxhash64(length, F.lit(k), F.substring(word, F.lit(1), a),
                                F.substring(word, own - (length - b) + 1, length - b))
                     for k, (a, b) in enumerate(_rests(length))])


def near_pairs(words: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: every pair of ``words`` (word, n; distinct) exactly one inserted, deleted or
    replaced letter apart, once. ``a`` is the shorter one, of equal ones the smaller."""
    length = F.length("word")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.explode(_keys(F.col("word"), length, length)).alias("key"))
    grams = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.explode(
        F.concat(_keys(F.col("word"), length, length), _keys(F.col("word"), length, length - 1))).alias("key"))
    ordered = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))
    met = chunks.join(grams, (chunks.key == grams.key) & ordered & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of ``forms`` (word, form) by doubling: forms grow tenfold a step, so a chain has
    at most 19 steps and a few rounds end it."""
    now = reliable_checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = reliable_checkpoint(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                         F.col("next").isNotNull().alias("moved")))
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """word, n, n_near (words one edit away), form (the near word of largest n, ties to the smallest,
    if that n is at least ten times the word's), form_n, root (the last of the forms that follow).

    Words are runs of letters up to U+00FF of whole texts, with at least ``least`` letters and two
    occurrences. Null and empty texts have none; a null doc_id hashes as an empty one; repeated
    rows count again; an empty table gives no rows; other columns are not looked at.
    """
    words = reliable_checkpoint(word_counts(docs, least).where(F.col("n") >= LEAST_COUNT))
    pairs = reliable_checkpoint(near_pairs(words))
    near = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("b_n").alias("other_n")).union(
        pairs.select("b", "a", "a_n"))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    large = -F.col("best.less") >= FORM_FACTOR * F.col("n")
    rows = reliable_checkpoint(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(large, F.col("best.other")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n")))
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
