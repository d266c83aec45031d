"""SimHash near-duplicates: 64-bit fingerprints searched in BK-trees.

Two fingerprints within ``radius`` bits agree on at least ``blocks - radius`` of ``blocks``
bit blocks, whichever bits differ. Every choice of that many blocks is a table; fingerprints
that agree there meet in one shard, and a BK-tree per shard finds the links. A shard beyond
``shard_rows`` fingerprints is cut into trees of that size, and each tree is sent to every
query block of its shard, so no task holds an unbounded shard and no link is lost.
"""

from __future__ import annotations

import math
import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh, map_groups, text_or_empty
from millrace.llm.components import connected_components
from millrace.session import reliable_checkpoint

SEED = 42
SHARD_ROWS = 1024
CHUNK = 1 << 16


def shingle_hashes(data: bytes, shingle: int) -> np.ndarray:
    """Hashes of one UTF-8 text's shingles, repeats included; none if it has no words."""
    import xxhash

    words = data.lower().split()  # on bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    flat, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    spans = zip((ends - lengths)[:len(words) - shingle + 1].tolist(), ends[shingle - 1:].tolist())
    return np.fromiter((digest(flat[s:e], SEED) for s, e in spans), np.uint64, len(words) - shingle + 1)


def text_fingerprint(data: bytes, shingle: int = 4) -> int:
    """Signed 64-bit fingerprint of one UTF-8 text; 0 if it has no words."""
    return _majority(shingle_hashes(data, shingle))


def _majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i:i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def two_fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, h, fp as `fingerprints` gives them, and fp2, a fingerprint of the same shingles under another hash."""
    def run(batches):
        for batch in batches:
            pairs = []
            for data in batch.column(1).to_pylist():
                hashes = shingle_hashes(data, shingle)
                other = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                pairs.append((_majority(hashes), _majority(other ^ (other >> np.uint64(32)))))
            first, second = zip(*pairs) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(first, pa.int64()), pa.array(second, pa.int64())],
                                             ["doc_id", "h", "fp", "fp2"])

    return _hashed_texts(docs).mapInArrow(run, "doc_id long, h long, fp long, fp2 long")


def _hashed_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       text_or_empty().cast("binary").alias("data"), F.xxhash64(text_or_empty()).alias("h"))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, h (hash of the text), fp (signed long) per row of ``docs``; a null text is empty."""
    def run(batches):
        for batch in batches:
            values = [text_fingerprint(v, shingle) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(values, pa.int64())], ["doc_id", "h", "fp"])

    return _hashed_texts(docs).mapInArrow(run, "doc_id long, h long, fp long")


def table_masks(blocks: int, radius: int) -> list[int]:
    """Signed 64-bit masks, one per choice of ``blocks - radius`` blocks."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(rows: int, radius: int) -> int:
    """Blocks that leave some tens of unrelated fingerprints in a shard; links don't depend on it."""
    blocks = radius + 1
    while blocks < radius + 4 and rows / 2 ** (64 * (blocks - radius) / blocks) > 64:
        blocks += 1
    return blocks


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        new, at = len(self.values) - 1, 0
        while new:
            distance = (value ^ self.values[at]).bit_count()
            child = self.children[at].get(distance)
            if child is None:
                self.children[at][distance] = new
                break
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        found, todo = [], [0] if self.values else []
        values, children = self.values, self.children
        while todo:
            at = todo.pop()
            distance = (value ^ values[at]).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, child in children[at].items():
                if -radius <= edge - distance <= radius:
                    todo.append(child)
        return found


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def shard_links(tree_side: list[int], query_side: list[int] | None, radius: int,
                second: list[int] | None = None, both: int = 128) -> list[tuple[int, int]]:
    """Links that join a shard's components: all within ``tree_side``, or those of
    ``query_side`` with it. At most one link fewer than there are fingerprints. With ``second``
    fingerprints, of tree side then query side, the two distances together are at most ``both``."""
    tree, links = BKTree(), []
    values = tree_side if query_side is None else tree_side + query_side
    parent = list(range(len(values)))
    if query_side is not None:
        for value in tree_side:
            tree.add(value)
    for i in range(0 if query_side is None else len(tree_side), len(values)):
        met = [((values[i] ^ values[j]).bit_count(), j) for j in tree.within(values[i], radius)]
        if second is not None:
            met = [(d, j) for d, j in met if d + (second[i] ^ second[j]).bit_count() <= both]
        for _, j in sorted(met):
            a, b = _find(parent, i), _find(parent, j)
            if a != b:
                parent[a] = b
                links.append((values[i], values[j]))
        if query_side is None:
            tree.add(values[i])
    return links


def fingerprint_links(distinct: DataFrame, radius: int = 4, shard_rows: int = SHARD_ROWS,
                      masks: list[int] | None = None, both: int | None = None) -> DataFrame:
    """Links (a, b) that connect every pair of ``distinct`` (fp) within ``radius`` bits, or with
    ``masks`` of a caller every such pair that agrees on one of them; with ``both`` only pairs whose
    distance and that of their second fingerprints (fp2) together are at most that."""
    masks = masks or table_masks(blocks_for(distinct.count(), radius), radius)
    more = [] if both is None else ["fp2"]
    keyed = distinct.select("fp", *more, F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks]))
                            .alias("t", "k"))
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    cut = keyed.join(sizes, ["t", "k"]).withColumn("parts", F.ceil(F.col("n") / shard_rows).cast("int")) \
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sent = cut.select("t", "k", "fp", *more, "part", other.alias("o")).select(
        "t", "k", F.least("part", "o").alias("i"), F.greatest("part", "o").alias("j"), "part", "fp", *more)

    def run(table, bounds):
        fps, *others = ((table.column(c).to_numpy().view(np.uint64)).tolist() for c in ("fp", *more))
        parts, first, second = (table.column(c).to_pylist() for c in ("part", "i", "j"))
        links = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            tree = [n for n in range(s, e) if parts[n] == first[s]]
            query = [] if first[s] == second[s] else [n for n in range(s, e) if parts[n] != first[s]]
            also = [others[0][n] for n in tree + query] if others else None
            links += shard_links([fps[n] for n in tree], [fps[n] for n in query] if query else None, radius, also, both or 128)
        pairs = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return map_groups(sent, ["t", "k", "i", "j"], run, "a long, b long")


def _members(marked: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """fp, root (one fingerprint of its component), component_id per distinct fingerprint."""
    classes = reliable_checkpoint(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(classes.select("fp"), radius, shard_rows))
    rooted = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(heads, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable) per row.

    Null and empty texts have fingerprint zero and link like any other; a text shorter than
    a shingle is one shingle; repeated rows give repeated results; a component of null ids
    alone has a null id; an empty table gives no rows; other columns are not looked at.
    """
    marked = reliable_checkpoint(fingerprints(docs, shingle))
    return marked.join(_members(marked, radius, shard_rows).drop("root"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def wide_radius(least: float, bits: int = 64) -> int:
    """Bits by which 98 in 100 pairs of texts at that Jaccard index differ at most: a bit differs with the
    chance of the angle between their shingle counts."""
    chance = math.acos(2 * least / (1 + least)) / math.pi
    return math.ceil(bits * chance + 2.05 * math.sqrt(bits * chance * (1 - chance)))


def wide_masks(rows: int, least: float, missed: float = 0.05) -> list[int]:
    """Masks of random bits, enough of them that a pair at Jaccard index ``least`` agrees on one but
    for a share ``missed``. Bits grow with the rows, so a shard holds some tens of unrelated rows."""
    chance = math.acos(2 * least / (1 + least)) / math.pi
    bits = max(8, math.ceil(math.log2(max(rows, 1) / 64)))
    differ = [math.comb(64, x) * chance ** x * (1 - chance) ** (64 - x) for x in range(65 - bits)]
    agree = [math.comb(64 - x, bits) / math.comb(64, bits) for x in range(65 - bits)]
    tables = 1
    while 1 - sum(p * (1 - (1 - a) ** tables) for p, a in zip(differ, agree)) > missed:
        tables += 1 + tables // 32
    rng = random.Random(SEED)
    masks = [sum(1 << b for b in rng.sample(range(64), bits)) for _ in range(tables)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """fp, shingles (distinct hashes, array of long) per row of ``docs`` (fp, text)."""
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                some = batch.slice(i, 256)
                sets = [np.unique(shingle_hashes(data, shingle)).view(np.int64) for data in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], ["fp", "shingles"])

    return docs.select("fp", text_or_empty().cast("binary").alias("data")).mapInArrow(run, "fp long, shingles array<long>")


def similar_links(docs: DataFrame, heads: DataFrame, least: float, shingle: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between rows of ``heads`` (fp, fp2, doc_id, h: one document each) whose texts in
    ``docs`` share at least ``least`` of their distinct shingles. Fingerprints propose, in tables of
    random bits and with a wide radius, at which two of them keep unrelated texts apart; the
    shingles themselves decide."""
    proposed = reliable_checkpoint(fingerprint_links(
        heads.select("fp", "fp2"), wide_radius(least), shard_rows, wide_masks(heads.count(), least),
        wide_radius(least, 128)).distinct())
    ends = proposed.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    wanted = heads.join(ends, "fp").select("fp", F.col("doc_id").alias("head_id"), F.col("h").alias("head_hash"))
    rows = docs.select("doc_id", "text", F.xxhash64(text_or_empty()).alias("h"))
    texts = rows.join(wanted, rows["doc_id"].eqNullSafe(F.col("head_id")) & (rows["h"] == F.col("head_hash"))) \
        .select("fp", "text").dropDuplicates(["fp"])
    sets = reliable_checkpoint(shingle_sets(texts, shingle))
    a = sets.select(F.col("fp").alias("a"), F.col("shingles").alias("of_a"))
    b = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("of_b"))
    shared = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - shared
    return proposed.join(a, "a").join(b, "b").where(shared >= least * either).select("a", "b")


def keep_first(docs: DataFrame, radius: int = 4, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One document of each group of near duplicates, with the columns of ``docs``: the one of
    the least doc_id (null last), ties to the text of the least hash. Equal rows count once.

    Documents whose fingerprints are within ``radius`` bits are one class; classes whose first
    documents share at least ``least`` of their distinct shingles are one group. Fingerprints may
    miss some pairs near ``least`` (`wide_masks`, `wide_radius`: 7 in 100 at the very limit), links
    found are exact. Null and empty texts are equal texts; an empty table gives no rows.

    The decision travels as (doc_id, text hash), so the texts move once and by a skew-proof join.
    """
    hashed, chosen, wanted_id = (fresh(docs, c) for c in ("text_hash", "chosen_hash", "chosen_id"))
    rows = docs.withColumn(hashed, F.xxhash64(text_or_empty()))
    marked = reliable_checkpoint(two_fingerprints(docs, shingle))
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    near = reliable_checkpoint(_members(marked, radius, SHARD_ROWS).select("fp", "root"))
    # the first document of a class stands for it, under its own fingerprint
    firsts = reliable_checkpoint(marked.join(near, "fp").withColumn("first", F.struct(place.alias("p"), "fp", "fp2")).groupBy("root").agg(
        F.min("first").alias("best")).select("best.fp", "best.fp2", F.col("best.p.doc_id").alias("doc_id"), F.col("best.p.h").alias("h")))
    groups = connected_components(similar_links(docs, firsts, least, shingle))
    best = firsts.join(groups.withColumnRenamed("node", "fp"), "fp", "left").groupBy(
        F.coalesce("root", "fp").alias("group")).agg(F.min(place).alias("best"))
    wanted = best.select(F.col("best.doc_id").alias(wanted_id), F.col("best.h").alias(chosen))
    once = rows.dropDuplicates(["doc_id", hashed])
    return once.join(wanted, F.col("doc_id").eqNullSafe(F.col(wanted_id)) & (F.col(hashed) == F.col(chosen)),
                     "left_semi").drop(hashed)
