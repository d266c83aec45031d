"""Embedding near-duplicates: sign hashing in several tables, exact cosines, components.

Tables grow in bits with the number of vectors, so that a bucket of unrelated vectors stays
small, and in number with the bits, so that a pair at the threshold meets in one of them but
for a chance of ``MISSED``. Buckets are cut into blocks; pairs of blocks are compared as matrix
products. A pair counts in the first table where it meets. Only counts and as many links as
connect a block leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_groups
from millrace.llm.components import connected_components
from millrace.llm.vectors import by_dimension, classes, keyed, planes, unit, usable
from millrace.session import reliable_checkpoint

BLOCK, MISSED, SEED = 512, 5e-4, 17


def hash_shape(rows: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) for so many vectors."""
    bits = max(6, math.ceil(math.log2(max(rows, 2))) - 6)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log(1 - meet))


def sign_codes(table: DataFrame, bits: int, tables: int) -> DataFrame:
    """c, n, unit vector as bytes, the codes of all tables as bytes (dimension mixed in)."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = (1 << np.arange(bits)).astype(np.int64)
        for vectors in batches:
            units, codes = np.empty(len(vectors), object), np.empty(len(vectors), object)
            for at, rows in by_dimension(vectors):
                rows = unit(rows)
                signs = (rows @ planes(SEED, rows.shape[1], bits * tables) > 0).reshape(len(rows), tables, bits)
                code = (signs @ weights) * 65536 + rows.shape[1]
                for i, row, own in zip(at, rows, code):
                    units[i], codes[i] = row.tobytes(), own.astype(np.int64).tobytes()
            yield pd.DataFrame({"unit": units, "codes": codes})

    hashed = F.pandas_udf(run, "unit binary, codes binary")
    return table.select("c", "n", hashed("v").alias("h")).select("c", "n", "h.unit", "h.codes")


def block_links(threshold: float):
    """The task of one pair of blocks: links per vector, and links that connect the block."""
    def run(table: pa.Table, bounds: np.ndarray):
        c, n, t = (table.column(k).to_numpy() for k in ("c", "n", "t"))
        part, first, second = (table.column(k).to_numpy() for k in ("part", "i", "j"))
        units, codes = table.column("unit").combine_chunks(), table.column("codes").combine_chunks()
        rows_a, rows_b, rows_n = [], [], []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            vectors = np.frombuffer(b"".join(units.slice(s, e - s).to_pylist()), np.float64).reshape(e - s, -1)
            left = np.arange(e - s) if first[s] == second[s] else np.flatnonzero(part[s:e] == first[s])
            right = left if first[s] == second[s] else np.flatnonzero(part[s:e] != first[s])
            if not len(left) or not len(right):
                continue
            close = vectors[left] @ vectors[right].T >= threshold
            if first[s] == second[s]:
                close = np.triu(close, 1)
            x, y = np.nonzero(close)
            x, y = left[x], right[y]
            if t[s] and len(x):
                code = np.frombuffer(b"".join(codes.slice(s, e - s).to_pylist()), np.int64).reshape(e - s, -1)[:, :t[s]]
                new = np.concatenate([~(code[x[k:k + 65536]] == code[y[k:k + 65536]]).any(axis=1)
                                      for k in range(0, len(x), 65536)])
                x, y = x[new], y[new]
            if not len(x):
                continue
            links = np.bincount(x, n[s:e][y], e - s) + np.bincount(y, n[s:e][x], e - s)
            label = np.arange(e - s)
            while True:
                low = np.minimum(label[x], label[y])
                moved = label.copy()
                np.minimum.at(moved, x, low)
                np.minimum.at(moved, y, low)
                moved = moved[moved]
                if (moved == label).all():
                    break
                label = moved
            some, tied = np.flatnonzero(links), np.flatnonzero(label != np.arange(e - s))
            rows_a += [c[s:e][some], c[s:e][tied]]
            rows_b += [np.full(len(some), -1), c[s:e][label[tied]]]
            rows_n += [links[some].astype(np.int64), np.zeros(len(tied), np.int64)]
        if rows_a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(r).astype(np.int64)) for r in (rows_a, rows_b, rows_n)],
                                             ["a", "b", "n"])
    return run


def near_duplicates(table: DataFrame, threshold: float = 0.95, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of ``table`` (vec_id, embedding).

    Links join vectors whose cosine in double precision is at least ``threshold``; equal vectors
    link with each other. A vector that is null, zero, or holds null or non-finite components
    links with nothing and is its own component; vectors of other lengths don't link. Repeated
    rows are rows of their own; an empty table gives no rows; other columns are not looked at.
    """
    rows = keyed(table)
    distinct = classes(rows)
    bits, tables = hash_shape(distinct.count(), threshold)
    coded = reliable_checkpoint(sign_codes(distinct, bits, tables))
    code_of = F.expr(f"transform(sequence(0, {tables - 1}), i -> substr(codes, i * 8 + 1, 8))")
    spread = coded.select("c", F.posexplode(code_of).alias("t", "code"))
    sizes = reliable_checkpoint(spread.groupBy("t", "code").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"))
    parts = F.ceil(F.col("rows") / block).cast("int")
    cut = spread.join(sizes, ["t", "code"]).withColumn("parts", parts) \
        .withColumn("part", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))
    sent = cut.select("c", "t", "code", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("o")).select(
        "c", "t", F.xxhash64("code").alias("code"), "part", F.least("part", "o").alias("i"),
        F.greatest("part", "o").alias("j")).join(coded, "c")
    found = reliable_checkpoint(map_groups(sent, ["t", "code", "i", "j"], block_links(threshold),
                                           "a long, b long, n long"))
    counts = found.where("b < 0").groupBy(F.col("a").alias("c")).agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("b >= 0").select("a", "b")).withColumnRenamed("node", "c")
    known = distinct.select("c", "k1", "k2", "n", F.col("ids")[0].alias("least")).join(counts, "c", "left") \
        .join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    heads = known.groupBy("root").agg(F.min("least").alias("component_id"))
    members = reliable_checkpoint(known.join(heads, "root").select(
        "k1", "k2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"))
    linked = rows.select("vec_id", "k1", "k2").join(members, ["k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = table.where(~usable("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"),
                                                    F.col("vec_id").cast("long").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
