"""Connected components: blocks of edges contracted on their own, then star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import reliable_checkpoint, shuffle_width

BLOCK_EDGES = 100_000


def _pairs(scope: list[str], *pairs: tuple[str, str]) -> list:
    """Columns that give each row once per pair, as (scope, u, v)."""
    return [*scope, F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]))]


def _hang_larger(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Every node hands its larger neighbours to the least node it sees, itself included."""
    both = edges.select(*_pairs(scope, ("u", "v"), ("v", "u")))
    least = both.groupBy(*scope, "u").agg(F.least("u", F.min("v")).alias("low"))
    return both.filter("v > u").join(least, [*scope, "u"]).select(*_pairs(scope, ("v", "low"))).distinct()


def _hang_smaller(edges: DataFrame, scope: list[str]) -> DataFrame:
    """Every node hands its smaller neighbours, and itself, to the least of them."""
    least = edges.groupBy(*scope, "u").agg(F.min("v").alias("low"))
    return edges.join(least, [*scope, "u"]).select(*_pairs(scope, ("u", "low"), ("v", "low"))).filter("u <> v").distinct()


def _all_stars(edges: DataFrame, scope: list[str]) -> bool:
    """Whether every node hangs on one root and no root hangs on another."""
    ends = edges.select(*scope, F.inline(F.array(*[F.struct(F.col(c).alias("node"), F.lit(h).alias("hangs"))
                                                   for c, h in (("u", 1), ("v", 0))])))
    twice = ends.groupBy(*scope, "node").agg(F.sum("hangs").alias("h"), F.count_if(F.col("hangs") == 0).alias("roots"))
    return twice.filter("h > 1 or (h > 0 and roots > 0)").isEmpty()


def _least_of_blocks(batches: Iterator[pa.RecordBatch], n_scope: int) -> Iterator[pa.RecordBatch]:
    """(scope, u, v, open) of edges sorted by scope: each node with the least one it reaches by the
    edges of its block. Scopes at the ends of a block may go on elsewhere: they are open."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK_EDGES:
            yield _least_of_block(pa.Table.from_batches(held), n_scope)
            held, rows = [], 0
    if rows:
        yield _least_of_block(pa.Table.from_batches(held), n_scope)


def _least_of_block(edges: pa.Table, n_scope: int) -> pa.RecordBatch:
    scopes, u, v = edges.columns[:n_scope], edges.column(n_scope), edges.column(n_scope + 1)
    changed = np.zeros(edges.num_rows, bool)
    for scope in scopes:
        codes = scope.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        changed[1:] |= codes[1:] != codes[:-1]
    group = np.cumsum(changed)
    names = pa.chunked_array([*u.chunks, *v.chunks]).combine_chunks().dictionary_encode()
    order = pc.sort_indices(names.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # texts by code point, as the least of them counts
    keys, nodes = np.unique(np.tile(group, 2) * len(order) + place[names.indices.to_numpy()], return_inverse=True)
    first, second = np.split(nodes, 2)
    root = np.arange(len(keys))
    while (root[first] != root[second]).any():
        np.minimum.at(root, np.maximum(root[first], root[second]), np.minimum(root[first], root[second]))
        while (root[root] != root).any():
            root = root[root]
    group_of, name_of = keys // len(order), order[keys % len(order)]
    begins = np.concatenate(([0], np.flatnonzero(changed)))
    at = pa.array(begins[group_of])
    text = names.dictionary
    return pa.RecordBatch.from_arrays(
        [*[s.combine_chunks().take(at) for s in scopes], text.take(pa.array(name_of)), text.take(pa.array(name_of[root])),
         pa.array((group_of == 0) | (group_of == group[-1]))], [*edges.schema.names, "open"])


def star_components(edges: DataFrame, scope: list[str], first: str, second: str) -> DataFrame:
    """(scope, node, root): the least node that each node of an edge can reach within its scope.

    Edges are dealt out by ranges of (scope, node) and contracted in blocks of ``BLOCK_EDGES``. A
    scope inside a block is done. Of the others, at most two a block, the contracted edges go on in
    rounds of star contraction: two aggregated joins, so a node with many edges is a skewed join
    at worst, that end in the checkpoint folder. A chain of n nodes takes about log n rounds.
    """
    ends = edges.select(*scope, F.greatest(first, second).alias("u"), F.least(first, second).alias("v")).filter("u <> v")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in ends.schema.fields], "open boolean"])
    cut = reliable_checkpoint(
        ends.repartitionByRange(shuffle_width(ends.sparkSession), *scope, "u").sortWithinPartitions(*scope)
        .mapInArrow(lambda batches: _least_of_blocks(batches, len(scope)), schema))
    now = reliable_checkpoint(cut.filter("open and u <> v").drop("open").distinct())
    while not _all_stars(now, scope):
        now = reliable_checkpoint(_hang_smaller(_hang_larger(now, scope), scope))
    rest = now.select(*_pairs(scope, ("u", "v"), ("v", "v"))).distinct()
    return cut.filter("not open").drop("open").unionByName(rest).withColumnsRenamed({"u": "node", "v": "root"})
