"""Approximate nearest neighbours: NN-descent on Spark joins, greedy search on the graph.

Nodes are distinct vectors. A first graph comes from blocks of vectors that are neighbours in
the order of their sign codes under several sets of hyperplanes. A round of NN-descent joins
every node with its neighbours and a sample of the nodes that name it, compares those with each
other, and keeps the best ``degree`` per node; rounds end when few edges change. A query walks the
graph: it expands the best nodes of its beam that it hasn't expanded yet, until that no longer
improves its best. Bits, tables and beam grow with the rows. Graph work uses unit vectors
in single precision and compares them by cosine - 1, which keeps its digits where vectors are nearly
equal; the whole beam is scored exactly before it is cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_groups
from millrace.llm.vectors import by_dimension, classes, keyed, planes, unit
from millrace.session import reliable_checkpoint, shuffle_width

SEED = 23
GRAPH = "c long, near binary, sims binary"
NONE = -4.0  # below every cosine - 1


@dataclass(frozen=True)
class Shape:
    """Sizes of the index and the search; every row is indexed whatever they are.

    ``rounds`` and ``steps`` are the least numbers; rounds go on while more than ``settled`` of
    the edges change, and the search of a query while a step improves its best.
    """

    degree: int = 32
    tables: int = 10
    block: int = 1024
    rounds: int = 3
    offered: int = 8
    beam: int = 160
    expanded: int = 40
    steps: int = 5
    bits: int = 14
    settled: float = 0.01

    def grown(self, rows: int) -> Shape:
        """The sizes for so many rows: one bit for each doubling beyond 2 ** 16, one table and an
        eighth of the beam too."""
        more = max(0, math.ceil(math.log2(max(rows, 1))) - 16)
        return replace(self, bits=self.bits + more, tables=self.tables + more, beam=self.beam + self.beam * more // 8)


def _codes(table: DataFrame, tables: int, bits: int) -> DataFrame:
    """c, q (unit vector in single precision), codes (a sign code per table, dimension first),
    ties (per table a projection that orders vectors of one code, nearly equal ones too)."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        weights = (1 << np.arange(bits)[::-1]).astype(np.int64)
        for vectors in batches:
            small, codes, ties = (np.empty(len(vectors), object) for _ in range(3))
            for at, rows in by_dimension(vectors):
                rows = unit(rows)
                dim = rows.shape[1]
                code = (rows @ planes(SEED, dim, tables * bits) > 0).reshape(len(rows), tables, bits) @ weights
                tie = rows @ planes(SEED + 1, dim, tables)
                for i, row, own, order in zip(at, rows.astype(np.float32), code, tie):
                    small[i], codes[i], ties[i] = row.tobytes(), (own + dim * (1 << bits)).tolist(), order.tolist()
            yield pd.DataFrame({"q": small, "codes": codes, "ties": ties})

    return table.select("c", F.pandas_udf(run, "q binary, codes array<long>, ties array<double>")("v").alias("h")) \
        .select("c", "h.q", "h.codes", "h.ties")


def _small(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows."""
    values = column.to_pylist()
    rows = np.frombuffer(b"".join(values), np.float32).reshape(len(values), -1).astype(np.float64)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _best(ids: np.ndarray, sims: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` best of candidates that may repeat; ties to the smaller id."""
    order = np.lexsort((ids, -sims))
    ids, sims = ids[order], sims[order]
    _, first = np.unique(ids, return_index=True)
    first.sort()
    first = first[:most]
    return ids[first], sims[first]


def _rows(schema: list[str], rows: list[tuple]) -> pa.RecordBatch:
    c, near, sims = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(near, pa.binary()), pa.array(sims, pa.binary())], schema)


def _merge(candidates: DataFrame, most: int) -> DataFrame:
    def run(table, bounds):
        c, near, sims = table.column("c").to_numpy(), table.column("near").to_pylist(), table.column("sims").to_pylist()
        out = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            ids, best = _best(np.frombuffer(b"".join(near[s:e]), np.int64), np.frombuffer(b"".join(sims[s:e]), np.float32), most)
            out.append((int(c[s]), ids.tobytes(), best.tobytes()))
        yield _rows(["c", "near", "sims"], out)

    return reliable_checkpoint(map_groups(candidates, ["c"], run, GRAPH))


def _offers(c: np.ndarray, sims: np.ndarray, least: np.ndarray, most: int) -> list[tuple]:
    """Per row of a block, its ``most`` best others that beat ``least``; ``sims`` is cosine - 1."""
    sims = sims.astype(np.float32)
    np.fill_diagonal(sims, NONE)
    take = min(most, len(c) - 1)
    if take < 1:
        return []
    best = np.argpartition(-sims, take - 1, axis=1)[:, :take]
    values = np.take_along_axis(sims, best, axis=1)
    good = values > least[:, None]
    return [(int(c[i]), c[best[i, good[i]]].tobytes(), values[i, good[i]].tobytes()) for i in np.flatnonzero(good.any(axis=1))]


def first_graph(coded: DataFrame, shape: Shape) -> DataFrame:
    """Neighbours within blocks of the order of each table's codes; blocks are cut by row count."""
    def run(batches):
        held, rows = [], 0

        def flush(most_rows):
            nonlocal held, rows
            table = pa.Table.from_batches(held).combine_chunks()
            t, code = table.column("t").to_numpy(), table.column("code").to_numpy()
            part = t * (1 << 20) + (code >> shape.bits)  # blocks never mix tables or dimensions
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            out, done = [], 0
            for s, e in zip(cuts[:-1], cuts[1:]):
                for k in range(s, e, shape.block):
                    end = min(k + shape.block, e)
                    if end == len(part) and end - k < most_rows:
                        break
                    c = table.column("c").to_numpy()[k:end]
                    q = _small(table.column("q").slice(k, end - k))
                    out += _offers(c, q @ q.T - 1, np.full(len(c), NONE), shape.degree)
                    done = end
            held, rows = table.slice(done).to_batches(), table.num_rows - done
            return _rows(["c", "near", "sims"], out)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
                if rows >= 4 * shape.block:
                    yield flush(shape.block)
        if rows:
            yield flush(0)

    spread = coded.select("c", "q", "ties", F.posexplode("codes").alias("t", "code")) \
        .select("c", "q", "t", "code", F.col("ties")[F.col("t")].alias("tie"))
    width = max(1, shuffle_width(coded.sparkSession))
    ordered = spread.repartitionByRange(width, "t", "code", "tie", "c").sortWithinPartitions("t", "code", "tie", "c")
    return _merge(ordered.mapInArrow(run, GRAPH), shape.degree)


def _edges(graph: DataFrame) -> DataFrame:
    """c, other per edge."""
    def run(batches):
        for batch in batches:
            near = [np.frombuffer(n, np.int64) for n in batch.column(1).to_pylist()]
            if near:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(batch.column(0).to_numpy(), [len(n) for n in near])),
                    pa.array(np.concatenate(near))], ["c", "other"])

    return graph.select("c", "near").mapInArrow(run, "c long, other long")


def around(graph: DataFrame, shape: Shape, salt: int) -> DataFrame:
    """center, member: a node's neighbours, and about ``degree`` of the nodes that name it (a
    sample by hash where there are more, as NN-descent has it)."""
    edges = reliable_checkpoint(_edges(graph))
    named = reliable_checkpoint(edges.groupBy("other").agg(F.count(F.lit(1)).alias("times")))
    back = edges.join(named, "other").where(
        F.pmod(F.xxhash64("c", "other", F.lit(salt)), F.col("times")) < shape.degree)
    return edges.select(F.col("c").alias("center"), F.col("other").alias("member")).union(
        back.select(F.col("other").alias("center"), F.col("c").alias("member"))).distinct()


def descend(graph: DataFrame, coded: DataFrame, shape: Shape, salt: int) -> DataFrame:
    """One round: neighbours of a node meet there and offer themselves to each other."""
    def least(sims: pd.Series) -> pd.Series:
        return pd.Series([float(np.frombuffer(s, np.float32)[-1]) if len(s) >= 4 * shape.degree else NONE for s in sims])

    bar = graph.select(F.col("c").alias("member"), F.pandas_udf(least, "double")("sims").alias("least"))
    members = around(graph, shape, salt).join(coded.select(F.col("c").alias("member"), "q"), "member").join(bar, "member")

    def run(table, bounds):
        c, bars, q = table.column("member").to_numpy(), table.column("least").to_numpy(), table.column("q").combine_chunks()
        for k in range(0, len(bounds) - 1, 512):
            out = []
            for s, e in zip(bounds[k:k + 512].tolist(), bounds[k + 1:k + 513].tolist()):
                rows = _small(q.slice(s, e - s))
                out += _offers(c[s:e], rows @ rows.T - 1, bars[s:e], shape.offered)
            yield _rows(["c", "near", "sims"], out)

    return _merge(map_groups(members, ["center"], run, GRAPH).union(graph), shape.degree)


def build_graph(coded: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """c, near, sims (the neighbours of a node, best first, as bytes) for every node of ``coded``."""
    graph, salt, share = first_graph(coded, shape), 0, 1.0
    while salt < shape.rounds or share > shape.settled:
        before, graph = graph, descend(graph, coded, shape, salt)
        salt, share = salt + 1, _changed(before, graph)
    return graph


def _changed(before: DataFrame, after: DataFrame) -> float:
    """Share of the edges of ``after`` that ``before`` doesn't have; 0 without edges. Rounds only
    better a node's edges, so it falls to 0."""
    def new(old: pd.Series, now: pd.Series) -> pd.Series:
        return pd.Series([int((~np.isin(np.frombuffer(n, np.int64), np.frombuffer(o, np.int64))).sum())
                          for o, n in zip(old, now)], dtype="int64")

    both = after.select("c", F.col("near").alias("now")).join(before.select("c", F.col("near").alias("old")), "c", "left")
    fresh, edges = both.select(
        F.pandas_udf(new, "long")(F.coalesce("old", F.lit(b"")), "now").alias("new"), (F.length("now") / 8).alias("n")) \
        .agg(F.coalesce(F.sum("new"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    return fresh / max(edges, 1)


def greedy_search(starts: DataFrame, coded: DataFrame, graph: DataFrame, shape: Shape = Shape(), k: int = 5) -> DataFrame:
    """From ``starts`` (c, q: nodes to search from) to c, near, sims: the beam of each."""
    links = reliable_checkpoint(around(graph, shape, -1))
    beam = reliable_checkpoint(starts.join(graph, "c", "left").select(
        "c", "q", F.coalesce("near", F.lit(b"")).alias("near"), F.coalesce("sims", F.lit(b"")).alias("sims"),
        F.lit(b"").alias("seen"), F.lit(b"").alias("front"), F.lit(True).alias("better")))
    schema = "c long, q binary, near binary, sims binary, seen binary, front binary, better boolean"

    def choose(batches, every):
        """The best nodes of the beam that weren't expanded become the front: of each search, or of
        those whose last step bettered their best."""
        for batch in batches:
            near, seen, better = (batch.column(i).to_pylist() for i in (2, 4, 6))
            fronts, all_seen = [], []
            for n, s, on in zip(near, seen, better):
                ids, old = np.frombuffer(n, np.int64), np.frombuffer(s, np.int64)
                front = ids[~np.isin(ids, old)][:shape.expanded if every or on else 0]
                fronts.append(front.tobytes())
                all_seen.append(np.concatenate([old, front]).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(all_seen, pa.binary()),
                                              pa.array(fronts, pa.binary()), batch.column(6)], schema=batch.schema)

    def run(table, bounds):
        c, q, member = table.column("c").to_numpy(), table.column("q").to_pylist(), table.column("member").to_numpy()
        near, sims, seen = (table.column(k).to_pylist() for k in ("near", "sims", "seen"))
        out = []
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = next(i for i in range(s, e) if near[i] is not None)
            rest = [i for i in range(s, e) if i != own]
            had = near[own][:8 * (k + 1)]
            ids, best = np.frombuffer(near[own], np.int64), np.frombuffer(sims[own], np.float32)
            if rest:
                rows = _small(pa.array([q[own], *(q[i] for i in rest)]))
                ids = np.concatenate([ids, member[rest]])
                best = np.concatenate([best, (rows[1:] @ rows[0] - 1).astype(np.float32)])
            ids, best = _best(ids, best, shape.beam)
            out.append((int(c[s]), q[own], ids.tobytes(), best.tobytes(), seen[own], b"", ids[:k + 1].tobytes() != had))
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (pa.int64(), *[pa.binary()] * 5, pa.bool_()))],
                                         ["c", "q", "near", "sims", "seen", "front", "better"])

    step = 0
    while True:
        every = step < shape.steps
        beam = reliable_checkpoint(beam.mapInArrow(lambda batches, every=every: choose(batches, every), schema))
        if beam.where("length(front) > 0").isEmpty():
            break
        step += 1
        front = _edges(beam.select("c", F.col("front").alias("near")))
        found = front.join(links, front["other"] == links["center"]).select("c", "member").distinct() \
            .where("c <> member").join(coded.select(F.col("c").alias("member"), "q"), "member")
        state = beam.select("c", "q", F.lit(-1).cast("long").alias("member"), "near", "sims", "seen")
        none = F.lit(None).cast("binary")
        rows = state.union(found.select("c", "q", "member", none, none, none))
        beam = reliable_checkpoint(map_groups(rows, ["c"], run, schema))
    return beam.select("c", "near", "sims")


def nearest(table: DataFrame, every: int = 50, k: int = 5, shape: Shape = Shape()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows found for each row of ``table``
    (vec_id, embedding) whose vec_id is divisible by ``every``, its own row left out.

    Scores are cosines in double precision on the original vectors, ties go to the smaller
    vec_id. Vectors that are null, zero or hold null or non-finite components take no part;
    vectors of other lengths are no neighbours; a vec_id counts once per query; with fewer
    candidates than ``k`` all are given; an empty table gives no rows.
    """
    rows = keyed(table)
    distinct = classes(rows, k + 1)
    shape = shape.grown(distinct.count())
    coded = reliable_checkpoint(_codes(distinct, shape.tables, shape.bits))
    graph = build_graph(coded, shape)
    queries = reliable_checkpoint(rows.where(F.col("vec_id") % every == 0).select("vec_id", "k1", "k2").distinct()
                                  .join(distinct.select("c", "k1", "k2"), ["k1", "k2"]).select("vec_id", "c"))
    starts = queries.select("c").distinct().join(coded.select("c", "q"), "c")
    found = greedy_search(starts, coded, graph, shape, k)
    pairs = _edges(found).union(starts.select("c", F.col("c").alias("other")))
    vectors = distinct.select("c", "v")

    def cosine(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([float(np.clip(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)), -1, 1)) for x, y in zip(a, b)], dtype=float)

    scored = pairs.join(vectors, "c").join(distinct.select(F.col("c").alias("other"), F.col("v").alias("w"), "ids"), "other") \
        .select("c", F.pandas_udf(cosine, "double")("v", "w").alias("score"), "ids")
    best = F.array_sort(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("id"))))))
    lists = scored.groupBy("c").agg(F.slice(best, 1, 4 * (k + 1)).alias("best"))
    ranked = queries.join(lists, "c").select("vec_id", F.expr(
        f"slice(filter(best, x -> x.id <> vec_id), 1, {k})").alias("best"))
    return ranked.select(F.col("vec_id").alias("query_id"), F.posexplode("best").alias("place", "hit")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("hit.id").alias("vec_id"),
        (-F.col("hit.s")).alias("score"))
