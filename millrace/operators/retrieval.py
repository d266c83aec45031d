"""Exact vector top-k over chunk embeddings and what is built from the hits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.numeric import round_half
from millrace.functions.text import name_query

# Queries travel to the tasks in blocks of at most this many numbers.
MAX_BLOCK_VALUES = 8_000_000
# Query texts built from component and signal names.
COMPONENT_SUFFIXES = ("", "specifications operating range", "maintenance cleaning fault error")
SIGNAL_SUFFIXES = ("unit measurement specification",)


def name_queries(names: DataFrame, column: str, suffixes=COMPONENT_SUFFIXES) -> DataFrame:
    """(columns..., query): the retrieval queries of each component or signal name."""
    return names.withColumn("query", F.explode(name_query(F.col(column), *suffixes)))


def _query_blocks(queries: DataFrame, columns: list[str]):
    """The query catalogue in driver-sized blocks; the size is measured first."""
    picked = queries.select("query_id", "embedding", *columns)
    count, width = picked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-(count * (width or 1)) // MAX_BLOCK_VALUES))
    for i in range(blocks):
        part = picked if blocks == 1 else picked.filter(
            F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = part.orderBy("query_id").collect()
        if rows:
            yield rows


def top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, filters: tuple[str, ...] = (),
          metric: str = "cosine", chunk_id: str = "chunk_id",
          chunk_type: str = "long") -> DataFrame:
    """(query_id, chunk_id, rank, distance, score): the k nearest chunks of each query.

    ``queries(query_id, embedding, filters...)`` is the catalogue, ``chunks`` the large
    side; it is scanned once per query block and never broadcast or joined. A chunk
    qualifies when it equals every filter column of the query that is not null. Each
    task keeps only its k best per query, so k x queries rows per task are shuffled.
    Distances are compared at nine digits, equal ones by chunk id. A vector without a
    direction, such as a zero vector, has no cosine distance: it is null and ranks last.
    """
    hits = None
    id_type = queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {id_type}, chunk_id {chunk_type}, distance double"
    for rows in _query_blocks(queries, list(filters)):
        part = _scan_block(rows, chunks, k, filters, metric, chunk_id, schema)
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        hits = chunks.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "chunk_id")
    return (hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "chunk_id", "rank", "distance",
                    round_half(1 - F.col("distance"), 4).alias("score")))


def _scan_block(rows, chunks, k, filters, metric, chunk_id, schema):
    ids = [r["query_id"] for r in rows]
    matrix = np.array([r["embedding"] for r in rows], dtype=np.float64)
    if metric == "cosine":
        with np.errstate(invalid="ignore", divide="ignore"):
            matrix = matrix / np.linalg.norm(matrix, axis=1, keepdims=True)
    wanted = {c: [r[c] for r in rows] for c in filters}

    def distances(vectors):
        if metric == "cosine":
            norms = np.linalg.norm(vectors, axis=1)
            return 1.0 - (vectors @ matrix.T) / norms[:, None]
        squares = (vectors ** 2).sum(axis=1)[:, None] + (matrix ** 2).sum(axis=1)[None, :]
        return np.maximum(squares - 2.0 * (vectors @ matrix.T), 0.0)

    def nearest(batches):
        best = [([], []) for _ in ids]  # per query: distances, chunk ids
        for pdf in batches:
            pdf = pdf[pdf["_vector"].notna()]
            if not len(pdf):
                continue
            vectors = np.stack(pdf["_vector"].to_numpy()).astype(np.float64)
            with np.errstate(invalid="ignore", divide="ignore"):
                found = np.round(distances(vectors), 9)
            found[np.isnan(found)] = np.inf  # sorts last, leaves as null
            keys = pdf["_id"].to_numpy()
            for q in range(len(ids)):
                mask = np.ones(len(keys), dtype=bool)
                for c in filters:
                    if wanted[c][q] is not None:
                        mask &= (pdf[c] == wanted[c][q]).to_numpy()
                d, i = found[mask, q], keys[mask]
                if len(d) > k:  # keep ties at the border: the id decides among them
                    border = np.partition(d, k - 1)[k - 1]
                    near = d <= border
                    d, i = d[near], i[near]
                merged = sorted(zip([*best[q][0], *d.tolist()], [*best[q][1], *i.tolist()]))[:k]
                best[q] = ([m[0] for m in merged], [m[1] for m in merged])
        out = [(ids[q], i, None if np.isinf(d) else d) for q in range(len(ids)) for d, i in zip(*best[q])]
        yield pd.DataFrame(out, columns=["query_id", "chunk_id", "distance"])

    narrow = chunks.select(F.col(chunk_id).alias("_id"), F.col("embedding").alias("_vector"),
                           *filters)
    return narrow.mapInPandas(nearest, schema)


def merge_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(chunk_id, first_hit, matched_queries): each chunk once, its queries in catalogue
    order. ``queries(query_id, query_ord, query)``; a chunk has at most one hit per query,
    so the arrays are bounded by the catalogue."""
    placed = hits.join(queries.select("query_id", "query_ord", "query"), "query_id")
    merged = placed.groupBy("chunk_id").agg(
        F.min(F.struct("query_ord", "rank")).alias("first_hit"),
        F.array_sort(F.collect_list(F.struct("query_ord", "query"))).alias("_q"))
    return merged.select("chunk_id", "first_hit", F.col("_q.query").alias("matched_queries"))


def topic_chunks(merged: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, chunk_id, first_hit): a chunk once per distinct topic of its queries.

    ``topics(ord, topic, query)``: a query listed twice belongs to its last topic, an
    unlisted one to ``general``.
    """
    of_query = topics.groupBy("query").agg(F.max_by("topic", "ord").alias("topic"))
    return (merged.select("chunk_id", "first_hit", F.explode("matched_queries").alias("query"))
            .join(of_query, "query", "left")
            .select(F.coalesce("topic", F.lit("general")).alias("topic"), "chunk_id", "first_hit")
            .distinct())


def topic_counts(placed: DataFrame) -> DataFrame:
    return placed.groupBy("topic").agg(F.count(F.lit(1)).alias("n_chunks"))


def numbered_context(placed: DataFrame, group: str = "topic") -> DataFrame:
    """(group, n_chunks, context): retrieved chunks as numbered text in hit order.

    The input is a top-k result with ``text`` and ``page``, so a group has at most
    k x queries rows.
    """
    ordered = F.array_sort(F.collect_list(F.struct("first_hit", "chunk_id", "page", "text")))
    grouped = placed.groupBy(group).agg(ordered.alias("_c"))
    parts = F.transform("_c", lambda c, i: F.concat(
        F.lit("--- Chunk "), (i + 1).cast("string"), F.lit(" | page="), c["page"].cast("string"),
        F.lit(" ---\n"), c["text"]))
    return grouped.select(group, F.size("_c").cast("long").alias("n_chunks"),
                          F.array_join(parts, "\n\n").alias("context"))


def topic_context(placed: DataFrame) -> DataFrame:
    """One text per topic: a heading and each chunk under its page range."""
    ordered = F.array_sort(F.collect_list(F.struct(
        "first_hit", "chunk_id", "start_page", "end_page", "text")))
    grouped = placed.groupBy("topic").agg(ordered.alias("_c"))
    parts = F.transform("_c", lambda c: F.concat(
        F.lit("[Pages "), c["start_page"].cast("string"), F.lit("-"),
        c["end_page"].cast("string"), F.lit("]\n"), c["text"]))
    return grouped.select("topic", F.concat(
        F.lit("## "), "topic", F.lit("\n"), F.array_join(parts, "\n")).alias("context"))


def with_curated(hits: DataFrame, queries: DataFrame, curated: DataFrame) -> DataFrame:
    """(chunk_id, origin, position): hits unique by id in first-hit order, then curated
    chunks that were not hit. Both sides are bounded: k x queries hits and a
    hand-written list, ordered by ``ord``."""
    first = (hits.join(queries.select("query_id", "query_ord"), "query_id")
             .groupBy("chunk_id").agg(F.min(F.struct("query_ord", "rank")).alias("at")))
    found = first.select("chunk_id", F.lit("hit").alias("origin"), F.col("at.query_ord").alias("a"),
                         F.col("at.rank").cast("long").alias("b"))
    added = curated.join(first, "chunk_id", "left_anti").groupBy("chunk_id").agg(
        F.min("ord").alias("ord")).select(
        "chunk_id", F.lit("curated").alias("origin"), F.col("ord").cast("long").alias("a"),
        F.lit(0).cast("long").alias("b"))
    both = found.withColumn("a", F.col("a").cast("long")).unionByName(added)
    order = Window.orderBy(F.desc("origin"), "a", "b", "chunk_id")
    return both.select("chunk_id", "origin", F.row_number().over(order).alias("position"))
