"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import shuffle_width


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (names differ by more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; MILLRACE_TOKENIZERS names another folder."""
    folder = os.environ.get("MILLRACE_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def text_parts(texts: list[str], most_chars: int = 2_000_000) -> Iterator[list[str]]:
    """``texts`` in order, in lists of bounded length; a longer text is a list of its own."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > most_chars:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def column_parts(column: pa.Array, most_chars: int, rows: int = 256) -> Iterator[list[str]]:
    """The texts of an Arrow column as ``text_parts``, made into strings some rows at a time."""
    for at in range(0, len(column), rows):
        yield from text_parts(column.slice(at, rows).to_pylist(), most_chars)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups of the sorted stream, with the groups' boundaries.

    The last group of a batch may go on in the next one and is held back until it ends.
    """
    held: list[pa.RecordBatch] = []

    def cuts(table: pa.Table) -> np.ndarray:
        changed = np.zeros(max(table.num_rows - 1, 0), bool)
        for key in keys:
            values = table.column(key).to_numpy()
            changed |= values[1:] != values[:-1]
        return np.concatenate([[0], np.flatnonzero(changed) + 1, [table.num_rows]])

    def same_group(first: pa.RecordBatch, second: pa.RecordBatch) -> bool:
        return all(first.column(first.schema.get_field_index(k))[0]
                   == second.column(second.schema.get_field_index(k))[second.num_rows - 1] for k in keys)

    for batch in batches:
        if not batch.num_rows:
            continue
        if held and same_group(held[0], batch):
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        bounds = cuts(table)
        if len(bounds) > 2:
            yield table.slice(0, int(bounds[-2])), bounds[:-1]
        held = table.slice(int(bounds[-2])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, cuts(table)


def map_groups(df: DataFrame, keys: list[str],
               run: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, then: Sequence = ()) -> DataFrame:
    """One shuffle by ``keys``, then ``run`` over tables of whole groups, in order of ``then``. The
    caller bounds the groups; the shuffle has a fixed width, as bytes say little about the work."""
    def tasks(batches):
        for table, bounds in whole_groups(batches, keys):
            yield from run(table, bounds)

    spread = df.repartition(shuffle_width(df.sparkSession), *keys).sortWithinPartitions(*keys, *then)
    return spread.mapInArrow(tasks, schema)


def slices(text, gap, most: int = 1 << 22):
    """``text`` (str or bytes) in order, in parts of about ``most`` characters that end with a
    match of ``gap``, a pattern of one character that no word holds."""
    at = 0
    while len(text) - at > most:
        cut = gap.search(text, at + most)
        if cut is None:
            break
        yield text[at:cut.end()]
        at = cut.end()
    yield text[at:]
