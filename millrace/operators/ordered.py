"""Ordered work per key as one scan over ranges of (key, order, tie).

Rows are dealt out by ranges of the whole sort key, so a key that holds much of the data is cut
like any other and a range is as large as the next. The ranges are written to the checkpoint
folder, as their bounds are sampled and must not change. Each is read once for what its last
key has come to, one row a range; these rows, chained in order, give every range the state in
which its first key enters it. A second reading gives the rows their values. Only the first
key of a range can come from an earlier one, so the states are as many as there are ranges,
whatever the number of keys, and travel by broadcast.

The steps are associative (counts, last values, sums since a reset, clamped affine states), so
what a range does to a state is known before the state is. Sums are kept in whole multiples of
2**-56 and give the same bits however the rows are cut; a `RunningSum` adds row by row instead.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import reliable_checkpoint, shuffle_width

LANE_ROWS, HELD_ROWS = 512, 4096
HIGH_BITS, LOW_BITS = 16, 40
LARGE, FULL = 2.0 ** 32, 1 << 60


def order_number(df: DataFrame, order: str) -> Column:
    """The order column as a number: microseconds for timestamps, else itself."""
    dtype = df.schema[order].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{order}`)")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(order)
    if isinstance(dtype, T.DateType):
        return F.unix_date(order).cast("long")
    return F.col(order)


def _floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)


def _flags(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).fill_null(False).to_numpy(zero_copy_only=False)


# ------------------------------------------------------------------ steps
# A step has a state of a key's rows so far. ``state_after`` reads the rows [s, e) of one key, of
# which the first ``begins`` the key or goes on; ``join`` puts the state of a later part behind that of an earlier one; ``values`` gives a
# batch its column, with ``state`` for its first key and ``starts`` where the keys begin in it
# (the first one at 0, also if it goes on from before).

@dataclass(frozen=True)
class Position:
    """Zero-based position of the row within its key."""

    name: str
    sql_type: str = "long"

    def inputs(self):
        return []

    def empty(self):
        return 0

    def state_after(self, state, batch, s, e, begins):
        return state + e - s

    def join(self, earlier, later):
        return earlier + later

    def values(self, state, batch, starts, begins):
        begin = np.repeat(starts, np.diff(np.append(starts, batch.num_rows)))
        at = np.arange(batch.num_rows) - begin
        return pa.array(at + np.where(begin == 0, state, 0))


@dataclass(frozen=True)
class Last:
    """Last non-null ``value`` so far, this row included; with ``first`` the key's first row
    counts by its ``first`` column where ``value`` is null."""

    name: str
    value: str
    sql_type: str
    first: str | None = None

    def inputs(self):
        return [self.value, *([self.first] if self.first else [])]

    def empty(self):
        return None

    def _known(self, batch, starts, begins):
        column = batch.column(self.value)
        if self.first is not None:
            at_start = np.zeros(batch.num_rows, bool)
            at_start[starts if begins else starts[1:]] = True
            column = pc.if_else(pc.and_(pa.array(at_start), column.is_null()), batch.column(self.first), column)
        return column

    def state_after(self, state, batch, s, e, begins):
        part = batch.slice(s, e - s)
        known = self._known(part, np.array([0]), begins).drop_null()
        return (known[-1].as_py(),) if len(known) else state

    def join(self, earlier, later):
        return later or earlier

    def values(self, state, batch, starts, begins):
        column, n = self._known(batch, starts, begins), batch.num_rows
        begin = np.repeat(starts, np.diff(np.append(starts, n)))
        at = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
        inside = at >= begin
        found = column.take(pa.array(np.where(inside, at, 0), mask=~inside)) if n else column
        if state:
            before = pa.array(~inside & (begin == 0))
            found = pc.if_else(before, pa.scalar(state[0], column.type), found)
        return found


@dataclass(frozen=True)
class SumSince:
    """Sum of ``amount`` (null: 0) since the last row with ``reset``, which counts 0; with
    ``first`` the key's first row is a reset too."""

    name: str
    amount: str
    reset: str
    first: bool = False
    sql_type: str = "double"

    def inputs(self):
        return [self.amount, self.reset]

    def empty(self):
        return (False, 0, 0, 0.0)

    def _parts(self, batch, starts, begins):
        amount, reset = np.nan_to_num(_floats(batch, self.amount), nan=0.0, posinf=np.inf, neginf=-np.inf), _flags(batch, self.reset).copy()
        if self.first:
            reset[starts if begins else starts[1:]] = True
        amount[reset] = 0.0
        large = np.abs(amount) >= LARGE
        scaled = np.where(large, 0.0, amount) * 2.0 ** HIGH_BITS
        whole = np.floor(scaled)
        return reset, whole.astype(np.int64), np.rint((scaled - whole) * 2.0 ** LOW_BITS).astype(np.int64), np.where(large, amount, 0.0)

    @staticmethod
    def _even(high, low):
        return high + (low >> LOW_BITS), low & ((1 << LOW_BITS) - 1)

    def state_after(self, state, batch, s, e, begins):
        reset, high, low, large = self._parts(batch.slice(s, e - s), np.array([0]), begins)
        marks = np.flatnonzero(reset)
        at = int(marks[-1]) if len(marks) else 0
        part = (bool(len(marks)), *self._even(int(high[at:].sum()), int(low[at:].sum())), float(large[at:].sum()))
        return self.join(state, part)

    def join(self, earlier, later):
        if later[0]:
            return later
        high, low = self._even(earlier[1] + later[1], earlier[2] + later[2])
        large = earlier[3] + later[3]
        return (earlier[0], 0, low, large + high * 2.0 ** -HIGH_BITS) if abs(high) > FULL else (earlier[0], high, low, large)

    def values(self, state, batch, starts, begins):
        reset, high, low, large = self._parts(batch, starts, begins)
        n = batch.num_rows
        cut = reset.copy()
        cut[starts] = True
        begin = np.maximum.accumulate(np.where(cut, np.arange(n), 0))
        sums = [c - c[begin] + x[begin] for x in (high, low) for c in (np.cumsum(x),)]
        with np.errstate(invalid="ignore"):
            c = np.cumsum(large)
            big = c - c[begin] + large[begin] if np.isfinite(c).all() else _restarted(large, cut)
        ends = starts[1] if len(starts) > 1 else n
        follows = (np.arange(n) < ends) & ~(np.maximum.accumulate(reset) if n else reset)
        sums[0] = sums[0] + np.where(follows, state[1], 0)
        sums[1] = sums[1] + np.where(follows, state[2], 0)
        big = big + np.where(follows, state[3], 0.0)
        high, low = self._even(*sums)
        return pa.array(big + (high * 2.0 ** -HIGH_BITS + low * 2.0 ** -(HIGH_BITS + LOW_BITS)))


def _restarted(values: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Running sums that begin anew at ``cut``, added up one by one."""
    return np.concatenate([np.cumsum(part) for part in np.split(values, np.flatnonzero(cut)[1:])])


@dataclass(frozen=True)
class RunningSum:
    """Sum of ``amount`` (null: 0) since the last row with ``reset``, which counts 0, in doubles and
    row by row: the bits of a loop over the key's rows.

    A state is (known, sum, amounts): the sum once the key's begin or a reset is known, else the
    amounts still to be added to it, in order. Only a key that goes through a whole range without
    reset leaves amounts; from ``HELD_ROWS`` on they are one exact sum, and last bits can differ.
    """

    name: str
    amount: str
    reset: str
    sql_type: str = "double"

    def inputs(self):
        return [self.amount, self.reset]

    def empty(self):
        return (False, 0.0, ())

    def _parts(self, batch):
        amount, reset = _floats(batch, self.amount), _flags(batch, self.reset)
        return np.where(reset | np.isnan(amount), 0.0, amount), reset

    def state_after(self, state, batch, s, e, begins):
        amount, reset = self._parts(batch.slice(s, e - s))
        marks = np.flatnonzero(reset)
        at = int(marks[-1]) if len(marks) else 0
        part = (False, 0.0, tuple(amount[at:].tolist()))
        return self.join((True, 0.0, ()) if begins or len(marks) else state, part)

    def join(self, earlier, later):
        if later[0]:
            return later
        if earlier[0]:
            return (True, float(np.cumsum((earlier[1], *later[2]))[-1]), ())
        held = (*earlier[2], *later[2])
        return (False, 0.0, held if len(held) <= HELD_ROWS else (_exact_sum(held),))

    def values(self, state, batch, starts, begins):
        amount, reset = self._parts(batch)
        cut = reset.copy()
        cut[starts] = True
        if not begins and len(amount) and not reset[0]:
            amount[0] = state[1] + amount[0]
        return pa.array(_restarted(amount, cut))


def _exact_sum(amounts) -> float:
    return math.fsum(amounts) if np.isfinite(amounts).all() else float(np.sum(amounts))


@dataclass(frozen=True)
class Fold:
    """State x -> clamp(a*x + b, lo, hi) after each row, from ``start`` (constant per key).

    A state is a level once the key's begin is known, else the four numbers of the composed step.
    Long keys are cut into lanes that advance side by side: their steps are composed first,
    combined by doubling, and then replayed from the levels in which they begin.
    """

    name: str
    start: str
    a: str = "a"
    b: str = "b"
    lo: str = "lo"
    hi: str = "hi"
    sql_type: str = "double"

    def inputs(self):
        return [self.start, self.a, self.b, self.lo, self.hi]

    def empty(self):
        return ("steps", (1.0, 0.0, -np.inf, np.inf))

    def _arrays(self, batch):
        return tuple(_floats(batch, c) for c in (self.a, self.b, self.lo, self.hi))

    def state_after(self, state, batch, s, e, begins):
        steps = tuple(x[s:e] for x in self._arrays(batch))
        if begins:
            state = ("level", float(_floats(batch.slice(s, 1), self.start)[0]))
        if state[0] == "level":
            return ("level", float(_replayed(steps, np.array([0]), np.array([state[1]]))[-1]))
        return ("steps", tuple(float(x) for x in _compose(state[1], tuple(x[-1] for x in _composed(steps, np.array([0]), e - s)))))

    def join(self, earlier, later):
        if later[0] == "level":
            return later
        if earlier[0] == "level":
            return ("level", float(_apply(later[1], earlier[1])))
        return ("steps", tuple(float(x) for x in _compose(earlier[1], later[1])))

    def values(self, state, batch, starts, begins):
        levels = _floats(batch, self.start)[starts].copy()
        if not begins:
            levels[0] = state[1]
        return pa.array(_replayed(self._arrays(batch), starts, levels))


def _apply(step, level):
    a, b, lo, hi = step
    return np.fmin(hi, np.fmax(lo, a * level + b))


def _compose(first, then):
    """The step of ``first`` followed by ``then``; numbers or arrays."""
    a, b, lo, hi = first
    with np.errstate(invalid="ignore"):
        ends = [np.where(then[0] == 0, then[1], then[0] * end + then[1]) for end in (lo, hi)]
    ends = [np.fmin(then[3], np.fmax(then[2], end)) for end in ends]
    return then[0] * a, then[0] * b + then[1], np.fmin(*ends), np.fmax(*ends)


def _lanes(starts: np.ndarray, rows: int):
    """Begins, lengths and owner (key number) of lanes of at most ``LANE_ROWS`` rows, longest first."""
    lengths = np.diff(np.append(starts, rows))
    count = -(-lengths // LANE_ROWS)
    owner = np.repeat(np.arange(len(starts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    begins = starts[owner] + nth * LANE_ROWS
    return begins, np.minimum(LANE_ROWS, lengths[owner] - nth * LANE_ROWS), owner, nth


def _composed(steps, starts, rows):
    """The composed step of each lane and of all lanes of its key before it, itself included."""
    begins, lengths, owner, nth = _lanes(starts, rows)
    order = np.argsort(-lengths, kind="stable")
    now = [np.full(len(order), x) for x in (1.0, 0.0, -np.inf, np.inf)]
    sizes = -np.sort(-lengths)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -j, side="left"))
        at = begins[order[:k]] + j
        for held, new in zip(now, _compose(tuple(x[:k] for x in now), tuple(x[at] for x in steps))):
            held[:k] = new
    lanes = [np.empty(len(order)) for _ in now]
    for lane, x in zip(lanes, now):
        lane[order] = x
    reach = 1
    while reach <= (int(nth.max()) if len(nth) else 0):  # doubling: what ``reach`` lanes before have come to
        on = np.flatnonzero(nth >= reach)
        joined = _compose(tuple(x[on - reach] for x in lanes), tuple(x[on] for x in lanes))
        for lane, x in zip(lanes, joined):
            lane[on] = x
        reach *= 2
    return tuple(lanes)


def _replayed(steps, starts, levels):
    """The level after each row of keys that begin at ``starts`` with ``levels``."""
    rows = len(steps[0])
    begins, lengths, owner, nth = _lanes(starts, rows)
    now = levels[owner].astype(np.float64)
    later = np.flatnonzero(nth > 0)
    if len(later):
        before = _composed(steps, starts, rows)
        now[later] = _apply(tuple(x[later - 1] for x in before), now[later])
    order = np.argsort(-lengths, kind="stable")
    sizes, now, out = lengths[order], now[order], np.empty(rows)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        k = int(np.searchsorted(-sizes, -j, side="left"))
        at = begins[order[:k]] + j
        now[:k] = _apply(tuple(x[at] for x in steps), now[:k])
        out[at] = now[:k]
    return out


# ------------------------------------------------------------------ the scan

def _keys_begin(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows at which another key begins, the first row included."""
    changed = np.zeros(batch.num_rows, bool)
    changed[:1] = True
    for key in keys:
        codes = batch.column(key).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        changed[1:] |= codes[1:] != codes[:-1]
    return np.flatnonzero(changed)


def _key_at(batch: pa.RecordBatch, keys: list[str], at: int) -> bytes:
    return repr([batch.column(k)[at].as_py() for k in keys]).encode()


def _last_keys(batches: Iterator[pa.RecordBatch], keys: list[str], steps) -> Iterator[pa.RecordBatch]:
    """One row for a range: its first and last key, and what the last one has come to in it. If
    that is its only key, it may begin here or before: ``begun`` holds what it has come to if it
    begins here, ``state`` else."""
    first = last = states = begun = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts, now = _keys_begin(batch, keys), _key_at(batch, keys, 0)
        if first is None:
            first, at = now, batch.column("_range")[0].as_py()
        if len(starts) > 1 or (last is not None and now != last):
            states = [step.state_after(step.empty(), batch, int(starts[-1]), n, True) for step in steps]
            begun = None
        elif last is None:
            states, begun = ([step.state_after(step.empty(), batch, 0, n, begins) for step in steps] for begins in (False, True))
        else:
            states, begun = ([step.state_after(state, batch, 0, n, False) for step, state in zip(steps, held)] if held else None
                             for held in (states, begun))
        last = _key_at(batch, keys, n - 1)
    if first is not None:
        yield pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int32()), *[pa.array([x], pa.binary()) for x in (first, last, pickle.dumps(states), pickle.dumps(begun))]],
            ["_range", "first", "last", "state", "begun"])


def _chained(batches: Iterator[pa.RecordBatch], steps) -> Iterator[pa.RecordBatch]:
    """The state in which the first key of each range enters it, for keys that come from before."""
    last, states, ranges, entering = None, None, [], []
    for batch in batches:
        for at, first, end, own, begun in zip(*(c.to_pylist() for c in batch.columns)):
            own, begun = pickle.loads(own), pickle.loads(begun)
            if first == last:
                ranges.append(at)
                entering.append(pickle.dumps(states))
                states = own if begun is None else [s.join(x, y) for s, x, y in zip(steps, states, own)]
            else:
                states = begun or own
            last = end
    yield pa.RecordBatch.from_arrays([pa.array(ranges, pa.int32()), pa.array(entering, pa.binary())], ["_of", "_enters"])


def _valued(batches: Iterator[pa.RecordBatch], keys: list[str], steps, kept: int) -> Iterator[pa.RecordBatch]:
    """The rows of a range with a column for each step."""
    last = states = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        starts, first = _keys_begin(batch, keys), _key_at(batch, keys, 0)
        if last is None and (entering := batch.column("_enters")[0].as_py()) is not None:
            states = pickle.loads(entering)
        elif first != last:
            states = None
        begins = states is None
        held = [step.empty() for step in steps] if begins else states
        added = [step.values(state, batch, starts, begins) for step, state in zip(steps, held)]
        if len(starts) > 1:
            held, begins = [step.empty() for step in steps], True
        states = [step.state_after(state, batch, int(starts[-1]), n, begins) for step, state in zip(steps, held)]
        last = _key_at(batch, keys, n - 1)
        yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *added], [*batch.schema.names[:kept], *[s.name for s in steps]])


def scan(df: DataFrame, keys: list[str], order: str, tie: list[str], steps: list, ranges: int | None = None) -> DataFrame:
    """``df`` with one column for each of ``steps``, by (order, tie) within ``keys``.

    Null keys are a key, null order values come first, rows that agree in order and tie follow
    the digest of their other columns. ``ranges`` is the number of parts, by default the width of
    the session's shuffles; the values do not depend on it (states of a `Fold` to their last
    bits: exact up to ``LANE_ROWS`` rows of a key).
    """
    rest = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    sort = [*keys, order, *tie, "_digest"]
    kept = len(df.columns)
    ranged = reliable_checkpoint(
        df.withColumn("_digest", F.xxhash64(*rest)).repartitionByRange(ranges or shuffle_width(df.sparkSession), *sort)
        .sortWithinPartitions(*sort).drop("_digest").withColumn("_range", F.spark_partition_id()))
    needed = dict.fromkeys([*keys, *[c for step in steps for c in step.inputs()]])
    ends = ranged.select(*needed, "_range").mapInArrow(
        lambda batches: _last_keys(batches, keys, steps), "_range int, first binary, last binary, state binary, begun binary")
    enters = ends.repartition(1).sortWithinPartitions("_range").mapInArrow(
        lambda batches: _chained(batches, steps), "_of int, _enters binary")
    entered = ranged.join(F.broadcast(enters), F.col("_range") == F.col("_of"), "left").drop("_range", "_of")
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], *[f"`{s.name}` {s.sql_type}" for s in steps]])
    return entered.mapInArrow(lambda batches: _valued(batches, keys, steps, kept), schema)


# ------------------------------------------------------------------ single steps

def row_index(df: DataFrame, keys: list[str], order: str, tie: list[str], name: str = "t",
              total: str | None = None, ranges: int | None = None) -> DataFrame:
    """Zero-based position of each row within its key; ``total`` adds the key's row count."""
    if total:
        counts = df.groupBy(*[F.col(k).alias(f"_of_{k}") for k in keys]).agg(F.count(F.lit(1)).alias(total))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
        df = df.join(counts, same).drop(*[f"_of_{k}" for k in keys])
        out = scan(df, keys, order, tie, [Position(name)], ranges)
        return out.select(*[c for c in out.columns if c not in (name, total)], name, total)
    return scan(df, keys, order, tie, [Position(name)], ranges)


def running_last(df: DataFrame, keys: list[str], order: str, tie: list[str],
                 values: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Last non-null value so far (this row included) of each expression."""
    given = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    types = {n: given.schema[f"_v_{n}"].dataType.simpleString() for n in values}
    return scan(given, keys, order, tie, [Last(n, f"_v_{n}", types[n]) for n in values], ranges).drop(*[f"_v_{n}" for n in values])


def sum_since_reset(df: DataFrame, keys: list[str], order: str, tie: list[str],
                    amount: str, reset: str, name: str, ranges: int | None = None) -> DataFrame:
    """Running sum of ``amount`` since the last row with ``reset``; zero on that row."""
    return scan(df, keys, order, tie, [SumSince(name, amount, reset)], ranges)


def running_sum(df: DataFrame, keys: list[str], order: str, tie: list[str],
                amount: str, reset: str, name: str, ranges: int | None = None) -> DataFrame:
    """The same sum with the bits of a loop that adds up row by row."""
    return scan(df, keys, order, tie, [RunningSum(name, amount, reset)], ranges)


def affine_fold(df: DataFrame, keys: list[str], order: str, tie: list[str], start: str,
                name: str = "level", ranges: int | None = None) -> DataFrame:
    """State after each row, for rows that carry step columns ``a, b, lo, hi``.

    ``start`` is the column with the initial state of the key (constant per key).
    Output: the input columns plus ``name``.
    """
    return scan(df, keys, order, tie, [Fold(name, start)], ranges)
