"""Adaptive context-mixing range coder for token ids, many blocks at a time.

Every block starts from the same model. The ids last seen after one and after two ids propose
the next id; a logistic mixer over how often such proposals held and the order-0 share of the
proposed id gives the odds that it comes. If it doesn't, the id is coded by order-0 counts of
whole ids, or, if these don't hold it, as a new one by a fixed law that favours small ids. The
counts of whole ids are those of the block so far, brought up to date at the places ``RENEWED``;
the mixer learns after ``LEARN_FIRST`` ids and then after every ``LEARN_MOST``.
All model arithmetic is in integers and tables of integers, so that any machine decodes what
another one wrote. Blocks run in step, one lane each, the longest first.
"""

from __future__ import annotations

import math
import zlib

import numpy as np

BLOCK, LANES = 4096, 2048
MOST_IDS = 1 << 16
SLOTS = 1024
RENEWED = (32, 64, 128, 256, 512, 1024, 1536, 2048, 3072)
TOP, LOW, EMPTIED = 62, 46, 512
REST = (1 << LOW) - 1
NEW_BITS = 20

_P = np.arange(4096)
STRETCH = np.array([round(256 * math.log((p + 0.5) / (4095.5 - p))) for p in _P], np.int32)
SQUASH = np.array([min(64000, max(500, round(65536 / (1 + math.exp(-x / 256))))) for x in range(-2400, 2401)], np.int32)


def _new_law() -> np.ndarray:
    """Ends of the ranges of new ids, of 2**20: odds fall with the id, none is below 1 in 2**20."""
    spare = (1 << NEW_BITS) - MOST_IDS
    ends = [i + round(spare * math.log((i + 256) / 256) / math.log((MOST_IDS + 256) / 256)) for i in range(MOST_IDS + 1)]
    return np.array(ends, np.int64)


NEW_ENDS = _new_law()
NEW_IDS = np.repeat(np.arange(MOST_IDS, dtype=np.uint16), np.diff(NEW_ENDS))

# Order-0 shares of 1024 in four degrees.
DEGREES = np.array([min(3, max(0, n.bit_length() // 2 - 1)) << 18 for n in range(1025)], np.int64)
# A state of a proposal: whether order 1 names another id, order-0 degree, trust of order 2, trust of order 1.
STATES, SIDES, LEARN_FIRST, LEARN_MOST = 128, (2, 4, 4, 4), (8, 16, 32, 64, 128, 256), 256
FIRST_ODDS = np.array([64, 800, 1600, 2400, 64, 600, 800, 900, 64, 1000, 2200, 3000, 400, 800, 1600, 2400], np.int64)
# The parts of a state: of order 1 (by trust and whether it names another), of order 2, of order 0.
ORDER_STARTS, ORDER_OF = [0, 8, 12], np.repeat([0, 1, 2], [8, 4, 4])


def by_part(values: np.ndarray) -> np.ndarray:
    """Sums over the states of each part; rows are lanes."""
    sides = values.reshape(len(values), *SIDES)
    pairs = sides.sum(axis=2)
    return np.concatenate([pairs.sum(axis=2).reshape(-1, 8), pairs.sum(axis=(1, 3)), sides.sum(axis=(1, 3, 4))], axis=1)


def order_0(seen: np.ndarray, half: np.ndarray):
    """Counts of whole ids per lane (row), ``half`` being the distinct ids at the renewal before:
    ``count << 40 | place << 24 | degree << 18 | id`` of the ids in order, those of a lane followed
    by an entry that stands for a new id; the counts; the sums of a lane; its distinct ids."""
    lanes, n = seen.shape
    ids = np.zeros((lanes, n + 1), np.uint16)
    ids[:, :n] = seen
    ids[:, :n].sort(axis=1, kind="stable")
    first = np.ones(ids.shape, bool)
    np.not_equal(ids[:, 1:n], ids[:, :n - 1], out=first[:, 1:n])
    distinct = first.sum(axis=1) - 1
    share = 2 * (distinct - half) + 1
    starts = np.flatnonzero(first)
    counts = np.diff(starts, append=ids.size)
    packed = counts << 40 | starts % (n + 1) << 24 | DEGREES.take((counts << 10) // n) | ids.take(starts)
    packed[np.cumsum(distinct + 1) - 1] = share << 40 | n << 24
    return packed, counts, n + share, distinct


class Model:
    """State of ``lanes`` blocks; calls work on the first ``k`` lanes."""

    def __init__(self, lanes: int):
        order, lane = np.arange(2)[:, None], np.arange(lanes)
        # Per order (1, 2), lane and slot: order-0 degree of the id << 18, how often it held << 16,
        # and the id; 0: nothing seen.
        self.slot_base = (order * lanes + lane) * SLOTS
        self.seen = np.zeros(2 * lanes * SLOTS, np.int32)
        self.at = self.slot_base.copy()
        self.last = np.zeros(lanes, np.int64)
        self.state_base = (lane * STATES).astype(np.int32)
        # Per lane and part of the state, in sixteenths: proposals met and those that came.
        self.met = np.full((lanes, len(FIRST_ODDS)), 1 << 8)
        self.came = np.tile(FIRST_ODDS >> 4, (lanes, 1))
        self.weights = np.tile(np.array([20000, 20000, 6000]), (lanes, 1))
        self.odds = np.zeros((lanes, STATES), np.int32)
        self.log = np.zeros((LEARN_MOST, lanes), np.uint8)
        self.logged = self.step = 0
        self._mix(lanes)

    def _mix(self, k: int) -> None:
        """Odds of every state by the logistic mix of its parts."""
        self.inputs = STRETCH.take((self.came << 12) // self.met, mode="clip").astype(np.int64)
        parts = self.inputs[:k] * self.weights[:k].take(ORDER_OF, axis=1)
        mixed = parts[:, :8].reshape(k, 2, 1, 1, 4) + (
            parts[:, 12:].reshape(k, 1, 4, 1, 1) + parts[:, 8:12].reshape(k, 1, 1, 4, 1))
        self.odds[:k] = SQUASH.take((mixed >> 15) + 2400, mode="clip").reshape(k, STATES)

    def _learn(self, k: int) -> None:
        """Learn weights and rates of parts from the steps logged since the last time."""
        keys = self.log[:self.logged, :k] + (np.arange(k) * (2 * STATES))
        counts = np.bincount(keys.ravel(), minlength=2 * STATES * k).reshape(k, 2, STATES)
        came, met = counts[:, 1], counts.sum(axis=1)
        slope = (self.inputs[:k] * by_part((came << 16) - met * self.odds[:k])) >> 16
        weights = self.weights[:k]
        weights += np.add.reduceat(slope, ORDER_STARTS, axis=1)
        np.clip(weights, 0, 1 << 16, out=weights)
        self.came[:k] += by_part(came) << 4
        self.met[:k] += by_part(met) << 4
        full = (self.met > 1 << 13).astype(np.int64)
        self.met >>= full
        self.came >>= full
        self._mix(k)
        self.logged = 0

    def predict(self, k: int):
        """(proposed id, odds of 65536 that it comes)."""
        at = self.at[:, :k]
        seen = self.seen[at]
        first, second = seen
        best = np.where(second, second, first)
        state = (first >> 16) & 3
        state += (second >> 14) & 12
        state += (best >> 14) & 48
        state += (((first ^ best) & 0xFFFF) != 0).astype(np.int32) << 6
        odds = self.odds.take(self.state_base[:k] + state)
        self.kept = (k, at, seen, best, state)
        return best & 0xFFFF, odds

    def update(self, entry: np.ndarray, hit: np.ndarray) -> None:
        """Learn from ids with their order-0 degrees: ``entry`` as in ``seen`` with trust 0."""
        k, at, seen, best, state = self.kept
        self.log[self.logged, :k] = state + (hit.astype(np.int32) << 7)
        actual = entry & 0xFFFF
        own = (seen & 0xFFFF) == actual
        seen &= 0x30000
        seen += 0x10000
        np.minimum(seen, 0x30000, out=seen)
        seen *= own.astype(np.int32)
        np.maximum(seen, 0x10000, out=seen)
        seen += entry
        self.seen[at] = seen
        wide = actual.astype(np.int64)
        mixed = wide * 0x9E3779B1
        at[0] = mixed >> 15
        at[1] = (mixed + self.last[:k]) >> 17
        at &= SLOTS - 1
        at += self.slot_base[:, :k]
        np.multiply(wide, 0x27D4EB2F, out=self.last[:k])
        self.step += 1
        self.logged += 1
        if self.logged == LEARN_MOST or self.step in LEARN_FIRST:
            self._learn(k)


def _in_step(lengths: np.ndarray):
    """(step, lanes that still have an id) for lengths in falling order."""
    ends = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), side="left")
    return enumerate(ends.tolist())


def _places(rows: np.ndarray, begin: int, half: np.ndarray):
    """From one renewal to the next: by step and lane, the entry of the id in the order-0 counts,
    that of new ids if they don't hold it; the sums of the counts; the distinct ids."""
    end = min([p for p in RENEWED if p > begin] + [rows.shape[1]])
    packed, _, sums, distinct = order_0(rows[:, :begin], half)
    held, upto = packed & 0xFFFF, np.cumsum(distinct + 1).tolist()
    out, found = np.zeros((end - begin, len(rows)), np.int64), np.empty(MOST_IDS, np.uint16)
    for at in range(0, len(rows), 16):
        part = np.empty((min(16, len(rows) - at), end - begin), np.int64)
        for i, row in enumerate(part, at):
            ids, own = rows[i, begin:end].astype(np.int64), slice(upto[i - 1] if i else 0, upto[i])
            size = own.stop - own.start - 1
            found[ids] = size
            found[held[own][:size]] = np.arange(size)
            packed[own].take(found.take(ids), out=row, mode="clip")
        out[:, at:at + len(part)] = part.T
    return out, sums, distinct


def encode_lanes(blocks: list[np.ndarray]) -> list[bytes]:
    """Payloads of blocks given by falling length."""
    lengths = np.array([len(b) for b in blocks])
    lanes, steps = len(blocks), int(lengths[0])
    rows = np.zeros((lanes, steps), np.uint16)
    for i, block in enumerate(blocks):
        rows[i, :len(block)] = block
    ids = np.ascontiguousarray(rows.T)
    # Words are kept with the carry they give to the word before; they leave ``out`` at times.
    width = 3 * EMPTIED + 8
    out, written = np.zeros(lanes * width, np.int32), [[np.zeros(1, np.int32)] for _ in range(lanes)]
    home = np.arange(lanes) * width
    pos, low, span = home.copy(), np.zeros(lanes, np.int64), np.full(lanes, 1 << TOP, np.int64)
    model, counted, total, distinct = Model(lanes), 0, None, np.zeros(lanes, np.int64)

    def empty():
        for words, begin, end in zip(written, home.tolist(), pos.tolist()):
            if end > begin:
                words.append(out[begin:end].copy())
        pos[:] = home

    for step, k in _in_step(lengths):
        if step in RENEWED:
            counted = step
            places, total, distinct = _places(rows[:k], step, distinct[:k])
        if step and not step % EMPTIED:
            empty()
        actual = ids[step, :k].astype(np.int32)
        proposed, odds = model.predict(k)
        hit = actual == proposed
        part = span[:k] >> 16
        limit = part * odds.astype(np.int64)
        entry = actual | model.kept[3] & 0xC0000
        miss = np.flatnonzero(~hit)
        if len(miss):
            values = actual.take(miss)
            begin, wide = low.take(miss), (part << 16).take(miss)
            skip = limit.take(miss)
            begin += skip
            wide -= skip
            if counted:
                place = places[step - counted].take(miss)
                before = (place >> 24) & 0xFFFF
                wide //= total.take(miss)
                begin += wide * before
                wide *= place >> 40
                late = np.flatnonzero(before == counted)
                entry[miss] = values | (place & 0xC0000).astype(np.int32)
            else:
                late = np.arange(len(miss))
                entry[miss] = values
            if len(late):
                values = values.take(late)
                unit, ends = wide.take(late) >> NEW_BITS, NEW_ENDS.take(values)
                begin[late] += unit * ends
                wide[late] = unit * (NEW_ENDS.take(values + 1) - ends)
            low[miss] = begin
            limit[miss] = wide
        span[:k] = limit
        model.update(entry, hit)
        short = np.flatnonzero(limit < 1 << LOW)
        while len(short):
            where, value, wide = pos.take(short), low.take(short), span.take(short) << 16
            out[where] = value >> LOW
            low[short] = (value & REST) << 16
            span[short] = wide
            pos[short] = where + 1
            short = short[wide < 1 << LOW]
    empty()
    payloads = []
    for i in range(lanes):
        words = np.concatenate([*written[i], [low[i] >> LOW, *((low[i] >> s) & 0xFFFF for s in (30, 14)), low[i] << 2 & 0xFFFF]])
        while (over := words >> 16).any():
            words = (words & 0xFFFF) + np.concatenate([over[1:], [0]])
        payloads.append(words[1:].astype("<u2").tobytes())
    return payloads


def decode_lanes(payloads: list[bytes], lengths: np.ndarray) -> list[np.ndarray]:
    """Ids of blocks given by falling length."""
    lanes, steps = len(payloads), int(lengths[0])
    words = [np.frombuffer(p, "<u2") for p in payloads]
    width = max(map(len, words)) + 4
    flat = np.zeros(lanes * width, np.uint16)
    for i, w in enumerate(words):
        flat[i * width:i * width + len(w)] = w
    pos = np.arange(lanes) * width
    first = [flat[pos + i].astype(np.int64) for i in range(4)]
    code, span = first[0] << 46 | first[1] << 30 | first[2] << 14 | first[3] >> 2, np.full(lanes, 1 << TOP, np.int64)
    # These are 62 bits, so the words that follow begin two bits before the stored ones.
    flat[:-1] = flat[:-1] << 14 | flat[1:] >> 2
    pos += 3
    model, ids = Model(lanes), np.zeros((steps, lanes), np.uint16)
    counted, total, distinct, lane = 0, None, np.zeros(lanes, np.int64), np.arange(lanes)

    for step, k in _in_step(lengths):
        if step in RENEWED:
            counted = step
            packed, counts, total, distinct = order_0(ids[:step, :k].T, distinct[:k])
            held = np.repeat(packed, counts)
        proposed, odds = model.predict(k)
        part = span[:k] >> 16
        limit = part * odds.astype(np.int64)
        hit = code[:k] < limit
        entry = model.kept[3] & 0xCFFFF
        miss = np.flatnonzero(~hit)
        if len(miss):
            rest, wide = code.take(miss), (part << 16).take(miss)
            skip = limit.take(miss)
            rest -= skip
            wide -= skip
            if counted:
                wide //= total.take(miss)
                at = rest // wide
                np.minimum(at, counted, out=at)
                at += lane.take(miss) * (counted + 1)
                place = held.take(at)
                before = (place >> 24) & 0xFFFF
                rest -= wide * before
                wide *= place >> 40
                late = np.flatnonzero(before == counted)
                entry[miss] = place & 0xCFFFF
            else:
                late = np.arange(len(miss))
            if len(late):
                unit, left = wide.take(late) >> NEW_BITS, rest.take(late)
                values = NEW_IDS.take(left // unit, mode="clip")
                ends = NEW_ENDS.take(values)
                rest[late] = left - unit * ends
                wide[late] = unit * (NEW_ENDS.take(values + np.int32(1)) - ends)
                entry[miss.take(late)] = values
            code[miss] = rest
            limit[miss] = wide
        ids[step, :k] = entry & 0xFFFF
        span[:k] = limit
        model.update(entry, hit)
        short = np.flatnonzero(limit < 1 << LOW)
        while len(short):
            where, wide = pos.take(short), span.take(short) << 16
            code[short] = code.take(short) << 16 | flat.take(where).astype(np.int64)
            span[short] = wide
            pos[short] = where + 1
            short = short[wide < 1 << LOW]
    return [ids[:n, i].astype(np.uint32) for i, n in enumerate(lengths.tolist())]


def _by_length(sizes: list[int]):
    order = np.argsort(-np.array(sizes), kind="stable")
    return [order[i:i + LANES] for i in range(0, len(order), LANES)]


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Payload per block: two checksums (of the ids, of the code), then the code."""
    out: list[bytes] = [b""] * len(blocks)
    if any(len(b) and int(b.max()) >= MOST_IDS for b in blocks):
        raise ValueError(f"ids must be under {MOST_IDS}")
    for lanes in _by_length([len(b) for b in blocks]):
        for i, code in zip(lanes.tolist(), encode_lanes([blocks[i] for i in lanes])):
            sums = zlib.crc32(blocks[i].astype("<u4").tobytes()), zlib.crc32(code)
            out[i] = b"".join(s.to_bytes(4, "little") for s in sums) + code
    return out


def decode_blocks(payloads: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """Ids per block; a wrong checksum raises ValueError."""
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(payloads)
    for lanes in _by_length(lengths):
        codes = [payloads[i][8:] for i in lanes]
        if any(zlib.crc32(c) != int.from_bytes(payloads[i][4:8], "little") for i, c in zip(lanes, codes)):
            raise ValueError("a block of ids is damaged")
        for i, ids in zip(lanes.tolist(), decode_lanes(codes, np.array([lengths[i] for i in lanes]))):
            if zlib.crc32(ids.astype("<u4").tobytes()) != int.from_bytes(payloads[i][:4], "little"):
                raise ValueError("a block of ids doesn't decode to what was written")
            out[i] = ids
    return out
