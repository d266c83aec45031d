"""Byte-level BPE over rank files: a segment tree holds the leftmost minimum pair rank.

The leaves of a tree are the byte positions of one pre-token; leaf i has the rank of the pair
that begins there. The root gives the best rank, the descent its leftmost position, and a merge
changes three leaves (the pair, its left neighbour, the part that went), each in logarithmic
time. Short pre-tokens run together, one tree per lane of an array.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column_parts, text_or_empty, text_parts

NONE = np.int32(2**31 - 1)
CACHED = 100_000
LONG = 512
PASS_CHARS = 500_000
#: Fixed value: the pattern that splits a text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@lru_cache(maxsize=2)
def parts(path: str) -> list[bytes]:
    """The bytes of every id."""
    ranks = read_ranks(path)
    out = [b""] * (max(ranks.values()) + 1)
    for part, rank in ranks.items():
        out[rank] = part
    return out


class Merger:
    """Merges pre-tokens by the ranks of a file of ``base64 rank`` lines; ids are ranks."""

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        ranks = self.ranks
        found = np.fromiter((v for p, rank in ranks.items() for i in range(1, len(p)) if p[:i] in ranks and p[i:] in ranks
                             for v in (ranks[p[:i]] << 32 | ranks[p[i:]], rank)), np.int64).reshape(-1, 2)
        found = found[np.argsort(found[:, 0])]
        self.keys, self.values = found[:, 0].copy(), found[:, 1].astype(np.int32)
        self.bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)

    @lru_cache(maxsize=1)  # noqa: B019 - long pre-tokens are rare; short ones search the arrays
    def pairs(self) -> dict[int, int]:
        return dict(zip(self.keys.tolist(), self.values.tolist()))

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], NONE)

    def merge_lanes(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Ids per word of at most ``width`` (a power of two) bytes; one tree per lane."""
        lanes, span = len(words), 2 * width
        lengths = np.fromiter(map(len, words), np.int64, lanes)
        inside = np.arange(width) < lengths[:, None]
        ids = np.zeros((lanes, width + 1), np.int32)
        ids[:, :width][inside] = self.bytes[np.frombuffer(b"".join(words), np.uint8)]
        tree = np.full((lanes, span), NONE, np.int32)
        pair = np.arange(width - 1) < (lengths - 1)[:, None]
        tree[:, width:span - 1][pair] = self.pair_ranks(ids[:, :width - 1][pair], ids[:, 1:width][pair])
        level = width
        while level > 1:
            tree[:, level // 2:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
            level //= 2
        after = np.repeat(np.arange(1, width + 2)[None], lanes, axis=0)
        before = np.repeat(np.arange(-1, width)[None], lanes, axis=0)
        alive = inside.copy()
        leaves, ids_, after, before, ends = tree.ravel(), ids.ravel(), after.ravel(), before.ravel(), lengths
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            root, base, flat = live * span, live * (width + 1), live * width
            best = leaves[root + 1]
            node = np.ones(len(live), np.int64)
            level = 1
            while level < width:
                node = 2 * node
                node += leaves[root + node] != best
                level *= 2
            at = node - width
            gone = after[base + at]
            follows = after[base + gone]
            ids_[base + at] = best
            after[base + at] = follows
            before[base + np.minimum(follows, width)] = at
            alive.ravel()[flat + gone] = False
            end = ends[live]
            leaves[root + width + gone] = NONE
            right = np.where(follows < end, self.pair_ranks(best, ids_[base + np.minimum(follows, width)]), NONE)
            leaves[root + node] = right
            previous = before[base + at]
            has = previous >= 0
            previous = np.where(has, previous, at)
            leaves[root + width + previous] = np.where(has, self.pair_ranks(ids_[base + previous], best), right)
            nodes = np.stack([node, width + gone, width + previous])
            while level > 1:
                nodes >>= 1
                where = root + 2 * nodes
                leaves[root + nodes] = np.minimum(leaves[where], leaves[where + 1])
                level //= 2
            live = live[leaves[root + 1] != NONE]
        counts = alive.sum(axis=1)
        return np.split(ids[:, :width][alive], np.cumsum(counts)[:-1])

    def merge_long(self, word: bytes) -> np.ndarray:
        """The same for one long pre-token."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        ids, none, pairs = [self.ranks[bytes([b])] for b in word], int(NONE), self.pairs()
        tree = [none] * (2 * width)
        tree[width:width + n - 1] = [pairs.get(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(leaf: int, rank: int) -> None:
            node = width + leaf
            tree[node] = rank
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] != none:
            best, node = tree[1], 1
            while node < width:
                node = 2 * node + (tree[2 * node] != best)
            at = node - width
            gone = after[at]
            follows = after[gone]
            ids[at], after[at], ids[gone] = best, follows, -1
            put(gone, none)
            if follows < n:
                before[follows] = at
            put(at, pairs.get(best << 32 | ids[follows], none) if follows < n else none)
            if before[at] >= 0:
                put(before[at], pairs.get(ids[before[at]] << 32 | best, none))
        return np.array([i for i in ids if i >= 0], np.int32)

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids per pre-token; one that is a part as a whole is that part."""
        out: list[bytes] = [b""] * len(words)
        lanes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            rank = self.ranks.get(word)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            elif len(word) > LONG:
                out[i] = self.merge_long(word).astype("<u4").tobytes()
            elif word:
                lanes.setdefault(1 << (len(word) - 1).bit_length(), []).append(i)
        for width, own in lanes.items():
            step = max(1, (1 << 18) // width)
            for k in range(0, len(own), step):
                part = own[k:k + step]
                for i, ids in zip(part, self.merge_lanes([words[i] for i in part], width)):
                    out[i] = ids.astype("<u4").tobytes()
        return out


@lru_cache(maxsize=2)
def merger(path: str) -> Merger:
    return Merger(path)


class Encoder:
    """Encodes texts; remembers a bounded number of words.

    A space between two characters that are no white space always begins a match of the
    pattern, so the pieces between such spaces are independent and may be remembered whole.
    """

    def __init__(self, path: str, pattern: str = PATTERN):
        self.merger, self.find = merger(path), regex.compile(pattern).findall
        self.spaced: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, strings: list[str]) -> list[bytes]:
        """Ids of each string, split by the pattern; new words are merged together."""
        split = [self.find(s) for s in strings]
        new = list({w for ws in split for w in ws if w not in self.words})
        self.words.update(zip(new, self.merger.encode_words([w.encode() for w in new])))
        return [b"".join([self.words[w] for w in ws]) for ws in split]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.spaced) > CACHED:
            self.spaced = {}
        if len(self.words) > CACHED:
            self.words = {}
        split, plain = [], []
        for i, text in enumerate(texts):
            pieces = text.split(" ")
            if all(p and not p[0].isspace() and not p[-1].isspace() for p in pieces if p not in self.spaced):
                split.append((i, pieces))
            else:
                plain.append(i)
        new = list({p for _, pieces in split for p in pieces[1:] if p not in self.spaced})
        self.spaced.update(zip(new, self._learn([" " + p for p in new])))
        out = [b""] * len(texts)
        for i, ids in zip(plain, self._learn([texts[i] for i in plain])):
            out[i] = ids
        firsts = self._learn([pieces[0] for _, pieces in split])
        for (i, pieces), first in zip(split, firsts):
            out[i] = first + b"".join([self.spaced[p] for p in pieces[1:]])
        return out


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of every whole text as little-endian 32-bit integers (binary).

    A null text is encoded as an empty one and has no ids; an endless pre-token is merged whole;
    rows, repeated ones too, stay; an existing column ``out`` is replaced. ``path``: a rank file
    that every executor can read.
    """
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(path)
        for texts in batches:
            yield pd.Series([ids for part in text_parts(texts.tolist()) for ids in encoder.encode(part)], dtype=object)

    return docs.withColumn(out, F.pandas_udf(run, "binary")(text_or_empty(text)))


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the bytes that the ids stand for (binary); null ids give empty bytes."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        part = parts(path).__getitem__
        for rows in batches:
            yield pd.Series([b"".join(map(part, np.frombuffer(r, "<u4").tolist())) for r in rows], dtype=object)

    return tokens.withColumn(out, F.pandas_udf(run, "binary")(F.coalesce(F.col(ids), F.lit(b""))))


def _passes(path: str, kept: int, names: list[str], with_ids: bool):
    """A pass over (``kept`` columns, text): texts encoded, the ids decoded, both digested, some rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder(path), parts(path).__getitem__
        for batch in batches:
            at = 0
            for some in column_parts(batch.column(kept), PASS_CHARS):
                rows = []
                for ids in encoder.encode(some):
                    decoded = b"".join(map(part, np.frombuffer(ids, "<u4").tolist()))
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids))
                n, of_ids, of_decoded, ids = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [*[c.slice(at, len(rows)) for c in batch.columns[:kept]], pa.array(n, pa.int64()), pa.array(of_ids, pa.string()),
                     pa.array(of_decoded, pa.string()), *([pa.array(ids, pa.binary())] if with_ids else [])],
                    [*names, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])
                at += len(rows)

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of ``docs`` (doc_id, text).

    One Python pass encodes, decodes the ids and digests both, so ids and decoded texts
    never travel; a null text counts as an empty one, an endless pre-token is merged whole,
    repeated rows stay.
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(
        _passes(path, 1, ["doc_id"], False), f"doc_id {doc_id}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id", "source", "lang")) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, and n_tokens, ids (little-endian unsigned 32-bit
    integers), and the digests of the ids and of what they decode to. Rows as in `round_trip`."""
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text_or_empty().alias("text")).mapInArrow(
        _passes(path, len(keep), list(keep), True), f"{types}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary")
