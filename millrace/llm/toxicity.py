"""Toxicity scores of a small bidirectional gated recurrent network, trained in numpy.

A word enters as a learned vector of the word and the mean of learned vectors of its character
groups, so that unseen forms of a known stem are recognised. Texts are cut into overlapping
windows; attention pools the states of a window, and a text scores as its worst window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import column_parts, fresh, text_or_empty

WINDOW, STRIDE = 32, 24
WORD_BUCKETS, GROUP_BUCKETS = 1 << 14, 1 << 16
WORD_DIM, GROUP_DIM, HIDDEN, ATTENTION = 8, 24, 8, 8
GROUP_SIZES = (3, 4, 5)
EDGE = ".,;:!?\"'()[]{}<>*#$%&_-"
CACHED_WORDS = 50_000
PASS_CHARS, PASS_WINDOWS = 500_000, 1024


@dataclass(frozen=True)
class Sample:
    """Bounds of the labelled rows that are read for training: at most ``per_label`` texts of
    each label, none longer than ``most_chars`` characters. Scores cover all texts whole."""

    per_label: int = 700
    most_chars: int = 4000
    steps: int = 264
    seed: int = 7


def held_out(column: Column) -> Column:
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, buckets of their character groups one word after the other, and the
    groups' number per word; case and punctuation at the ends don't count. Groups are runs of
    UTF-8 bytes of the framed word, hashed for all words at once."""
    plain = [(w.lower().strip(EDGE) or w).encode("utf-8", "replace") for w in words]
    whole = np.fromiter((zlib.crc32(w) for w in plain), np.int64, len(plain)) % WORD_BUCKETS
    lengths = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
    framed = np.frombuffer(b"<" + b"><".join(plain) + b">", np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(plain)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(framed))
    groups, owners = [], []
    for size in GROUP_SIZES:
        mixed = np.full(len(framed), size, np.uint32)
        for k in range(size):
            mixed = (mixed ^ np.roll(framed, -k)) * np.uint32(0x01000193)
        inside = left >= size
        groups.append(((mixed ^ (mixed >> np.uint32(15)))[inside] % np.uint32(GROUP_BUCKETS)).astype(np.int64))
        owners.append(owner[inside])
    owner = np.concatenate(owners)
    return whole, np.concatenate(groups)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(plain))


def window_starts(words: int) -> range:
    """Every STRIDE words a window begins, until one reaches the end; a text without words has one."""
    return range(0, max(words - WINDOW, 0) + STRIDE if words > WINDOW else 1, STRIDE)


def inputs(words: np.ndarray, groups: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Rows of the words' vectors beside the scaled sums of their groups' vectors."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scale = (1 / np.sqrt(sizes)).astype(np.float32)[:, None]
    return np.concatenate([words, np.add.reduceat(groups, starts) * scale], axis=1)


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    """Parameters by name; ``dir`` 0 reads forward, 1 backward. Gate order: update, reset, new."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        inputs, gates = WORD_DIM + GROUP_DIM, 3 * HIDDEN

        def draw(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": draw(WORD_BUCKETS, WORD_DIM, scale=0.02), "group": draw(GROUP_BUCKETS, GROUP_DIM, scale=0.02),
                  "va": draw(ATTENTION, scale=0.3), "ba": np.zeros(ATTENTION, np.float32),
                  "wa": draw(2 * HIDDEN, ATTENTION, scale=0.3), "wo": draw(2 * HIDDEN, scale=0.5),
                  "bo": np.full(1, -1, np.float32)}
        for d in (0, 1):
            self.p |= {f"w{d}": draw(inputs, gates, scale=0.4), f"u{d}": draw(HIDDEN, gates, scale=0.3),
                       f"b{d}": np.zeros(gates, np.float32)}

    def embed(self, words: list[str]) -> np.ndarray:
        buckets, groups, sizes = word_features(words)
        return inputs(self.p["word"][buckets], self.p["group"][groups], sizes)

    def project(self, x: np.ndarray) -> list[np.ndarray]:
        return [x @ self.p[f"w{d}"] + self.p[f"b{d}"] for d in (0, 1)]

    def _run(self, d: int, gates: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """States (time, window, HIDDEN) over gate inputs (time, window, 3 HIDDEN)."""
        u, n = self.p[f"u{d}"], HIDDEN
        states = np.zeros((len(gates), gates.shape[1], n), np.float32)
        h = np.zeros((gates.shape[1], n), np.float32)
        for t in range(len(gates)) if d == 0 else range(len(gates) - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(gates[t, :, :2 * n] + hu[:, :2 * n])
            z, r = zr[:, :n], zr[:, n:]
            c = np.tanh(gates[t, :, 2 * n:] + r * hu[:, 2 * n:])
            if keep is not None:
                keep.append((t, h, z, r, c, hu[:, 2 * n:]))
            h = (c + z * (h - c)) * mask[t][:, None]
            states[t] = h
        return states

    def logits(self, gates: list[np.ndarray], mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        kept = [None, None] if keep is None else [[], []]
        h = np.concatenate([self._run(d, gates[d], mask, kept[d]) for d in (0, 1)], axis=2)
        e = np.tanh(h @ self.p["wa"] + self.p["ba"])
        scores = e @ self.p["va"] + (mask - 1) * 30
        weights = np.exp(scores - scores.max(axis=0))
        weights = weights * mask
        weights /= np.maximum(weights.sum(axis=0), 1e-9)
        pooled = np.einsum("tb,tbh->bh", weights, h)
        if keep is not None:
            keep += [kept, h, e, weights, pooled]
        return pooled @ self.p["wo"] + self.p["bo"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, d_logit: np.ndarray, keep: list):
        """Of the parameters but the embeddings, and of the inputs ``x`` (time, window, input)."""
        (kept, h, e, weights, pooled), p, n = keep, self.p, HIDDEN
        g = {"wo": pooled.T @ d_logit, "bo": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["wo"]
        d_weights = np.einsum("bh,tbh->tb", d_pooled, h)
        d_h = weights[:, :, None] * d_pooled
        d_scores = weights * (d_weights - (weights * d_weights).sum(axis=0))
        g["va"] = np.einsum("tb,tba->a", d_scores, e)
        d_e = d_scores[:, :, None] * p["va"] * (1 - e * e)
        g["wa"], g["ba"] = np.einsum("tbh,tba->ha", h, d_e), d_e.sum(axis=(0, 1))
        d_h = d_h + d_e @ p["wa"].T
        d_x = np.zeros_like(x)
        for d in (0, 1):
            u, d_next = p[f"u{d}"], np.zeros((x.shape[1], n), np.float32)
            g |= {f"w{d}": np.zeros_like(p[f"w{d}"]), f"u{d}": np.zeros_like(u), f"b{d}": np.zeros_like(p[f"b{d}"])}
            for t, h0, z, r, c, hc in reversed(kept[d]):
                dh = (d_h[t, :, d * n:(d + 1) * n] + d_next) * mask[t][:, None]
                da_c = dh * (1 - z) * (1 - c * c)
                da_z = dh * (h0 - c) * z * (1 - z)
                da_r = da_c * hc * r * (1 - r)
                into_x = np.concatenate([da_z, da_r, da_c], axis=1)
                into_u = np.concatenate([da_z, da_r, da_c * r], axis=1)
                g[f"w{d}"] += x[t].T @ into_x
                g[f"b{d}"] += into_x.sum(axis=0)
                g[f"u{d}"] += h0.T @ into_u
                d_x[t] += into_x @ p[f"w{d}"].T
                d_next = dh * z + into_u @ u.T
        return g, d_x


def train(texts: list[str], labels: list[int], sample: Sample = Sample()) -> Network | None:
    """Fit on whole texts, and an empty one as clean, by the worst windows of each; None if a
    label is missing.

    The loss of a text goes to its windows by the softmax of their logits, and Adam moves all
    parameters, embeddings included. The order of texts and the seed fix the result.
    """
    if len(set(labels)) < 2:
        return None
    texts, labels = [*texts, ""], [*labels, 0]
    net, rng, where = Network(sample.seed), np.random.default_rng(sample.seed), {"<>": 0}
    rows, owner = [], []
    for i, text in enumerate(texts):
        ids = []
        for w in text.split():
            ids.append(where.setdefault(w, len(where)))
        for s in window_starts(len(ids)):
            part = ids[s:s + WINDOW]
            rows.append(part + [0] * (WINDOW - len(part)))
            owner.append(i)
    windows, owner = np.array(rows), np.array(owner)
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    buckets, flat, sizes = word_features(list(where))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    y = np.array(labels, np.float32)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    while step < sample.steps:
        order = rng.permutation(len(texts))
        for at in range(0, len(order), 32):
            docs = order[at:at + 32]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in docs])
            ids, inverse = np.unique(windows[rows], return_inverse=True)
            inverse = inverse.reshape(len(rows), WINDOW).T
            pick = np.concatenate([np.arange(begins[i], begins[i + 1]) for i in ids])
            counts = sizes[ids]
            scale = (1 / np.sqrt(counts)).astype(np.float32)[:, None]
            table = inputs(net.p["word"][buckets[ids]], net.p["group"][flat[pick]], counts)
            x = table[inverse]
            mask = (windows[rows].T != 0).astype(np.float32)
            keep: list = []
            logits = net.logits(net.project(x), mask, keep)
            d_logit = np.zeros_like(logits)
            begin = 0
            for i in docs:
                end = begin + first[i + 1] - first[i]
                part = logits[begin:end]
                share = np.exp(2 * (part - part.max()))
                share /= share.sum()
                d_logit[begin:end] = share * (_sigmoid((share * part).sum()) - y[i]) / len(docs)
                begin = end
            g, d_x = net.gradients(x, mask, d_logit.astype(np.float32), keep)
            d_table = np.zeros_like(table)
            np.add.at(d_table, inverse.ravel(), d_x.reshape(-1, d_x.shape[2]))
            step += 1
            rate = 0.01 * np.sqrt(1 - 0.999 ** step) / (1 - 0.9 ** step)
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)
            for k, rows_of, grads in (("word", buckets[ids], d_table[:, :WORD_DIM]),
                                      ("group", flat[pick], np.repeat(d_table[:, WORD_DIM:] * scale, counts, axis=0))):
                touched, back = np.unique(rows_of, return_inverse=True)
                grad = np.zeros((len(touched), grads.shape[1]), np.float32)
                np.add.at(grad, back, grads)
                m, s = moments[k]
                m[touched] += 0.1 * (grad - m[touched])
                s[touched] += 0.001 * (grad * grad - s[touched])
                net.p[k][touched] -= (rate * m[touched] / (np.sqrt(s[touched]) + 1e-8)).astype(np.float32)
    return net


class Scorer:
    """Scores texts; gate inputs are kept for a bounded number of words."""

    def __init__(self, net: Network, most_windows: int = PASS_WINDOWS):
        self.net, self.most = net, most_windows
        self._empty()

    def _empty(self):
        pad = self.net.project(np.zeros((1, WORD_DIM + GROUP_DIM), np.float32))
        self.where, self.gates = {"": 0}, [np.repeat(g, 1, axis=0) for g in pad]

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.where) > CACHED_WORDS:
            self._empty()
        where, new, out = self.where, [], []
        for text in texts:
            words = text.split()
            try:
                ids = [where[w] for w in words]
            except KeyError:
                for w in words:
                    if w not in where:
                        where[w] = len(where)
                        new.append(w)
                ids = [where[w] for w in words]
            out.append(np.array(ids, np.int32))
        for i in range(0, len(new), 4096):
            gates = self.net.project(self.net.embed(new[i:i + 4096]))
            self.gates = [np.concatenate([old, g]) for old, g in zip(self.gates, gates)]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        ids = self._ids(texts)
        starts = [window_starts(len(w)) for w in ids]
        owner = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
        flat = np.concatenate([*ids, np.zeros(WINDOW, np.int32)])
        base = np.concatenate([[0], np.cumsum([len(w) for w in ids])])
        begin = base[owner] + np.concatenate([np.array(s) for s in starts])
        length = np.minimum(base[owner + 1] - begin, WINDOW)
        worst = np.full(len(ids), -np.inf, np.float32)
        slots = np.arange(WINDOW)[:, None]
        for i in range(0, len(begin), self.most):
            b, n = begin[i:i + self.most], length[i:i + self.most]
            mask = (slots < n).astype(np.float32)
            at = np.where(slots < n, flat[np.minimum(b + slots, len(flat) - 1)], 0)
            logits = self.net.logits([g[at] for g in self.gates], mask)
            np.maximum.at(worst, owner[i:i + self.most], logits)
        return _sigmoid(worst.astype(np.float64))


def training_rows(docs: DataFrame, labels: DataFrame, sample: Sample) -> tuple[list[str], list[int]]:
    """Texts and labels of a bounded sample, by a hash of doc_id; rows held out never enter. A label that
    ``docs`` hold, but none of the sampled ids in a text short enough, is an error."""
    marks = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))) \
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    texts, marked = [], []
    for label in (0, 1):
        ids = marks.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id") \
            .limit(4 * sample.per_label).select("doc_id")  # so few ids may be broadcast
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")) \
            .where(F.length("text") <= sample.most_chars).join(F.broadcast(ids), "doc_id", "left_semi") \
            .orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(sample.per_label).collect()
        if not rows and not docs.join(marks.where(F.col("toxic") == label), "doc_id", "left_semi").isEmpty():
            raise ValueError(f"no text labelled {label} among the first of its label has {sample.most_chars} characters or fewer")
        texts += [r["text"] for r in rows]
        marked += [label] * len(rows)
    return texts, marked


def fit(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> Network | None:
    return train(*training_rows(docs, labels, sample), sample)


def score(docs: DataFrame, net: Network | None, column: str = "score") -> DataFrame:
    """``docs`` (columns doc_id, text and any others) with the score of every whole text.

    Null and empty texts have one window without words; a text of one endless word is one
    word; without a network (no labels of both kinds) every score is 0. Rows stay as they
    are, repeated ones too; an existing column of the name is replaced.
    """
    if net is None:
        return docs.withColumn(column, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def worst_window(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            parts = [scorer.scores(part) for part in column_parts(texts, PASS_CHARS)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    return docs.withColumn(column, F.arrow_udf(worst_window, "double")(text_or_empty()))


def flagged(docs: DataFrame, labels: DataFrame, sample: Sample = Sample()) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5) per row of ``docs``. An id that is null
    is not held out. Learns from ``labels`` (doc_id, toxic) by ``fit``."""
    return score(docs.select("doc_id", "text"), fit(docs, labels, sample)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None,
               sample: Sample = Sample()) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with their columns. ``labelled`` has the texts
    that ``labels`` speaks of, ``docs`` themselves if not given."""
    name = fresh(docs, "score")
    net = fit(docs if labelled is None else labelled, labels, sample)
    return score(docs, net, name).where(F.col(name) < 0.5).drop(name)
