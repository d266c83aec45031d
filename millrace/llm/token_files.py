"""Token files: ids of whole documents in order of doc_id, in blocks of the range coder.

A file is a Parquet table of records. A record holds whole documents (their doc_ids and numbers
of ids) and their ids as independently reset, checksummed blocks; ``part`` and ``first`` give
its place in the order. Texts are dealt out by ranges of doc_id once; each task encodes its
range, and the parts' totals turn places in a part into places in the whole.
"""

from __future__ import annotations

import functools
import os
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import text_or_empty, text_parts
from millrace.llm.range_coder import BLOCK, LANES, decode_blocks, encode_blocks
from millrace.session import checkpoint_folder, shuffle_width

RECORD_IDS, HELD_IDS, LINES = 4 * BLOCK, LANES * BLOCK, 512
# Words a worker remembers and their bytes; characters encoded together.
CACHED, CACHED_BYTES, TOGETHER = 1_200_000, 1 << 26, 4_000_000
FILE = "part int, first long, doc_ids array<long>, counts array<int>, blocks array<binary>"


# White space of more than one byte begins so; some others do too, which only makes longer pieces.
WIDE_SPACE = np.zeros(1 << 16, bool)
WIDE_SPACE[[0xC285, 0xC2A0, 0xE19A, 0xE1A0, 0xE280, 0xE281, 0xE380]] = True
NARROW_SPACE, LETTER, SIGN = (np.zeros(256, bool) for _ in range(3))
NARROW_SPACE[[*range(9, 14), *range(28, 33)]] = True
LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
SIGN[[*b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~']] = True
# Words that may stand in lines: no white space but a first space.
LINE = re.compile(rb" ?(?:[!-~]|[\xc3-\xdf][\x80-\xbf]|[\xe4-\xf4][\x80-\xbf]+)+")


def word_starts(data: np.ndarray) -> list[np.ndarray]:
    """Places in UTF-8 bytes (two bytes of white space at both ends) where a byte-level splitter
    always begins a word: at spaces and line feeds between characters which are no white space,
    after such line feeds, and at signs (but apostrophes) after letters."""
    at = np.flatnonzero((data == 32) | (data == 10))[3:-2]
    at = at[~(NARROW_SPACE[data[at - 1]] | NARROW_SPACE[data[at + 1]])]
    wide = np.flatnonzero((data[at - 1] | data[at + 1]) >> 7)
    if len(wide):
        near = at[wide]
        back3, back2, back1, next1, next2 = (data[near + d].astype(np.int32) for d in (-3, -2, -1, 1, 2))
        at = np.delete(at, wide[WIDE_SPACE[back3 << 8 | back2] | WIDE_SPACE[back2 << 8 | back1] | WIDE_SPACE[next1 << 8 | next2]])
    return [at, at[data[at] == 10] + 1, np.flatnonzero(LETTER[data[:-1]] & SIGN[data[1:]]) + 1]


class Tokens:
    """Ids by the tokenizers library; remembers a bounded number of pieces.

    With a byte-level splitter, texts are cut where a word always begins, and the distinct pieces
    (found by Arrow) are encoded once each. Other tokenizers get whole texts.
    """

    def __init__(self, path: str):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec.get("pre_tokenizer") or {}
        self.pieces = spec.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get(
            "use_regex", True) and not split.get("add_prefix_space")
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_binary())
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _lines(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, and how many each has, by way of texts with a word a line: before such a
        word, each line feed is an id of its own."""
        ids, sizes, feed = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], self._plain(["\n"])[0]
        for at in range(0, len(words), LINES):
            some = words[at:at + LINES]
            found = self._plain([(b"\n" + b"\n".join(some)).decode()])[0]
            feeds = np.flatnonzero(found == feed[0])
            if len(feed) > 1 or len(feeds) != len(some):
                each = self._plain([w.decode() for w in some])
                ids += each
                sizes.append(np.array([len(i) for i in each]))
            else:
                ids.append(np.delete(found, feeds))
                sizes.append(np.diff(feeds, append=len(found)) - 1)
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Remember new pieces; returns their places among the known ones."""
        ends, data = np.frombuffer(pieces.buffers()[1], np.int64).tolist(), pieces.buffers()[2].to_pybytes()
        words = [data[i:j] for i, j in zip(ends[:len(pieces)], ends[1:])]
        other = np.array([LINE.fullmatch(w) is None for w in words])
        order = np.argsort(other, kind="stable")
        ids, sizes = self._lines([words[i] for i in order[:len(words) - other.sum()]])
        rest = self._plain([words[i].decode() for i in np.flatnonzero(other)])
        place = np.empty(len(words), np.int64)
        place[order] = len(self.known) + np.arange(len(words))
        self.known = pa.concat_arrays([self.known, pieces.take(pa.array(order))])
        self.ids = np.concatenate([self.ids, ids, *rest])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([*sizes, *map(len, rest)], dtype=np.int64)])
        return place

    def encode(self, texts: list[str], end_id: int) -> list[np.ndarray]:
        """Ids of each text and the end id."""
        if not self.pieces:
            return [np.append(ids, np.uint32(end_id)) for ids in self._plain(texts)]
        if len(self.known) > CACHED or self.known.nbytes + self.ids.nbytes > CACHED_BYTES:
            self._forget()
        parts = [t.encode() for t in texts]
        data = b"\n\n\n" + b"\n".join(parts) + b"\n\n"
        # Between texts stands one byte, a piece of its own that becomes the end id.
        stops = 3 + np.cumsum([len(p) + 1 for p in parts]) - 1
        starts = np.concatenate([[3], stops[:-1] + 1])
        cuts = np.concatenate([starts, stops, *word_starts(np.frombuffer(data, np.uint8)), stops[-1:] + 1])
        cuts.sort(kind="stable")
        cuts = cuts.astype(np.int64)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        place = pc.index_in(coded.dictionary, self.known)
        new = place.is_null().to_numpy(zero_copy_only=False)
        place = place.fill_null(0).to_numpy().astype(np.int64)
        if new.any():
            place[new] = self._learn(coded.dictionary.filter(pa.array(new)))
        begins, sizes = self.ends[place], self.ends[place + 1] - self.ends[place]
        codes = coded.indices.to_numpy()
        begin, size = begins[codes], sizes[codes]
        # An empty text has its start and its stop at one place; its end is the latter.
        last = np.searchsorted(cuts, stops, side="right") - 1
        size[last] = 1
        upto = np.cumsum(size)
        ids = self.ids[np.repeat(begin - upto + size, size) + np.arange(upto[-1])] if len(self.ids) else np.zeros(upto[-1], np.uint32)
        ids[upto[last] - 1] = end_id
        return np.split(ids, upto[last[:-1]])


@functools.lru_cache(maxsize=1)
def _tokens(path: str, changed: int, size: int) -> Tokens:
    return Tokens(path)


def tokens_of(path: str) -> Tokens:
    """The tokenizer of a worker, kept from task to task until its file changes."""
    state = os.stat(path)
    return _tokens(path, state.st_mtime_ns, state.st_size)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Write the ids of ``docs`` (doc_id, text), each document followed by ``end_id``, to ``folder``.

    A null or empty text is its end id alone; null doc_ids come first; rows that agree in doc_id
    follow each other by text; a long document fills many blocks of one record; an empty table
    writes no records. Ids must be under 65536. ``tokenizer``: a file every executor can read.
    """
    def run(batches):
        tokens, part = tokens_of(tokenizer), TaskContext.get().partitionId()
        place, held, doc_ids = 0, [], []

        def records():
            nonlocal place
            groups, size = [[]], 0
            for doc_id, ids in zip(doc_ids, held):
                if size >= RECORD_IDS:
                    groups.append([])
                    size = 0
                groups[-1].append((doc_id, ids))
                size += len(ids)
            blocks, owners = [], []
            for g, group in enumerate(groups):
                ids = np.concatenate([i for _, i in group])
                for k in range(0, len(ids), BLOCK):
                    blocks.append(ids[k:k + BLOCK])
                    owners.append(g)
            own = [[] for _ in groups]
            for g, payload in zip(owners, encode_blocks(blocks)):
                own[g].append(payload)
            firsts = []
            for group in groups:
                firsts.append(place)
                place += sum(len(i) for _, i in group)
            return pa.RecordBatch.from_arrays([
                pa.array([part] * len(groups), pa.int32()), pa.array(firsts, pa.int64()),
                pa.array([[d for d, _ in g] for g in groups], pa.list_(pa.int64())),
                pa.array([[len(i) for _, i in g] for g in groups], pa.list_(pa.int32())),
                pa.array(own, pa.list_(pa.binary()))], ["part", "first", "doc_ids", "counts", "blocks"])

        size = 0
        for batch in batches:
            ids_of, texts, at = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for some in text_parts(texts, TOGETHER):
                for ids in tokens.encode(some, end_id):
                    held.append(ids)
                    doc_ids.append(ids_of[at])
                    size, at = size + len(ids), at + 1
                if size >= HELD_IDS:
                    yield records()
                    held, doc_ids, size = [], [], 0
        if held:
            yield records()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ranged = rows.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id", "text").sortWithinPartitions("doc_id", "text")
    ranged.mapInArrow(run, FILE).write.parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """part, first, place (in the record), doc_id, ids (little-endian 32-bit, binary) per document;
    a damaged block raises."""
    def run(batches):
        for batch in batches:
            part, first = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            doc_ids, counts, blocks = (batch.column(i).to_pylist() for i in (2, 3, 4))
            begin = 0
            while begin < len(part):
                end, size = begin, 0
                while end < len(part) and (end == begin or size < HELD_IDS):
                    size += sum(counts[end])
                    end += 1
                lengths = [min(BLOCK, sum(counts[r]) - k) for r in range(begin, end) for k in range(0, sum(counts[r]), BLOCK)]
                ids = iter(decode_blocks([b for r in range(begin, end) for b in blocks[r]], lengths))
                out = []
                for r in range(begin, end):
                    whole = np.concatenate([next(ids) for _ in blocks[r]]).astype("<u4")
                    at = 0
                    for place, (doc_id, n) in enumerate(zip(doc_ids[r], counts[r])):
                        out.append((part[r], first[r] + at, place, doc_id, whole[at:at + n].tobytes()))
                        at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()))],
                    ["part", "first", "place", "doc_id", "ids"])
                begin = end

    return spark.read.schema(FILE).parquet(folder).mapInArrow(run, "part int, first long, place int, doc_id long, ids binary")


def part_starts(spark: SparkSession, folder: str) -> DataFrame:
    """part, before (ids of all earlier parts): one row per task that wrote."""
    records = spark.read.schema(FILE).parquet(folder)
    sizes = records.groupBy("part").agg(F.max(
        F.col("first") + F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))


def written_report(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` and report from the files: doc_id, start, n_tokens, ids_crc32 per document."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, folder, tokenizer, end_id)

    found = read(spark, folder).select("part", "first", "doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                                       F.crc32("ids").alias("ids_crc32"))
    return found.join(part_starts(spark, folder), "part").select(
        "doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
