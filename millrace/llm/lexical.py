"""Ranked lexical search: the Best Position Algorithm over impact lists.

The impact of a term in a document is what it adds to a score; an item's score of a document is
the sum over its terms. Documents are dealt out to shards of some hundred thousand postings; a
shard holds, for each term of the items, the list of its documents in order of impact.

For an item the algorithm reads its lists from the top, side by side. Each new document is
looked up directly in all other lists, which gives its whole score and its places there. A list's
best position is the last one before which everything has been seen, whether read or looked up.
No unseen document can score above the sum of the impacts that follow the best positions; the search
of a shard ends when that sum is strictly below its k-th score, so ties at the end stay whole.

What the corpus says of a term (its documents, all documents, all terms) is counted over all texts.
Items meet the shards as rows of the same shuffle, in blocks of bounded size.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import column_parts, map_groups, slices, text_or_empty
from millrace.session import checkpoint_folder, reliable_checkpoint

TOP = 20
SHARD_POSTINGS = 500_000
BLOCK_ITEMS = 2048
FIRST_READ = 32
PART_CHARS = 4_000_000
ROWS = 8192
ITEM, DOCUMENT, POSTING = 0, 1, 2

TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def text_terms(data: bytes) -> Counter:
    """Terms of one UTF-8 text with their occurrences: ASCII letters (lower-cased), digits and
    everything beyond ASCII are parts of terms, all else is between them."""
    found: Counter = Counter()
    for part in slices(data.translate(TERM_BYTES), re.compile(b" ")):
        found.update(part.split())
    return found


def term_counts(rows: DataFrame, text: str = "text") -> DataFrame:
    """``rows`` (row long, id long, text) -> row, id, n (terms with repeats), term, tf. The empty
    term stands for the row itself and comes once for every row that has terms."""
    def run(batches):
        for batch in batches:
            keys, at = (batch.column(0), batch.column(1)), 0
            for texts in column_parts(batch.column(2), PART_CHARS):
                terms, counts, sizes, totals = [], [], [], []
                for data in texts:
                    found = text_terms(data)
                    total = sum(found.values())
                    totals.append(total)
                    sizes.append(len(found) + 1 if total else 0)
                    if total:
                        terms.append(b"")
                        counts.append(1)
                        terms += found.keys()
                        counts += found.values()
                spread = np.repeat(np.arange(at, at + len(texts)), sizes)
                at += len(texts)
                every = pa.RecordBatch.from_arrays(
                    [keys[0].take(pa.array(spread)), keys[1].take(pa.array(spread)),
                     pa.array(np.repeat(np.array(totals, np.int64), sizes)), pa.array(terms, pa.binary()), pa.array(counts, pa.int64())],
                    ["row", "id", "n", "term", "tf"])
                for i in range(0, every.num_rows, 1 << 18):
                    yield every.slice(i, 1 << 18)

    data = rows.select("row", F.col("id").cast("long").alias("id"), text_or_empty(text).cast("binary").alias("data"))
    return data.mapInArrow(run, "row long, id long, n long, term binary, tf long")


def _seen_places(unseen: np.ndarray, starts: np.ndarray, ends: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Each list's best position moved on to its first unseen place, or to its end."""
    moved = best.copy()
    for i, (s, e) in enumerate(zip((starts + best).tolist(), ends.tolist())):
        if s < e:
            skip = int(unseen[s:e].argmax())
            moved[i] += skip if unseen[s + skip] else e - s
    return moved


class Shard:
    """Impact lists of one shard, all postings in order of (term, impact from the highest).

    ``terms`` are numbers of terms, ``docs`` numbers 0 to ``size`` - 1 within the shard.
    """

    def __init__(self, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray, size: int):
        self.names, self.starts = np.unique(terms, return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))
        self.docs, self.impacts, self.size = docs, impacts, size
        self.list_of = np.repeat(np.arange(len(self.names)), self.ends - self.starts)
        self.by_doc = np.argsort(docs, kind="stable")  # direct access: the places of a document in all lists
        self.doc_starts = np.searchsorted(docs[self.by_doc], np.arange(size + 1))
        self.slot = np.full(len(self.names) + 1, -1)
        self.seen_docs = np.zeros(size, bool)

    def _places(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places that ``docs`` have in the lists, with the position in ``docs`` of their owner."""
        starts, counts = self.doc_starts[docs], self.doc_starts[docs + 1] - self.doc_starts[docs]
        owner = np.repeat(np.arange(len(docs)), counts)
        shift = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.by_doc[starts[owner] + shift], owner

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, ties: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(docs, scores, places read) of the ``k`` best documents of an item, ties to the least ``ties``."""
        at = np.searchsorted(self.names, terms)
        there = at < len(self.names)
        there[there] = self.names[at[there]] == terms[there]
        lists, weights = at[there], weights[there]
        starts, ends = self.starts[lists], self.ends[lists]
        length = ends - starts
        offset = np.cumsum(length) - length  # place in the item's own flags, one per posting of its lists
        unseen = np.ones(int(length.sum()), bool)
        self.slot[lists] = np.arange(len(lists))
        best = np.zeros(len(lists), np.int64)
        docs, scores, depth, step = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, FIRST_READ
        while len(lists):
            # sorted access: the next places of every list
            spread = np.minimum(length - depth, step).clip(0)
            which = np.repeat(np.arange(len(lists)), spread)
            place = depth + np.arange(len(which)) - np.repeat(np.cumsum(spread) - spread, spread)
            unseen[offset[which] + place] = False
            new = self.docs[starts[which] + place]
            new = np.unique(new[~self.seen_docs[new]])
            self.seen_docs[new] = True
            # direct access: the whole score of new documents and their places in all lists
            places, owner = self._places(new)
            slots = self.slot[self.list_of[places]]
            places, owner, slots = places[slots >= 0], owner[slots >= 0], slots[slots >= 0]
            unseen[offset[slots] + places - starts[slots]] = False
            got = np.zeros(len(new), np.int64)
            np.add.at(got, owner, weights[slots] * self.impacts[places])
            docs.append(new)
            scores.append(got)
            depth, step = depth + step, step * 2
            best = _seen_places(unseen, offset, offset + length, best)
            left = best < length
            bound = int((weights[left] * self.impacts[starts[left] + best[left]]).sum())
            if not left.any():
                break
            kept = np.concatenate(scores)
            if len(kept) > k:
                high = np.argpartition(-kept, k - 1)[:k]
                if kept[high].min() > bound:
                    break
        self.slot[lists] = -1
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        self.seen_docs[docs] = False
        docs, scores = docs[scores > 0], scores[scores > 0]
        order = np.lexsort((ties[docs], -scores))[:k]
        return docs[order], scores[order], int(np.minimum(length, depth).sum())


def _answer(table: pa.Table, k: int) -> tuple[list, list, list]:
    """item, row, score of one shard's best documents for the items sent to it."""
    kind, term, row, value = (table.column(c).to_numpy() for c in ("kind", "term", "row", "value"))
    items, documents, postings = (np.flatnonzero(kind == x) for x in (ITEM, DOCUMENT, POSTING))
    known = np.sort(row[documents])
    of = np.searchsorted(known, row[postings])
    ties = np.empty(len(known), np.int64)
    ids = table.column("id")
    doc_ids = ids.take(pa.array(documents)).to_pylist()
    order = sorted(range(len(documents)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, row[documents[i]]))
    ties[np.searchsorted(known, row[documents[order]])] = np.arange(len(order))
    shard = Shard(term[postings], of, value[postings], len(known))
    by_item = items[np.argsort(row[items], kind="stable")]
    out: tuple[list, list, list] = ([], [], [])
    cuts = np.flatnonzero(np.diff(row[by_item])) + 1
    for part in np.split(by_item, cuts) if len(by_item) else []:
        docs, scores, _ = shard.best(term[part], value[part], k, ties)
        out[0].extend([row[part[0]]] * len(docs))
        out[1].extend(known[docs].tolist())
        out[2].extend(scores.tolist())
    return out


def _term_weights(postings: DataFrame, corpus) -> DataFrame:
    """term, number, w of the terms of the items that any document holds."""
    df = postings.where("term <> x''").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * corpus.N + 2) / (2 * F.col("df") + 1))).cast("long")
    return reliable_checkpoint(df.select("term", F.monotonically_increasing_id().alias("number"), weight.alias("w")))


def search(docs: DataFrame, items: DataFrame, k: int = TOP, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` documents of highest score above 0 for each
    row of ``items`` (item_id, text), ties to the least doc_id (null last).

    Every row of ``docs`` is a document of its own and every row of ``items`` an item of its own,
    repeated ones too. Null texts and texts without terms are no documents, and items without terms
    have no rows, as with empty tables. Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = f"{checkpoint_folder(spark)}/lexical-{uuid.uuid4().hex}"

    asked = term_counts(items.select(F.monotonically_increasing_id().alias("row"), F.col("item_id").alias("id"), "text"))
    asked.write.parquet(f"{folder}/items")
    asked = spark.read.parquet(f"{folder}/items")
    wanted = asked.select("term").union(spark.sql("select x'' as term")).distinct()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("id"), F.col("text"))
    term_counts(rows).join(wanted, "term", "left_semi").write.parquet(f"{folder}/postings")
    postings = spark.read.parquet(f"{folder}/postings")

    corpus = postings.agg(F.count(F.when(F.expr("term = x''"), 1)).alias("N"),
                          F.coalesce(F.sum(F.expr("if(term = x'', n, 0)")), F.lit(0)).alias("L"),
                          F.count(F.lit(1)).alias("all")).first()
    shards = max(1, -(-corpus["all"] // shard_postings))
    shard = F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int")
    blocks = max(1, -(-asked.where("term = x''").count() // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int")

    weights = _term_weights(postings, corpus)
    terms = asked.where("term <> x''").select("row", block.alias("block"), "term", "tf").join(weights, "term")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    sent_items = terms.select(everywhere.alias("shard"), "block", F.lit(ITEM).alias("kind"), F.col("number").alias("term"),
                              "row", F.lit(None).cast("long").alias("id"), F.col("tf").alias("value"))
    to_all = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent_docs = postings.where("term = x''").select(
        shard.alias("shard"), to_all.alias("block"), F.lit(DOCUMENT).alias("kind"), F.lit(0).cast("long").alias("term"), "row", "id",
        F.lit(0).cast("long").alias("value"))
    impact = F.expr(f"w * ((1000000000 * tf) div (1000 * tf + 12 * (75 + (25 * n * {corpus.N}) div {max(corpus.L, 1)})))")
    used = terms.select("block", "term", "number", "w").distinct()
    sent_postings = postings.join(used, "term").select(
        shard.alias("shard"), "block", F.lit(POSTING).alias("kind"), F.col("number").alias("term"), "row",
        F.lit(None).cast("long").alias("id"), impact.alias("value"))

    def run(table, bounds):
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            found = _answer(table.slice(s, e - s), k)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["item", "row", "score"])

    found = map_groups(sent_items.union(sent_docs).union(sent_postings), ["shard", "block"], run, "item long, row long, score long",
                       then=["kind", "term", F.col("value").desc()])
    first = found.join(postings.where("term = x''").select("row", F.col("id").alias("doc_id")), "row") \
        .withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(
            F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"))).where(F.col("rank") <= k)
    names = asked.where("term = x''").select(F.col("row").alias("item"), F.col("id").alias("item_id"))
    return first.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


#: The same ranking by scoring every document that holds a term.
SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
b as (select row_number() over () as item, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select item, item_id, term, count(*) as qtf from b group by all),
c as (select count(*) as n_docs, sum(len(t))::bigint as n_terms from d where len(t) > 0),
p as (select r, doc_id, n, term, count(*) as tf from (select r, doc_id, len(t) as n, unnest(t) as term from d) group by all),
w as (select term, floor(1000 * ln((2 * n_docs + 2)::double / (2 * df + 1)))::bigint as w
    from (select term, count(*) as df from p group by term) cross join c),
s as (select q.item, q.item_id, p.r, p.doc_id, sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::bigint as score
    from q join w using (term) join p using (term) cross join c group by all),
k as (select *, row_number() over (partition by item order by score desc, doc_id nulls last, r) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from k where rank <= 20
"""
