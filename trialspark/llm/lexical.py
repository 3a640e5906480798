"""Ranked lexical search with the roles of query and document reversed.

The items' terms are indexed: for every term, the items that hold it and what one unit of a document's term is worth to
them. The index is broadcast, and documents stream through it: each looks up its own terms, gathers a score per item it
shares a term with, and is offered to that item's heap of bounded size. The heaps of all tasks are merged by a tree.

Corpus statistics (documents, terms, document frequencies) come from all documents. One pass over the texts counts the
index's terms per document and writes the counts; statistics and scores read those. An index above BLOCK_BYTES is worked
off in blocks of items, so what is broadcast stays bounded whatever the number of items.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, written
from .ranking import best

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of item terms in one broadcast index, about a tenth of its memory in a Python task.
BLOCK_BYTES = 8 << 20
#: Cells of a task's score table (documents at a time x items), and postings expanded at a time.
CELLS, POSTINGS = 1 << 21, 1 << 21
TOP = 20

# Letters, digits and all bytes of non-ASCII characters stay, A-Z become a-z, the rest parts terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order; none for null. Blanks are the only white space left, so split() cuts at them alone."""
    return text.encode().translate(TERMS).split() if text else []


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(_item, item id, term, times) of every row of `items`, written; `_item` numbers the rows, so equal rows stay two."""
    rows = written(items.select(F.monotonically_increasing_id().alias("_item"), F.col(item).alias("_id"), F.col(text).alias("_text")), "search-items")

    def split(batches):
        from collections import Counter

        for batch in batches:
            out: dict[str, list] = {"_item": [], "term": [], "times": []}
            for own, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = Counter(terms(body))
                out["_item"] += [own] * len(counts)
                out["term"] += counts.keys()
                out["times"] += counts.values()
            yield pa.RecordBatch.from_arrays([pa.array(out["_item"], pa.int64()), pa.array(out["term"], pa.binary()), pa.array(out["times"], pa.int64())], names=list(out))

    found = rows.select("_item", "_text").mapInArrow(split, "_item long, term binary, times long")
    return written(found, "search-terms"), rows.select("_item", "_id")


def counted(docs: DataFrame, doc: str, text: str, vocabulary) -> DataFrame:
    """Per document: doc, n (all its terms), slots and tfs (which of the index's terms it holds, and how often), written.

    `vocabulary` is a broadcast of term -> slot. Documents without any term of the index keep a row, for the statistics.
    """
    kind = docs.select(doc).schema[0].dataType.simpleString()

    def count(batches):
        from collections import Counter

        slot_of = vocabulary.value
        for batch in batches:
            n, slots, tfs, ends = [], [], [], [0]
            for body in batch.column(1).to_pylist():
                words = terms(body)
                n.append(len(words))
                held = [(slot_of[w], c) for w, c in Counter(words).items() if w in slot_of]
                slots += [s for s, _ in held]
                tfs += [c for _, c in held]
                ends.append(len(slots))
            cuts = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(slots, pa.int32())), pa.ListArray.from_arrays(cuts, pa.array(tfs, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *lists], names=["doc", "n", "slots", "tfs"])

    found = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).mapInArrow(count, f"doc {kind}, n long, slots array<int>, tfs array<long>")
    return written(found, "search-counts")


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Postings:
    """An inverted index: of each slot, from `first` to the next one's, the items that hold the term and times x weight."""

    def __init__(self, first: np.ndarray, items: np.ndarray, worth: np.ndarray, n_items: int):
        self.first, self.items, self.worth, self.n_items = first, items, worth, n_items
        # No share of a document's score exceeds 1,000,000 x worth: below 2^53 sums of doubles are exact.
        most = np.bincount(items, weights=worth.astype(float), minlength=max(1, n_items)).max(initial=0)
        self.exact = most * 1e6 < 2**53

    def scores(self, n, ends, slots, tfs, n_docs: int, n_terms: int) -> np.ndarray:
        """Scores of documents x items, in 64-bit integers."""
        m = np.array([75 + 25 * int(x) * n_docs // n_terms for x in n], np.int64)
        owner = np.repeat(np.arange(len(n)), np.diff(ends))
        share = 1_000_000_000 * tfs // (1000 * tfs + 12 * m[owner])
        out = np.zeros(len(n) * self.n_items, np.int64)
        sizes = self.first[slots + 1] - self.first[slots]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        at = 0
        while at < len(slots):  # as many terms at a time as have POSTINGS postings
            to = max(at + 1, int(np.searchsorted(upto, upto[at] + POSTINGS, "right")) - 1)
            size = sizes[at:to]
            place = np.arange(upto[to] - upto[at]) - np.repeat(upto[at:to] - upto[at], size) + np.repeat(self.first[slots[at:to]], size)
            cell = np.repeat(owner[at:to], size) * self.n_items + self.items[place]
            gain = np.repeat(share[at:to], size) * self.worth[place]
            if self.exact:
                low = int(cell[0] // self.n_items * self.n_items) if len(cell) else 0
                sums = np.bincount(cell - low, weights=gain)
                out[low:low + len(sums)] += sums.astype(np.int64)
            else:
                np.add.at(out, cell, gain)
            at = to
        return out.reshape(len(n), self.n_items)


class Heaps:
    """For every item the best `k` (score, doc) met so far; of equal scores the smaller doc, a null one last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.n_items = k, n_items
        self.least, self.last = np.ones(n_items, np.int64), np.full(n_items, np.iinfo(np.int64).max)
        self.kept = tuple(np.empty(0, np.int64) for _ in range(3))

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """scores: documents x items; docs: their ids as ordered numbers."""
        row, item = np.nonzero((scores > self.least) | ((scores == self.least) & (docs[:, None] <= self.last)))
        if len(row):
            new = (item, scores[row, item], docs[row])
            item, score, doc = (np.concatenate([a, b]) for a, b in zip(self.kept, new))
            order = np.lexsort((doc, -score, item))
            item, score, doc = item[order], score[order], doc[order]
            place = np.arange(len(item)) - np.searchsorted(item, item)
            stay = place < self.k
            self.kept = item, score, doc = item[stay], score[stay], doc[stay]
            full = place[stay] == self.k - 1
            self.least[item[full]], self.last[item[full]] = score[full], doc[full]


def offered(counts: DataFrame, postings, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(part, item, score, doc): the heaps of every task, at its end. `postings` is a broadcast `Postings`."""
    def stream(batches):
        index = postings.value
        heaps = Heaps(index.n_items, k)
        step = max(1, CELLS // max(1, index.n_items))
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False)
            ids = batch.column(0).fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)
            lists = batch.column(2)
            ends = lists.offsets.to_numpy().astype(np.int64)
            slots, tfs = lists.values.to_numpy(), batch.column(3).values.to_numpy()
            for a in range(0, len(n), step):
                b = min(a + step, len(n))
                if ends[b] > ends[a]:
                    own = slice(ends[a], ends[b])
                    heaps.offer(index.scores(n[a:b], ends[a:b + 1] - ends[a], slots[own], tfs[own], n_docs, n_terms), ids[a:b])
        item, score, doc = heaps.kept
        part = np.full(len(item), TaskContext.get().partitionId())
        nulls = doc == np.iinfo(np.int64).max
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(item, pa.int32()), pa.array(score, pa.int64()), pa.array(doc, pa.int64(), mask=nulls)], names=["part", "item", "score", "doc"])

    return written(counts.mapInArrow(stream, "part int, item int, score long, doc long"), "search-heaps")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank, doc, score): the `k` best documents with a score above 0 of each row of `items`, equal scores by ascending doc.

    Document ids are whole numbers. Null and empty texts have no terms: such an item has no result, such a document is in none and
    does not count among the documents. A repeated document is a document of its own; a repeated item row is answered again.
    A null document id comes last among equal scores. A term that many documents share costs one row per document and none
    per pair. Empty tables give an empty result. Columns of other names are not looked at.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    held, names = item_terms(items, item, item_text)
    size = held.agg(F.coalesce(F.sum(F.length("term") + 8), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    found = None
    for block in range(blocks):
        mine = held.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == block) if blocks > 1 else held
        # At most about `block_bytes`, or one item; the items' own terms only, never the documents'.
        vocabulary = {bytes(r[0]): slot for slot, r in enumerate(mine.select("term").distinct().orderBy("term").collect())}
        known = spark.sparkContext.broadcast(vocabulary)
        counts = counted(docs, "doc", "text", known)
        n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        frequency = dict(counts.select(F.explode("slots").alias("slot")).groupBy("slot").count().collect())  # one row per term of the index
        rows = sorted((vocabulary[bytes(t)], own, times) for own, t, times in mine.collect())
        owners = sorted({own for _, own, _ in rows})
        number = {own: i for i, own in enumerate(owners)}
        slots = np.array([r[0] for r in rows], np.int64)
        worth = {slot: weight(n_docs, frequency.get(slot, 0)) for slot in set(slots.tolist())}
        index = Postings(np.searchsorted(slots, np.arange(len(vocabulary) + 1)), np.array([number[r[1]] for r in rows], np.int64),
                         np.array([r[2] * worth[r[0]] for r in rows], np.int64), len(owners))
        heaps = offered(counts, spark.sparkContext.broadcast(index), n_docs, max(1, n_terms), k)
        parts = heaps.agg(F.coalesce(F.max("part"), F.lit(0))).first()[0] + 1
        ranked = best(heaps, ["item"], [F.col("score").desc(), F.col("doc").asc_nulls_last()], k, "part", parts)
        owned = spark.createDataFrame(list(enumerate(owners)), "item int, _item long")
        ranked = ranked.join(owned, "item").select("_item", "rank", "doc", "score")
        found = ranked if found is None else found.unionByName(ranked)
    return found.join(names, "_item").select(F.col("_id").alias(item), "rank", F.col("doc").alias(doc), "score")
