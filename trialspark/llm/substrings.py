"""Substring deduplication by recompression.

Every text is a sequence of word symbols. Rounds replace runs of one symbol, then pairs of neighbours, by new symbols
whose names are hashes of their parts: a name means the same content in every document of the corpus, with no table to
look names up in. Whether two neighbours pair depends on one bit of each name, so equal stretches of text get equal
symbols except near their ends; with each symbol go the words that decided it. A window's anchor is the smallest name
among the symbols whose deciding words it contains, so equal windows have equal anchors at equal places.

Spark then counts anchor names over the corpus. A name met once settles its windows: they are unique. A stretch (all
windows of an anchor, joined) met several times settles them too: they repeat. Where a name has several stretches, the
windows of each are compared one by one, by name and a second, independent hash (128 bits in all).
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import prepare, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 35
#: Kinds of rounds, in order. More rounds name longer stretches, and symbols depend on more words around them.
ROUNDS = ("run", "pair", "pair", "pair", "pair")


class Text:
    """Symbols of a group of documents: name, document, words covered [start, end), words that decide it [low, high)."""

    def __init__(self, np, names, doc, doc_start, doc_end):
        n = len(names)
        self.np, self.name, self.doc = np, names, doc
        self.start, self.end = np.arange(n), np.arange(1, n + 1)
        self.low, self.high = self.start.copy(), self.end.copy()
        self.doc_start, self.doc_end = doc_start, doc_end

    def _pick(self, first, last, name, low, high):
        self.name, self.low, self.high = name, low, high
        self.doc, self.start, self.end = self.doc[first], self.start[first], self.end[last]

    def _before(self):
        """Deciding words of the left neighbour; one word before the document where there is none."""
        out = self.doc_start[self.doc] - 1
        same = self.doc[1:] == self.doc[:-1]
        out[1:][same] = self.low[:-1][same]
        return out

    def _after(self):
        out = self.doc_end[self.doc] + 1
        same = self.doc[1:] == self.doc[:-1]
        out[:-1][same] = self.high[1:][same]
        return out

    def run(self, seed):
        np, n = self.np, len(self.name)
        first = np.flatnonzero(np.concatenate(([True], (self.name[1:] != self.name[:-1]) | (self.doc[1:] != self.doc[:-1]))))
        last = np.concatenate((first[1:], [n])) - 1
        length = (last - first + 1).astype(np.uint64)
        name = np.where(length == 1, self.name[first], kernels.mix(self.name[first] * np.uint64(0x9FB21C651E98DF25) + length))
        low = np.minimum(self.low[first], self._before()[first])
        high = np.maximum(self.high[last], self._after()[last])
        self._pick(first, last, name, low, high)

    def pair(self, seed):
        np, n = self.np, len(self.name)
        right = (kernels.mix(self.name ^ np.uint64(seed)) & np.uint64(1)).astype(bool)
        joins = np.zeros(n, bool)
        joins[:-1] = ~right[:-1] & right[1:] & (self.doc[1:] == self.doc[:-1])
        taken = np.zeros(n, bool)
        taken[1:] = joins[:-1]
        low = np.where(right & ~taken, np.minimum(self.low, self._before()), self.low)
        high = np.where(~right, np.maximum(self.high, self._after()), self.high)
        first = np.flatnonzero(~taken)
        last = first + joins[first]
        other = self.name[last]
        both = kernels.mix(self.name[first] * np.uint64(0xC2B2AE3D27D4EB4F) + kernels.mix(other + np.uint64(seed + 1)))
        self._pick(first, last, np.where(last > first, both, self.name[first]), low[first], high[first])


def parsed(np, data, start_byte, end_byte, powers, window, in_word):
    """Anchors of all windows of a group of documents.

    Returns document, first window (word in the document), number of windows and name of each anchor, the hash of
    the whole stretch with its place, and what window_hashes() needs.
    """
    word_start, _, first, second = kernels.hashed_words(data, in_word, powers)
    doc = np.searchsorted(start_byte, word_start, "right") - 1
    n_docs = len(start_byte)
    count = np.bincount(doc, minlength=n_docs)
    doc_end = np.cumsum(count)
    doc_start = doc_end - count
    p = np.arange(max(0, len(first) - window + 1))
    p = p[doc[p] == doc[p + window - 1]] if len(p) else p
    if not len(p):
        return None
    text = Text(np, first, doc, doc_start, doc_end)
    for k, kind in enumerate(ROUNDS):
        getattr(text, kind)(0x517CC1B727220A95 + 2 * k)
    pair = text.doc[1:] == text.doc[:-1]
    name = kernels.mix(text.name[:-1] * np.uint64(0x94D049BB133111EB) + text.name[1:])[pair]
    low, high, at = np.minimum(text.low[:-1], text.low[1:])[pair], np.maximum(text.high[:-1], text.high[1:])[pair], text.start[:-1][pair]
    fits = high - low <= window
    name, low, high, at = name[fits], low[fits], high[fits], at[fits]
    # Both bounds grow along the text, so the symbols that a window contains are neighbours: a range minimum.
    a, b = np.searchsorted(low, p, "left"), np.searchsorted(high, p + window, "right")
    inside = b > a
    best = np.full(len(p), -1)
    if inside.any():
        best[inside] = range_minimum(np, name, a[inside], b[inside])
    sums = [kernels.prefix(first, powers[0]), kernels.prefix(second, powers[1])]
    own = kernels.mix(kernels.spans(sums[0], p, p + window, powers[0]))
    alone = best < 0
    cut = np.ones(len(p), bool)
    cut[1:] = (best[1:] != best[:-1]) | alone[1:] | (p[1:] != p[:-1] + 1)
    head = np.flatnonzero(cut)
    number = np.diff(np.concatenate((head, [len(p)])))
    p1, item = p[head], best[head]
    if len(name):
        anchor, place = np.where(item < 0, own[head], name[item]), np.where(item < 0, 0, at[item] - p1)
    else:
        anchor, place = own[head], np.zeros(len(head), np.int64)
    stretch = kernels.spans(sums[1], p1, p1 + number - 1 + window, powers[1])
    stretch = kernels.mix(stretch + kernels.mix((place * 4096 + number).astype(np.uint64)))
    return doc[p1], p1 - doc_start[doc[p1]], number, anchor, stretch, p1, sums


def range_minimum(np, values, a, b):
    """Index of the smallest (leftmost of equal) of values[a:b], for ranges that are not empty."""
    best, width, levels = np.arange(len(values)), 1, []
    longest = int((b - a).max())
    while True:
        levels.append(best)
        if 2 * width > longest:
            break
        x, y = best[:-width], best[width:]
        best = np.where(values[y] < values[x], y, x)
        width *= 2
    level = np.frexp((b - a).astype(float))[1] - 1
    out = np.empty(len(a), np.int64)
    for k, table in enumerate(levels):
        own = level == k
        x, y = table[a[own]], table[b[own] - (1 << k)]
        out[own] = np.where(values[y] < values[x], y, x)
    return out


def _signed(np, x):
    return x.view(np.int64)


def anchors(keyed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, text) -> (name, stretch, k1, k2, first, number): the anchor of every window, windows of one anchor together."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        powers, in_word = [kernels.Powers(b) for b in kernels.BASES], kernels.word_table()
        names = ["name", "stretch", "k1", "k2", "first", "number"]
        for batch in batches:
            k1, k2 = np.asarray(batch.column("k1")), np.asarray(batch.column("k2"))
            for at, data, start, end in kernels.groups(kernels.encoded(batch.column("text"))):
                if (got := parsed(np, data, start, end, powers, window, in_word)) is not None:
                    doc, first, number, name, stretch, _, _ = got
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np, name)), pa.array(_signed(np, stretch)), pa.array(k1[at + doc]), pa.array(k2[at + doc]),
                                                      pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32))], names=names)

    return keyed.select("k1", "k2", "text").mapInArrow(run, "name long, stretch long, k1 long, k2 long, first int, number int")


def doubtful_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(k1, k2, doc, text, doubtful) -> (name, hash, k1, k2, first): each window of the anchors that start at `doubtful`."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        powers, in_word = [kernels.Powers(b) for b in kernels.BASES], kernels.word_table()
        names = ["name", "hash", "k1", "k2", "first"]
        for batch in batches:
            k1, k2 = np.asarray(batch.column("k1")), np.asarray(batch.column("k2"))
            asked = batch.column("doubtful").to_pylist()
            for at, data, start, end in kernels.groups(kernels.encoded(batch.column("text"))):
                if (got := parsed(np, data, start, end, powers, window, in_word)) is None:
                    continue
                doc, first, number, name, _, p1, sums = got
                want = np.concatenate([np.asarray(x, np.int64) + (i << 40) for i, x in enumerate(asked[at:at + len(start)])])
                own = np.flatnonzero(np.isin(first + (doc << 40), want))
                shift = np.arange(int(number[own].sum())) - np.repeat(np.cumsum(number[own]) - number[own], number[own])
                row = np.repeat(own, number[own])
                p = p1[row] + shift
                hashed = kernels.mix(kernels.spans(sums[1], p, p + window, powers[1]))
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np, name[row])), pa.array(_signed(np, hashed)), pa.array(k1[at + doc[row]]), pa.array(k2[at + doc[row]]),
                                                  pa.array((first[row] + shift).astype(np.int32))], names=names)

    return docs.mapInArrow(run, "name long, hash long, k1 long, k2 long, first int")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Documents (k1, k2, doc, text) -> (k1, k2, first, number): windows that occur elsewhere too, `number` neighbours per row."""
    found = written(anchors(docs, window), "anchors")
    # Written first: a join with an aggregate could not be split where a name is hot.
    names = written(found.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("name"), "shared-names")
    shared = written(found.join(names, "name"), "shared-anchors")
    stretches = written(shared.groupBy("name", "stretch").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "first")).alias("one")), "stretches")
    settled = shared.join(stretches.where("n > 1").select("name", "stretch"), ["name", "stretch"]).select("k1", "k2", "first", "number")
    mixed = stretches.groupBy("name").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("name")
    # One document speaks for all that share a stretch.
    doubtful = (stretches.join(mixed, "name").groupBy(F.col("one.k1").alias("k1"), F.col("one.k2").alias("k2"))
                .agg(F.collect_list("one.first").alias("doubtful")))
    windows = doubtful_windows(docs.join(doubtful, ["k1", "k2"]).select("k1", "k2", "doc", "text", "doubtful"), window)
    # Written first, as the shared names are: a passage amid ever differing surroundings is a hot window.
    twice = written(windows.groupBy("name", "hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("name", "hash"), "repeated-windows")
    return settled.unionByName(windows.join(twice, ["name", "hash"]).select("k1", "k2", "first", F.lit(1).alias("number")))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept_text) per row: words inside any window that also starts elsewhere are removed.

    A null text has no words and gives an empty kept_text. Texts shorter than the window lose nothing. Repeated rows
    repeat: each is an occurrence of its own, so their windows go. Other columns are not looked at.
    """
    prepare(docs.sparkSession)
    keyed = docs.select(F.xxhash64(F.col(id_col)).alias("k1"), F.xxhash64(F.col(text), F.col(id_col)).alias("k2"),
                        F.col(id_col).alias("doc"), F.col(text).alias("text"))
    # A window's place fits a long with its length. A set, which merges map-side: repeated rows share a key, and the places of
    # any number of them are no more than a document has words.
    gone = (repeated_windows(keyed, window).groupBy("k1", "k2")
            .agg(F.collect_set(F.shiftleft(F.col("first").cast("long"), 20).bitwiseOR(F.col("number").cast("long"))).alias("gone")))
    joined = keyed.join(gone, ["k1", "k2"], "left").select("doc", "text", "gone")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for data, own in zip(kernels.encoded(batch.column("text")), batch.column("gone").to_pylist(), strict=True):
                words = data.split()
                if own:
                    own = np.asarray(own, np.int64)
                    first, number = own >> 20, own & 0xFFFFF
                    change = np.zeros(len(words) + 1, np.int64)
                    np.add.at(change, first, 1)
                    np.add.at(change, first + number - 1 + window, -1)
                    left = [w for w, covered in zip(words, np.cumsum(change[:-1]), strict=True) if not covered]
                else:
                    left = words
                n_words.append(len(words))
                n_removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
                                             names=[id_col, "n_words", "n_removed", "kept_text"])

    schema = joined.select(F.col("doc").alias(id_col), F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema
    return joined.mapInArrow(run, schema)
