"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark texts.

Normalising maps bytes to bytes (A-Z to a-z, other ASCII but letters and digits to a blank) and joins words by one
blank, so that a match's place gives the word it starts at and, through the words' own places, the span in the
original text. The automaton holds every window of an item's words; each Python worker builds it once. A benchmark over
BLOCK_BYTES is worked off in blocks of that size, each with an automaton of its own, with a written table between blocks;
an item that is larger is cut into pieces that overlap by all but one word of a window, so that no window is lost.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import aside, prepare, restored, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
#: Bytes of normalised benchmark text in one broadcast automaton (about 100 times as much memory, in every Python task).
BLOCK_BYTES = 1 << 20

# Letters, digits and all bytes of non-ASCII characters stay, A-Z become a-z, the rest parts words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def windows_of(words: list[bytes], window: int) -> list[bytes]:
    """Runs of `window` words, blanks at both ends; fewer words are one run, none are none."""
    if not words:
        return []
    return [b" " + b" ".join(words[i:i + window]) + b" " for i in range(max(1, len(words) - window + 1))]


def automaton(items: list[tuple[str, bytes]], window: int):
    """Latin-1 strings stand for bytes, whichever way the library was built. Values: (items, words, length)."""
    import ahocorasick

    owners: dict[str, tuple[set, int]] = {}
    for item, text in items:
        words = text.split()
        for run in windows_of(words, window):
            owners.setdefault(run.decode("latin-1"), (set(), min(window, len(words))))[0].add(item)
    built = ahocorasick.Automaton()
    for run, (names, n) in owners.items():
        built.add_word(run, (tuple(sorted(names, key=str)), n, len(run)))
    if owners:
        built.make_automaton()
    return built if owners else None


def merged(spans) -> list[list[int]]:
    """Spans in order, those that touch or overlap joined."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out


def matches(built, data: bytes) -> tuple[list[bytes], list[list[int]], set[str]]:
    """Words of a text, merged [first, end) spans of words inside a match, items that match."""
    words = data.translate(NORMAL).split()
    items: set[str] = set()
    if built is None or not words:
        return words, [], items
    text = " " + b" ".join(words).decode("latin-1") + " "
    at, word, found = 0, 0, []
    for end, (names, n, length) in built.iter(text):
        start = end - length + 1
        if start < at:  # a shorter run that began later may end first
            word -= text.count(" ", start, at)
        else:
            word += text.count(" ", at, start)
        at = start
        found.append((word, word + n))
        items.update(names)
    return words, merged(found), items


def original_spans(data: bytes, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Code point offsets, end exclusive, in the original text of spans of words."""
    import re

    import numpy as np

    place = [m.span() for m in re.finditer(rb"[^ ]+", data.translate(NORMAL))]
    points = np.cumsum(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)  # code points up to and with each byte
    return [(int(points[place[a][0]]) - 1, int(points[place[b - 1][1] - 1])) for a, b in spans]


def pieces(data: bytes, window: int, most: int) -> list[bytes]:
    """A normalised item whole, or in pieces of about `most` bytes that hold all its windows and no others."""
    if len(data) <= most:
        return [data]
    words, out, start = data.split(), [], 0
    while True:
        end, size = start, 0
        while end < len(words) and (end - start < window or size + len(words[end]) < most):
            size += len(words[end]) + 1
            end += 1
        out.append(b" ".join(words[start:end]))
        if end == len(words):
            return out
        start = end - window + 1


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, most: int):
    """Normalised items, or pieces of them, in blocks of about `most` bytes; one block is on the driver at a time."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item).cast("string"), F.col(text).cast("binary"))
    block, size = [], 0
    for name, data in rows.toLocalIterator():
        for piece in pieces(bytes(data).translate(NORMAL), window, most):
            if block and size + len(piece) > most:
                yield block
                block, size = [], 0
            block.append((name, piece))
            size += len(piece)
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW,
                  block_bytes: int = BLOCK_BYTES, prefix: str = "", offsets: bool = True) -> DataFrame:
    """`docs` with n_words, n_hit (words inside an occurring window), items (sorted ids as strings) and spans.

    spans lists [start, end) code points of hit stretches in the original text (null without `offsets`). Names of the added
    columns take `prefix`; columns of `docs` with such a name are replaced. Null or wordless texts have no words and no hits;
    null or wordless items never occur; an item without id is not listed, its hits count. Repeated rows and items are
    no special case. An empty benchmark hits nothing. Documents are neither shuffled nor dropped.
    """
    spark = prepare(docs.sparkSession)
    new = [prefix + c for c in ("n_words", "n_hit", "items", "spans")]
    keep = [c for c in docs.columns if c not in new]
    hidden, named = aside(docs.select(*[F.col(f"`{c}`") for c in keep]))
    now = hidden.select("*", F.lit(0).cast("long").alias("_n"), F.lit(None).cast("array<array<int>>").alias("_spans"), F.lit(None).cast("array<string>").alias("_items"),
                      F.lit(None).cast("array<array<int>>").alias("_places"))
    for number, block in enumerate(_blocks(benchmark, item, item_text, window, block_bytes)):
        if number:
            now = written(now, "decontaminate-block")
        now = _scanned(spark, now, keep.index(text), block, window, offsets)
    hit = F.aggregate(F.coalesce("_spans", F.array()), F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    told = now.select(*named.values(), F.col("_n").alias(new[0]), hit.alias(new[1]), F.coalesce(F.array_sort("_items"), F.array().cast("array<string>")).alias(new[2]),
                      F.col("_places").alias(new[3]))
    return restored(told, named, new)


def _scanned(spark, docs: DataFrame, text_at: int, block, window: int, offsets: bool) -> DataFrame:
    """One block of items looked up in every document, added to what earlier blocks found."""
    held, names = spark.sparkContext.broadcast({"items": block}), docs.columns

    def run(batches):
        import pyarrow as pa

        own_block = held.value  # a worker keeps it, and with it the automaton, for its next tasks
        if "built" not in own_block:
            own_block["built"] = automaton(own_block["items"], window)
        built = own_block["built"]
        for batch in batches:
            counts, spans, items, places = [], [], [], []
            column = batch.column(text_at).cast(pa.binary()).to_pylist()
            for data, had, old in zip(column, batch.column(len(names) - 3).to_pylist(), batch.column(len(names) - 2).to_pylist(), strict=True):
                words, own, met = matches(built, data or b"")
                if had:
                    own = merged([*own, *had])
                counts.append(len(words))
                spans.append(own or None)
                items.append(sorted({*(old or ()), *(x for x in met if x is not None)}) or None)
                places.append(original_spans(data, own) if own and offsets else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-4], pa.array(counts, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string())),
                 pa.array([[list(x) for x in p] if p else None for p in places], pa.list_(pa.list_(pa.int32())))], names=names)

    return docs.mapInArrow(run, docs.schema)
