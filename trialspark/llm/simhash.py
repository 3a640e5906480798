"""Near-duplicates by SimHash: a byte-position inverted index with count filtering.

A fingerprint is 8 bytes. Two that differ in at most 3 bits differ in at most 3 bytes, so they share at least 5
positional bytes: the guaranteed minimum of matches. Lists per single byte would hold 1/256 of all fingerprints and
tallying over them is quadratic, so the index is kept by the guaranteed minimum itself: one list for every choice of
5 positions and their bytes (56 per distinct fingerprint, 40 bits each). Within a list the bytes that a pair shares
are tallied, pairs with fewer than 5 are dropped, the rest are verified by their differing bits. A list holds at most
2^24 fingerprints; one longer than LONG is indexed once more by 3 of the 6 half bytes left, after which at most 4096
fingerprints share a key. No pair is ever emitted: a list gives each member a link to the smallest member that
it reaches inside the list.
"""

from __future__ import annotations

import itertools
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import prepare, written
from .components import components

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BITS = 3
MATCHES = 8 - BITS
#: Lists up to this length are compared at once; longer ones are indexed further.
LONG = 1024


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def byte_masks() -> list[int]:
    """One mask for every choice of MATCHES of the 8 bytes."""
    return [_signed(sum(0xFF << 8 * p for p in chosen)) for chosen in itertools.combinations(range(8), MATCHES)]


def half_byte_masks() -> list[list[int]]:
    """For every byte mask, that mask with 3 of the 6 half bytes it leaves open."""
    out = []
    for chosen in itertools.combinations(range(8), MATCHES):
        base = sum(0xFF << 8 * p for p in chosen)
        open_ = [8 * p + s for p in range(8) if p not in chosen for s in (0, 4)]
        out.append([_signed(base | sum(0xF << s for s in three)) for three in itertools.combinations(open_, 3)])
    return out


def fingerprint_of(data: bytes, shingle: int = 3) -> int:
    """Fingerprint of one text: bit set where it is set in over half of the shingles' XXH64."""
    import numpy as np
    import xxhash

    digest, words = xxhash.xxh64_intdigest, data.lower().split()  # both are ASCII-only on bytes
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= shingle:
        hashes = [digest(text, 42)]
    else:
        end = list(itertools.accumulate(len(w) + 1 for w in words))
        start = [0, *end]
        hashes = [digest(text[a:b - 1], 42) for a, b in zip(start, end[shingle - 1:], strict=False)]
    seen, n = np.zeros(2048, np.int64), len(hashes)
    for at in range(0, n, 1 << 16):  # how often each byte stands at each position; bounded memory for very long texts
        part = np.array(hashes[at:at + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        seen += np.bincount((part + np.arange(0, 2048, 256)).ravel(), minlength=2048)
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(float)
    set_ = (seen.reshape(8, 256).astype(float) @ bits).ravel()  # counts below 2^53 are exact
    return int.from_bytes(np.packbits(2 * set_ > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fp", shingle: int = 3) -> DataFrame:
    """`docs` without its text, with its fingerprint as a signed 64-bit `name`.

    Null and blank texts have fingerprint 0. Other columns pass through; one called `name` is replaced.
    """
    keep = [c for c in docs.columns if c not in (text, name)]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [_signed(fingerprint_of(t, shingle)) for t in kernels.encoded(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], names=[*keep, name])

    schema = docs.select(*keep, F.lit(0).cast("long").alias(name)).schema
    return docs.select(*keep, text).mapInArrow(run, schema)


def _linked(fps, np):
    """(member, smallest member that it reaches) of one list, for members that are linked at all."""
    n = len(fps)
    near = np.zeros((n, n), bool)
    for at in range(0, n, 256):
        differ = fps[at:at + 256, None] ^ fps[None, :]
        shared = (differ.view(np.uint8).reshape(*differ.shape, 8) == 0).sum(-1, dtype=np.uint8)
        near[at:at + 256] = (shared >= MATCHES) & (np.bitwise_count(differ) <= BITS)
    label = np.arange(n)
    while True:
        new = np.where(near, label[None, :], n).min(1)
        new = np.minimum(new, label[new])
        if (new == label).all():
            break
        label = new
    return fps, fps[label]


def links(postings: DataFrame, keys: list[str], longest: int | None) -> DataFrame:
    """Postings (keys, fp) -> (u, v, null) links; members of lists over `longest` come back as (fp, null, list)."""
    dealt = postings.repartition(*keys).sortWithinPartitions(*keys)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def result(u, v):
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.nulls(len(u), pa.int32())],
                                              names=["u", "v", "list"])

        def handed_on(u, number):
            number = np.broadcast_to(np.asarray(number, np.int32), len(u))
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.nulls(len(u), pa.int64()), pa.array(number)], names=["u", "v", "list"])

        def one(held):
            return result(*lists(np.zeros(sum(map(len, held)), int), np.concatenate(held)))

        def lists(key, fps):
            """Links of whole lists; key holds the number of the list of each row."""
            cut = np.flatnonzero(np.diff(key)) + 1
            start, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(key)]))
            us, vs, size = [], [], end - start
            two = start[size == 2]
            differ = fps[two] ^ fps[two + 1]
            shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1) if len(two) else np.zeros(0, int)
            good = two[(shared >= MATCHES) & (np.bitwise_count(differ) <= BITS)]
            us.append(fps[good])
            vs.append(fps[good + 1])
            for a, b in zip(start[size > 2], end[size > 2], strict=True):
                u, v = _linked(fps[a:b], np)
                us.append(u[u != v])
                vs.append(v[u != v])
            return np.concatenate(us), np.concatenate(vs)

        held_key, held, over = None, [], False
        number = len(keys)
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [np.asarray(batch.column(i)) for i in range(number)]
            fps = np.ascontiguousarray(np.asarray(batch.column(number)))
            change = np.zeros(len(fps), bool)
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            first, last = tuple(c[0] for c in cols), tuple(c[-1] for c in cols)
            cut = np.concatenate(([0], np.flatnonzero(change), [len(fps)]))
            if first != held_key:
                if held:
                    yield one(held)
                held, over = [], False
            head = fps[:cut[1]]
            if over:
                yield handed_on(head, first[0])
            else:
                held.append(head)
            held_key = first
            if longest and not over and sum(map(len, held)) > longest:  # too long: hand its members on
                for part in held:
                    yield handed_on(part, first[0])
                held, over = [], True
            if len(cut) > 2:  # the list at the front is complete, so are those in the middle
                if held:
                    yield one(held)
                a, b = cut[1], cut[-2]
                if b > a:
                    key, own = np.cumsum(change[a:b]), fps[a:b]
                    size = np.bincount(key)
                    long_ = (size > longest)[key] if longest else np.zeros(len(own), bool)
                    if long_.any():
                        yield handed_on(own[long_], cols[0][a:b][long_])
                    if not long_.all():
                        yield result(*lists(key[~long_], own[~long_]))
                held, over, held_key = [fps[b:]], False, last
        if held:
            yield one(held)

    return dealt.mapInArrow(run, "u long, v long, list int")


def _postings(fps: DataFrame, masks: Column, first: Column | None = None) -> DataFrame:
    number = F.col("_n") if first is None else first + F.col("_n")
    return (fps.select("*", F.posexplode(masks).alias("_n", "_mask"))
            .select(number.cast("int").alias("_list"), F.col("fp").bitwiseAND(F.col("_mask")).alias("_bytes"), "fp"))


def fingerprint_classes(distinct: DataFrame, long_list: int = LONG) -> DataFrame:
    """Distinct fingerprints (fp) -> (fp, root) for those linked to another one."""
    masks = byte_masks()
    postings = _postings(distinct, F.array(*[F.lit(m) for m in masks]))
    found = written(links(postings, ["_list", "_bytes"], long_list).distinct(), "simhash-links")
    fine = F.array(*[F.array(*[F.lit(m) for m in row]) for row in half_byte_masks()])
    further = _postings(found.where(F.col("v").isNull()).select(F.col("u").alias("fp"), "list"),
                        F.element_at(fine, F.col("list") + 1), F.col("list") * 20)
    more = links(further, ["_list", "_bytes"], None)
    edges = found.where(F.col("v").isNotNull()).unionByName(more).select("u", "v")
    return components(edges).select(F.col("node").alias("fp"), "root")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3, long_list: int = LONG) -> DataFrame:
    """(id, fp, component_id) per row of `docs`; component_id is the smallest id reachable over links.

    Equal fingerprints share a component; fingerprints of up to BITS differing bits are linked. Null and blank texts
    have fingerprint 0, linked like any other. Null ids are never the smallest unless a component has no other.
    Repeated rows repeat in the result. Other columns are not looked at. Empty in, empty out.
    """
    prepare(docs.sparkSession)
    found = written(fingerprints(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text"), "simhash")
    firsts = written(found.groupBy("fp").agg(F.min("_id").alias("_first")), "simhash-distinct")
    classes = written(fingerprint_classes(firsts.select("fp"), long_list), "simhash-classes")
    rooted = firsts.join(classes, "fp", "left").select("fp", "_first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = written(rooted.join(smallest, "root").select("fp", "component_id"), "simhash-named")
    return found.join(named, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """`docs` with one row per component of near_duplicates(): that of the smallest id, null ids last.

    Of rows with the same id, and of repeated rows, one stays. Rows are written once with a number each, so that both passes
    over them see the same rows. All columns are kept.
    """
    prepare(docs.sparkSession)
    named = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    rows = written(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in named.items()], F.monotonically_increasing_id().alias("_row")), "simhash-rows")
    own, body = F.col(named[id_col]), F.col(named[text])
    key = F.struct(own.isNull().alias("none"), own.alias("id"), F.col("_row").alias("row"))
    groups = near_duplicates(rows.select(key.alias("key"), body.alias("text")), "key", "text", shingle)
    first = groups.where(F.col("key") == F.col("component_id")).select(F.col("key.row").alias("_row"))
    return rows.join(first, "_row", "left_semi").select(*[F.col(n).alias(c) for c, n in named.items()])
