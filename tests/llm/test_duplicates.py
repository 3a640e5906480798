"""SimHash near-duplicates and substring deduplication against brute force."""

import random
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from trialspark.llm import simhash, substrings
from trialspark.llm.components import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k:k + 3]), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_near_duplicates_match_brute_force(corpus):
    docs, rows = corpus
    got = simhash.near_duplicates(docs.withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))).collect()
    fps = [fingerprint(r[1]) for r in rows]
    found = classes(set(fps))
    smallest = defaultdict(lambda: None)
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            c = found[f]
            smallest[c] = r[0] if smallest[c] is None else min(smallest[c], r[0])
    want = Counter((r[0], f, smallest[found[f]]) for r, f in zip(rows, fps, strict=True))
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got) == want


@pytest.mark.parametrize("long_list", [3, 1024])
def test_fingerprint_classes_of_dense_clusters(spark, long_list):
    """Clusters with long lists: the further index finds the same links."""
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(300)}
    for _ in range(4):
        centre = r.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(r.randint(0, 4)):
                x ^= 1 << r.randrange(16)  # all in two bytes: one hot list each
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    got = {a % (1 << 64): b % (1 << 64) for a, b in simhash.fingerprint_classes(spark.createDataFrame(signed, "fp long").repartition(5), long_list).collect()}
    want = classes(fps)
    groups = defaultdict(set)
    for f, c in want.items():
        groups[c].add(f)
    for group in groups.values():
        assert len({got.get(f, f) for f in group}) == 1
    assert len({got.get(f, f) for f in fps}) == len(groups)


def test_one_of_each_keeps_columns_and_one_row(corpus):
    docs, rows = corpus
    kept = simhash.one_of_each(docs.withColumn("_row", F.lit(9))).collect()
    groups = classes({fingerprint(r[1]) for r in rows})
    assert len(kept) == len(set(groups.values()))
    assert kept[0]["_row"] == 9 and len(kept[0]) == 6


def test_components_of_a_chain_and_loops(spark):
    edges = [(i, i + 1) for i in range(50)] + [(70, 70), (80, 81), (81, 80)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 80: 80, 81: 80}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def removed(rows, window):
    texts = [(r[1] or "").encode().split() for r in rows]
    met = Counter(tuple(w[k:k + window]) for w in texts for k in range(len(w) - window + 1))
    out = []
    for w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if met[tuple(w[k:k + window])] > 1:
                gone |= set(range(k, k + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


@pytest.mark.parametrize("window", [35, 12])
def test_substrings_match_brute_force(corpus, window):
    docs, rows = corpus
    got = substrings.deduplicated(docs.withColumns({"k1": F.lit(0), "gone": F.lit("x"), "kept_text": F.lit("y")}), window=window).collect()
    want = Counter((r[0], *x) for r, x in zip(rows, removed(rows, window), strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert sum(r.n_removed for r in got) > 0


def test_substrings_of_periodic_and_random_texts(spark):
    """A small alphabet, where names repeat by chance and stretches differ at their ends."""
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.choice([34, 35, 36, 200]))), None, None, None) for i in range(40)]
    rows += [(100 + i, " ".join("abc"[k % p] for k in range(120)), None, None, None) for i, p in enumerate((1, 2, 3))]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    for window in (8, 35):
        assert Counter(tuple(x) for x in substrings.deduplicated(docs, window=window).collect()) == Counter((r[0], *x) for r, x in zip(rows, removed(rows, window), strict=True))


def test_empty_tables(nothing):
    assert simhash.near_duplicates(nothing).collect() == []
    assert simhash.one_of_each(nothing).collect() == []
    assert substrings.deduplicated(nothing).collect() == []
