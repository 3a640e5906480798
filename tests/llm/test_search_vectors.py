import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialspark.llm import lexical, queries, topk, whitening
from trialspark.llm.ranking import best

from .conftest import DOCS

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def searched(docs, items, k):
    """Every item against every document, by the formula."""
    bags = [(doc, Counter(terms(text))) for doc, text, *_ in docs]
    bags = [(doc, bag) for doc, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = []
    for item, text in items:
        found = []
        for doc, bag in bags:
            m = 75 + 25 * sum(bag.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text))
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return Counter(out)


def rows(df):
    return Counter(map(tuple, df.collect()))


def items_of(docs):
    r = random.Random(5)
    texts = [t for _, t, *_ in docs if t]
    out = [(i, " ".join(r.sample(r.choice(texts).split(), 3) if i % 2 else r.choice(texts).split()[:12])) for i in range(12)]
    return out + [(20, None), (21, ""), (22, "?! --"), (23, "neverseen"), (24, "ÜBER über Über W1 w1"), (25, "ha batman"), (25, "ha batman"), (None, "one two"),
                  (26, "w1 " * 3000), (27, " ".join(f"w{i}" for i in range(400)))]


@pytest.mark.parametrize("block,k", [(lexical.BLOCK_BYTES, 20), (200, 3)])
def test_search_equals_brute_force(spark, corpus, block, k):
    frame, docs = corpus
    items = items_of(docs)
    got = lexical.search(frame, spark.createDataFrame(items, ITEMS), k, block_bytes=block)
    assert rows(got) == searched(docs, items, k)


def test_search_small_steps_and_wide_integers(spark, corpus, monkeypatch):
    """Tasks that expand few postings at a time, and sums too large for doubles, give the same scores."""
    _, docs = corpus
    bag = Counter(terms("w1 w1 w2 w3"))
    vocabulary = {t: i for i, t in enumerate(bag)}
    index = lexical.Postings(np.array([0, 2, 3, 4]), np.array([0, 1, 1, 0]), np.array([5, 7, 11, 13]), 2)
    n, ends, slots, tfs = np.array([4, 2, 0]), np.array([0, 3, 4, 4]), np.array([0, 1, 2, 0]), np.array([2, 1, 1, 2])
    want = index.scores(n, ends, slots, tfs, 3, 6)
    assert len(vocabulary) == 3 and want[2].tolist() == [0, 0]
    monkeypatch.setattr(lexical, "POSTINGS", 1)
    assert (index.scores(n, ends, slots, tfs, 3, 6) == want).all()
    index.exact = False
    assert (index.scores(n, ends, slots, tfs, 3, 6) == want).all()
    assert not lexical.Postings(np.array([0, 1]), np.array([0]), np.array([2**40]), 1).exact


def test_search_ties_repeats_and_hidden_columns(spark):
    docs = [(i % 7, "alpha beta" if i % 2 else "beta gamma", "x", i) for i in range(300)] + [(None, "alpha beta", "x", 1)]
    names = "doc_id long, text string, doc string, n int"
    frame = spark.createDataFrame(docs, names).withColumns({c: F.lit(1) for c in ("slots", "tfs", "score", "rank", "_item", "_id", "part", "item", "_text")}).repartition(5)
    items = spark.createDataFrame([(1, "alpha", 5), (2, "gamma delta", 6)], "item_id long, text string, rank int")
    assert rows(lexical.search(frame, items, 5)) == searched([d[:2] for d in docs], [(1, "alpha"), (2, "gamma delta")], 5)


def test_search_of_empty_tables(spark, nothing, corpus):
    frame, _ = corpus
    none = spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "w1")], ITEMS)
    for docs, items in ((nothing, one), (frame, none), (nothing, none), (spark.createDataFrame([(1, None, None, None, None)], DOCS), one)):
        got = lexical.search(docs, items)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_best_merges_many_parts(spark):
    r = random.Random(3)
    data = [(key, part, r.randrange(50), i) for i, (key, part) in enumerate((r.choice("ab"), r.randrange(5000)) for _ in range(6000))]
    frame = spark.createDataFrame(data, "k string, part int, score int, id int")
    got = rows(best(frame, ["k"], [F.col("score").desc(), F.col("id")], 7, "part", 5000).select("k", "rank", "score", "id"))
    want = Counter()
    for key in "ab":
        for rank, (s, i) in enumerate(sorted((-s, i) for k, _, s, i in data if k == key)[:7], 1):
            want[(key, rank, -s, i)] += 1
    assert got == want


VECTORS = "vec_id long, embedding array<float>"


def nearest(data, k, every=100, scale=1024):
    rows = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in data
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (query, q) in enumerate(rows):
        if query is not None and query % every == 0:
            found = sorted((-max(-2**63, min(2**63 - 1, sum(x * y for x, y in zip(q, v)))), i is None, i or 0, i) for b, (i, v) in enumerate(rows) if b != a and len(v) == len(q))
            out += [(query, rank, x[3], -x[0]) for rank, x in enumerate(found[:k], 1)]
    return Counter(out)


def vectors(seed=2, n=450, size=6):
    r = random.Random(seed)
    hot = [r.gauss(0, 1) for _ in range(size)]
    data = [(i, hot if i % 3 == 0 else [r.choice([0.0, -0.0, 0.5, r.gauss(0, 1)]) for _ in range(size)]) for i in range(-100, n)]
    data += [(500, None), (600, [None] * size), (700, [float("nan")] + [0.0] * (size - 1)), (800, [float("inf")] + [0.0] * (size - 1))]
    data += [(900, [0.0] * size), (1000, [1.0, 2.0]), (1001, [3.0, 4.0]), (1100, []), (1101, []), (None, hot), (None, [1.0] * size)]
    data += [data[100], data[100], data[107], (200, [9.0] * size)]  # repeated rows, and a second row of a query's id
    return data


@pytest.mark.parametrize("shards,k", [(None, 10), (1, 3), (70, 4)])
def test_top_k_equals_brute_force(spark, shards, k):
    data = vectors()
    frame = spark.createDataFrame(data, VECTORS).repartition(7)
    assert rows(topk.top_k(frame, k, shards=shards)) == nearest(data, k)


def test_top_k_of_small_tiles_far_entries_and_hidden_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "TILE", (3, 5))
    data = vectors(3, 130) + [(1200, [1e30, -1e30, 3e38, 0.0, 1.0, 2.0]), (1201, [1e30] * 6), (1300, [2e7, 3.0, 1e8, 5.0, 1.0, -7.0]), (1301, [3e8, 1.0, 1.0, 1.0, 1.0, 2.0])]
    frame = spark.createDataFrame(data, VECTORS).withColumns({c: F.lit("x") for c in ("id", "x", "_row", "shard", "size", "_query", "rank", "score", "own", "query_id")}).repartition(3)
    got = topk.top_k(frame, 5, shards=2)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and rows(got) == nearest(data, 5)


def test_top_k_of_empty_tables(spark):
    for data in ([], [(100, None)], [(100, [1.0])], [(1, [1.0])]):
        assert topk.top_k(spark.createDataFrame(data, VECTORS)).collect() == []


def whole(v):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]


def check_whitened(got, data, components):
    """Against an eigendecomposition of the covariance in plain numpy, from exact integers."""
    x = [(i, whole(v)) for i, v in data]
    n, size = len(x), len(x[0][1])
    sums = [sum(v[d] for _, v in x) for d in range(size)]
    deep = np.array([[n * v[d] - sums[d] for d in range(size)] for _, v in x], object)
    cov = (deep.T @ deep).astype(float) / n**3
    values, basis = np.linalg.eigh(cov)
    values, basis = values[::-1], basis[:, ::-1]
    rank = min(components, int((values > 1e-10 * values[0]).sum()))
    want = Counter((i, int((row * row).sum())) for (i, _), row in zip(x, deep))
    assert Counter((r.vec_id, r.deviation) for r in got) == want and {r.n for r in got} == {n}
    assert {len(r.whitened) for r in got} == {rank}
    np.testing.assert_allclose(got[0].explained, values[:rank] / values.sum(), rtol=1e-9)
    assert got[0].identity_error < 1e-9
    plain = {}
    for (i, _), row in zip(x, deep):
        plain[i] = (row.astype(float) / n) @ basis[:, :rank] / np.sqrt(values[:rank])
    gaps = np.abs(np.diff(values[:rank + 1] if rank < size else np.append(values, 0)))
    apart = [k for k in range(rank) if gaps[k] > 1e-3 * values[0] and (k == 0 or gaps[k - 1] > 1e-3 * values[0])]
    signs = None
    for r in got:
        ours, theirs = np.array(r.whitened)[apart], plain[r.vec_id][apart]
        if signs is None and (np.abs(theirs) > 1e-3).all():
            signs = np.sign(ours * theirs)
        if signs is not None:
            np.testing.assert_allclose(ours * signs, theirs, atol=1e-6)


@pytest.mark.parametrize("size,components", [(12, 32), (40, 32), (5, 3)])
def test_whitened_equals_numpy(spark, size, components):
    r = np.random.default_rng(size)
    data = [(i, (r.normal(size=size) * np.linspace(0.1, 3, size)).tolist()) for i in range(300)]
    frame = spark.createDataFrame(data, VECTORS).repartition(5)
    check_whitened(whitening.whitened(frame, components).collect(), data, components)


def test_whitened_of_dependent_entries_and_dropped_rows(spark):
    r = random.Random(8)
    data = [(i, [a := r.randrange(-50, 50) / 64, 2 * a, b := r.randrange(-9, 9) / 64, a + b, 0.25]) for i in range(90)] + [(None, [1.0, 2.0, 0.0, 1.0, 0.25])]
    data.append(data[3])
    extra = [(500, None), (501, [None] * 5), (502, [float("nan")] * 5), (503, [float("-inf")] + [0.0] * 4), (504, [1.0]), (505, [])]
    frame = spark.createDataFrame(data + extra, VECTORS).withColumns({c: F.lit(2) for c in ("id", "x", "n", "i", "j", "s", "whitened", "size", "deviation")}).repartition(4)
    got = whitening.whitened(frame).collect()
    check_whitened(got, data, 32)
    assert len(got[0].whitened) == 2


def test_whitened_of_far_entries(spark):
    data = [(i, [float(i * 1e9), float(-i % 7), 1e30 if i == 5 else 0.0]) for i in range(50)]
    got = {r.vec_id: r for r in whitening.whitened(spark.createDataFrame(data, VECTORS)).collect()}
    assert len(got) == 50 and got[5].deviation == 2**63 - 1 and got[5].identity_error < 1e-4


def test_whitened_without_variance_or_rows(spark):
    for data in ([], [(1, None)], [(1, [])]):
        assert [len(r.whitened) for r in whitening.whitened(spark.createDataFrame(data, VECTORS)).collect()] in ([], [0])
    same = whitening.whitened(spark.createDataFrame([(i, [0.5, 0.5]) for i in range(4)], VECTORS)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(4, 0, [], [], 0.0)] * 4


def test_eigen_of_wide_spectra():
    """Small eigenvalues keep their digits where the factor is well scaled by the diagonal."""
    r = np.random.default_rng(1)
    d = np.logspace(0, -6, 8)
    q = r.normal(size=(200, 8))
    scatter = (q * d).T @ (q * d)
    values, vectors = whitening.eigen(scatter)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(8), atol=1e-12)
    np.testing.assert_allclose(scatter @ vectors, vectors * values, atol=1e-12 * values[0])
    np.testing.assert_allclose(values, np.linalg.svd(q * d, compute_uv=False) ** 2, rtol=1e-6)


def test_pairs_of_rounds_are_complete():
    for n in range(2, 9):
        pairs = [(a, b) for p, q in whitening.rounds(n) for a, b in zip(p.tolist(), q.tolist())]
        assert sorted(pairs) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_new_queries_cover_their_tables(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/embeddings.parquet").count()
    got = queries.QUERIES["op13_whiten_embeddings"](spark, sf)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.count() == 32 * n and got.agg(F.max("identity_error")).first()[0] < 1e-6
    assert queries.QUERIES["op12_exact_top_k"](spark, sf).columns == ["query_id", "rank", "vec_id", "score"]
