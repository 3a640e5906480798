"""Mixing, sharding, the registered queries and the pipeline."""

import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from trialspark.llm import mixing, sharding  # noqa: E402
from trialspark.llm.common import prepare  # noqa: E402


def shared_out(sizes, weights=(1, 2, 3), most=3):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return {**target, **{s: level * weight[s] for s in open_}}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_mix_targets_and_copies(corpus):
    docs, rows = corpus
    size = lambda t: len((t or "").split())
    totals = Counter()
    for r in rows:
        totals[r[3]] += size(r[1])
    want = shared_out(totals)
    got = mixing.mixed(docs.withColumns({"size": F.lit("clash"), "target": F.lit(0)})).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    for r in got:
        assert r.source_size == totals[r.source] and r.target == pytest.approx(want[r.source])
        rate = r.target / r.source_size if r.source_size else 0
        assert r.copies in (int(rate), int(rate) + 1) and r.copies <= 3
    again = mixing.mixed(docs.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    copies = Counter()
    for r in got:
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.repeated(docs).collect()) == +copies


def test_mix_of_many_sources(spark):
    rows = [(i, "w " * (1 + i % 17), f"s{i:05d}") for i in range(25_000)]
    got = mixing.targets(spark.createDataFrame([(r[2], 1 + r[0] % 17) for r in rows], "source string, size long")).collect()
    want = shared_out({r[2]: 1 + r[0] % 17 for r in rows})
    assert all(r.target == pytest.approx(want[r.source]) for r in got) and len(got) == len(rows)


def test_empty_mix_and_shards(nothing):
    assert mixing.mixed(nothing).collect() == [] and mixing.repeated(nothing).collect() == []
    assert sharding.sharded(nothing).collect() == [] and sharding.sharded(nothing, carry=True).collect() == []


@pytest.mark.parametrize("sizes", [[5, 5, 5, 5], [9, 1, 1, 1, 1, 1], [1, 2, 3, 4, 5, 6, 7, 8, 9], [3], [1, 1, 50, 1, 1, 1, 1]])
@pytest.mark.parametrize("shards", [1, 3, 4])
def test_capacity_is_the_smallest(spark, sizes, shards):
    def best(left, k):
        if k == 1 or not left:
            return sum(left)
        return min(max(sum(left[:i]), best(left[i:], k - 1)) for i in range(len(left) + 1))

    row = spark.createDataFrame([([(i, s, 1) for i, s in enumerate(sizes)],)], "cells array<struct<cell:int,size:long,n:long>>")
    capacity, starts = row.select(sharding.smallest_capacity(F.transform("cells", lambda c: c["size"]), shards), sharding.shard_starts(F.col("cells"), shards)).first()
    assert capacity == best(sizes, shards)
    bounds = [0, *starts, len(sizes)]
    assert len(starts) < shards and max(sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)) <= capacity


@pytest.mark.parametrize("part_rows", [2, 100_000])
def test_shards_hold_groups_and_gapless_slots(corpus, part_rows):
    docs, rows = corpus
    got = sharding.sharded(docs.withColumns({"shard": F.lit("clash"), "_n": F.lit(1)}), shards=4, carry=True, part_rows=part_rows).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    slots, where = defaultdict(list), defaultdict(set)
    for r in got:
        data = (r.text or "").encode()
        assert r["size"] == len(data) + 1 and r.text_crc32 == zlib.crc32(data)
        slots[r.shard].append(r.slot)
        where[data].add(r.shard)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and set(slots) <= set(range(4))
    assert all(len(x) == 1 for x in where.values())


SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")


@needs_tables
@pytest.mark.parametrize("name", sorted(entry.CORPUS_SQL))
def test_queries_match_their_sql(spark, name):
    import check
    import duckdb

    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF)
    cur = con.execute(entry.oracle_sql()[name])
    assert check.rows_of(got.columns, got.collect()) == check.rows_of([d[0] for d in cur.description], cur.fetchall())


def test_thirteen_operators_are_registered():
    assert {n.split("_")[0] for n in entry.CORPUS if n != "pipeline"} == {f"op{i}" for i in range(1, 14)} and "pipeline" in entry.CORPUS


@needs_tables
def test_pipeline_stages_keep_what_their_operators_say(spark, tmp_path):
    """Each stage against brute force on its own input."""
    from .test_duplicates import classes, fingerprint
    from .test_filters import counts, hits

    prepare(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        columns, docs = docs.columns, spark.read.parquet(str(tmp_path / str(k)))
        after = docs.collect()
        assert docs.columns[:5] == columns
        ids = Counter(r.doc_id for r in after)
        if k == 0:
            for r in before:
                n, _, _, _, again = counts(r.text)
                assert not ids[r.doc_id] or n >= 50 and 2 * again <= n
        elif k == 1:
            groups = classes({fingerprint(r.text) for r in before})
            first = {}
            for r in before:
                c = groups[fingerprint(r.text)]
                first[c] = min(first.get(c, r.doc_id), r.doc_id)
            assert ids == Counter(first.values())
        elif k == 2:
            assert ids == Counter(r.doc_id for r in before if not hits(r.text, items)[1])
        elif k == 3:
            copies = {r.doc_id: r.copies for r in mixing.mixed(spark.createDataFrame(before)).collect()}
            assert ids == +Counter(copies)
        else:
            assert ids == Counter(r.doc_id for r in before)


@needs_tables
def test_run_writes_each_stage(spark, monkeypatch):
    read = []

    def stage(spark, docs, sf):
        read.append(set(docs.inputFiles()))
        return docs.where("doc_id < 50")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", stage), ("two", stage)])
    got = corpus_pipeline.run(spark, SF)
    assert got.count() == 50
    assert all(SF in f for f in read[0]) and not any(SF in f for f in read[1]) and not read[1] & set(got.inputFiles())
