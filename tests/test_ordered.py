"""Ordered helpers against plain Python, with groups cut into many chunks and with none cut."""

import random

import pytest
from pyspark.sql import functions as F

from trialspark.operators import replay, summaries
from trialspark.plans import ordered

KEYS, ORDER = ["trial_id"], ["us", "seq"]
CUTS = [None, 0, 20, ordered.BOUNDED]  # never, every group, hot ones only, plain window


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    out, seq = [], 0
    for trial in range(12):
        n = 300 if trial == 0 else rng.randint(1, 30)  # trial 0 is hot
        us = 0
        for _ in range(n):
            us += rng.choice([0, 1, 2, 7, 40])
            seq += 1
            out.append((trial, us, seq, rng.choice("ab") + rng.choice(["", " "]), rng.choice([0, 1, None]), rng.randint(-9, 9)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "trial_id int, us bigint, seq bigint, command string, exit_code int, v int").repartition(5)


def groups(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    return by


@pytest.mark.parametrize("hot", CUTS)
def test_running_values(df, rows, hot):
    for through in (True, False):
        got = {r.seq: (r.n, r.s, r.m) for r in ordered.running(
            df, KEYS, ORDER, F.col("us"),
            {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, through, hot).collect()}
        for g in groups(rows).values():
            for i, r in enumerate(g):
                past = [x[5] for x in g[:i + through]]
                assert got[r[2]] == (len(past), sum(past), max(past) if past else None)


@pytest.mark.parametrize("hot", CUTS)
@pytest.mark.parametrize("following", [False, True])
def test_neighbour(df, rows, hot, following):
    got = {r.seq: r.x for r in ordered.neighbour(df, KEYS, ORDER, F.col("us"), "x", F.col("seq"), following, hot).collect()}
    for g in groups(rows).values():
        for i, r in enumerate(g):
            j = i + 1 if following else i - 1
            assert got[r[2]] == (g[j][2] if 0 <= j < len(g) else None)


@pytest.mark.parametrize("hot", CUTS)
def test_recent_and_loop_guard(df, rows, hot):
    got = {r.seq: r for r in replay.loop_guard(df, ORDER, F.col("us"), hot_rows=hot).collect()}
    for g in groups(rows).values():
        for i, r in enumerate(g):
            last = [(x[3].strip(), x[4]) for x in g[max(0, i - 9):i + 1]]
            n = last.count(last[-1])
            assert (got[r[2]].repeats, got[r[2]].warned, got[r[2]].stuck) == (n, 3 <= n < 5, n >= 5)


def test_positions_are_dense(spark, df, rows):
    got = ordered.positions(df, [F.col("v").desc(), F.col("seq")], "p").collect()
    want = {r[2]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (-r[5], r[2])))}
    assert {r.seq: r.p for r in got} == want


def test_a_hot_group_is_split_and_others_are_not(spark):
    # One trial holds a third of all rows.
    rows = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("trial_id"), (F.col("id") * 1000).alias("us"), F.col("id").alias("seq"))
    cut = ordered.chunked(rows, KEYS, F.col("us"), hot_rows=1000)
    sizes = cut.groupBy("trial_id", "_chunk").count()
    assert sizes.agg(F.max("count")).first()[0] <= 1000
    assert sizes.where("trial_id = 0").count() >= 20
    assert sizes.where("trial_id > 0 AND _chunk <> 0").count() == 0
    numbered = ordered.numbered(cut, KEYS, ORDER, F.col("us"), "n").where("trial_id = 0")
    assert numbered.agg(F.count_distinct("n"), F.max("n"), F.count_if((F.col("n") - 1) * 3 != F.col("seq"))).first() == (20_000, 20_000, 0)


def test_chunks_are_reused_without_a_second_shuffle(df):
    cut = ordered.chunked(df, KEYS, F.col("us"))
    guarded = replay.loop_guard(ordered.numbered(cut, KEYS, ORDER, F.col("us"), "idx"), ORDER, F.col("us"))
    guarded.collect()
    # Two windows, one sort and one exchange of the rows once the empty list of hot groups is known.
    final = guarded._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Window [") == 2 and final.count("Exchange hashpartitioning(trial_id") == 1


@pytest.mark.parametrize("hot", [None, 0])
def test_file_growth(spark, hot):
    log = [("log", i * 200_000 + (1_500_000 if i > 5 else 0), i, 200 * (i % 6 + 1)) for i in range(12)]
    log += [("beat", i * 2_000_000, i, 10) for i in range(3)] + [("audit", 0, 0, 99)]
    got = summaries.file_growth(spark.createDataFrame(log, "source string, us bigint, seq int, size int"), hot)
    top = got.orderBy(F.col("grown").desc()).collect()
    assert (top[0].source, top[0].grown, top[0].restarts) == ("log", 2000, 1)
    assert {r.source: r.grown for r in top[1:]} == {"beat": 0, "audit": 0}
