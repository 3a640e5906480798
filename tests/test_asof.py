import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trialspark.operators.asof import as_of

LEFT, RIGHT = "k string, at bigint, id int", "k string, at bigint, v string, w int"


def looked_up(left, right, strict):
    out = Counter()
    for k, at, i in left:
        best = max(((a, v, w) for key, a, v, w in right if key == k and k is not None and a is not None and at is not None and (a < at if strict else a <= at)),
                   default=(None, None, None))
        out[(k, at, i, *best)] += 1
    return out


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("hot", [None, 10])
def test_as_of_equals_brute_force(spark, strict, hot):
    rng = random.Random(6)
    def key():
        return rng.choice(["hot"] * 6 + ["a", "b", "c", None])
    left = [(key(), rng.choice([None, *range(-20, 200)]), i) for i in range(300)] + [("lone", 5, 900), ("a", 7, 901), ("a", 7, 901)]
    right = [(key(), rng.choice([None, *range(-20, 200, 3)]), rng.choice("xyz"), rng.randrange(3)) for _ in range(200)] + [("other", 1, "x", 1)]
    got = as_of(spark.createDataFrame(left, LEFT).repartition(3), spark.createDataFrame(right, RIGHT).repartition(2), ["k"], "at", ["v", "w"], strict, hot_rows=hot)
    assert got.columns == ["k", "at", "id", "matched_at", "v", "w"]
    assert Counter(map(tuple, got.collect())) == looked_up(left, right, strict)


def test_as_of_two_keys_and_empty_tables(spark):
    left = spark.createDataFrame([("a", 1, 5, "l")], "k string, n int, at int, note string")
    right = spark.createDataFrame([("a", 1, 4, 1.5), ("a", 2, 5, 2.5), ("b", 1, 5, 3.5)], "k string, n int, at int, price double")
    assert [tuple(r) for r in as_of(left, right, ["k", "n"], "at", ["price"], matched_at="seen").collect()] == [("a", 1, 5, "l", 4, 1.5)]
    assert [tuple(r) for r in as_of(left, right.limit(0), ["k", "n"], "at", ["price"]).collect()] == [("a", 1, 5, "l", None, None)]
    assert as_of(left.limit(0), right, ["k", "n"], "at", ["price"]).collect() == []


def test_as_of_shuffles_each_table_once(spark):
    left, right = spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("at")), spark.range(1000).select(F.col("id").alias("k"), F.col("id").alias("at"), F.lit(1).alias("v"))
    plan = as_of(left, right, ["k"], "at", ["v"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1
