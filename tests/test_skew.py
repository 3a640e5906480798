"""A run that holds a third of all trials: its join partition is split, and no row is lost."""

import pytest
from pyspark.sql import functions as F

from trialspark.operators import fleet, replay, summaries
from trialspark.plans.joins import join_one
from trialspark.session import tune

SMALL = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
         "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
         "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB"}
N = 120_000


@pytest.fixture()
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL}
    tune(spark)
    for k, v in SMALL.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def trials(spark):
    run = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 1000 + 1)
    return spark.range(0, N, 1, 6).select(run.alias("run_id"), F.col("id").alias("trial_id"), F.sha2(F.col("id").cast("string"), 256).alias("task"),
                                          F.lit("PASS").alias("status"))


def test_runs_with_trials_splits_the_hot_run(small_partitions):
    spark = small_partitions
    runs = spark.range(1100).select(F.col("id").alias("run_id"), F.lit("m").alias("model"))
    rows, plan = final_plan(summaries.runs_with_trials(runs, trials(spark)))
    assert len(rows) == N + 99  # 99 runs have none
    assert len({r.trial_id for r in rows}) == N + 1
    assert "skewed" in plan or "isSkew" in plan or "skew=true" in plan, plan


def test_watchdog_splits_a_hot_trial(small_partitions):
    spark = small_partitions
    samples = trials(spark).select(F.col("run_id").alias("trial_id"), (F.col("trial_id") * 1_000_000).alias("us"),
                                   (F.col("trial_id") % 50).cast("double").alias("disk_mb"))
    rows, plan = final_plan(replay.watchdog(samples, 60_000, 48, hot_rows=2000))
    assert len(rows) == samples.select("trial_id").distinct().count()
    # One shuffle by trial and chunk, no join of the samples by trial.
    assert "Exchange hashpartitioning(trial_id" in plan and "_chunk" in plan


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("hot_rows", [0, 1000, None])
def test_join_one(spark, how, hot_rows):
    many = trials(spark).where("trial_id < 9000").select("run_id", "trial_id")
    one = many.groupBy("run_id").agg(F.count("trial_id").alias("n")).where("run_id % 2 = 0")
    got = join_one(many, one, ["run_id"], how, hot_rows)
    want = many.join(one, ["run_id"], how)
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_completed_runs_with_a_hot_run(small_partitions):
    spark = small_partitions
    runs = spark.range(1100).select(F.col("id").alias("run_id"), F.lit("running").alias("run_status"))
    waiting = trials(spark).withColumn("status", F.when(F.col("run_id") == 0, "queued").otherwise("PASS"))
    assert {r.run_id for r in fleet.completed_runs(runs, waiting).collect()} == set(range(1, 1100))
