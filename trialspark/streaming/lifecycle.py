"""Run and trial states folded from a feed of actions, exactly once per micro-batch.

Actions (seq, run_id, trial_id, action, status): claim, finish, crash, and cancel for a run.
Rules: a claim needs a queued or running trial; a finish or crash always applies; a cancel
takes queued trials only, and an open run; a run is done when a finish leaves it no open
trial. The outcome of any number of actions follows from the first and last of each kind, so a
batch is folded by aggregates and joins, without walking through it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..plans.joins import join_one
from .run import each_batch

TRIAL_COLUMNS = ["run_id", "trial_id", "status", "started_seq", "finished_seq"]
RUN_COLUMNS = ["run_id", "run_status", "closed_seq"]


def new_trials(plan: DataFrame) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return plan.select("run_id", "trial_id", F.lit("queued").alias("status"), none.alias("started_seq"), none.alias("finished_seq"))


def new_runs(plan: DataFrame) -> DataFrame:
    return plan.select("run_id").distinct().select("run_id", F.lit("queued").alias("run_status"),
                                                   F.lit(None).cast("bigint").alias("closed_seq"))


def fold_trials(trials: DataFrame, actions: DataFrame) -> DataFrame:
    """Trial states after a batch of actions, with what `fold_runs` needs to know of the change.

    `trials` holds all trials of the runs the batch touches.
    """
    kind, seq = F.col("action"), F.col("seq")
    ends = kind.isin("finish", "crash")
    said = F.when(kind == "crash", "ERROR").otherwise(F.col("status"))
    per_trial = (actions.where(kind != "cancel").groupBy("trial_id").agg(
        F.min(F.when(kind == "claim", seq)).alias("claim1"),
        F.min(F.when(ends, seq)).alias("end1"), F.max(F.when(ends, seq)).alias("end2"),
        F.max_by(said, F.when(ends, seq)).alias("end_status")))
    # Only claims before the first end can count; one row per trial again.
    claims = (join_one(actions.where(kind == "claim").select("trial_id", "seq"), per_trial.select("trial_id", "end1"), ["trial_id"])
              .where(F.col("end1").isNull() | (seq < F.col("end1")))
              .groupBy("trial_id").agg(F.max("seq").alias("claim2")))
    cancels = actions.where(kind == "cancel").groupBy("run_id").agg(F.min("seq").alias("cancel1"))
    state = (trials.join(per_trial, "trial_id", "left").join(claims, "trial_id", "left"))
    state = join_one(state, cancels, ["run_id"], "left")  # a run may hold very many trials
    never = F.lit(2 ** 62)
    first_touch = F.least(F.coalesce("claim1", never), F.coalesce("end1", never))
    cancelled = (F.col("status") == "queued") & (F.col("cancel1") < first_touch)
    claimed = F.col("status").isin(*C.OPEN) & ~F.coalesce(cancelled, F.lit(False)) & F.col("claim2").isNotNull()
    flags = state.withColumn("_c", F.coalesce(cancelled, F.lit(False))).withColumn("_k", F.coalesce(claimed, F.lit(False)))
    return flags.select(
        "run_id", "trial_id", F.col("status").alias("_was"), "end1", "_k",
        (F.col("end2").isNotNull() | F.col("_c") | F.col("_k")).alias("_changed"),
        F.when(F.col("end_status").isNotNull(), F.col("end_status")).when(F.col("_c"), "cancelled")
         .when(F.col("_k"), "running").otherwise(F.col("status")).alias("status"),
        F.when(F.col("_k"), F.col("claim2")).otherwise(F.col("started_seq")).alias("started_seq"),
        F.coalesce("end2", F.when(F.col("_c"), F.col("cancel1")), "finished_seq").alias("finished_seq"))


def fold_runs(runs: DataFrame, after: DataFrame, actions: DataFrame) -> DataFrame:
    """Run states, from the result of `fold_trials`."""
    cancels = actions.where("action = 'cancel'").groupBy("run_id").agg(F.min("seq").alias("cancel1"))
    # When a run's last open trial ends; null while one stays open.
    was_open = F.col("_was").isin(*C.OPEN)
    closing = after.groupBy("run_id").agg(
        F.count_if(was_open & F.col("end1").isNull()).alias("_left"),
        F.max(F.when(was_open, F.col("end1"))).alias("_last"), F.max("end1").alias("_any_end"),
        F.max("_k").alias("_started"))
    run_state = runs.join(closing, "run_id").join(cancels, "run_id", "left")
    done_at = F.when(F.col("_left") == 0, F.coalesce("_last", "_any_end"))
    is_open = F.col("run_status").isin(*C.OPEN)
    cut = is_open & F.col("cancel1").isNotNull() & F.coalesce(F.col("cancel1") < F.col("_done"), F.lit(True))
    return run_state.withColumn("_done", done_at).withColumn("_cut", cut).select(
        "run_id",
        F.when(F.col("_cut"), "cancelled").when(is_open & F.col("_done").isNotNull(), "done")
         .when((F.col("run_status") == "queued") & F.col("_started"), "running").otherwise(F.col("run_status")).alias("run_status"),
        F.when(F.col("_cut"), F.col("cancel1")).when(is_open & F.col("_done").isNotNull(), F.col("_done"))
         .otherwise(F.col("closed_seq")).alias("closed_seq"))


class StateTable:
    """A keyed table kept as a base and one set of changed rows per batch, in the shared folder.

    A batch writes only rows it changed, and overwrites its own set when it is run again. Every
    `compact_every` batches the set is the whole table, and readers start from there.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, compact_every: int = 20):
        self.spark, self.path, self.key, self.every = spark, path, key, compact_every

    def create(self, rows: DataFrame) -> None:
        """Write the base, unless an earlier start of the same stream already did."""
        rows.write.mode("ignore").parquet(f"{self.path}/batch=-1")

    def last(self) -> int:
        return self.spark.read.parquet(self.path).agg(F.max("batch")).first()[0]

    def _start(self, batch_id: int) -> int:
        return -1 if batch_id < self.every - 1 else (batch_id + 1) // self.every * self.every - 1

    def as_of(self, batch_id: int, only: DataFrame | None = None, on: str | None = None) -> DataFrame:
        """Latest rows after a batch; `only` keeps those whose `on` is among its rows."""
        parts = [f"{self.path}/batch={b}" for b in range(self._start(batch_id), batch_id + 1)]
        log = self.spark.read.option("basePath", self.path).parquet(*parts)
        if only is not None:
            log = log.join(only, on, "left_semi")
        rest = [c for c in log.columns if c not in (self.key, "batch")]
        return (log.groupBy(self.key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
                .select(self.key, "r.*"))

    def save(self, batch_id: int, changed: DataFrame) -> None:
        if (batch_id + 1) % self.every == 0:
            untouched = self.as_of(batch_id - 1).join(changed.select(self.key), self.key, "left_anti")
            changed = untouched.unionByName(changed)
        changed.write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def lifecycle(actions: DataFrame, plan: DataFrame, target: str, compact_every: int = 20) -> tuple[DataFrame, DataFrame]:
    """Fold a stream of actions into trial and run tables; returns both as of the last batch."""
    spark = plan.sparkSession
    trials = StateTable(spark, f"{target}/trials", "trial_id", compact_every)
    runs = StateTable(spark, f"{target}/runs", "run_id", compact_every)
    trials.create(new_trials(plan))
    runs.create(new_runs(plan))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read several times below
        own = batch.sparkSession
        t, r = (StateTable(own, s.path, s.key, s.every) for s in (trials, runs))
        touched = batch.select("run_id")
        after = fold_trials(t.as_of(batch_id - 1, touched, "run_id").select(*TRIAL_COLUMNS), batch).persist()
        t.save(batch_id, after.where("_changed").select(*TRIAL_COLUMNS))
        r.save(batch_id, fold_runs(r.as_of(batch_id - 1, touched, "run_id").select(*RUN_COLUMNS), after, batch))
        after.unpersist()
        batch.unpersist()

    each_batch(actions, target, "append", save)
    return trials.as_of(trials.last()), runs.as_of(runs.last())
