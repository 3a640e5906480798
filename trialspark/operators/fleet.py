"""Runs, plans, leases and workers: joins that follow the state of a running evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.text import short_id
from ..plans import ordered


def trial_plan(requests: DataFrame) -> DataFrame:
    """One queued trial per requested (run_id, task) and number 1..trials; ids come from the key."""
    return (requests.withColumn("trial_no", F.explode(F.sequence(F.lit(1), F.col("trials"))))
            .select(short_id(F.col("run_id"), F.col("task"), F.col("trial_no")).alias("id"),
                    "run_id", "task", "trial_no", F.lit("queued").alias("status")))


def named_tasks(requests: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requests with a task each: one that names none (null) asks for every task of the catalogue (task)."""
    named = requests.where(F.col("task").isNotNull())
    every = requests.where(F.col("task").isNull()).drop("task").join(catalogue.select("task").distinct())
    return named.unionByName(every.select(*requests.columns))


def unknown_tasks(requested: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Requested (run_id, ord, task) rows that the catalogue (task) does not hold."""
    return requested.join(catalogue.select("task"), "task", "left_anti")


def completed_runs(runs: DataFrame, trials: DataFrame) -> DataFrame:
    """Open runs none of whose trials is queued or running: they are done."""
    waiting = trials.where(F.col("status").isin(*C.OPEN)).select("run_id").distinct()
    return runs.where(F.col("run_status").isin(*C.OPEN)).join(waiting, "run_id", "left_anti")


def key_problems(runs: DataFrame, trials: DataFrame) -> DataFrame:
    """Repeated (run_id, task, trial_no) and trials whose run is missing, with their counts."""
    per_key = trials.groupBy("run_id", "task", "trial_no").agg(F.count(F.lit(1)).alias("rows"))
    twice = per_key.where("rows > 1").withColumn("problem", F.lit("duplicate"))
    lost = (per_key.join(runs.select("run_id"), "run_id", "left_anti")
            .withColumn("problem", F.lit("orphan")))
    return twice.unionByName(lost)


def dead_workers(leases: DataFrame, heartbeats: DataFrame, now: Column,
                 ttl_seconds: int = C.HEARTBEAT_SECONDS) -> DataFrame:
    """Workers with leases whose last heartbeat is too old or missing."""
    holders = leases.groupBy("worker").agg(F.count(F.lit(1)).alias("held"))
    last = heartbeats.groupBy("worker").agg(F.max("us").alias("last_beat"))
    joined = holders.join(last, "worker", "left")
    gone = F.coalesce(F.col("last_beat") <= now - ttl_seconds * 1_000_000, F.lit(True))
    return joined.where(gone).select("worker", "held", "last_beat")


def rerun_order(dead_leases: DataFrame, queue: DataFrame) -> DataFrame:
    """Trials in the order they run next: orphans newest lease first, then the queue in its order.

    dead_leases(worker, trial_id, seq), queue(trial_id, seq).
    """
    both = (dead_leases.select("worker", "trial_id", "seq", F.lit(0).alias("stage"))
            .unionByName(queue.select(F.lit(None).cast(dead_leases.schema["worker"].dataType).alias("worker"),
                                      "trial_id", "seq", F.lit(1).alias("stage"))))
    order = [F.col("stage"), F.col("worker").desc(),
             F.when(F.col("stage") == 0, -F.col("seq")).otherwise(F.col("seq")), F.col("trial_id")]
    return ordered.positions(both, order, "position")


def task_catalogue(files: DataFrame) -> DataFrame:
    """Task folders from (task, relpath, content): instruction, allowed paths, problem.

    Folders without an instruction are not tasks. `problem` names missing files, or a task.json
    that cannot be read; it is null for a good task.
    """
    needed = F.array(*[F.lit(f) for f in C.TASK_FILES])
    kept = [*C.TASK_FILES, "task.json"]
    text = F.col("content").cast("string")
    # Only five names per folder matter: the set is bounded, whatever else the folder holds.
    folders = (files.where(F.col("relpath").isin(*kept)).groupBy("task").agg(
        F.collect_set("relpath").alias("have"),
        F.max(F.when(F.col("relpath") == "instruction.md", text)).alias("instruction"),
        F.max(F.when(F.col("relpath") == "task.json", text)).alias("config"))
        .where(F.array_contains("have", "instruction.md")))
    missing = F.filter(needed, lambda f: ~F.array_contains("have", f))
    bad = F.col("config").isNotNull() & F.try_parse_json("config").isNull()
    problem = (F.when(F.size(missing) > 0, F.concat(F.lit("task '"), F.col("task"), F.lit("' is missing: "),
                                                    F.array_join(missing, ", ")))
               .when(bad, F.concat(F.lit("task '"), F.col("task"), F.lit("' has invalid task.json"))))
    paths = F.from_json("config", "allowed_paths array<string>")["allowed_paths"]
    return folders.select("task", "instruction",
                          F.coalesce(paths, F.array().cast("array<string>")).alias("allowed_paths"),
                          problem.alias("problem"))


def permission_audit(inventory: DataFrame, exceptions: DataFrame, owner: str, group: str,
                     dir_mode: int, file_mode: int) -> DataFrame:
    """Paths whose owner, group or mode is not as expected. exceptions(path, expected_mode)."""
    rule = exceptions.select(F.col("path").alias("_path"), "expected_mode")
    joined = inventory.join(rule, inventory["path"] == rule["_path"], "left").drop("_path")
    want = F.coalesce("expected_mode", F.when(F.col("is_dir"), dir_mode).otherwise(file_mode))
    actual = F.concat("owner", F.lit(":"), "group", F.lit(" "), F.col("mode").cast("string"))
    expected = F.concat(F.lit(f"{owner}:{group} "), want.cast("string"))
    return (joined.withColumn("actual", actual).withColumn("expected", expected)
            .where(F.col("actual") != F.col("expected")).select("path", "actual", "expected"))


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `keys` on one side only, with the side that has them. One shuffle for both directions."""
    sides = (left.select(*keys, F.lit(1).alias("l"), F.lit(0).alias("r"))
             .unionByName(right.select(*keys, F.lit(0).alias("l"), F.lit(1).alias("r"))))
    return (sides.groupBy(*keys).agg(F.max("l").alias("l"), F.max("r").alias("r"))
            .where(F.col("l") != F.col("r"))
            .select(*keys, F.when(F.col("l") == 1, "left").otherwise("right").alias("only_in")))


def history_kept(before: DataFrame, after: DataFrame, key: str, item: str) -> DataFrame:
    """Per key: items lost and items new. The history is kept if none is lost and one is new."""
    diff = set_difference(before, after, [key, item])
    keys = before.select(key).union(after.select(key)).distinct()
    counts = diff.groupBy(key).agg(F.count_if(F.col("only_in") == "left").alias("lost"),
                                   F.count_if(F.col("only_in") == "right").alias("added"))
    zero = F.lit(0).cast("bigint")
    return (keys.join(counts, key, "left")
            .select(key, F.coalesce("lost", zero).alias("lost"), F.coalesce("added", zero).alias("added"))
            .withColumn("kept", (F.col("lost") == 0) & (F.col("added") > 0)))
