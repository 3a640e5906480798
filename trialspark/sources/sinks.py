"""Writers: run summaries, the keyed store of runs and trials, and trees of single files."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import filesystem

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def run_summaries(per_task: DataFrame, runs: DataFrame) -> DataFrame:
    """{run, model, limits, tasks: {task: {...}}} from task_summary(by run and task).

    A map holds one entry per task of the catalogue.
    """
    value = F.struct("trials", "passed", "tampered", "resource_limited", "avg_steps", "avg_seconds")
    tasks = (per_task.groupBy("run_id")
             .agg(F.map_from_entries(F.collect_list(F.struct(F.col("task"), value))).alias("tasks")))
    return runs.join(tasks, "run_id")


def write_run_summaries(summaries: DataFrame, path: str) -> None:
    summaries.write.mode("overwrite").json(path)


def write_store(runs: DataFrame, trials: DataFrame, path: str) -> None:
    """Both tables as Parquet, clustered by run so that reading one run prunes row groups.

    The range includes the trial id: a hot run spreads over several files.
    """
    runs.write.mode("overwrite").parquet(f"{path}/runs")
    (trials.repartitionByRange("run_id", "trial_id").sortWithinPartitions("run_id", "trial_id")
     .write.mode("overwrite").parquet(f"{path}/trials"))


def read_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/runs"), spark.read.parquet(f"{path}/trials")


def write_files(files: DataFrame, root: str) -> None:
    """A file for each (relpath, content) below `root`, written by executors. A task that runs again writes the same files again."""
    def write(batches):
        system, base = filesystem(root)
        made: set[str] = set()
        for batch in batches:
            for relpath, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folder = f"{base}/{relpath}".rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{relpath}") as out:
                    out.write(content or b"")
            yield from ()

    (files.select("relpath", F.col("content").cast("binary").alias("content")).mapInArrow(write, "relpath string")
     .write.format("noop").mode("overwrite").save())
